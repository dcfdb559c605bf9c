"""Session defaults and the one place where lineage may be cut."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# a join on ticker and day keeps a panel that is partitioned by ticker where it is
BY_TICKER = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


def build_session(master: str = "local[*]", app: str = "barloom", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC wall clock and adaptive execution."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(*BY_TICKER)
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder the cluster names in spark.checkpoint.dir.

    A folder of this machine is made up only for a local master, and goes when the program ends; on several machines
    each would write to its own disk, so there the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and continue from the files.

    A lost executor then costs a file read instead of the whole plan; later plans stay small, read only
    the columns they need and know the real size of the table.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

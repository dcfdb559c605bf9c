"""Append-only logs: fills, guard results and equity records as JSON lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import cut_lineage

FILL_LOG = ("ts STRING, broker STRING, as_of DATE, ticker STRING, side STRING, quantity DOUBLE, status STRING, "
            "filled_quantity DOUBLE, filled_price DOUBLE, order_id STRING, message STRING, modelled_price DOUBLE, exposure_scale DOUBLE")
GUARD_LOG = "ts STRING, broker STRING, as_of DATE, passed BOOLEAN"
EQUITY_LOG = "ts STRING, as_of DATE, equity DOUBLE"


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines are skipped, a missing folder is an empty log."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_checked_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a JSON-lines log: the well-formed lines, and the malformed ones as text with their file.

    The lines are parsed once and stored, so that both tables come from one reading of files that may still grow.
    """
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file STRING, line STRING")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    stored = cut_lineage(lines.select("file", "value", parsed.alias("row")))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return stored.filter(~bad).select("row.*").drop("_bad"), stored.filter(bad).select("file", F.col("value").alias("line"))


def log_health(rows: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: well-formed lines, malformed lines, and the number of files that hold any."""
    return rows.agg(F.count("*").alias("n_good")).withColumns({
        "n_bad": quarantine.agg(F.count("*")).scalar(), "n_bad_files": quarantine.agg(F.count_distinct("file")).scalar()})


def equity_history(local: DataFrame, broker: DataFrame, today: DataFrame) -> DataFrame:
    """One equity per account and day: the local log (its last line of a day wins), the broker's record
    where the log has a gap, and today's equity over both."""
    last_line = local.groupBy("account", "as_of").agg(F.max_by("equity", "seq").alias("local_equity"))
    seen = broker.groupBy("account", "as_of").agg(F.max("equity").alias("broker_equity"))
    now = today.select("account", "as_of", F.col("equity").alias("today_equity"))
    keys = ["account", "as_of"]
    return last_line.join(seen, keys, "full").join(now, keys, "full").select(
        *keys, F.coalesce("today_equity", "local_equity", "broker_equity").alias("equity"))

"""Result sinks: columnar tables for jobs, CSV and JSON for people, append-only logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log folder."""
    df.write.mode("append").json(path)


def save_backtest(path: str, equity: DataFrame, positions: DataFrame, weights: DataFrame, trades: DataFrame,
                  metrics: DataFrame, benchmark: DataFrame | None = None) -> None:
    """The files of a backtest: equity, positions, weights, trades and benchmark as CSV, metrics as JSON."""
    for name, df in (("equity", equity), ("positions", positions), ("weights", weights), ("trades", trades)):
        write_csv(df, f"{path}/{name}.csv")
    if benchmark is not None:
        write_csv(benchmark, f"{path}/benchmark.csv")
    write_json(metrics, f"{path}/metrics.json")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions below `root`: those whose job has left its mark of success."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    named = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[2:]) for n in named if n[:2] == "v-" and n[2:].isdigit() and files.exists(context._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> int:
    """Store `df` as the next whole version of the table below `root` and return its number.

    A version counts once its job has ended, so readers see the one before until then, a killed job changes nothing, and
    the new version may be computed from the old one. A half-written folder of the same number is replaced.
    """
    number = max(_versions(df.sparkSession, root), default=-1) + 1
    write_table(df, f"{root}/v-{number}", partition_by=partition_by)
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest finished version of the table, or the one asked for."""
    have = _versions(spark, root)
    if not have or (number is not None and number not in have):
        raise FileNotFoundError(f"{root} holds no finished version{'' if number is None else f' {number}'}")
    return spark.read.parquet(f"{root}/v-{have[-1] if number is None else number}")


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest `keep` finished versions; returns the numbers deleted."""
    context = spark.sparkContext
    gone = _versions(spark, root)[:-keep] if keep > 0 else []
    for n in gone:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{root}/v-{n}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return gone

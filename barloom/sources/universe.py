"""Universes, sector maps and membership files."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import normal_symbol

# The broad index, bond, commodity and sector funds of the "etfs" universe.
ETFS = ["SPY", "QQQ", "IWM", "DIA", "VTI", "EFA", "EEM", "TLT", "IEF", "LQD", "HYG", "GLD", "SLV", "USO",
        "XLK", "XLF", "XLE", "XLV", "XLY", "XLP", "XLI", "XLU", "XLB", "XLRE", "XLC"]

# The large caps of the "megacaps" universe.
MEGA_CAPS = ["AAPL", "MSFT", "AMZN", "GOOGL", "META", "NVDA", "BRK-B", "JPM", "V", "UNH",
             "XOM", "JNJ", "PG", "MA", "HD", "COST", "ABBV", "WMT", "KO", "PEP"]


def ticker_table(spark: SparkSession, tickers: Sequence[str]) -> DataFrame:
    """A short literal list as a table of normalised symbols."""
    return spark.createDataFrame([(t,) for t in tickers], "ticker string").select(normal_symbol("ticker").alias("ticker")).distinct()


def read_universe_file(spark: SparkSession, path: str) -> DataFrame:
    """One ticker per line or whitespace-separated, or a CSV whose first column is headed Symbol."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = F.split("value", ",")[0]
    headed = F.lower(F.trim(first)) == "symbol"
    token = F.explode(F.split(F.trim(F.when(F.instr("value", ",") > 0, first).otherwise(F.col("value"))), r"\s+"))
    return lines.filter(~headed).select(token.alias("ticker")).select(normal_symbol("ticker").alias("ticker")).distinct()


def resolve_universe(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct tickers of several universe tables, for use as the right side of a semi join."""
    out = None
    for part in parts:
        named = part.select(normal_symbol("ticker").alias("ticker"))
        out = named if out is None else out.unionByName(named)
    return out.distinct()


def sector_map(layers: Sequence[DataFrame]) -> DataFrame:
    """One sector per ticker; a later layer overrides an earlier one (funds, constituents, extras)."""
    tagged = None
    for rank, layer in enumerate(layers):
        part = layer.select(normal_symbol("ticker").alias("ticker"), "sector", F.lit(rank).alias("_layer"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("ticker").agg(F.max_by("sector", "_layer").alias("sector"))


def etf_sectors(spark: SparkSession) -> DataFrame:
    return ticker_table(spark, ETFS).withColumn("sector", F.lit("ETF"))


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """A constituents CSV (Symbol, ..., GICS Sector) as (ticker, sector)."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(normal_symbol("Symbol").alias("ticker"), F.col("GICS Sector").alias("sector"))


def membership_long(raw: DataFrame, tickers_col: str = "tickers") -> DataFrame:
    """Snapshots with a comma list (or array) of tickers -> one row per (snapshot date, ticker)."""
    column = F.col(tickers_col)
    items = F.split(column, ",") if raw.schema[tickers_col].dataType.typeName() == "string" else column
    clean = F.array_distinct(F.transform(F.filter(items, lambda t: F.trim(t) != ""), normal_symbol))
    return raw.select(F.to_date("date").alias("date"), F.explode(F.array_sort(clean)).alias("ticker"))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return membership_long(spark.read.option("header", True).csv(path))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row per key under `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")

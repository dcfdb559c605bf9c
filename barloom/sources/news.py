"""News articles: normalisation, month-partitioned table, coverage and refresh decisions.

Timestamps are zone-free UTC wall clock (TIMESTAMP_NTZ), so results do not depend on a session zone.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import normal_symbol, utc_wall_clock
from barloom.session import cut_lineage

TEXT_FIELDS = ["headline", "summary", "source", "url"]
NEWS_FIELDS = ["id", "created_at", "updated_at", *TEXT_FIELDS, "symbols"]


def normalize_news(raw: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """Coerce to the article layout with one row per id, the latest update winning.

    Missing columns become null, `updated_at` defaults to `created_at`, symbols are normalised and
    rows without a creation time are dropped. The top row per id is found by a limited window, which
    keeps one candidate per id in every task before the shuffle.
    """
    df = raw
    for c in NEWS_FIELDS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("array<string>" if c == "symbols" else "string"))
    seq = F.col(seq_col) if seq_col in df.columns else F.lit(0)
    typed = df.select(
        F.col("id").cast("long").alias("id"),
        utc_wall_clock("created_at").alias("created_at"),
        F.coalesce(utc_wall_clock("updated_at"), utc_wall_clock("created_at")).alias("updated_at"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TEXT_FIELDS],
        F.coalesce(F.transform("symbols", normal_symbol), F.array().cast("array<string>")).alias("symbols"),
        seq.alias("_seq"),
    ).filter(F.col("created_at").isNotNull())
    newest = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("_seq"))
    return typed.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).select(*NEWS_FIELDS)


def with_month(news: DataFrame) -> DataFrame:
    return news.withColumn("month", F.date_format("created_at", "yyyy-MM"))


def month_rows(news: DataFrame, month: str) -> DataFrame:
    """Only articles created inside the month; an old story re-edited in it is not this month's news."""
    return with_month(news).filter(F.col("month") == month)


def write_news(news: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store one folder per UTC month. Rows spread over several tasks inside a busy month."""
    with_month(news).repartition("month", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("month").parquet(path)


def upsert_news(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Merge a fetch into the table, rewriting only the months it touches; the fetched row wins a tie.

    A story keeps the month it was created in: a fetched row that the table holds under an earlier or later month, as
    happens when an old story is edited, updates nothing there.
    """
    known = spark.read.parquet(path).select("id", F.col("month").alias("_known"))
    fresh = with_month(normalize_news(fresh)).join(known, "id", "left").filter(F.col("_known").isNull() | (F.col("_known") == F.col("month"))).drop("_known", "month")
    fresh = cut_lineage(fresh)
    months = with_month(fresh).select("month").distinct()
    old = spark.read.parquet(path).join(months, "month", "left_semi").withColumn("ingest_seq", F.lit(0))
    new = fresh.withColumn("ingest_seq", F.lit(1))
    write_news(normalize_news(old.select(*NEWS_FIELDS, "ingest_seq").unionByName(new.select(*NEWS_FIELDS, "ingest_seq"))), path)


def news_between(news: DataFrame, start: str | None = None, end: str | None = None,
                 symbols: Sequence[str] | None = None) -> DataFrame:
    """Articles created in [start, end] that carry any of `symbols`.

    On the stored table the month bounds prune partitions before the exact time filter runs.
    """
    out = news if "month" in news.columns else with_month(news)
    if start is not None:
        out = out.filter((F.col("month") >= start[:7]) & (F.col("created_at") >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        out = out.filter((F.col("month") <= end[:7]) & (F.col("created_at") <= F.lit(end).cast("timestamp_ntz")))
    if symbols is not None:
        want = F.array(*[F.lit(s.upper()) for s in symbols])
        out = out.filter(F.arrays_overlap("symbols", want))
    return out


def news_coverage(news: DataFrame) -> DataFrame:
    """Articles and latest creation time per month."""
    return with_month(news).groupBy("month").agg(
        F.count("*").alias("articles"), F.max("created_at").alias("last_created"))


def month_starts(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Explode every month between two dates (SQL expressions over `rows`) into `month_start`."""
    first = F.trunc(F.expr(start), "month")
    return rows.withColumn("month_start", F.explode(F.sequence(first, F.trunc(F.expr(end), "month"), F.expr("interval 1 month"))))


def news_refresh_plan(coverage: DataFrame, start: str, now: str, end: str | None = None,
                      settle_hours: float = 24.0) -> DataFrame:
    """Which months to fetch, and from when.

    A stored month that ended more than `settle_hours` before `now` is settled and skipped. Any other
    month resumes a day before its latest stored article.
    """
    spark = coverage.sparkSession
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    stop = F.least(stamp(end), stamp(now)) if end is not None else stamp(now)
    frame = spark.range(1).select(F.trunc(stamp(start), "month").alias("first"), stop.alias("stop"))
    months = month_starts(frame, "first", "stop").select(
        F.date_format("month_start", "yyyy-MM").alias("month"),
        F.col("month_start").cast("timestamp_ntz").alias("opens"),
        F.least((F.add_months("month_start", 1).cast("timestamp_ntz") - F.expr("interval 1 second")), F.col("stop")).alias("fetch_to"),
    )
    joined = months.join(coverage, "month", "left")
    settled = F.col("fetch_to") < stamp(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(settle_hours * 3600.0))
    skip = F.col("articles").isNotNull() & settled
    resume = F.greatest(F.col("opens"), stamp(start), F.col("last_created") - F.expr("interval 1 day"))
    return joined.select(
        "month", F.when(skip, F.lit("skip")).otherwise(F.lit("fetch")).alias("action"),
        F.when(~skip, resume).alias("fetch_from"), F.when(~skip, F.col("fetch_to")).alias("fetch_to"),
        F.coalesce("articles", F.lit(0).cast("long")).alias("articles"),
    )

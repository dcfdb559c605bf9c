"""Scored articles and the daily features built from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import per_day
from barloom.functions.text import with_scores
from barloom.operators.panel import with_features
from barloom.operators.schedule import news_session
from barloom.session import cut_lineage
from barloom.sources.lexicon import Lexicon

NEWS_FEATURES = ["news_tone_sum", "news_neg_sum", "news_count"]
SESSION_LAG = 14   # days; no run of holidays is longer


def article_text():
    """What is scored: headline and summary as two sentences."""
    return F.concat(F.coalesce("headline", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))


def score_articles(news: DataFrame, lexicon: Lexicon, exchange_days: DataFrame | None = None) -> DataFrame:
    """One row per article: session, symbols, tone, negativity and counts."""
    slim = news.select("id", "created_at", "symbols", article_text().alias("_text"))
    scored = with_scores(slim, F.col("_text"), lexicon).drop("_text")
    return news_session(scored, exchange_days).select(
        "id", "created_at", "session", "symbols", "tone", "negativity", "positive", "negative", "uncertainty", "n_tokens")


def sentiment_by_ticker(scored: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Sums per (session, ticker), of the universe if one is given. Partial sums keep a much-tagged ticker cheap."""
    tagged = scored.select("session", F.explode("symbols").alias("ticker"), "tone", "negativity")
    mine = tagged if universe is None else tagged.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    return mine.groupBy(F.col("session").alias("date"), "ticker").agg(
        F.sum("tone").alias("news_tone_sum"), F.sum("negativity").alias("news_neg_sum"),
        F.count("*").cast("double").alias("news_count"))


def daily_sentiment(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """Attach the news features to the grid; cells without news hold 0, sessions off the grid vanish."""
    return with_features(grid, sentiment_by_ticker(scored), NEWS_FEATURES, 0.0)   # the join drops unknown names


def news_feature_info(scored: DataFrame, featured: DataFrame) -> DataFrame:
    """One row: articles, tags, the covered sessions and the share of ticker-days with news among them."""
    span = scored.agg(
        F.count("*").alias("articles"), F.sum(F.size("symbols")).cast("long").alias("articles_tagged"),
        F.greatest(F.trunc(F.min("created_at"), "month"), F.min("session")).alias("first"),
        F.least(F.last_day(F.max("created_at")), F.max("session")).alias("last"))
    days = featured.groupBy("date").agg(F.count("*").alias("cells"), F.count_if(F.col("news_count") > 0).alias("hits"))
    covered = days.filter(F.col("date").between(span.select("first").scalar(), span.select("last").scalar()))
    share = covered.agg(F.coalesce(F.try_divide(F.sum("hits").cast("double"), F.sum("cells").cast("double")), F.lit(0.0))).scalar()
    return span.select("articles", "articles_tagged", share.alias("ticker_days_with_news"), "first", "last")


def unscored_months(raw: DataFrame, scored: DataFrame) -> DataFrame:
    """Months whose raw articles are newer than their scores, or that were never scored."""
    fresh = raw.groupBy("month").agg(F.max("ingest_ts").alias("raw_ts"))
    done = scored.groupBy("month").agg(F.max("scored_ts").alias("scored_ts"))
    return fresh.join(done, "month", "left").filter(
        F.col("scored_ts").isNull() | (F.col("scored_ts") < F.col("raw_ts"))).select("month", "raw_ts", "scored_ts")


def rescore(news: DataFrame, months: DataFrame, lexicon: Lexicon, path: str) -> None:
    """Score the listed months and replace just their partitions of the score table."""
    todo = news.join(months.select("month"), "month", "left_semi")
    scored = score_articles(todo, lexicon)
    scored.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def refresh_scores(spark: SparkSession, news: DataFrame, months: DataFrame, lexicon: Lexicon, path: str) -> DataFrame:
    """`rescore`, and the sessions (one column) whose articles are other ones or score differently than before.

    Only the listed months of the score table are read; their number is that of a history's months.
    """
    listed = [r["month"] for r in months.select("month").distinct().collect()]

    def stored() -> DataFrame:
        table = spark.read.parquet(path).filter(F.col("month").isin(listed))
        return cut_lineage(table.select("id", "session", F.xxhash64("session", F.array_sort("symbols"), "tone", "negativity").alias("mark")))

    before = stored().select(F.col("id").alias("old_id"), F.col("session").alias("old_session"), F.col("mark").alias("old_mark"))
    rescore(news, months, lexicon, path)
    both = stored().join(before, F.col("id") == F.col("old_id"), "full").filter(~F.col("mark").eqNullSafe(F.col("old_mark")))
    return both.select(F.explode(F.array("session", "old_session")).alias("session")).filter("session IS NOT NULL").distinct()


def refresh_features(features: DataFrame, scored: DataFrame, sessions: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """`sentiment_by_ticker` after a refresh of the scores: the changed sessions are summed anew, the others stay as they are.

    An article belongs to a session at most `SESSION_LAG` days after it was made, so of a score table stored by month only the
    months that reach into the changed sessions are read. The sums equal those of a full rebuild to the last bit that
    their order of addition allows.
    """
    spans = sessions.select(F.explode(F.array("session", F.date_sub("session", SESSION_LAG))).alias("day"))
    listed = [r["month"] for r in spans.select(F.date_format("day", "yyyy-MM").alias("month")).distinct().collect()]
    near = scored.filter(F.col("month").isin(listed)) if "month" in scored.columns else scored
    fresh = sentiment_by_ticker(near.join(per_day(sessions), "session", "left_semi"), universe)
    kept = features.join(per_day(sessions.withColumnRenamed("session", "date")), "date", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)

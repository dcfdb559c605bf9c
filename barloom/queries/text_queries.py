"""Tokens, word-list scores and daily news features."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions import text as T
from barloom.operators import sentiment as X
from barloom.queries.fixtures import CTES, Market, r6, r6c, sql
from barloom.session import cut_lineage, shared_folder
from barloom.sources import news as N
from barloom.sources.lexicon import NEGATORS, Lexicon

# Frequent words of the invented corpus, so that every branch of the scoring fires.
WORDS = {"positive": ["AND", "WITH", "THIS", "FROM"], "negative": ["WAS", "ARE", "THAN"], "uncertainty": ["THAT"]}
LEXICON = Lexicon(positive=frozenset(WORDS["positive"]), negative=frozenset(WORDS["negative"]),
                  uncertainty=frozenset(WORDS["uncertainty"]), negators=NEGATORS | {"OF"})


def word_table(spark):
    return spark.createDataFrame([(c, w) for c, ws in WORDS.items() for w in ws], "category string, word string")


def scored_news(m: Market):
    return X.score_articles(N.normalize_news(m.raw_news), LEXICON)


def featured_grid(m: Market):
    return X.daily_sentiment(scored_news(m), m.grid)


def tokenize(spark, folder):
    docs = Market(spark, folder).documents()
    return docs.select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def lexicon_score(spark, folder):
    docs = T.with_scores(Market(spark, folder).documents().select("doc_id", "text"), F.col("text"), LEXICON)
    return docs.select("doc_id", "positive", "negative", "uncertainty", "n_tokens")


def lexicon_score_table(spark, folder):
    docs = Market(spark, folder).documents()
    return T.score_with_table(docs, "doc_id", F.col("text"), word_table(spark), LEXICON.negators)


def tone(spark, folder):
    docs = T.with_scores(Market(spark, folder).documents().select("doc_id", "text"), F.col("text"), LEXICON)
    return docs.select("doc_id", r6c("tone").alias("tone"), r6c("negativity").alias("negativity"))


def score_articles(spark, folder):
    return scored_news(Market(spark, folder)).select(
        "id", "created_at", "session", F.size("symbols").cast("long").alias("n_symbols"), r6c("tone").alias("tone"),
        r6c("negativity").alias("negativity"), "positive", "negative", "n_tokens")


def daily_sentiment(spark, folder):
    return featured_grid(Market(spark, folder)).select("ticker", "date", *[r6c(c).alias(c) for c in X.NEWS_FEATURES])


def news_feature_info(spark, folder):
    m = Market(spark, folder)
    scored = scored_news(m)
    return X.news_feature_info(scored, X.daily_sentiment(scored, m.grid)).withColumn(
        "ticker_days_with_news", r6c("ticker_days_with_news"))


def unscored_months(spark, folder):
    news = N.with_month(N.normalize_news(Market(spark, folder).raw_news))
    raw = news.select("month", F.col("updated_at").alias("ingest_ts"))
    scored = news.filter((F.col("id") % 3 != 0) & (F.month("created_at") != 7)).select("month", F.col("updated_at").alias("scored_ts"))
    return X.unscored_months(raw, scored)


def refreshed_features(spark, folder):
    """Stories of one year lose their summary: their months are scored again and the changed sessions' features renewed."""
    m = Market(spark, folder)
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    news = cut_lineage(N.with_month(N.normalize_news(m.raw_news)))
    X.rescore(news, news.select("month").distinct(), LEXICON, path)
    features = cut_lineage(X.sentiment_by_ticker(spark.read.parquet(path)))
    touched = (F.col("id") % 3 == 0) & (F.year("created_at") == 1997)
    edited = news.withColumn("summary", F.when(touched, "").otherwise(F.col("summary")))
    sessions = X.refresh_scores(spark, edited, news.filter(touched).select("month"), LEXICON, path)
    out = X.refresh_features(features, spark.read.parquet(path), sessions)
    return out.select("date", "ticker", *[r6c(c).alias(c) for c in X.NEWS_FEATURES])


QUERIES = {f.__name__: f for f in (
    refreshed_features, tokenize, lexicon_score, lexicon_score_table, tone, score_articles, daily_sentiment, news_feature_info, unscored_months)}


def _listed(words):
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _counts(key, text, source):
    """Token table, then counts, as two SQL steps."""
    tokens = f"""
        SELECT {key}, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (
          SELECT {key}, list_transform(list_filter(regexp_extract_all({text}, '[A-Za-z][A-Za-z''\\-]*'), lambda t: len(t) > 1),
                                       lambda t: trim(upper(t), '''-')) AS toks FROM {source}) s"""
    counts = f"""
        SELECT {key}, count(*) FILTER (good AND NOT neg) AS positive, count(*) FILTER ((good AND neg) OR (NOT good AND bad)) AS negative,
               count(*) FILTER (unc) AS uncertainty, count(*) AS n_tokens FROM (
          SELECT {key}, tok IN {_listed(WORDS['positive'])} AS good, tok IN {_listed(WORDS['negative'])} AS bad, tok IN {_listed(WORDS['uncertainty'])} AS unc,
                 coalesce(bool_or(tok IN {_listed(LEXICON.negators)}) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS neg
          FROM __T__) f GROUP BY {key}"""
    return tokens, counts


_DOC_TOKENS, _DOC_COUNTS = _counts("doc_id", "text", "documents")
_NEWS_TOKENS, _NEWS_COUNTS = _counts("id", "headline || '. ' || summary", "news")
CTES["doc_tokens"] = ([], _DOC_TOKENS)
CTES["doc_counts"] = (["doc_tokens"], _DOC_COUNTS.replace("__T__", "doc_tokens"))
CTES["doc_scores"] = (["doc_counts"], """
    SELECT doc_id, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(uncertainty, 0) AS uncertainty, coalesce(n_tokens, 0) AS n_tokens
    FROM documents LEFT JOIN doc_counts USING (doc_id)""")
CTES["news_tokens"] = (["news"], _NEWS_TOKENS)
CTES["news_counts"] = (["news_tokens"], _NEWS_COUNTS.replace("__T__", "news_tokens"))
CTES["scored"] = (["news_counts", "news_days"], """
    SELECT id, created_at, session, symbols, positive, negative, n_tokens,
           CASE WHEN positive + negative > 0 THEN (positive - negative)::DOUBLE / (positive + negative) ELSE 0.0::DOUBLE END AS tone,
           CASE WHEN n_tokens > 0 THEN negative::DOUBLE / n_tokens ELSE 0.0::DOUBLE END AS negativity
    FROM (SELECT n.id, created_at, session, symbols, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(n_tokens, 0) AS n_tokens
          FROM news_days n LEFT JOIN news_counts c ON c.id = n.id) s""")
CTES["news_features"] = (["scored", "grid"], """
    SELECT g.*, coalesce(f.tone, 0.0::DOUBLE) AS news_tone_sum, coalesce(f.neg, 0.0::DOUBLE) AS news_neg_sum, coalesce(f.n, 0.0::DOUBLE) AS news_count
    FROM grid g LEFT JOIN (SELECT session, t, sum(tone) AS tone, sum(negativity) AS neg, count(*)::DOUBLE AS n
                           FROM (SELECT session, unnest(symbols) AS t, tone, negativity FROM scored) x GROUP BY ALL) f
    ON f.t = g.ticker AND f.session = g.date""")

_RATIOS = f"""
    doc_id, {r6('CASE WHEN positive + negative > 0 THEN (positive - negative)::DOUBLE / (positive + negative) ELSE 0.0::DOUBLE END')} AS tone,
    {r6('CASE WHEN n_tokens > 0 THEN negative::DOUBLE / n_tokens ELSE 0.0::DOUBLE END')} AS negativity"""

_EDITED_TOKENS, _ = _counts("id", "headline || '. ' || CASE WHEN id % 3 = 0 AND year(created_at) = 1997 THEN '' ELSE summary END", "news")

ORACLES = {
    "refreshed_features": sql(f"""
        SELECT session AS date, ticker, {r6('sum(tone)')} AS news_tone_sum, {r6('sum(negativity)')} AS news_neg_sum, count(*)::DOUBLE AS news_count
        FROM (SELECT session, unnest(symbols) AS ticker, tone, negativity FROM scored) x GROUP BY ALL""", "scored", news_tokens=_EDITED_TOKENS),
    "tokenize": sql("SELECT tok AS token, count(*) AS n FROM doc_tokens GROUP BY tok", "doc_tokens"),
    "lexicon_score": sql("SELECT * FROM doc_scores", "doc_scores"),
    "lexicon_score_table": sql("SELECT * FROM doc_scores", "doc_scores"),
    "tone": sql(f"SELECT {_RATIOS} FROM doc_scores", "doc_scores"),
    "score_articles": sql(f"""
        SELECT id, created_at, session, len(symbols) AS n_symbols, {r6('tone')} AS tone, {r6('negativity')} AS negativity, positive, negative, n_tokens
        FROM scored""", "scored"),
    "daily_sentiment": sql(f"""
        SELECT ticker, date, {r6('news_tone_sum')} AS news_tone_sum, {r6('news_neg_sum')} AS news_neg_sum, news_count FROM news_features""", "news_features"),
    "news_feature_info": sql(f"""
        SELECT articles, articles_tagged, first, last, (SELECT {r6('avg(CASE WHEN news_count > 0 THEN 1.0::DOUBLE ELSE 0 END)')} FROM news_features
                 WHERE date BETWEEN i.first AND i.last) AS ticker_days_with_news
        FROM (SELECT count(*) AS articles, CAST(sum(len(symbols)) AS BIGINT) AS articles_tagged,
                     greatest(CAST(date_trunc('month', min(created_at)) AS DATE), min(session)) AS first,
                     least(last_day(max(created_at)), max(session)) AS last FROM scored) i""", "news_features"),
    "unscored_months": sql("""
        SELECT * FROM (SELECT strftime(created_at, '%Y-%m') AS month, max(created_at) AS raw_ts,
                              max(created_at) FILTER (id % 3 <> 0 AND month(created_at) <> 7) AS scored_ts FROM news GROUP BY 1) m
        WHERE scored_ts IS NULL OR scored_ts < raw_ts""", "news"),
}

"""Scans, normalisation, upserts, refresh decisions, universes and logs."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.queries.fixtures import CTES, MARKET, Market, r6, r6c, sql
from barloom.sources import bars as B
from barloom.sources import lexicon as L
from barloom.session import shared_folder
from barloom.sources import logs, news as N, sinks
from barloom.sources import universe as U

NOW, CUT = "2001-08-20 12:00:00", "2000-12-31"


def _messy_bars(m: Market):
    day = Window.partitionBy("l_suppkey", "l_shipdate").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return m.table("lineitem").join(m.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lower("s_name").alias("Ticker"), F.col("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("Open"),
        (F.col("l_extendedprice") * 2).alias("High"), F.lit(1).alias("Low"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("Adj Close"),
        F.col("l_quantity").cast("string").alias("Volume"), F.row_number().over(day).alias("ingest_seq"))


def normalize_bars(spark, folder):
    return B.normalize_bars(_messy_bars(Market(spark, folder)))


def bar_coverage(spark, folder):
    return B.bar_coverage(Market(spark, folder).bars)


def merge_bars(spark, folder):
    m = Market(spark, folder)
    cached = m.bars.filter(F.col("date") <= F.lit(CUT).cast("date"))
    fresh = m.bars.filter(F.col("date") > F.date_sub(F.lit(CUT).cast("date"), 30)).withColumn("close", F.col("close") * 2)
    return B.merge_bars(cached, fresh).groupBy("ticker", F.year("date").alias("year")).agg(
        F.count("*").alias("n_bars"), F.max("close").alias("top_close"), F.min("close").alias("low_close"))


def _known_bars(m):
    return m.bars.join(m.sectors, "ticker", "left_semi")


def refresh_plan(spark, folder):
    m = Market(spark, folder)
    universe = m.table("supplier").select(F.col("s_name").alias("ticker"))
    return B.refresh_plan(universe, B.bar_coverage(_known_bars(m)), "1990-01-01")


def refresh_batches(spark, folder):
    m = Market(spark, folder)
    universe = m.table("supplier").select(F.col("s_name").alias("ticker"))
    return B.refresh_batches(B.refresh_plan(universe, B.bar_coverage(_known_bars(m)), "1990-01-01"))


def _adjusted(m):
    bump = F.when((F.col("volume") % 17 == 0) & (F.dayofmonth("date") == 13), 1.05).otherwise(1.0)
    return m.bars.filter(F.col("date") >= F.lit("2001-03-01").cast("date")).withColumn("close", F.col("close") * bump)


def history_disagreement(spark, folder):
    m = Market(spark, folder)
    return B.history_disagreement(m.bars, _adjusted(m)).select(
        "ticker", "settled_days", r6c("worst_gap").alias("worst_gap"), "disagrees")


def refresh_split(spark, folder):
    m = Market(spark, folder)
    fresh = _adjusted(m)
    merge, replace = B.split_refresh(fresh, B.history_disagreement(m.bars, fresh))
    both = merge.withColumn("mode", F.lit("merge")).unionByName(replace.withColumn("mode", F.lit("replace")))
    return both.groupBy("mode").agg(F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"))


def import_long(spark, folder):
    m = Market(spark, folder)
    table = _messy_bars(m).withColumn("Name", F.replace("Ticker", F.lit("#"), F.lit("."))).drop("Ticker")
    return B.import_long(table, "Name", "Date", {"Adj Close": "Close"}).groupBy("ticker").agg(F.count("*").alias("n_bars"))


def source_fallback(spark, folder):
    m = Market(spark, folder)
    pick = lambda *names: m.bars.join(m.sectors.filter(F.col("sector").isin(*names)), "ticker", "left_semi")
    first = pick("ASIA").filter(F.year("date") >= 1999)
    return B.source_fallback([first, pick("ASIA", "EUROPE"), m.bars]).groupBy("ticker", "priority").agg(
        F.count("*").alias("n_bars"), F.min("date").alias("first_date"))


def _edited_news(m):
    raw = m.raw_news.withColumn("ingest_seq", F.lit(0)).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    edits = m.raw_news.filter(F.col("id") % 3 == 0).withColumn("ingest_seq", F.lit(1)).withColumn(
        "updated_at", F.col("created_at") + F.expr("interval 2 days")).withColumn("headline", F.concat(F.lit("EDIT "), "headline"))
    stale = m.raw_news.filter(F.col("id") % 5 == 0).withColumn("ingest_seq", F.lit(2)).withColumn(
        "updated_at", F.col("created_at") - F.expr("interval 1 days")).withColumn("headline", F.lit(None).cast("string"))
    return raw.unionByName(edits).unionByName(stale)


def normalize_news(spark, folder):
    return N.normalize_news(_edited_news(Market(spark, folder))).select(
        "id", "created_at", "updated_at", "headline", "source", "url", F.size("symbols").cast("long").alias("n_symbols"),
        F.array_join("symbols", "|").alias("symbols"))


def news_by_symbol(spark, folder):
    m = Market(spark, folder)
    return N.news_between(N.normalize_news(m.raw_news), "1996-01-15", "1999-06-30 12:00:00", [MARKET, "supplier#000000005"]).select("id", "created_at")


def news_coverage(spark, folder):
    return N.news_coverage(N.normalize_news(Market(spark, folder).raw_news))


def news_refresh_plan(spark, folder):
    m = Market(spark, folder)
    stored = N.normalize_news(m.raw_news).filter(F.month("created_at") != 5)
    return N.news_refresh_plan(N.news_coverage(stored), "1994-11-15", NOW)


def membership_long(spark, folder):
    m = Market(spark, folder)
    listed = m.membership.groupBy("date").agg(F.array_join(F.array_sort(F.collect_list(F.lower("ticker"))), ",").alias("tickers"))
    return U.membership_long(listed.withColumn("tickers", F.concat("tickers", F.lit(", brk.b,,brk.b"))))


def sector_map(spark, folder):
    m = Market(spark, folder)
    base = m.table("supplier").select(F.col("s_name").alias("ticker"), F.lit("ETF").alias("sector"))
    extra = m.table("supplier").filter(F.col("s_acctbal") < 0).select(F.col("s_name").alias("ticker"), F.lit("Distressed").alias("sector"))
    return U.sector_map([base, m.sectors, extra])


def universe_semi(spark, folder):
    m = Market(spark, folder)
    rich = m.table("supplier").filter(F.col("s_acctbal") > 5000).select(F.lower("s_name").alias("ticker"))
    universe = U.resolve_universe([rich, m.membership.filter(F.year("date") == 1998), U.ticker_table(spark, U.ETFS)])
    return m.bars.join(universe, "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n_bars"))


def lexicon_long(spark, folder):
    """Words of every document with invented list years: the parity of their frequency decides the category."""
    words = Market(spark, folder).table("documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("Word")).groupBy("Word").agg(F.count("*").alias("n"))
    raw = words.select(
        "Word", F.when(F.col("n") % 3 == 0, "2009").when(F.col("n") % 3 == 1, "-2018").otherwise("0").alias("Negative"),
        F.when(F.col("n") % 4 == 0, "2011").otherwise("x").alias("Positive"), F.when(F.col("n") % 5 == 0, "2009").alias("Uncertainty"))
    return L.lexicon_long(raw)


def equity_history(spark, folder):
    m = Market(spark, folder)
    local = m.guard_log.join(m.table("events"), F.col("seq") == F.col("event_id")).filter(F.col("event_type") != "click").select(
        "account", "as_of", "seq", F.col("value").alias("equity"))
    broker = m.table("events").groupBy(F.col("user_id").alias("account"), F.to_date("ts").alias("as_of")).agg((F.max("value") * 10).alias("equity"))
    today = m.table("events").groupBy(F.col("user_id").alias("account")).agg(
        F.max(F.to_date("ts")).alias("as_of"), (F.min("value") + 1000.0).alias("equity"))
    return logs.equity_history(local, broker, today)


def history_replaced(spark, folder):
    """Bars stored as one version, refreshed into the next, and read back: disagreeing tickers have their fetched history only."""
    m = Market(spark, folder)
    root = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    sinks.write_version(m.bars.select("ticker", "date", *B.BAR_FIELDS), root)
    stored, fresh = sinks.read_version(spark, root), _adjusted(m)
    sinks.write_version(B.replace_history(stored, fresh, B.history_disagreement(stored, fresh)), root)
    return sinks.read_version(spark, root).groupBy("ticker").agg(
        F.count("*").alias("n_bars"), F.min("date").alias("first_date"), F.round(F.sum("close"), 2).alias("closes"))


def news_in_months(spark, folder):
    """Articles stored by month and read back for a span: other months are not opened."""
    m = Market(spark, folder)
    path = f"{shared_folder(spark)}/news-{uuid.uuid4().hex}"
    N.write_news(N.normalize_news(m.raw_news), path)
    return N.news_between(spark.read.parquet(path), "1996-01-15", "1999-06-30 12:00:00").select("id", "created_at", "month")


def log_quarantine(spark, folder):
    """Guard results written as JSON lines, some of them cut off, and read back: sound lines by day, malformed ones in all."""
    m = Market(spark, folder)
    path = f"{shared_folder(spark)}/guards-{uuid.uuid4().hex}"
    run = m.guard_log.select(F.struct(F.lit("x").alias("ts"), F.lit("paper").alias("broker"), "as_of", "passed").alias("r"), "seq")
    line = F.to_json("r")
    run.select(F.when(F.col("seq") % 17 == 0, F.substr(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    rows, bad = logs.read_checked_log(spark, path, logs.GUARD_LOG)
    days = rows.groupBy("as_of").agg(F.count("*").alias("n_lines"), F.count_if("passed").alias("n_passed"))
    return days.unionByName(logs.log_health(rows, bad).select(F.lit(None).cast("date").alias("as_of"), F.col("n_bad").alias("n_lines"), F.lit(0).cast("long").alias("n_passed")))


QUERIES = {f.__name__: f for f in (
    history_replaced, news_in_months, log_quarantine, normalize_bars, bar_coverage, merge_bars, refresh_plan, refresh_batches, history_disagreement, refresh_split, import_long,
    source_fallback, normalize_news, news_by_symbol, news_coverage, news_refresh_plan, membership_long, sector_map,
    universe_semi, lexicon_long, equity_history)}

_SEQ = """row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey,
          l_extendedprice, l_quantity, l_discount, l_tax)"""
_MESSY = f"""
    SELECT upper(s_name) AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, l_extendedprice * 2 AS high,
           1.0::DOUBLE AS low, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS close, l_quantity AS volume, {_SEQ} AS seq
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
_KNOWN = "SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM sectors)"
_ADJUSTED = """
    SELECT ticker, date, close * CASE WHEN volume % 17 = 0 AND day(date) = 13 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS close
    FROM bars WHERE date >= DATE '2001-03-01'"""
_GAPS = """
    SELECT ticker, count(*) AS settled_days, max(gap) AS worst_gap FROM (
      SELECT b.ticker, abs(f.close / b.close - 1) AS gap, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date DESC) AS age
      FROM bars b JOIN fresh f ON f.ticker = b.ticker AND f.date = b.date) g WHERE age > 2 GROUP BY ticker"""
_PLAN = """
    SELECT u.ticker, CASE WHEN last_date IS NULL THEN 'full' ELSE 'incremental' END AS mode,
           coalesce(last_date - 7, DATE '1990-01-01') AS fetch_from
    FROM (SELECT upper(s_name) AS ticker FROM supplier) u LEFT JOIN (SELECT ticker, max(date) AS last_date FROM known GROUP BY ticker) c USING (ticker)"""

CTES["news"] = (["raw_news"], """
    SELECT id, created_at, created_at AS updated_at, headline, summary, source, lang,
           coalesce(list_transform(symbols, lambda s: upper(s)), []) AS symbols FROM raw_news""")

ORACLES = {
    "normalize_bars": sql("SELECT * EXCLUDE (seq) FROM (SELECT * FROM messy QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) = 1) l WHERE close IS NOT NULL", messy=_MESSY),
    "bar_coverage": sql("SELECT ticker, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker", "bars"),
    "merge_bars": sql(f"""
        SELECT ticker, year(date) AS year, count(*) AS n_bars, max(c) AS top_close, min(c) AS low_close FROM (
          SELECT ticker, date, CASE WHEN date > DATE '{CUT}' - 30 THEN close * 2 ELSE close END AS c FROM bars) b GROUP BY ALL""", "bars"),
    "refresh_plan": sql(_PLAN, "bars", "sectors", known=_KNOWN),
    "refresh_batches": sql(f"SELECT mode, fetch_from, count(*) AS n_tickers FROM ({_PLAN}) p GROUP BY ALL", "bars", "sectors", known=_KNOWN),
    "history_disagreement": sql(f"SELECT ticker, settled_days, {r6('worst_gap')} AS worst_gap, worst_gap > 0.02 AS disagrees FROM gaps", "bars", fresh=_ADJUSTED, gaps=_GAPS),
    "history_replaced": sql("""
        SELECT ticker, count(*) AS n_bars, min(date) AS first_date, round(sum(close), 2) AS closes FROM (
          SELECT coalesce(b.ticker, f.ticker) AS ticker, coalesce(b.date, f.date) AS date, coalesce(f.close, b.close) AS close, f.close IS NOT NULL AS fetched
          FROM bars b FULL JOIN fresh f ON f.ticker = b.ticker AND f.date = b.date) m LEFT JOIN gaps USING (ticker) WHERE fetched OR coalesce(worst_gap, 0) <= 0.02 GROUP BY ticker""",
        "bars", fresh=_ADJUSTED, gaps=_GAPS),
    "news_in_months": sql("""
        SELECT id, created_at, strftime(created_at, '%Y-%m') AS month FROM news WHERE created_at BETWEEN TIMESTAMP '1996-01-15' AND TIMESTAMP '1999-06-30 12:00:00'""", "news"),
    "log_quarantine": sql("""
        SELECT as_of, count(*) AS n_lines, count(*) FILTER (passed) AS n_passed FROM guard_log WHERE seq % 17 <> 0 GROUP BY as_of
        UNION ALL SELECT NULL, count(*), 0 FROM guard_log WHERE seq % 17 = 0""", "guard_log"),
    "refresh_split": sql("""
        SELECT CASE WHEN worst_gap > 0.02 THEN 'replace' ELSE 'merge' END AS mode, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers
        FROM fresh LEFT JOIN gaps USING (ticker) GROUP BY 1""", "bars", fresh=_ADJUSTED, gaps=_GAPS),
    "import_long": sql("""
        SELECT replace(ticker, '#', '-') AS ticker, count(*) AS n_bars FROM (
          SELECT * FROM messy QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) = 1) l WHERE close IS NOT NULL GROUP BY ticker""", messy=_MESSY),
    "source_fallback": sql("""
        SELECT ticker, CASE coalesce(sector, '') WHEN 'ASIA' THEN (CASE WHEN max(year(date)) >= 1999 THEN 0 ELSE 1 END) WHEN 'EUROPE' THEN 1 ELSE 2 END AS priority,
               count(*) FILTER (coalesce(sector, '') <> 'ASIA' OR year(date) >= 1999) AS n_bars,
               min(date) FILTER (coalesce(sector, '') <> 'ASIA' OR year(date) >= 1999) AS first_date
        FROM bars LEFT JOIN sectors USING (ticker) GROUP BY ticker, sector""", "bars", "sectors"),
    "normalize_news": sql("""
        SELECT id, created_at, CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 2 DAY ELSE created_at END AS updated_at,
               CASE WHEN id % 3 = 0 THEN 'EDIT ' || headline ELSE headline END AS headline, source, '' AS url,
               len(symbols) AS n_symbols, array_to_string(symbols, '|') AS symbols FROM news""", "news"),
    "news_by_symbol": sql(f"""
        SELECT id, created_at FROM news WHERE created_at BETWEEN TIMESTAMP '1996-01-15' AND TIMESTAMP '1999-06-30 12:00:00'
          AND (list_contains(symbols, '{MARKET}') OR list_contains(symbols, 'SUPPLIER#000000005'))""", "news"),
    "news_coverage": sql("SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS articles, max(created_at) AS last_created FROM news GROUP BY 1", "news"),
    "news_refresh_plan": sql(f"""
        SELECT month, CASE WHEN skip THEN 'skip' ELSE 'fetch' END AS action, CASE WHEN NOT skip THEN greatest(opens, TIMESTAMP '1994-11-15', coalesce(last_created - INTERVAL 1 DAY, opens)) END AS fetch_from,
               CASE WHEN NOT skip THEN fetch_to END AS fetch_to, coalesce(articles, 0) AS articles
        FROM (SELECT m.*, articles, last_created, articles IS NOT NULL AND fetch_to < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AS skip
              FROM (SELECT strftime(o, '%Y-%m') AS month, o AS opens, least(o + INTERVAL 1 MONTH - INTERVAL 1 SECOND, TIMESTAMP '{NOW}') AS fetch_to
                    FROM (SELECT unnest(generate_series(TIMESTAMP '1994-11-01', TIMESTAMP '{NOW}', INTERVAL 1 MONTH)) AS o) s) m
              LEFT JOIN (SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS articles, max(created_at) AS last_created
                         FROM news WHERE month(created_at) <> 5 GROUP BY 1) c USING (month)) p""", "news"),
    "membership_long": sql("SELECT date, ticker FROM membership UNION ALL SELECT DISTINCT date, 'BRK-B' FROM membership", "membership"),
    "sector_map": sql("""
        SELECT upper(s_name) AS ticker, CASE WHEN s_acctbal < 0 THEN 'Distressed' ELSE coalesce(sector, 'ETF') END AS sector
        FROM supplier LEFT JOIN sectors ON ticker = upper(s_name)""", "sectors"),
    "universe_semi": sql("""
        SELECT ticker, count(*) AS n_bars FROM bars WHERE ticker IN (SELECT upper(s_name) FROM supplier WHERE s_acctbal > 5000)
          OR ticker IN (SELECT ticker FROM membership WHERE year(date) = 1998) GROUP BY ticker""", "bars", "membership"),
    "lexicon_long": sql("""
        SELECT DISTINCT unnest(CASE WHEN n % 3 = 0 THEN ['negative'] ELSE [] END || CASE WHEN n % 4 = 0 THEN ['positive'] ELSE [] END
                      || CASE WHEN n % 5 = 0 THEN ['uncertainty'] ELSE [] END) AS category, upper(w) AS word
        FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) t GROUP BY w) c"""),
    "equity_history": sql("""
        SELECT account, as_of, coalesce(CASE WHEN as_of = last_day THEN lowest + 1000 END, line, seen) AS equity FROM (
          SELECT user_id AS account, CAST(ts AS DATE) AS as_of, max_by(value, event_id) FILTER (event_type <> 'click') AS line, max(value) * 10 AS seen
          FROM events GROUP BY 1, 2) e
        JOIN (SELECT user_id AS account, max(CAST(ts AS DATE)) AS last_day, min(value) AS lowest FROM events GROUP BY 1) t USING (account)"""),
}

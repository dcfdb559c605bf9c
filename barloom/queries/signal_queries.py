"""Signals, selection, sizing and complete strategy weights."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.scalars import per_day
from barloom.operators import panel as P
from barloom.operators import schedule as S
from barloom.operators import signals as G
from barloom.operators import sizing as K
from barloom.plans.strategies import Panel, get_strategy
from barloom.queries.fixtures import CTES, MARKET, Market, r6, r6c, sql
from barloom.queries.text_queries import featured_grid
from barloom.session import cut_lineage


def dated(spark, folder) -> Market:
    """The market with its calendar stored, for strategies. They read the panel for scores of all names and for returns of the
    chosen ones; building it for both costs less than writing it, dealing it by ticker again and sorting it."""
    m = Market(spark, folder)
    m.days = cut_lineage(m.days)
    return m


def panel_of(m: Market, featured: bool = False) -> Panel:
    grid = featured_grid(m) if featured else m.grid
    return Panel(P.with_eligible(grid), m.days, m.sectors, m.grid)


def _monthly_scores(m: Market):
    scored = G.with_momentum_score(m.grid, 252, 21, MARKET).select("ticker", "date", "bar_idx", "score")
    return P.with_sector(scored.join(per_day(S.decision_dates(m.days, "monthly").select("date")), "date", "left_semi"), m.sectors)


def momentum_score(spark, folder):
    m = Market(spark, folder)
    grid = P.with_membership(m.grid, m.days, m.membership)
    return G.with_momentum_score(grid, 252, 21, MARKET).filter("score IS NOT NULL").select("ticker", "date", r6c("score").alias("score"))


def market_filter(spark, folder):
    return G.market_filter(Market(spark, folder).grid, MARKET, 200)


def sma_crossover(spark, folder):
    return G.with_sma_crossover(Market(spark, folder).grid, 50, 200).filter("score IS NOT NULL").select("ticker", "date", r6c("score").alias("score"))


def zscore(spark, folder):
    return G.with_zscore(Market(spark, folder).grid, 20, 100).select("ticker", "date", r6c("z").alias("z"), "uptrend")


def mean_reversion(spark, folder):
    m = Market(spark, folder)
    scored = G.with_zscore(m.grid, 20, 100).select("ticker", "date", "z", "uptrend", "eligible")
    return G.mean_reversion_holdings(scored, -1.5, 0.0, 3)


def sentiment_score(spark, folder):
    scored = G.with_sentiment_score(featured_grid(Market(spark, folder)), 10, "tone")
    return scored.filter("score IS NOT NULL").select("ticker", "date", r6c("score").alias("score"), "articles")


def sentiment_score_neg(spark, folder):
    scored = G.with_sentiment_score(featured_grid(Market(spark, folder)), 21, "neg")
    return scored.filter("score IS NOT NULL").select("ticker", "date", r6c("score").alias("score"), "articles")


def sentiment_report(spark, folder):
    m = Market(spark, folder)
    last = m.days.agg(F.max("bar_idx")).scalar()
    reached = featured_grid(m).filter(F.col("bar_idx") > last - 250)   # all that the windows of the last day hold
    scored = G.with_sentiment_score(reached, 250, "tone").filter(F.col("bar_idx") == last).withColumn("score", F.round("score", 9))
    today = cut_lineage(scored.select("date", "ticker", "score", "articles"))   # a row for each name; the report reads it three times
    return G.sentiment_report(today, m.sectors, 5, 3).withColumn("score", r6c("score"))


def buy_and_hold(spark, folder):
    m = Market(spark, folder)
    held = G.buy_and_hold(m.grid, [MARKET, "supplier#000000003", "supplier#000000004", "supplier#000000007"])
    return held.join(per_day(S.decision_dates(m.days, "monthly").select("date")), "date", "left_semi").select("date", "ticker", r6c("weight").alias("weight"))


def top_n(spark, folder):
    top = K.pick_top(_monthly_scores(Market(spark, folder)), 10)
    return top.select("date", "ticker", F.col("rank").cast("long").alias("rank"), r6c("score").alias("score"))


def top_n_sector_capped(spark, folder):
    top = K.equal_weight(K.pick_top(_monthly_scores(Market(spark, folder)), 10, 3))
    return top.select("date", "ticker", "sector", F.col("rank").cast("long").alias("rank"), r6c("score").alias("score"), r6c("weight").alias("weight"))


def equal_weight(spark, folder):
    scored = G.with_sma_crossover(Market(spark, folder).grid, 50, 200)
    weekly = scored.join(per_day(S.decision_dates(Market(spark, folder).days, "weekly").select("date")), "date", "left_semi")
    return K.equal_weight(K.pick_top(weekly, 30)).select("date", "ticker", r6c("weight").alias("weight"))


def trailing_vol(spark, folder):
    """The window form, for every cell of the panel."""
    vols = K.with_trailing_vol(P.with_padded_returns(Market(spark, folder).grid), 60)
    return vols.filter("vol IS NOT NULL").select("ticker", "date", r6c("vol").alias("vol"))


def inverse_vol(spark, folder):
    m = Market(spark, folder)
    chosen = K.with_selected_vol(K.pick_top(_monthly_scores(m), 10, 3), P.with_padded_returns(m.marked), 60)
    return K.inverse_vol(chosen).select("date", "ticker", r6c("weight").alias("weight"))


def vol_target(spark, folder):
    m = Market(spark, folder)
    book = K.equal_weight(K.pick_top(_monthly_scores(m), 10, 3)).select("date", "bar_idx", "ticker", "weight")
    return K.vol_target(book, P.with_padded_returns(m.grid), 0.15).select("date", "ticker", r6c("weight").alias("weight"))


def clean_weights(spark, folder):
    """Daily close-over-volume ratios as raw weights: infinite where nothing traded, null in holes."""
    m = Market(spark, folder)
    raw = m.grid.select("ticker", "date", F.when((F.col("volume") % 5 == 0), F.lit(float("inf"))).when(
        F.col("volume") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("close") / F.lit(997.0)).alias("weight"))
    return K.clean_weights(raw, m.sectors).select("ticker", "date", r6c("weight").alias("weight"))


def momentum_weights(spark, folder):
    weights = get_strategy("momentum", market_filter=MARKET).weights(panel_of(dated(spark, folder)))
    return weights.select("date", "ticker", r6c("weight").alias("weight"))


def sentiment_weights(spark, folder):
    strategy = get_strategy("sentiment", market_filter=MARKET, lookback=60, min_articles=2)
    weights = strategy.weights(panel_of(dated(spark, folder), featured=True))
    return weights.select("date", "ticker", r6c("weight").alias("weight"))


def sma_weights(spark, folder):
    weights = get_strategy("sma_crossover", search={"fast": [20, 50], "slow": [100, 200]}, sizing="inverse_vol").weights(panel_of(dated(spark, folder)))
    return weights.select(F.col("config").cast("long").alias("config"), "date", "ticker", r6c("weight").alias("weight"))


QUERIES = {f.__name__: f for f in (
    momentum_score, market_filter, sma_crossover, zscore, mean_reversion, sentiment_score, sentiment_score_neg, sentiment_report,
    buy_and_hold, top_n, top_n_sector_capped, equal_weight, trailing_vol, inverse_vol, vol_target, clean_weights, momentum_weights,
    sentiment_weights, sma_weights)}


def w(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


CTES["monthly"] = (["cal"], "SELECT date, bar_idx FROM cal QUALIFY coalesce(date_trunc('month', date) <> date_trunc('month', lead(date) OVER (ORDER BY date)), true)")
CTES["weekly"] = (["cal"], "SELECT date, bar_idx FROM cal QUALIFY coalesce(date_trunc('week', date) <> date_trunc('week', lead(date) OVER (ORDER BY date)), true)")
CTES["mom"] = (["grid"], f"""
    SELECT ticker, date, bar_idx, s AS score FROM (
      SELECT *, lag(close, 21) OVER (PARTITION BY ticker ORDER BY bar_idx) / lag(close, 252) OVER (PARTITION BY ticker ORDER BY bar_idx) - 1 AS s FROM grid) x
    WHERE s IS NOT NULL AND close IS NOT NULL AND ticker <> '{MARKET}'""")
CTES["gate"] = (["grid"], f"""
    SELECT date, coalesce(NOT (n = 200 AND close < m), true) AS risk_on FROM (
      SELECT date, close, count(close) {w(200)} AS n, avg(close) {w(200)} AS m FROM grid WHERE ticker = '{MARKET}') x""")
CTES["mom_monthly"] = (["mom", "monthly", "sectors"], """
    SELECT mom.*, coalesce(sector, 'Unknown') AS sector FROM mom JOIN monthly USING (date, bar_idx) LEFT JOIN sectors USING (ticker)""")
CTES["mom_top"] = (["mom_monthly"], """
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) AS sr FROM mom_monthly) x
    WHERE sr <= 3 OR sector = 'Unknown' QUALIFY rank <= 10""")
CTES["rets"] = (["marked"], "SELECT *, mark / lag(mark) OVER (PARTITION BY ticker ORDER BY bar_idx) - 1 AS pad_ret FROM marked")
CTES["vols"] = (["rets"], f"""
    SELECT ticker, date, CASE WHEN n >= 20 AND hi > lo AND v > 0 THEN v END AS vol FROM (
      SELECT ticker, date, count(pad_ret) {w(60)} AS n, stddev_samp(pad_ret) {w(60)} AS v, min(pad_ret) {w(60)} AS lo, max(pad_ret) {w(60)} AS hi FROM rets) x""")
CTES["sma"] = (["grid"], f"""
    SELECT ticker, date, f / s - 1 AS score FROM (
      SELECT ticker, date, close, avg(close) {w(50)} AS f, avg(close) {w(200)} AS s, count(close) {w(200)} AS n FROM grid) x
    WHERE n = 200 AND f > s AND close IS NOT NULL""")
CTES["ticks"] = (["grid"], "SELECT *, CAST(round(close * 1e8::DOUBLE) AS BIGINT) AS x FROM grid")   # sums of whole numbers are exact in any order
CTES["sma_exact"] = (["ticks"], f"""
    SELECT ticker, date, (f::DOUBLE / 50) / (s::DOUBLE / 200) - 1 AS score FROM (
      SELECT ticker, date, x, CAST(sum(x) {w(50)} AS BIGINT) AS f, CAST(sum(x) {w(200)} AS BIGINT) AS s, count(x) {w(200)} AS n FROM ticks) y
    WHERE n = 200 AND f::HUGEINT * 200 > s::HUGEINT * 50 AND x IS NOT NULL""")
CTES["zs_exact"] = (["ticks"], f"""
    SELECT ticker, date, bar_idx, CASE WHEN v > 0 THEN (n * x - s)::DOUBLE / sqrt(v::DOUBLE * n / (n - 1)) END AS z,
           coalesce(x * tn > ts, false) AS uptrend, x IS NOT NULL AS ok FROM (
      SELECT *, n * q - s * s AS v FROM (
        SELECT *, count(x) {w(20)} AS n, sum(x) {w(20)} AS s, sum(x::HUGEINT * x) {w(20)} AS q, count(x) {w(100)} AS tn, sum(x) {w(100)} AS ts FROM ticks) a) b""")
CTES["zs"] = (["zs_exact"], "SELECT * REPLACE (round(z, 9) AS z) FROM zs_exact")   # windows of the same shape tie


def book_sql(book: str) -> dict[str, str]:
    """Steps that scale the weights of step `book` (date, bar_idx, ticker, weight) to 15 % volatility."""
    return {
        "realised": f"""
            SELECT date, stddev_samp(r) * sqrt(252.0::DOUBLE) AS rv, max(g) AS g FROM (
              SELECT b.date, p.bar_idx, sum(b.weight * coalesce(p.pad_ret, 0.0::DOUBLE)) AS r, sum(abs(b.weight)) AS g
              FROM {book} b JOIN rets p ON p.ticker = b.ticker AND p.bar_idx BETWEEN b.bar_idx - 59 AND b.bar_idx GROUP BY ALL) x GROUP BY date""",
        "scaled": f"""
            SELECT date, bar_idx, ticker, CASE WHEN rv > 0 THEN weight * least(0.15::DOUBLE / rv, 1.0::DOUBLE / greatest(g, 1e-12::DOUBLE)) ELSE weight END AS weight
            FROM {book} JOIN realised USING (date)""",
    }


def score_window(kind: str, n: int) -> str:
    total = "-sum(news_neg_sum)" if kind == "neg" else "sum(news_tone_sum)"
    return f"""SELECT ticker, date, bar_idx, close, score, articles FROM (
        SELECT ticker, date, bar_idx, close, sum(news_count) {w(n)} AS articles, {total} {w(n)} / nullif(sum(news_count) {w(n)}, 0) AS score FROM news_features) x
        WHERE score IS NOT NULL"""


_SENT = f"""
    SELECT s.ticker, s.date, s.bar_idx, score, coalesce(sector, 'Unknown') AS sector FROM ({score_window('tone', 60)}) s
    JOIN weekly k ON k.date = s.date JOIN gate ON gate.date = s.date AND gate.risk_on LEFT JOIN sectors USING (ticker)
    WHERE s.close IS NOT NULL AND articles >= 2 AND s.ticker <> '{MARKET}'"""
_SENT_TOP = """
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) AS sr FROM sent) x
    WHERE sr <= 4 OR sector = 'Unknown' QUALIFY rank <= 20"""


def _inverse(top: str) -> str:
    return f"SELECT date, bar_idx, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS weight FROM {top} JOIN vols USING (ticker, date) WHERE vol IS NOT NULL"


_SMA_GRID = " UNION ALL ".join(f"""
    SELECT {i} AS config, date, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY date) AS weight FROM (
      SELECT ticker, date, f / s - 1 AS score FROM (
        SELECT ticker, date, close, avg(close) {w(f)} AS f, avg(close) {w(s)} AS s, count(close) {w(s)} AS n FROM grid) x
      JOIN weekly USING (date) WHERE n = {s} AND f > s AND close IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY date ORDER BY f / s - 1 DESC, ticker) <= 30) y
    JOIN vols USING (ticker, date) WHERE vol IS NOT NULL""" for i, (f, s) in enumerate([(20, 100), (20, 200), (50, 100), (50, 200)]))

ORACLES = {
    "momentum_score": sql(f"""
        SELECT ticker, date, {r6('score')} AS score FROM mom JOIN member_grid g USING (ticker, date) WHERE g.member""", "mom", "member_grid"),
    "market_filter": sql("SELECT date, risk_on FROM gate", "gate"),
    "sma_crossover": sql(f"SELECT ticker, date, {r6('score')} AS score FROM sma_exact", "sma_exact"),
    "zscore": sql(f"SELECT ticker, date, {r6('z')} AS z, uptrend FROM zs_exact", "zs_exact"),
    "mean_reversion": sql("""
        SELECT date, unnest(held) AS ticker FROM walk JOIN cal USING (bar_idx)""", "zs", "cal", recursive=True,
        cands="""
        SELECT bar_idx, list({'t': ticker, 'e': uptrend AND z < -1.5} ORDER BY z, ticker) AS names FROM zs WHERE ok AND z < 0 GROUP BY bar_idx""",
        walk="""
        SELECT CAST(-1 AS BIGINT) AS bar_idx, CAST([] AS VARCHAR[]) AS held
        UNION ALL
        SELECT w.bar_idx + 1, coalesce(list_transform(list_filter(c.names, lambda n: n.e OR list_contains(w.held, n.t)), lambda n: n.t)[1:3], CAST([] AS VARCHAR[]))
        FROM walk w LEFT JOIN cands c ON c.bar_idx = w.bar_idx + 1 WHERE w.bar_idx + 1 < (SELECT count(*) FROM cal)"""),
    "sentiment_score": sql(f"SELECT ticker, date, {r6('score')} AS score, articles FROM ({score_window('tone', 10)}) s", "news_features"),
    "sentiment_score_neg": sql(f"SELECT ticker, date, {r6('score')} AS score, articles FROM ({score_window('neg', 21)}) s", "news_features"),
    "sentiment_report": sql(f"""
        SELECT side, ticker, {r6('score')} AS score, articles, coalesce(sector, 'Unknown') AS sector FROM (
          SELECT 'most positive' AS side, * FROM (SELECT * FROM today ORDER BY score DESC, ticker LIMIT 5) a
          UNION ALL SELECT 'most negative', * FROM (SELECT * FROM today ORDER BY score, ticker LIMIT 5) b) r LEFT JOIN sectors USING (ticker)""",
        "news_features", "sectors",
        today=f"SELECT ticker, round(score, 9) AS score, articles FROM ({score_window('tone', 250)}) s WHERE articles >= 3 AND date = (SELECT max(date) FROM grid)"),
    "buy_and_hold": sql(f"""
        SELECT date, ticker, {r6('1.0::DOUBLE / count(*) OVER (PARTITION BY date)')} AS weight FROM grid JOIN monthly USING (date)
        WHERE close IS NOT NULL AND ticker IN ('{MARKET}', 'SUPPLIER#000000003', 'SUPPLIER#000000004', 'SUPPLIER#000000007')""", "grid", "monthly"),
    "top_n": sql(f"""
        SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank, {r6('score')} AS score
        FROM mom_monthly QUALIFY rank <= 10""", "mom_monthly"),
    "top_n_sector_capped": sql(f"""
        SELECT date, ticker, sector, rank, {r6('score')} AS score, {r6('1.0::DOUBLE / count(*) OVER (PARTITION BY date)')} AS weight FROM mom_top""", "mom_top"),
    "equal_weight": sql(f"""
        SELECT date, ticker, {r6('1.0::DOUBLE / count(*) OVER (PARTITION BY date)')} AS weight FROM (
          SELECT * FROM sma JOIN weekly USING (date) QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 30) x""", "sma", "weekly"),
    "trailing_vol": sql(f"SELECT ticker, date, {r6('vol')} AS vol FROM vols WHERE vol IS NOT NULL", "vols"),
    "inverse_vol": sql(f"SELECT date, ticker, {r6('weight')} AS weight FROM ({_inverse('mom_top')}) x", "mom_top", "vols"),
    "vol_target": sql(f"SELECT date, ticker, {r6('weight')} AS weight FROM scaled", "mom_top", "rets",
                      book="SELECT date, bar_idx, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM mom_top", **book_sql("book")),
    "clean_weights": sql(f"""
        SELECT ticker, date, CASE WHEN volume % 5 = 0 OR volume % 7 = 0 OR close IS NULL THEN 0.0::DOUBLE ELSE {r6('close / 997.0::DOUBLE')} END AS weight
        FROM grid WHERE ticker IN (SELECT ticker FROM sectors)""", "grid", "sectors"),
    "momentum_weights": sql(f"SELECT date, ticker, {r6('weight')} AS weight FROM scaled", "mom_top", "vols", "gate", "rets",
                            gated="SELECT * FROM mom_top JOIN gate USING (date) WHERE risk_on", book=_inverse("gated"), **book_sql("book")),
    "sentiment_weights": sql(f"SELECT date, ticker, {r6('weight')} AS weight FROM scaled", "news_features", "vols", "gate", "rets", "weekly", "sectors",
                             sent=_SENT, sent_top=_SENT_TOP, book=_inverse("sent_top"), **book_sql("book")),
    "sma_weights": sql(f"SELECT config, date, ticker, {r6('weight')} AS weight FROM ({_SMA_GRID}) g", "grid", "vols", "weekly"),
}

"""Panel projections and point-in-time access."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import panel as P
from barloom.queries.fixtures import Market, r6, r6c, sql
from barloom.sources import bars as B

START, END = "1996-01-10", "2000-06-30"


def align_panel(spark, folder):
    m = Market(spark, folder)
    return B.align_panel(m.bars, min_bars=1400)


def panel_slice(spark, folder):
    m = Market(spark, folder)
    cut = P.panel_slice(m.grid, m.days, START, END)
    return cut.groupBy("bar_idx", "date").agg(
        F.count("*").alias("n_names"), F.count("close").alias("n_prices"), r6c(F.max("close")).alias("top_close"))


def eligible(spark, folder):
    m = Market(spark, folder)
    grid = P.with_eligible(P.with_membership(m.grid, m.days, m.membership))
    return grid.select("ticker", "date", "member", "eligible")


def membership_asof(spark, folder):
    m = Market(spark, folder)
    return P.snapshot_of_date(m.days, m.membership).join(
        m.membership.groupBy(F.col("date").alias("snapshot")).agg(F.count("*").alias("n_members")), "snapshot", "left"
    ).select("date", "snapshot", "n_members")


def all_members(spark, folder):
    return P.all_members(Market(spark, folder).membership, "1996-02-01", "1996-12-31")


def attach_features(spark, folder):
    m = Market(spark, folder)
    traded = m.table("lineitem").join(m.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.upper("s_name").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("traded"))
    return P.with_features(m.grid, traded, ["traded"]).select("ticker", "date", "traded")


def min_history(spark, folder):
    m = Market(spark, folder)
    return P.with_min_history(m.grid, 1500).groupBy("ticker").agg(F.count("close").alias("n_closes"))


def returns(spark, folder):
    return P.with_returns(Market(spark, folder).grid).select("ticker", "date", r6c("ret").alias("ret"))


def trailing_window(spark, folder):
    w = P.trailing(20)
    return Market(spark, folder).grid.select(
        "ticker", "date", F.count("close").over(w).alias("n_close"), F.min("low").over(w).alias("low_20"),
        F.max("high").over(w).alias("high_20"), F.sum("volume").over(w).alias("volume_20"))


def padded_returns(spark, folder):
    return P.with_padded_returns(Market(spark, folder).grid).select("ticker", "date", r6c("pad_ret").alias("pad_ret"))


def mark_price(spark, folder):
    return Market(spark, folder).marked.select("ticker", "date", "mark")


def fill_reference(spark, folder):
    return Market(spark, folder).marked.select("ticker", "date", "fill_ref")


def sector_lookup(spark, folder):
    m = Market(spark, folder)
    return P.with_sector(m.grid, m.sectors).groupBy("sector", "date").agg(
        F.count("close").alias("n_prices"), F.max("close").alias("top_close"))


def eligible_share(spark, folder):
    m = Market(spark, folder)
    return P.eligible_share(P.with_membership(m.grid, m.days, m.membership)).select(
        r6c("eligible_share").alias("eligible_share"))


def select_tickers(spark, folder):
    m = Market(spark, folder)
    return P.select_tickers(m.grid, m.sectors.filter(F.col("sector").isin("ASIA", "EUROPE"))).groupBy("ticker").agg(
        F.max_by("close", "bar_idx").alias("last_close"), F.count("*").alias("n_rows"))


QUERIES = {f.__name__: f for f in (
    align_panel, panel_slice, select_tickers, eligible, membership_asof, all_members, attach_features, min_history, returns,
    trailing_window, padded_returns, mark_price, fill_reference, sector_lookup, eligible_share)}

_W20 = "OVER (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
ORACLES = {
    "align_panel": sql("""SELECT * FROM grid WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(close) >= 1400)""", "grid"),
    "panel_slice": sql(f"""
        SELECT rank() OVER (ORDER BY date) - 1 AS bar_idx, date, n_names, n_prices, top_close FROM (
          SELECT date, count(*) AS n_names, count(close) AS n_prices, {r6('max(close)')} AS top_close
          FROM grid WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY date) d""", "grid"),
    "select_tickers": sql("""
        SELECT ticker, max(close) FILTER (bar_idx = (SELECT max(bar_idx) FROM cal)) AS last_close, count(*) AS n_rows FROM grid
        WHERE ticker IN (SELECT ticker FROM sectors WHERE sector IN ('ASIA', 'EUROPE')) GROUP BY ticker""", "grid", "sectors"),
    "eligible": sql("SELECT ticker, date, member, member AND close IS NOT NULL AS eligible FROM member_grid", "member_grid"),
    "membership_asof": sql("""
        SELECT c.date, s.snapshot, (SELECT count(*) FROM membership m WHERE m.date = s.snapshot) AS n_members
        FROM cal c ASOF LEFT JOIN (SELECT DISTINCT date AS snapshot FROM membership) s ON c.date >= s.snapshot""", "cal", "membership"),
    "all_members": sql("""
        SELECT DISTINCT ticker FROM membership WHERE date BETWEEN DATE '1996-02-01' AND DATE '1996-12-31'""", "membership"),
    "attach_features": sql("""
        SELECT g.ticker, g.date, coalesce(traded, 0.0::DOUBLE) AS traded FROM grid g LEFT JOIN (
          SELECT upper(s_name) AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS traded
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) f ON f.ticker = g.ticker AND f.date = g.date""", "grid"),
    "min_history": sql("SELECT ticker, count(close) AS n_closes FROM bars GROUP BY ticker HAVING count(close) >= 1500", "bars"),
    "returns": sql(f"SELECT ticker, date, {r6('close / lag(close) OVER (PARTITION BY ticker ORDER BY bar_idx) - 1')} AS ret FROM grid", "grid"),
    "trailing_window": sql(f"""
        SELECT ticker, date, count(close) {_W20} AS n_close, min(low) {_W20} AS low_20, max(high) {_W20} AS high_20,
               sum(volume) {_W20} AS volume_20 FROM grid""", "grid"),
    "padded_returns": sql(f"SELECT ticker, date, {r6('mark / lag(mark) OVER (PARTITION BY ticker ORDER BY bar_idx) - 1')} AS pad_ret FROM marked", "marked"),
    "mark_price": sql("SELECT ticker, date, mark FROM marked", "marked"),
    "fill_reference": sql("SELECT ticker, date, fill_ref FROM marked", "marked"),
    "sector_lookup": sql(f"""
        SELECT coalesce(sector, 'Unknown') AS sector, date, count(close) AS n_prices, max(close) AS top_close
        FROM grid LEFT JOIN sectors USING (ticker) GROUP BY ALL""", "grid", "sectors"),
    "eligible_share": sql(f"""
        SELECT {r6('avg(share)')} AS eligible_share FROM (SELECT date, avg(CASE WHEN member THEN 1.0::DOUBLE ELSE 0 END) AS share FROM member_grid GROUP BY date) d""", "member_grid"),
}

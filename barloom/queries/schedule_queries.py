"""Exchange calendar, rebalance schedules and news sessions."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import schedule as S
from barloom.queries.fixtures import CTES, Market, sql
from barloom.sources import news as N


def trading_calendar(spark, folder):
    """Every order day with its place in the exchange calendar."""
    placed = Market(spark, folder).table("orders").select(F.to_date("o_orderdate").alias("date"))
    days = S.trading_calendar(placed)
    return placed.groupBy("date").agg(F.count("*").alias("n_orders")).join(days, "date").select(
        "date", "n_orders", "is_trading_day", "prev_trading_day", "next_trading_day", "session")


def _mask(schedule):
    def query(spark, folder):
        return S.rebalance_mask(Market(spark, folder).days, schedule).select("date", "bar_idx", "is_decision")
    return query


def is_rebalance_day(spark, folder):
    days = S.trading_calendar(Market(spark, folder).table("orders").select(F.to_date("o_orderdate").alias("date")))
    out = days
    for name in ("weekly", "monthly", "quarterly"):
        out = S.is_rebalance_day(out, name).withColumnRenamed("is_rebalance_day", name)
    orders = Market(spark, folder).table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n_orders"))
    return orders.join(out, "date").select("date", "n_orders", "weekly", "monthly", "quarterly")


def news_session(spark, folder):
    return S.news_session(N.normalize_news(Market(spark, folder).raw_news)).select("id", "created_at", "session")


QUERIES = {
    "trading_calendar": trading_calendar,
    "rebalance_daily": _mask("daily"),
    "rebalance_weekly": _mask("weekly"),
    "rebalance_monthly": _mask("monthly"),
    "rebalance_quarterly": _mask("quarterly"),
    "rebalance_every_n": _mask(10),
    "is_rebalance_day": is_rebalance_day,
    "news_session": news_session,
}

# Holidays by construction from the year (Gauss's Easter rule), independent of the day-by-day rules in Spark.
CTES["exchange"] = ([], """
    SELECT d AS date, isodow(d) < 6 AND NOT EXISTS (SELECT 1 FROM holidays h WHERE h.holiday = d) AS open
    FROM (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d) s""")
CTES["holidays"] = ([], """
    SELECT unnest([
        CASE WHEN isodow(make_date(y,1,1)) = 7 THEN make_date(y,1,2) ELSE make_date(y,1,1) END,
        make_date(y,1,1) + ((8 - isodow(make_date(y,1,1))) % 7)::INT + 14,
        make_date(y,2,1) + ((8 - isodow(make_date(y,2,1))) % 7)::INT + 14,
        make_date(y,3,22) + (CASE WHEN dd = 29 AND ee = 6 THEN 28 WHEN dd = 28 AND ee = 6 AND y % 19 > 10 THEN 27 ELSE dd + ee END)::INT - 2,
        make_date(y,5,31) - ((isodow(make_date(y,5,31)) - 1) % 7)::INT,
        make_date(y,7,4) + (CASE isodow(make_date(y,7,4)) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END)::INT,
        make_date(y,9,1) + ((8 - isodow(make_date(y,9,1))) % 7)::INT,
        make_date(y,11,1) + ((11 - isodow(make_date(y,11,1))) % 7)::INT + 21,
        make_date(y,12,25) + (CASE isodow(make_date(y,12,25)) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END)::INT]) AS holiday
    FROM (SELECT y, (19 * (y % 19) + 24) % 30 AS dd, (2 * (y % 4) + 4 * (y % 7) + 6 * ((19 * (y % 19) + 24) % 30) + 5) % 7 AS ee
          FROM (SELECT CAST(unnest(generate_series(1994, 2002)) AS BIGINT) AS y) a) b""")
CTES["exchange"] = (["holidays"], CTES["exchange"][1])
CTES["sessions"] = (["exchange"], """
    SELECT date, open, max(CASE WHEN open THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_day,
           min(CASE WHEN open THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_day,
           min(CASE WHEN open THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS session FROM exchange""")
CTES["news_days"] = (["news", "sessions"], """
    SELECT n.*, s.session FROM (
      SELECT news.*, CAST(timezone('America/New_York', timezone('UTC', created_at)) AS DATE)
             + CASE WHEN CAST(timezone('America/New_York', timezone('UTC', created_at)) AS TIME) >= TIME '16:00:01' THEN 1 ELSE 0 END AS day
      FROM news) n LEFT JOIN sessions s ON s.date = n.day""")


def _mask_sql(period):
    return sql(f"SELECT date, bar_idx, coalesce({period} <> lead({period}) OVER (ORDER BY date), true) AS is_decision FROM cal", "cal")


ORACLES = {
    "trading_calendar": sql("""
        SELECT date, n_orders, open AS is_trading_day, prev_day AS prev_trading_day, next_day AS next_trading_day, session
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY 1) o JOIN sessions USING (date)""", "sessions"),
    "rebalance_daily": sql("SELECT date, bar_idx, true AS is_decision FROM cal", "cal"),
    "rebalance_weekly": _mask_sql("date_trunc('week', date)"),
    "rebalance_monthly": _mask_sql("date_trunc('month', date)"),
    "rebalance_quarterly": _mask_sql("date_trunc('quarter', date)"),
    "rebalance_every_n": sql("SELECT date, bar_idx, bar_idx % 10 = 0 AS is_decision FROM cal", "cal"),
    "is_rebalance_day": sql("""
        SELECT date, n_orders, date_trunc('week', date) <> date_trunc('week', next_day) AS weekly, date_trunc('month', date) <> date_trunc('month', next_day) AS monthly,
               date_trunc('quarter', date) <> date_trunc('quarter', next_day) AS quarterly
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY 1) o JOIN sessions USING (date)""", "sessions"),
    "news_session": sql("SELECT id, created_at, session FROM news_days", "news_days"),
}

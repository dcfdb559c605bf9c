"""Checks over accounts, orders and logs, and user-defined strategies."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.costs import PRESETS
from barloom.operators import monitor as V
from barloom.operators import orders as O
from barloom.operators import panel as P
from barloom.operators import schedule as S
from barloom.plans import custom as U
from barloom.plans.backtest import BacktestConfig, run_backtest
from barloom.plans.strategies import get_strategy
from barloom.queries.fixtures import CTES, MARKET, Market, r6, r6c, sql
from barloom.queries.risk_queries import diff_sql
from barloom.queries.signal_queries import panel_of
from barloom.operators.limits import RiskLimits


def _books(m: Market):
    """Every ticker's newest bar, looked at the day after the newest order or on the day of its own last order line."""
    newest = m.bars.groupBy("ticker").agg(F.max("date").alias("as_of"))
    return newest.withColumn("today", F.date_add(F.lit("2001-11-03").cast("date"), (F.length("ticker") + F.ascii(F.substring("ticker", -1, 1)) % 5 - 18).cast("int")))


def freshness(spark, folder):
    m = Market(spark, folder)
    books = _books(m)
    return V.freshness(books, S.trading_calendar(books, "today"), 1).select("ticker", "as_of", "today", "allowed", "status")


def daily_loss(spark, folder):
    return V.daily_loss(_yesterday(Market(spark, folder)), 0.03).select("account", r6c("pnl").alias("pnl"), "status")


def _orders(m: Market):
    """Planned orders, a few without a price, and sales of some accounts written as negative quantities."""
    rows = O.order_diff(m.targets, m.holdings, m.last_close, m.accounts)
    signed = F.when((F.col("side") == "sell") & (F.col("account") % 3 == 0), -F.col("quantity")).otherwise(F.col("quantity"))
    return rows.withColumns({"price": F.when(F.substring("ticker", -2, 2) != "13", F.col("price")), "quantity": signed})


def _solvency(m: Market):
    """Accounts of which some have no equity, an unknown one or NaN, and some are missing."""
    part = F.col("account") % 50
    equity = F.when(part == 0, 0.0).when(part == 2, F.lit(float("nan"))).when(part != 3, F.col("equity"))
    return m.accounts.filter(part != 1).withColumn("equity", equity)


def _yesterday(m: Market):
    """Accounts of which some have an unknown equity now or before."""
    part = F.col("account") % 50
    return m.accounts.withColumns({"equity": F.when(part == 2, F.lit(float("nan"))).when(part != 3, F.col("equity")), "last_equity": F.when(part == 4, F.lit(float("nan"))).otherwise(F.col("last_equity"))})


def order_limits(spark, folder):
    m = Market(spark, folder)
    return V.order_limits(_orders(m), _solvency(m), 20, 0.2, 1.5).select("account", "rule", "ticker", r6c("value").alias("value"))


def _recorded(m: Market):
    kept = m.holdings.filter((F.length("ticker") + F.col("account")) % 11 != 0)
    noted = kept.withColumn("quantity", F.col("quantity") * F.when(F.col("account") % 13 == 0, 1.05).when(F.col("account") % 17 == 0, 1.005).otherwise(1.0))
    return noted.filter(F.col("account") % 4 != 0).unionByName(
        m.targets.filter(F.col("account") % 9 == 1).join(m.holdings, ["account", "ticker"], "left_anti").select("account", "ticker", F.lit(3.0).alias("quantity")))


def _pending(m: Market):
    return m.targets.filter(F.col("weight") > 0.08).select("account", "ticker")


def reconciliation(spark, folder):
    m = Market(spark, folder)
    return V.reconciliation(m.holdings, _recorded(m), _pending(m)).select("account", "rule", "ticker", r6c("value").alias("value"))


def guard_report(spark, folder):
    m = Market(spark, folder)
    loss = V.daily_loss(_yesterday(m), 0.03).filter("status = 'breach'").select("account", F.lit("daily_loss").alias("rule"))
    return V.guard_report(m.accounts, [loss, V.order_limits(_orders(m), _solvency(m), 20, 0.2, 1.5), V.reconciliation(m.holdings, _recorded(m), _pending(m))])


def gate_status(spark, folder):
    m = Market(spark, folder)
    fills = m.fills.withColumn("account", F.substring("ticker", -9, 9).cast("long"))
    return V.gate_status(fills, m.guard_log, 250, 3)


def shortfall(spark, folder):
    return V.shortfall(Market(spark, folder).fills).select("n", r6c("mean_bps").alias("mean_bps"), r6c("median_bps").alias("median_bps"), r6c("total_cost", 2).alias("total_cost"))


def shortfall_by_account(spark, folder):
    """Slippage of every account by itself."""
    fills = Market(spark, folder).fills.withColumn("account", F.substring("ticker", -9, 9).cast("long"))
    return V.shortfall(fills, ["account"]).select("account", "n", r6c("mean_bps").alias("mean_bps"), r6c("median_bps").alias("median_bps"), r6c("total_cost", 2).alias("total_cost"))


def worst_fills(spark, folder):
    out = V.with_slippage(Market(spark, folder).fills).withColumn("slip_bps", F.round("slip_bps", 6))
    return out.orderBy(F.desc("slip_bps"), F.desc("cost"), "as_of", "ticker").limit(5).select("as_of", "ticker", "side", r6c("slip_bps").alias("slip_bps"), r6c("cost", 3).alias("cost"))


def state_snapshot(spark, folder):
    m = Market(spark, folder)
    results = m.targets.select("account", "ticker", F.when(F.col("weight") > 0.1, "rejected").otherwise("accepted").alias("status"))
    return V.state_snapshot(m.holdings, results)


def _range_position(bars):
    """Where the last close lies in the range of the last bars."""
    closes = bars["close"].dropna()
    if len(closes) < 40 or bars["close"].isna().iloc[-1]:
        return None
    low, high = closes.min(), closes.max()
    return (closes.iloc[-1] - low) / (high - low) if high > low else None


def custom_strategy(spark, folder):
    """A Python score per ticker and decision, and a Python allocation per date."""
    m = Market(spark, folder)
    scored = U.score_with_function(m.grid, S.decision_dates(m.days, "quarterly"), _range_position, 60, ["close"])
    weights = U.allocate_with_function(scored.withColumn("score", F.round("score", 9)), lambda rows: 1.0 / (rows["rank"] * len(rows)), 8)
    return weights.select("date", "ticker", r6c("weight").alias("weight"))


def custom_columns(spark, folder):
    """The same score as a column expression."""
    m = Market(spark, folder)
    w = P.trailing(60)

    def score():
        low, high = F.min("close").over(w), F.max("close").over(w)
        return F.when((F.count("close").over(w) >= 40) & F.col("close").isNotNull(), F.try_divide(F.col("close") - low, high - low))

    return U.score_with_columns(m.grid, S.decision_dates(m.days, "quarterly"), score).filter("score IS NOT NULL").select("ticker", "date", r6c("score").alias("score"))


def backtest(spark, folder):
    """The registered momentum strategy with limits, costs, drawdown control and benchmark, end to end."""
    m = Market(spark, folder)
    m.materialise()
    config = BacktestConfig(costs=PRESETS["retail"], limits=RiskLimits(max_weight=0.2, max_gross=0.95), benchmark=MARKET, drawdown_control=(0.10, 0.20))
    run = run_backtest(panel_of(m), get_strategy("momentum", search={"top_n": [5, 10]}, market_filter=MARKET), config, "1996-06-01", "2001-06-30")
    perf = run.metrics()
    return perf.select(F.col("config").cast("long").alias("config"), "n_days", r6c("end_equity", 3).alias("end_equity"), r6c("sharpe", 5).alias("sharpe"),
                       r6c("annual_turnover", 5).alias("annual_turnover"), r6c("excess_cagr", 5).alias("excess_cagr"), r6c("beta", 5).alias("beta"))


QUERIES = {f.__name__: f for f in (
    freshness, daily_loss, order_limits, reconciliation, guard_report, gate_status, shortfall, shortfall_by_account, worst_fills, state_snapshot,
    custom_strategy, custom_columns, backtest)}

CTES["orders_plan"] = (["targets", "holdings", "last_close", "accounts"], f"""
    SELECT account, ticker, side, CASE WHEN side = 'sell' AND account % 3 = 0 THEN -quantity ELSE quantity END AS quantity, CASE WHEN right(ticker, 2) <> '13' THEN price END AS price
    FROM ({diff_sql('targets', 'holdings', 'last_close', 'accounts', 1.0, 0.002, False)}) d""")
CTES["order_fails"] = (["orders_plan", "accounts"], """
    SELECT account, 'order_count' AS rule, NULL AS ticker, count(*)::DOUBLE AS value FROM orders_plan GROUP BY account HAVING count(*) > 20
    UNION ALL SELECT account, 'unknown_account', NULL, count(*)::DOUBLE FROM orders_plan WHERE account % 50 = 1 GROUP BY account
    UNION ALL SELECT DISTINCT account, 'no_equity', NULL, CASE WHEN account % 50 = 0 THEN 0.0::DOUBLE END FROM orders_plan WHERE account % 50 IN (0, 2, 3)
    UNION ALL SELECT account, 'gross_notional', NULL, sum(abs(quantity * price)) / max(equity) FROM orders_plan JOIN accounts USING (account) WHERE account % 50 > 3
              GROUP BY account HAVING sum(abs(quantity * price)) > 1.5::DOUBLE * max(equity)
    UNION ALL SELECT account, 'no_price', ticker, quantity FROM orders_plan WHERE account % 50 > 3 AND price IS NULL
    UNION ALL SELECT account, 'order_notional', ticker, abs(quantity * price) / equity FROM orders_plan JOIN accounts USING (account)
              WHERE account % 50 > 3 AND abs(quantity * price) > 0.2::DOUBLE * equity""")
CTES["yesterday"] = (["accounts"], "SELECT account, CASE WHEN account % 50 NOT IN (2, 3) AND account % 50 <> 4 THEN equity / last_equity - 1 END AS pnl FROM accounts")
CTES["recorded"] = (["holdings", "targets"], """
    SELECT account, ticker, quantity * CASE WHEN account % 13 = 0 THEN 1.05::DOUBLE WHEN account % 17 = 0 THEN 1.005::DOUBLE ELSE 1.0::DOUBLE END AS quantity
    FROM holdings WHERE (length(ticker) + account) % 11 <> 0 AND account % 4 <> 0
    UNION ALL SELECT account, ticker, 3.0::DOUBLE FROM targets t WHERE account % 9 = 1 AND NOT EXISTS (SELECT 1 FROM holdings h WHERE h.account = t.account AND h.ticker = t.ticker)""")
CTES["recon_fails"] = (["recorded", "holdings", "targets"], """
    SELECT account, CASE WHEN noted IS NULL THEN 'unexpected_position' WHEN held IS NULL THEN 'position_gone' ELSE 'quantity_drift' END AS rule, ticker, coalesce(held, noted) AS value
    FROM (SELECT coalesce(h.account, r.account) AS account, coalesce(h.ticker, r.ticker) AS ticker, h.quantity AS held, r.quantity AS noted
          FROM (SELECT * FROM holdings WHERE account IN (SELECT account FROM recorded)) h FULL JOIN recorded r ON r.account = h.account AND r.ticker = h.ticker) b
    WHERE (noted IS NULL OR held IS NULL OR abs(held - noted) / noted > 0.01) AND NOT EXISTS (
      SELECT 1 FROM targets p WHERE p.weight > 0.08 AND p.account = b.account AND p.ticker = b.ticker)""")
CTES["slips"] = (["fills"], """
    SELECT *, s * (filled_price / modelled_price - 1) * 1e4::DOUBLE AS bps, s * (filled_price - modelled_price) * filled_quantity AS cost
    FROM (SELECT *, CASE WHEN side = 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM fills WHERE filled_quantity > 0) f""")

_RANGE = """
    SELECT ticker, date, (close - lo) / (hi - lo) AS score FROM (
      SELECT *, min(close) OVER v AS lo, max(close) OVER v AS hi, count(close) OVER v AS n FROM grid
      WINDOW v AS (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) x
    WHERE n >= 40 AND close IS NOT NULL AND hi > lo AND date IN (SELECT date FROM cal QUALIFY coalesce(date_trunc('quarter', date) <> date_trunc('quarter', lead(date) OVER (ORDER BY date)), true))"""

ORACLES = {
    "freshness": sql("""
        SELECT b.ticker, as_of, today, prev_day AS allowed, CASE WHEN as_of > today THEN 'future' WHEN as_of < prev_day THEN 'stale' ELSE 'fresh' END AS status
        FROM (SELECT ticker, max(date) AS as_of, DATE '2001-11-03' + CAST(length(ticker) + ascii(right(ticker, 1)) % 5 - 18 AS INT) AS today FROM bars GROUP BY ticker) b
        JOIN sessions s ON s.date = b.today""", "bars", "sessions"),
    "daily_loss": sql(f"""
        SELECT account, {r6('pnl')} AS pnl, CASE WHEN pnl IS NULL THEN 'unchecked' WHEN pnl < -0.03 THEN 'breach' ELSE 'ok' END AS status FROM yesterday""", "yesterday"),
    "order_limits": sql(f"SELECT account, rule, ticker, {r6('value')} AS value FROM order_fails", "order_fails"),
    "reconciliation": sql(f"SELECT account, rule, ticker, {r6('value')} AS value FROM recon_fails", "recon_fails"),
    "guard_report": sql("""
        SELECT account, count(f.rule) AS n_failures, count(f.rule) = 0 AS passed FROM accounts LEFT JOIN (
          SELECT account, rule FROM order_fails UNION ALL SELECT account, rule FROM recon_fails
          UNION ALL SELECT account, 'daily_loss' FROM yesterday WHERE pnl < -0.03) f USING (account) GROUP BY account""", "accounts", "yesterday", "order_fails", "recon_fails"),
    "gate_status": sql("""
        SELECT account, coalesce(fills, 0) AS fills, coalesce(fill_sessions, 0) AS fill_sessions, first_fill, last_fill, coalesce(total_runs, 0) AS total_runs,
               coalesce(clean_sessions, 0) AS clean_sessions, coalesce(fills, 0) >= 250 AND coalesce(clean_sessions, 0) >= 3 AS open
        FROM (SELECT CAST(right(ticker, 9) AS BIGINT) AS account, count(*) AS fills, count(DISTINCT as_of) AS fill_sessions, min(as_of) AS first_fill, max(as_of) AS last_fill
              FROM fills WHERE broker = 'paper' AND (status <> 'rejected' OR filled_quantity > 0) GROUP BY 1) f
        FULL JOIN (SELECT account, count(*) AS total_runs, count(*) FILTER (fails_after = 0) AS clean_sessions FROM (
                     SELECT account, sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (PARTITION BY account ORDER BY seq DESC) AS fails_after FROM guard_log) g GROUP BY 1) r USING (account)""", "fills", "guard_log"),
    "shortfall": sql(f"SELECT count(*) AS n, {r6('avg(bps)')} AS mean_bps, {r6('median(bps)')} AS median_bps, round(sum(cost), 2) AS total_cost FROM slips", "slips"),
    "shortfall_by_account": sql(f"""
        SELECT CAST(right(ticker, 9) AS BIGINT) AS account, count(*) AS n, {r6('avg(bps)')} AS mean_bps, {r6('median(bps)')} AS median_bps, round(sum(cost), 2) AS total_cost
        FROM slips GROUP BY 1""", "slips"),
    "worst_fills": sql(f"""
        SELECT as_of, ticker, side, {r6('b')} AS slip_bps, round(cost, 3) AS cost FROM (SELECT *, round(bps, 6) AS b FROM slips) s ORDER BY b DESC, cost DESC, as_of, ticker LIMIT 5""", "slips"),
    "state_snapshot": sql("""
        SELECT coalesce(h.account, t.account) AS account, coalesce(h.ticker, t.ticker) AS ticker, coalesce(quantity, 0.0::DOUBLE) AS quantity, t.account IS NOT NULL AS pending
        FROM holdings h FULL JOIN (SELECT * FROM targets WHERE weight <= 0.1) t ON t.account = h.account AND t.ticker = h.ticker""", "holdings", "targets"),
    "custom_strategy": sql(f"""
        SELECT date, ticker, {r6('1.0::DOUBLE / (rank * count(*) OVER (PARTITION BY date))')} AS weight FROM (
          SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, ticker) AS rank FROM ({_RANGE}) s QUALIFY rank <= 8) t""", "grid", "cal"),
    "custom_columns": sql(f"SELECT ticker, date, {r6('score')} AS score FROM ({_RANGE}) s", "grid", "cal"),
}


def _backtest_sql() -> str:
    """Two momentum books, selected, sized, limited, accounted twice (the second time throttled) and measured."""
    from barloom.queries.ledger_queries import TURN, ledger_steps, metric_steps, window_rows

    picked = " UNION ALL ".join(f"""
        SELECT {i} AS config, ticker, date, bar_idx FROM (
          SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) AS sr FROM mom_monthly JOIN gate USING (date) WHERE risk_on) x
        WHERE sr <= 3 OR sector = 'Unknown' QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= {n}""" for i, n in enumerate((5, 10)))
    retail = PRESETS["retail"]
    steps = {
        "picked": picked,
        "sized": """SELECT config, date, bar_idx, ticker, (1 / vol) / sum(1 / vol) OVER (PARTITION BY config, date) AS weight FROM picked JOIN vols USING (ticker, date) WHERE vol IS NOT NULL""",
        "risky": """
            SELECT config, date, stddev_samp(r) * sqrt(252.0::DOUBLE) AS rv, max(g) AS g FROM (
              SELECT b.config, b.date, p.bar_idx, sum(b.weight * coalesce(p.pad_ret, 0.0::DOUBLE)) AS r, sum(abs(b.weight)) AS g
              FROM sized b JOIN rets p ON p.ticker = b.ticker AND p.bar_idx BETWEEN b.bar_idx - 59 AND b.bar_idx GROUP BY ALL) x GROUP BY ALL""",
        "clipped": """
            SELECT config, bar_idx, ticker, least(CASE WHEN rv > 0 THEN weight * least(0.15::DOUBLE / rv, 1.0::DOUBLE / greatest(g, 1e-12::DOUBLE)) ELSE weight END, 0.2::DOUBLE) AS w
            FROM sized JOIN risky USING (config, date)""",
        "limited": """SELECT config, bar_idx, ticker, w * CASE WHEN g > 0.95 THEN 0.95::DOUBLE / g ELSE 1.0::DOUBLE END AS weight FROM (
            SELECT *, sum(w) OVER (PARTITION BY config, bar_idx) AS g FROM clipped) c""",
        "dec": "SELECT config, bar_idx FROM monthly CROSS JOIN (SELECT unnest([0, 1]) AS config) c",
        "win": window_rows({0: retail, 1: retail}, "(SELECT greatest(min(bar_idx), 253) FROM cal WHERE date >= DATE '1996-06-01')",
                           "(SELECT max(bar_idx) FROM cal WHERE date <= DATE '2001-06-30')"),
        **ledger_steps("limited", "win", "dec", "f_"),
        "cutbook": """
            SELECT b.config, b.bar_idx, ticker, weight * CASE WHEN dd >= 0.2 THEN 0.0::DOUBLE WHEN dd >= 0.1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM limited b JOIN (SELECT config, bar_idx, 1 - equity / greatest(max(equity) OVER (PARTITION BY config ORDER BY bar_idx), 100000.0::DOUBLE) AS dd FROM f_eq) d
            ON d.config = b.config AND d.bar_idx = b.bar_idx""",
        **ledger_steps("cutbook", "win", "dec"), **metric_steps("eq"), "turn": TURN,
        "bcurve": f"""SELECT v.config, m.bar_idx, mark AS equity FROM win v JOIN marked m ON m.ticker = '{MARKET}' AND m.bar_idx BETWEEN first_idx AND last_idx""",
        **metric_steps("bcurve", "config", "b_"),
    }
    return sql("""
        SELECT s.config, s.n_days, round(s.end_equity, 3) AS end_equity, round(s.sharpe, 5) AS sharpe, round(t.turnover, 5) AS annual_turnover,
               round(s.cagr - b.cagr, 5) AS excess_cagr, round(beta, 5) AS beta
        FROM stat s JOIN (SELECT config, avg(turnover) * 252 AS turnover FROM turn GROUP BY 1) t ON t.config = s.config JOIN b_stat b ON b.config = s.config
        JOIN (SELECT x.config, regr_slope(x.r, y.r) AS beta FROM ret x JOIN b_ret y ON y.config = x.config AND y.bar_idx = x.bar_idx GROUP BY 1) k ON k.config = s.config""",
        "mom_monthly", "gate", "vols", "rets", "marked", "monthly", "cal", recursive=True, **steps)


ORACLES["backtest"] = _backtest_sql()

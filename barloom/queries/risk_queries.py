"""Limits, sector caps, the drawdown budget, costs and order planning."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import costs as C
from barloom.functions.scalars import per_day
from barloom.operators import limits as R
from barloom.operators import orders as O
from barloom.operators import panel as P
from barloom.operators import schedule as S
from barloom.queries.fixtures import CTES, Market, r6, r6c, sql

LIMITS = R.RiskLimits(max_weight=0.12, max_gross=0.8, max_net=0.5, allow_short=True, min_weight=0.004, max_sector_weight=0.3)


def _raw_targets(m: Market):
    """Targets with some shorts and no sector for unmapped names."""
    tilt = F.when(F.length("ticker") + F.col("account") % 5 == 20, -1.0).otherwise(1.0)
    return m.targets.withColumn("weight", F.col("weight") * tilt).join(m.sectors, "ticker", "left")


def risk_limits(spark, folder):
    out = R.apply_limits(_raw_targets(Market(spark, folder)), LIMITS, ["account"])
    return out.select("account", "ticker", r6c("weight").alias("weight"))


def sector_cap(spark, folder):
    out = R.cap_sectors(_raw_targets(Market(spark, folder)), 0.25, 0.15, ["account"])
    return out.select("account", "ticker", r6c("weight").alias("weight"))


def member_weights(spark, folder):
    m = Market(spark, folder)
    grid = P.with_membership(m.grid, m.days, m.membership).join(per_day(S.decision_dates(m.days, "monthly").select("date")), "date", "left_semi")
    zeroed = R.zero_non_members(grid.select("date", "ticker", "member", (F.col("close") / 9973.0).alias("weight")))
    return zeroed.groupBy("date").agg(F.count_if(F.col("weight") > 0).alias("n_held"), r6c(F.sum("weight")).alias("gross"))


def drawdown_scale(spark, folder):
    dd = 1.0 - F.col("equity") / F.lit(30000.0)
    return Market(spark, folder).accounts.select("account", r6c(dd).alias("drawdown"), R.drawdown_scale(dd, 0.10, 0.20).alias("scale"))


def drawdown_from_history(spark, folder):
    history = Market(spark, folder).table("events").select(F.col("user_id").alias("account"), F.col("event_id"), (F.col("value") + 50).alias("equity"))
    return R.drawdown_from_history(history, ["account"], "event_id").select(
        "account", "peak", "last_equity", r6c("drawdown").alias("drawdown"), "scale")


def _orders_as_fills(m: Market):
    return m.fills.select("ticker", "side", F.col("filled_quantity").alias("quantity"), F.col("modelled_price").alias("reference"))


def fill_costs(spark, folder):
    costed = C.with_fill_costs(C.with_costs(_orders_as_fills(Market(spark, folder)), C.CostModel(0.005, 1.0, 0.0003, 5.0, 2.0)))
    return costed.groupBy("ticker", "side").agg(
        F.count("*").alias("n"), r6c(F.sum("commission"), 3).alias("commission"), r6c(F.sum("cost"), 3).alias("cost"), r6c(F.max("price"), 4).alias("top_price"))


def cost_scenarios(spark, folder):
    scenarios = {**C.PRESETS, "retail_x2": C.PRESETS["retail"].scaled(2), "ibkr_x3": C.PRESETS["ibkr"].scaled(3)}
    costed = C.with_fill_costs(C.with_scenarios(_orders_as_fills(Market(spark, folder)), scenarios))
    return costed.groupBy("scenario").agg(F.count("*").alias("n"), r6c(F.sum("commission"), 2).alias("commission"), r6c(F.sum("cost"), 2).alias("cost"))


def order_diff(spark, folder):
    m = Market(spark, folder)
    out = O.order_diff(m.targets, m.holdings, m.last_close, m.accounts)
    return out.select("account", "ticker", "side", r6c("quantity").alias("quantity"), "price")


def order_diff_whole(spark, folder):
    m = Market(spark, folder)
    out = O.order_diff(m.targets, m.holdings, m.last_close, m.accounts, 5.0, 0.01, fractional=False)
    return out.select("account", "ticker", "side", "quantity")


def cap_buys(spark, folder):
    m = Market(spark, folder)
    out = O.cap_buys(O.order_diff(m.targets, m.holdings, m.last_close, m.accounts), m.accounts)
    return out.select("account", "ticker", "side", r6c("quantity").alias("quantity"))


def _quotes(m: Market):
    return m.bars.filter(F.col("ticker").substr(-1, 1).cast("int") % 2 == 0).groupBy("ticker").agg((F.max_by("open", "date") * 1.01).alias("price"))


def price_fallback(spark, folder):
    m = Market(spark, folder)
    prices = O.price_fallback(m.holdings, _quotes(m), m.last_close)
    held = O.current_weights(m.holdings, prices, m.accounts)
    return held.join(prices, "ticker").select("account", "ticker", r6c("price").alias("price"), "stale", r6c("current_w").alias("current_w"))


def rebalance_plan(spark, folder):
    m = Market(spark, folder)
    exposure = R.drawdown_from_history(m.table("events").select(F.col("user_id").alias("account"), "event_id", (F.col("value") + 50).alias("equity")), ["account"], "event_id")
    plan = O.rebalance_plan(m.targets, m.holdings, _quotes(m), m.last_close, m.accounts, R.RiskLimits(max_weight=0.2), m.accounts, exposure)
    return plan.select("account", "submit_no", "ticker", "side", "quantity", r6c("est_price", 5).alias("est_price"), "current_w", "target_w")


def volume_cap(spark, folder):
    m = Market(spark, folder)
    asked = m.fills.select("ticker", F.col("as_of").alias("date"), "side", F.col("filled_quantity").alias("quantity"))
    capped = O.volume_cap(asked.join(m.bars.select("ticker", "date", (F.col("volume") * 3).alias("volume")), ["ticker", "date"], "left"))
    return capped.groupBy("ticker", "side").agg(
        F.count("*").alias("n"), F.count_if(F.col("filled") < F.col("quantity")).alias("n_capped"), r6c(F.sum("filled"), 3).alias("filled"))


QUERIES = {f.__name__: f for f in (
    risk_limits, sector_cap, member_weights, drawdown_scale, drawdown_from_history, fill_costs, cost_scenarios, order_diff,
    order_diff_whole, cap_buys, price_fallback, rebalance_plan, volume_cap)}

CTES["raw_targets"] = (["targets", "sectors"], """
    SELECT account, ticker, weight * CASE WHEN length(ticker) + account % 5 = 20 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, sector
    FROM targets LEFT JOIN sectors USING (ticker)""")


def sector_rounds(start: str, cap: float, max_weight: float) -> tuple[dict[str, str], str]:
    """Five rounds of three steps each over (account, ticker, sector, weight)."""
    steps = {"r0": f"SELECT account, ticker, sector, weight AS w, false AS closed, false AS done FROM {start}"}
    for i in range(5):
        steps[f"c{i}"] = f"""
            SELECT *, CASE WHEN sector IS NOT NULL AND NOT done AND tot > {cap} * (1 + 1e-9::DOUBLE) THEN w * ({cap}::DOUBLE / tot) ELSE w END AS cut,
                   sector IS NOT NULL AND NOT done AND tot > {cap} * (1 + 1e-9::DOUBLE) AS over FROM (
              SELECT *, sum(abs(w)) OVER (PARTITION BY account, sector) AS tot FROM r{i}) t"""
        steps[f"d{i}"] = f"""
            SELECT *, abs(cut) > 0 AND NOT (closed OR over) AS recv, sum(abs(w) - abs(cut)) OVER (PARTITION BY account) AS excess,
                   bool_or(over) OVER (PARTITION BY account) AS any_over, sum(abs(cut)) OVER (PARTITION BY account, sector) AS sec_tot FROM c{i}"""
        steps[f"r{i + 1}"] = f"""
            SELECT account, ticker, sector,
                   CASE WHEN recv AND any_over AND excess > 0 THEN cut + sign(cut) * least(excess * abs(cut) / rs, greatest({max_weight}::DOUBLE - abs(cut), 0.0::DOUBLE),
                        CASE WHEN sector IS NULL THEN 'inf'::DOUBLE ELSE greatest({cap}::DOUBLE - sec_tot, 0.0::DOUBLE) * abs(cut) / ss END) ELSE cut END AS w,
                   closed OR over AS closed, done OR NOT any_over OR rs <= 0 OR excess <= 0 AS done FROM (
              SELECT *, sum(CASE WHEN recv THEN abs(cut) ELSE 0 END) OVER (PARTITION BY account) AS rs,
                     sum(CASE WHEN recv THEN abs(cut) ELSE 0 END) OVER (PARTITION BY account, sector) AS ss FROM d{i}) x"""
    return steps, "r5"


_ROUNDS, _LAST = sector_rounds("clipped", LIMITS.max_sector_weight, LIMITS.max_weight)
_ROUNDS_ONLY, _ = sector_rounds("raw_targets", 0.25, 0.15)
CTES["quotes"] = (["bars"], "SELECT ticker, max_by(open, date) * 1.01::DOUBLE AS price FROM bars WHERE CAST(right(ticker, 1) AS INT) % 2 = 0 GROUP BY ticker")


def _costed(scenario: str, ps: float, mn: float, pct: float, pen: str) -> str:
    return f"""
        SELECT '{scenario}' AS scenario, ticker, side, price, commission, filled_quantity * abs(price - modelled_price) + commission AS cost FROM (
          SELECT *, CASE WHEN filled_quantity = 0 THEN 0.0::DOUBLE ELSE greatest(filled_quantity * {ps}::DOUBLE + filled_quantity * price * {pct}::DOUBLE, {mn}::DOUBLE) END AS commission
          FROM (SELECT *, modelled_price * (1 + CASE side WHEN 'buy' THEN 1 ELSE -1 END * {pen}::DOUBLE) AS price FROM fills) p) q"""


def diff_sql(targets: str, holdings: str, prices: str, accounts: str, notional: float, weight: float, whole: bool) -> str:
    goal = "trunc(weight * equity / price)" if whole else "weight * equity / price"
    qty = "trunc(abs(delta))" if whole else "abs(delta)"
    return f"""
        SELECT account, ticker, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, {qty} AS quantity, price, equity, cash, weight AS target_w FROM (
          SELECT *, {goal} - held AS delta FROM (
            SELECT coalesce(t.account, h.account) AS account, coalesce(t.ticker, h.ticker) AS ticker, coalesce(weight, 0.0::DOUBLE) AS weight, coalesce(quantity, 0.0::DOUBLE) AS held
            FROM {targets} t FULL JOIN {holdings} h ON h.account = t.account AND h.ticker = t.ticker) b
          JOIN {prices} USING (ticker) JOIN {accounts} USING (account) WHERE price > 0) d
        WHERE abs(delta) * price >= {notional} AND ((weight = 0 AND held <> 0) OR abs(delta) * price >= {weight}::DOUBLE * equity) AND {qty} > 0"""


_CAP = """
    SELECT account, ticker, side, price, equity, target_w, CASE WHEN side = 'sell' OR buys <= room OR buys <= 0 THEN quantity ELSE quantity * greatest(room, 0.0::DOUBLE) / buys END AS quantity FROM (
      SELECT *, sum(CASE WHEN side = 'buy' THEN quantity * price ELSE 0 END) OVER (PARTITION BY account) AS buys,
             cash + sum(CASE WHEN side = 'sell' THEN quantity * price ELSE 0 END) OVER (PARTITION BY account) - 0.005::DOUBLE * equity AS room FROM diff) o"""

ORACLES = {
    "risk_limits": sql(f"""
        SELECT account, ticker, {r6('CASE WHEN net > 0.5 THEN g * (0.5::DOUBLE / net) ELSE g END')} AS weight FROM (
          SELECT *, abs(sum(g) OVER (PARTITION BY account)) AS net FROM (
            SELECT *, CASE WHEN gross > 0.8 THEN w * (0.8::DOUBLE / gross) ELSE w END AS g FROM (
              SELECT *, sum(abs(w)) OVER (PARTITION BY account) AS gross FROM {_LAST}) a) b) c""", "raw_targets",
        clipped="""
        SELECT account, ticker, sector, CASE WHEN abs(w) < 0.004 THEN 0.0::DOUBLE ELSE w END AS weight FROM (
          SELECT *, least(greatest(weight, -0.12::DOUBLE), 0.12::DOUBLE) AS w FROM raw_targets) x""", **_ROUNDS),
    "sector_cap": sql(f"SELECT account, ticker, {r6('w')} AS weight FROM r5", "raw_targets", **_ROUNDS_ONLY),
    "member_weights": sql(f"""
        SELECT date, count(*) FILTER (member AND close > 0) AS n_held, {r6('sum(CASE WHEN member THEN close / 9973.0::DOUBLE ELSE 0 END)')} AS gross
        FROM member_grid JOIN monthly USING (date) GROUP BY date""", "member_grid", "monthly"),
    "drawdown_scale": sql(f"""
        SELECT account, {r6('dd')} AS drawdown, CASE WHEN dd >= 0.2 THEN 0.0::DOUBLE WHEN dd >= 0.1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale
        FROM (SELECT account, 1 - equity / 30000.0::DOUBLE AS dd FROM accounts) a""", "accounts"),
    "drawdown_from_history": sql(f"""
        SELECT account, peak, last_equity, {r6('dd')} AS drawdown, CASE WHEN dd >= 0.2 THEN 0.0::DOUBLE WHEN dd >= 0.1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale
        FROM (SELECT *, greatest(0.0::DOUBLE, 1 - last_equity / peak) AS dd FROM (
          SELECT user_id AS account, max(value + 50) AS peak, max_by(value + 50, event_id) AS last_equity FROM events GROUP BY 1) e) d"""),
    "fill_costs": sql("""
        SELECT ticker, side, count(*) AS n, round(sum(commission), 3) AS commission, round(sum(cost), 3) AS cost, round(max(price), 4) AS top_price
        FROM costed GROUP BY ALL""", "fills", costed=_costed("x", 0.005, 1.0, 0.0003, "0.0006")),
    "cost_scenarios": sql("""
        SELECT scenario, count(*) AS n, round(sum(commission), 2) AS commission, round(sum(cost), 2) AS cost FROM costed GROUP BY ALL""", "fills",
        costed=" UNION ALL ".join([_costed("zero", 0, 0, 0, "0.0"), _costed("retail", 0, 0, 0, "0.0006"), _costed("ibkr", 0.005, 1.0, 0, "0.0006"),
                                   _costed("pessimistic", 0, 0, 0, "0.0025"), _costed("retail_x2", 0, 0, 0, "0.0012"), _costed("ibkr_x3", 0.015, 3.0, 0, "0.0018")])),
    "order_diff": sql(f"SELECT account, ticker, side, {r6('quantity')} AS quantity, price FROM diff", "targets", "holdings", "last_close", "accounts",
                      diff=diff_sql("targets", "holdings", "last_close", "accounts", 1.0, 0.002, False)),
    "order_diff_whole": sql("SELECT account, ticker, side, quantity FROM diff", "targets", "holdings", "last_close", "accounts",
                            diff=diff_sql("targets", "holdings", "last_close", "accounts", 5.0, 0.01, True)),
    "cap_buys": sql(f"SELECT account, ticker, side, {r6('quantity')} AS quantity FROM ({_CAP}) c WHERE side = 'sell' OR quantity > 0", "targets", "holdings", "last_close", "accounts",
                    diff=diff_sql("targets", "holdings", "last_close", "accounts", 1.0, 0.002, False)),
    "price_fallback": sql(f"""
        SELECT account, h.ticker, {r6('coalesce(q.price, l.price)')} AS price, q.price IS NULL AS stale, {r6('quantity * coalesce(q.price, l.price) / equity')} AS current_w
        FROM holdings h JOIN accounts USING (account) JOIN last_close l ON l.ticker = h.ticker LEFT JOIN quotes q ON q.ticker = h.ticker""",
        "holdings", "accounts", "last_close", "quotes"),
    "rebalance_plan": sql("""
        SELECT c.account, row_number() OVER (PARTITION BY c.account ORDER BY side DESC, c.ticker) AS submit_no, c.ticker, side, round(c.quantity, 4) AS quantity,
               round(price, 5) AS est_price, round(coalesce(h.quantity * price / equity, 0.0::DOUBLE), 4) AS current_w, round(target_w, 4) AS target_w
        FROM capped c LEFT JOIN holdings h ON h.account = c.account AND h.ticker = c.ticker WHERE side = 'sell' OR c.quantity > 0""",
        "targets", "holdings", "last_close", "accounts", "quotes",
        exposure="""
        SELECT account, CASE WHEN dd >= 0.2 THEN 0.0::DOUBLE WHEN dd >= 0.1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM (
          SELECT user_id AS account, 1 - max_by(value + 50, event_id) / max(value + 50) AS dd FROM events GROUP BY 1) e""",
        limited="""
        SELECT account, ticker, weight FROM (
          SELECT c.account, ticker, CASE WHEN gross > 1 THEN c.w / gross ELSE c.w END * coalesce(scale, 1.0::DOUBLE) AS weight FROM (
            SELECT *, sum(w) OVER (PARTITION BY account) AS gross FROM (
              SELECT account, ticker, least(weight, 0.2::DOUBLE) AS w FROM targets) a) c LEFT JOIN exposure USING (account)) l WHERE weight <> 0""",
        px="SELECT l.ticker, coalesce(q.price, l.price) AS price FROM last_close l LEFT JOIN quotes q USING (ticker)",
        diff=diff_sql("limited", "holdings", "px", "accounts", 1.0, 0.002, False), capped=_CAP),
    "volume_cap": sql("""
        SELECT ticker, side, count(*) AS n, count(*) FILTER (filled < quantity) AS n_capped, round(sum(filled), 3) AS filled FROM (
          SELECT f.ticker, side, filled_quantity AS quantity, CASE WHEN volume > 0 THEN least(filled_quantity, 0.05::DOUBLE * (volume * 3)) ELSE filled_quantity END AS filled
          FROM fills f LEFT JOIN bars b ON b.ticker = f.ticker AND b.date = f.as_of) c GROUP BY ALL""", "fills", "bars"),
}

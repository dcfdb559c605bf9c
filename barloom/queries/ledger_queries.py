"""Accounting of target weights: entries, equity, trades, turnover, benchmark and cost scenarios."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.costs import PRESETS, CostModel, with_costs, with_scenarios
from barloom.operators import ledger as B
from barloom.operators import metrics as M
from barloom.operators import schedule as S
from barloom.operators import sizing as K
from barloom.queries.fixtures import CTES, MARKET, Market, r6, r6c, sql
from barloom.queries.signal_queries import _monthly_scores

WARMUP = 253
PRICY = CostModel(0.005, 0.0, 0.0002, 20.0, 10.0)
DEAR = PRESETS["pessimistic"]
SCENARIOS = {f"{k}x": PRESETS["retail"].scaled(k) for k in (1, 2, 3)}


def book(m: Market):
    """Two books: config 0 holds ten sector-capped momentum names, config 1 the five best; both 95 % invested."""
    scores = _monthly_scores(m)
    wide = K.equal_weight(K.pick_top(scores, 10, 3), 0.95).select(F.lit(0).alias("config"), "date", "bar_idx", "ticker", "weight")
    slim = K.equal_weight(K.pick_top(scores, 5), 0.95).select(F.lit(1).alias("config"), "date", "bar_idx", "ticker", "weight")
    return wide.unionByName(slim)


def two_configs(df):
    return df.withColumn("config", F.explode(F.array(F.lit(0), F.lit(1))))


def windows_of(m: Market, model: CostModel):
    return with_costs(two_configs(B.trading_window(m.days, WARMUP)), model)


def ledger(m: Market, model: CostModel = PRICY) -> B.Ledger:
    m.materialise()
    decisions = two_configs(S.decision_dates(m.days, "monthly").select("bar_idx"))
    weights = book(m).select("config", "bar_idx", "ticker", "weight")
    return B.Ledger(weights, decisions, windows_of(m, model), m.marked, ["config"], 100_000.0, 0 if model.is_free else 4)


def _out(df, *cols, keys=("config",)):
    return df.select(*[F.col(k).cast("long").alias(k) if k == "config" else k for k in keys], *cols)


def effective_weights(spark, folder):
    m = Market(spark, folder)
    moved = book(m).join(B.entries_of(two_configs(S.decision_dates(m.days, "monthly").select("bar_idx")), windows_of(m, PRICY), ["config"]), ["config", "bar_idx"])
    return _out(moved, F.col("entry_no").cast("long").alias("entry_no"), "entry_idx", "until_idx", "ticker", r6c("weight").alias("weight"))


def trading_window(spark, folder):
    m = Market(spark, folder)
    window = B.trading_window(m.days, 100, "1996-01-06", "1999-12-31")
    first, last = window.select("first_idx").scalar(), window.select("last_idx").scalar()
    inside = m.grid.filter(F.col("bar_idx").between(first, last)).select("date", first.alias("first_idx"), last.alias("last_idx"))
    return inside.groupBy("first_idx", "last_idx").agg(F.count("*").alias("n_cells"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def portfolio_equity(spark, folder):
    return _out(ledger(Market(spark, folder)).equity, "bar_idx", r6c("equity", 3).alias("equity"), r6c("cash", 3).alias("cash"))


def portfolio_equity_free(spark, folder):
    return _out(ledger(Market(spark, folder), PRESETS["zero"]).equity, "bar_idx", r6c("equity", 3).alias("equity"))


def capped(m: Market) -> B.Ledger:
    """The two books without a reserve for costs: buys end where the cash does."""
    m.materialise()
    decisions = two_configs(S.decision_dates(m.days, "monthly").select("bar_idx"))
    weights = book(m).select("config", "bar_idx", "ticker", (F.col("weight") / 0.95).alias("weight"))
    return B.Ledger(weights, decisions, windows_of(m, DEAR), m.marked, ["config"], 100_000.0, cap_cash=True)


def cash_capped_equity(spark, folder):
    return _out(capped(Market(spark, folder)).equity, "bar_idx", r6c("equity", 3).alias("equity"), r6c(F.greatest("cash", F.when(F.col("cash") > -1e-6, 0.0).otherwise(F.col("cash"))), 3).alias("cash"))


def cash_capped_trades(spark, folder):
    """What is bought for less than was wanted shows in the number and the size of the trades."""
    sides = capped(Market(spark, folder)).trades.filter("notional > 0.01").groupBy("config", "side")
    return sides.agg(F.count("*").alias("n_trades"), r6c(F.sum("notional"), 1).alias("notional")).select(F.col("config").cast("long").alias("config"), "side", "n_trades", "notional")


def turnover(spark, folder):
    return _out(ledger(Market(spark, folder)).turnover, "bar_idx", r6c("turnover").alias("turnover"))


def weights_at_close(spark, folder):
    return _out(ledger(Market(spark, folder)).weights_at_close, "bar_idx", "ticker", r6c("shares", 4).alias("shares"), r6c("weight").alias("weight"))


def implied_trades(spark, folder):
    return _out(ledger(Market(spark, folder)).trades, "bar_idx", "ticker", "side", r6c("quantity", 4).alias("quantity"), r6c("price", 2).alias("price"),
                r6c("commission", 4).alias("commission"), r6c("notional", 3).alias("notional"))


def benchmark_equity(spark, folder):
    m = Market(spark, folder)
    return _out(B.benchmark_equity(m.marked, MARKET, windows_of(m, PRICY), ["config"]), "bar_idx", r6c("benchmark", 3).alias("benchmark"))


def stressed(m: Market) -> B.Ledger:
    """The ten-name book under one, two and three times the costs, as three configurations of one job."""
    m.materialise()
    keys = ["scenario", "config"]
    weights = with_scenarios(book(m).filter("config = 0"), SCENARIOS).select(*keys, "bar_idx", "ticker", "weight")
    decisions = with_scenarios(S.decision_dates(m.days, "monthly").select(F.lit(0).alias("config"), "bar_idx"), SCENARIOS).select(*keys, "bar_idx")
    windows = with_scenarios(B.trading_window(m.days, WARMUP).withColumn("config", F.lit(0)), SCENARIOS)
    return B.Ledger(weights, decisions, windows, m.marked, keys, 100_000.0)


def cost_stress(spark, folder):
    books = stressed(Market(spark, folder))
    perf = M.metrics(books.equity, ["scenario"], books.turnover)
    return perf.select("scenario", r6c("end_equity", 3).alias("end_equity"), r6c("cagr").alias("cagr"), r6c("sharpe").alias("sharpe"),
                       r6c("max_drawdown").alias("max_drawdown"), r6c("annual_turnover").alias("annual_turnover"))


def drawdown_overlay(spark, folder):
    cut = B.drawdown_overlay(ledger(Market(spark, folder)), 0.05, 0.15)
    return _out(cut.equity, "bar_idx", r6c("equity", 3).alias("equity"))


def daily_returns(spark, folder):
    m = Market(spark, folder)
    marks = m.marked.filter("mark IS NOT NULL").select("ticker", "bar_idx", F.col("mark").alias("equity"))
    return B.daily_returns(marks, ["ticker"]).select("ticker", "bar_idx", r6c("ret").alias("ret"))


def portfolio_metrics(spark, folder):
    """Everything about the two books: returns, honesty, turnover, round trips and the benchmark."""
    m = Market(spark, folder)
    books = ledger(m)
    bench = B.benchmark_equity(m.marked, MARKET, windows_of(m, PRICY), ["config"])
    perf = M.metrics(books.equity, ["config"], books.turnover, books.trades, bench)
    names = [c for c in perf.columns if c not in ("config", "n_days", "n_trades", "n_round_trips")]
    return perf.select(F.col("config").cast("long").alias("config"), "n_days", "n_trades", F.col("n_round_trips").cast("long").alias("n_round_trips"),
                       *[r6c(c, 4).alias(c) for c in names])


QUERIES = {f.__name__: f for f in (
    effective_weights, trading_window, portfolio_equity, portfolio_equity_free, cash_capped_equity, cash_capped_trades, turnover, weights_at_close, implied_trades,
    benchmark_equity, cost_stress, drawdown_overlay, daily_returns, portfolio_metrics)}

CTES["book"] = (["mom_top", "mom_monthly"], """
    SELECT 0 AS config, date, bar_idx, ticker, 0.95::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM mom_top
    UNION ALL
    SELECT 1, date, bar_idx, ticker, 0.95::DOUBLE / count(*) OVER (PARTITION BY date) FROM (
      SELECT * FROM mom_monthly QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 5) x""")


def window_rows(configs: dict[object, CostModel], first: str = str(WARMUP), last: str = "(SELECT max(bar_idx) FROM cal)") -> str:
    return " UNION ALL ".join(
        f"SELECT {c!r} AS config, CAST({first} AS BIGINT) AS first_idx, {last} AS last_idx, {m.penalty}::DOUBLE AS pen, {m.commission_pct}::DOUBLE AS pct, "
        f"{m.commission_per_share}::DOUBLE AS ps, {m.commission_min}::DOUBLE AS mn" for c, m in configs.items())


def ledger_steps(weights: str, win: str, dec: str, p: str = "") -> dict[str, str]:
    """SQL accounting, entry after entry, over step names for weights (config, bar_idx, ticker, weight), windows and decisions."""
    rate = "(pen + (1 + sign(r.w - r.wr / growth) * pen) * pct + ps / r.ref)"
    return {
        f"{p}ent": f"""
            SELECT d.config, d.bar_idx, d.bar_idx + 1 AS entry_idx, row_number() OVER (PARTITION BY d.config ORDER BY d.bar_idx) AS entry_no,
                   coalesce(lead(d.bar_idx) OVER (PARTITION BY d.config ORDER BY d.bar_idx), last_idx) AS until_idx, pen, pct, ps, mn
            FROM {dec} d JOIN {win} v ON v.config = d.config AND d.bar_idx >= first_idx AND d.bar_idx < last_idx""",
        f"{p}now": f"SELECT e.config, e.entry_no, b.ticker, b.weight AS w FROM {weights} b JOIN {p}ent e ON e.config = b.config AND e.bar_idx = b.bar_idx WHERE weight <> 0",
        f"{p}legs": f"""
            SELECT e.config, e.entry_no, e.entry_idx, e.until_idx, x.ticker, w, w_prev, m.fill_ref AS ref,
                   CASE WHEN w_prev <> 0 THEN w_prev * m.fill_ref / q.fill_ref ELSE 0.0::DOUBLE END AS wr
            FROM (SELECT coalesce(a.config, b.config) AS config, coalesce(a.entry_no, b.entry_no + 1) AS entry_no, coalesce(a.ticker, b.ticker) AS ticker,
                         coalesce(a.w, 0.0::DOUBLE) AS w, coalesce(b.w, 0.0::DOUBLE) AS w_prev
                  FROM {p}now a FULL JOIN {p}now b ON b.config = a.config AND b.ticker = a.ticker AND b.entry_no + 1 = a.entry_no) x
            JOIN {p}ent e ON e.config = x.config AND e.entry_no = x.entry_no
            JOIN marked m ON m.ticker = x.ticker AND m.bar_idx = e.entry_idx
            LEFT JOIN {p}ent f ON f.config = x.config AND f.entry_no = x.entry_no - 1
            LEFT JOIN marked q ON q.ticker = x.ticker AND q.bar_idx = f.entry_idx""",
        f"{p}per": f"""
            SELECT e.config, e.entry_no, e.entry_idx, e.until_idx, pen, pct, ps, mn, coalesce(sum(w), 0.0::DOUBLE) AS invested,
                   1 - coalesce(sum(w_prev), 0.0::DOUBLE) + coalesce(sum(wr), 0.0::DOUBLE) AS gg, list({{'w': w, 'wr': wr, 'ref': ref}}) FILTER (ref IS NOT NULL) AS legs
            FROM {p}ent e LEFT JOIN {p}legs l ON l.config = e.config AND l.entry_no = e.entry_no GROUP BY ALL""",
        f"{p}chain": f"""
            SELECT config, CAST(0 AS BIGINT) AS entry_no, 0.0::DOUBLE AS cost, 1.0::DOUBLE AS growth, 100000.0::DOUBLE AS opened FROM {win}
            UNION ALL
            SELECT config, entry_no, coalesce(list_sum(list_transform(legs, lambda r: abs(r.w - r.wr / growth) * {rate})), 0.0::DOUBLE), growth, opened * growth
            FROM (SELECT n.*, n.gg - c.cost AS growth, c.opened FROM {p}chain c JOIN {p}per n ON n.config = c.config AND n.entry_no = c.entry_no + 1) s""",
        f"{p}held": f"""
            SELECT l.config, m.bar_idx, l.ticker, l.w * c.opened / l.ref AS shares, m.mark
            FROM {p}legs l JOIN {p}chain c ON c.config = l.config AND c.entry_no = l.entry_no
            JOIN marked m ON m.ticker = l.ticker AND m.bar_idx BETWEEN l.entry_idx AND l.until_idx WHERE l.w <> 0""",
        f"{p}eq": f"""
            SELECT d.config, d.bar_idx, cash, cash + coalesce(v, 0.0::DOUBLE) AS equity FROM (
              SELECT v.config, k.bar_idx, coalesce(c.opened * (1 - n.invested - c.cost), 100000.0::DOUBLE) AS cash
              FROM {win} v JOIN cal k ON k.bar_idx BETWEEN first_idx AND last_idx
              LEFT JOIN {p}per n ON n.config = v.config AND k.bar_idx BETWEEN n.entry_idx AND n.until_idx
              LEFT JOIN {p}chain c ON c.config = n.config AND c.entry_no = n.entry_no) d
            LEFT JOIN (SELECT config, bar_idx, sum(shares * mark) AS v FROM {p}held GROUP BY ALL) h ON h.config = d.config AND h.bar_idx = d.bar_idx""",
        f"{p}trades": f"""
            SELECT config, bar_idx, ticker, side, quantity, price,
                   CASE WHEN quantity = 0 THEN 0.0::DOUBLE ELSE greatest(quantity * ps + quantity * price * pct, mn) END AS commission, quantity * price AS notional FROM (
              SELECT l.config, l.entry_idx AS bar_idx, l.ticker, CASE WHEN l.w > l.wr / c.growth THEN 'buy' ELSE 'sell' END AS side, n.ps, n.pct, n.mn,
                     abs(l.w - l.wr / c.growth) * c.opened / l.ref AS quantity, l.ref * (1 + sign(l.w - l.wr / c.growth) * n.pen) AS price
              FROM {p}legs l JOIN {p}chain c ON c.config = l.config AND c.entry_no = l.entry_no JOIN {p}per n ON n.config = l.config AND n.entry_no = l.entry_no
              WHERE abs(l.w - l.wr / c.growth) > 1e-12) t""",
    }


def metric_steps(eq: str, key: str = "config", p: str = "") -> dict[str, str]:
    """SQL statistics over (key, bar_idx, equity)."""
    return {
        f"{p}ret": f"""
            SELECT {key}, bar_idx, equity, equity / lag(equity) OVER (PARTITION BY {key} ORDER BY bar_idx) - 1 AS r,
                   equity / max(equity) OVER (PARTITION BY {key} ORDER BY bar_idx) - 1 AS dd FROM {eq}""",
        f"{p}stat": f"""
            SELECT *, CASE WHEN sd > 0 THEN mean / sd * sqrt(252.0::DOUBLE) ELSE 0.0::DOUBLE END AS sharpe,
                   CASE WHEN n_days < 2 THEN 0.0::DOUBLE ELSE pow(end_equity / start_equity, 252.0::DOUBLE / (n_days - 1)) - 1 END AS cagr FROM (
              SELECT {key}, min_by(equity, bar_idx) AS start_equity, max_by(equity, bar_idx) AS end_equity, count(*) AS n_days, count(r) AS n, avg(r) AS mean,
                     stddev_samp(r) AS sd, skewness(r) AS skew, kurtosis(r) + 3 AS kurt, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS down, max(r) AS best, min(r) AS worst,
                     min(dd) AS max_drawdown FROM {p}ret GROUP BY {key}) a""",
    }


_DEC = "SELECT config, bar_idx FROM monthly CROSS JOIN (SELECT unnest([0, 1]) AS config) c"
USES = ("book", "marked", "monthly", "cal")


def book_ledger(model: CostModel) -> dict[str, str]:
    return {"dec": _DEC, "win": window_rows({0: model, 1: model}), **ledger_steps("book", "win", "dec")}


TURN = """SELECT e.config, e.bar_idx, coalesce(n, 0.0::DOUBLE) / equity AS turnover FROM eq e
    LEFT JOIN (SELECT config, bar_idx, sum(notional) AS n FROM trades GROUP BY ALL) t ON t.config = e.config AND t.bar_idx = e.bar_idx"""
_STRESS = {
    "dec": "SELECT config, bar_idx FROM monthly CROSS JOIN (SELECT unnest(['1x', '2x', '3x']) AS config) c",
    "win": window_rows(SCENARIOS),
    "wts": "SELECT c.config, bar_idx, ticker, weight FROM book b CROSS JOIN (SELECT unnest(['1x', '2x', '3x']) AS config) c WHERE b.config = 0",
    **ledger_steps("wts", "win", "dec"), **metric_steps("eq"), "turn": TURN}
_OVERLAY = {
    "cutbook": """
        SELECT b.config, b.bar_idx, ticker, weight * CASE WHEN dd >= 0.15 THEN 0.0::DOUBLE WHEN dd >= 0.05 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM book b JOIN (SELECT config, bar_idx, 1 - equity / greatest(max(equity) OVER (PARTITION BY config ORDER BY bar_idx), 100000.0::DOUBLE) AS dd FROM eq) d
        ON d.config = b.config AND d.bar_idx = b.bar_idx""",
    **ledger_steps("cutbook", "win", "dec", "x_")}
_SE = "sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12::DOUBLE) / (n - 1))"
BENCH = f"""SELECT v.config, m.bar_idx, mark / first_value(mark) OVER (PARTITION BY v.config ORDER BY m.bar_idx) * 100000.0::DOUBLE AS benchmark
    FROM win v JOIN marked m ON m.ticker = '{MARKET}' AND m.bar_idx BETWEEN first_idx AND last_idx"""

# Shares and cash, entry after entry: sales first, then purchases, fewest shares first, as far as the cash goes.
_CAPPED = {
    "dec": _DEC, "win": window_rows({0: DEAR, 1: DEAR}),
    "wholly": "SELECT config, bar_idx, ticker, weight / 0.95::DOUBLE AS weight FROM book",
    **{k: v for k, v in ledger_steps("wholly", "win", "dec").items() if k in ("ent", "now", "legs")},
    "per": """
        SELECT e.config, e.entry_no, e.entry_idx, e.until_idx, pen, list({'t': ticker, 'w': w, 'ref': ref}) FILTER (ref IS NOT NULL) AS legs
        FROM ent e LEFT JOIN legs l ON l.config = e.config AND l.entry_no = e.entry_no GROUP BY ALL""",
    "chain": """
        SELECT config, CAST(0 AS BIGINT) AS entry_no, 100000.0::DOUBLE AS cash, CAST([] AS STRUCT(t VARCHAR, s DOUBLE)[]) AS held, CAST([] AS STRUCT(t VARCHAR, d DOUBLE, ref DOUBLE)[]) AS done FROM win
        UNION ALL
        SELECT config, entry_no, after, list_filter(list_transform(got, lambda l: {'t': l.t, 's': l.s + l.d}), lambda l: abs(l.s) > 1e-9), list_transform(got, lambda l: {'t': l.t, 'd': l.d, 'ref': l.ref}) FROM (
          SELECT config, entry_no, pen, got, coalesce(avail - list_sum(list_transform(list_filter(got, lambda l: l.d > 0), lambda l: l.d * l.ref * (1 + pen))), avail) AS after FROM (
            SELECT config, entry_no, pen, avail, list_transform(moved, lambda l: {'t': l.t, 's': l.s, 'ref': l.ref, 'd': CASE WHEN l.d > 0 THEN least(l.d, greatest(
                avail - coalesce(list_sum(list_transform(list_filter(moved, lambda y: y.d > 0 AND (y.d < l.d OR (y.d = l.d AND y.t < l.t))), lambda y: y.d * y.ref * (1 + pen))), 0), 0) / (l.ref * (1 + pen))) ELSE l.d END}) AS got FROM (
              SELECT *, cash + coalesce(list_sum(list_transform(list_filter(moved, lambda l: l.d < 0), lambda l: -l.d * l.ref * (1 - pen))), 0) AS avail FROM (
                SELECT config, entry_no, pen, cash, list_transform(now, lambda l: {'t': l.t, 's': l.s, 'ref': l.ref, 'd': l.w * total / l.ref - l.s}) AS moved FROM (
                  SELECT *, cash + coalesce(list_sum(list_transform(now, lambda l: l.s * l.ref)), 0) AS total FROM (
                    SELECT n.config, n.entry_no, n.pen, c.cash, coalesce(list_transform(n.legs, lambda l: {'t': l.t, 'w': l.w, 'ref': l.ref, 's': coalesce(list_filter(c.held, lambda h: h.t = l.t)[1].s, 0)}), []) AS now
                    FROM chain c JOIN per n ON n.config = c.config AND n.entry_no = c.entry_no + 1) a) b) d) e) f) g""",
    "value": """
        SELECT h.config, m.bar_idx, sum(h.h.s * m.mark) AS v FROM (SELECT c.config, n.entry_idx, n.until_idx, unnest(c.held) AS h FROM chain c JOIN per n ON n.config = c.config AND n.entry_no = c.entry_no) h
        JOIN marked m ON m.ticker = h.h.t AND m.bar_idx BETWEEN h.entry_idx AND h.until_idx GROUP BY ALL""",
    "eq": """
        SELECT v.config, k.bar_idx, coalesce(c.cash, 100000.0::DOUBLE) AS cash, coalesce(c.cash, 100000.0::DOUBLE) + coalesce(x.v, 0) AS equity FROM win v JOIN cal k ON k.bar_idx BETWEEN first_idx AND last_idx
        LEFT JOIN per n ON n.config = v.config AND k.bar_idx BETWEEN n.entry_idx AND n.until_idx LEFT JOIN chain c ON c.config = n.config AND c.entry_no = n.entry_no
        LEFT JOIN value x ON x.config = v.config AND x.bar_idx = k.bar_idx""",
}

ORACLES = {
    "cash_capped_equity": sql("SELECT config, bar_idx, round(equity, 3) AS equity, round(CASE WHEN cash BETWEEN -1e-6 AND 0 THEN 0.0::DOUBLE ELSE cash END, 3) AS cash FROM eq", *USES, recursive=True, **_CAPPED),
    "cash_capped_trades": sql("""
        SELECT config, CASE WHEN x.d > 0 THEN 'buy' ELSE 'sell' END AS side, count(*) AS n_trades, round(sum(abs(x.d) * x.ref * (1 + sign(x.d) * pen)), 1) AS notional
        FROM (SELECT c.config, pen, unnest(done) AS x FROM chain c JOIN win v ON v.config = c.config) t WHERE abs(x.d) * x.ref > 0.01 GROUP BY ALL""", *USES, recursive=True, **_CAPPED),
    "effective_weights": sql(f"SELECT e.config, entry_no, entry_idx, until_idx, ticker, {r6('weight')} AS weight FROM ent e JOIN book b ON b.config = e.config AND b.bar_idx = e.bar_idx",
                             *USES, recursive=True, **book_ledger(PRICY)),
    "trading_window": sql("""
        SELECT first_idx, last_idx, count(*) AS n_cells, min(date) AS first_date, max(date) AS last_date FROM grid JOIN (
          SELECT greatest(min(bar_idx), 100) AS first_idx, max(bar_idx) AS last_idx FROM cal WHERE date BETWEEN DATE '1996-01-06' AND DATE '1999-12-31') v
        ON bar_idx BETWEEN first_idx AND last_idx GROUP BY ALL""", "grid", "cal"),
    "portfolio_equity": sql("SELECT config, bar_idx, round(equity, 3) AS equity, round(cash, 3) AS cash FROM eq", *USES, recursive=True, **book_ledger(PRICY)),
    "portfolio_equity_free": sql("SELECT config, bar_idx, round(equity, 3) AS equity FROM eq", *USES, recursive=True, **book_ledger(PRESETS["zero"])),
    "turnover": sql(f"SELECT config, bar_idx, {r6('turnover')} AS turnover FROM ({TURN}) t", *USES, recursive=True, **book_ledger(PRICY)),
    "weights_at_close": sql(f"""
        SELECT h.config, h.bar_idx, ticker, round(shares, 4) AS shares, {r6('shares * mark / equity')} AS weight FROM held h JOIN eq e ON e.config = h.config AND e.bar_idx = h.bar_idx""",
        *USES, recursive=True, **book_ledger(PRICY)),
    "implied_trades": sql("""
        SELECT config, bar_idx, ticker, side, round(quantity, 4) AS quantity, round(price, 2) AS price, round(commission, 4) AS commission, round(notional, 3) AS notional FROM trades""",
        *USES, recursive=True, **book_ledger(PRICY)),
    "benchmark_equity": sql(f"SELECT config, bar_idx, round(benchmark, 3) AS benchmark FROM ({BENCH}) b", "marked", "cal", win=window_rows({0: PRICY, 1: PRICY})),
    "cost_stress": sql(f"""
        SELECT s.config AS scenario, round(end_equity, 3) AS end_equity, {r6('cagr')} AS cagr, {r6('sharpe')} AS sharpe, {r6('max_drawdown')} AS max_drawdown,
               {r6('t.turnover')} AS annual_turnover FROM stat s JOIN (SELECT config, avg(turnover) * 252 AS turnover FROM turn GROUP BY config) t USING (config)""",
        *USES, recursive=True, **_STRESS),
    "drawdown_overlay": sql("SELECT config, bar_idx, round(equity, 3) AS equity FROM x_eq", *USES, recursive=True, **book_ledger(PRICY), **_OVERLAY),
    "daily_returns": sql(f"""
        SELECT ticker, bar_idx, coalesce({r6('mark / lag(mark) OVER (PARTITION BY ticker ORDER BY bar_idx) - 1')}, 0.0::DOUBLE) AS ret
        FROM marked WHERE mark IS NOT NULL""", "marked"),
}

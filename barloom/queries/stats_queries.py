"""Performance metrics, statistical honesty and walk-forward search."""
from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from barloom.functions import normal as NO
from barloom.functions.costs import PRESETS
from barloom.functions.scalars import per_day
from barloom.operators import honesty as H
from barloom.operators import ledger as B
from barloom.operators import limits as R
from barloom.operators import metrics as M
from barloom.operators import panel as P
from barloom.operators import schedule as S
from barloom.operators import signals as G
from barloom.operators import sizing as K
from barloom.plans import walkforward as WF
from barloom.plans.backtest import BacktestConfig
from barloom.plans.strategies import Panel, get_strategy
from barloom.queries.fixtures import CTES, MARKET, Market, r6, r6c, sql
from barloom.queries.ledger_queries import BENCH, PRICY, TURN, USES, book_ledger, ledger_steps, metric_steps
from barloom.session import cut_lineage

C = F.col


def curves(m: Market):
    """Every ticker's mark path as an equity curve."""
    return m.marked.filter("mark IS NOT NULL").select("ticker", "bar_idx", C("mark").alias("equity"))


def drawdown(spark, folder):
    return M.with_drawdown(curves(Market(spark, folder)), ["ticker"]).groupBy("ticker").agg(r6c(F.min("drawdown")).alias("max_drawdown"), r6c(F.avg("drawdown")).alias("mean_drawdown"))


def _moments(spark, folder):
    return M.return_moments(curves(Market(spark, folder)), ["ticker"])


def cagr(spark, folder):
    return _moments(spark, folder).select("ticker", r6c(M.cagr(C("start_equity"), C("end_equity"), C("n_days"))).alias("cagr"))


def sharpe(spark, folder):
    return _moments(spark, folder).select("ticker", r6c(M.sharpe(C("mean_ret"), C("sd_ret"), C("n_ret"), rf_annual=0.02)).alias("sharpe"))


def sortino(spark, folder):
    return _moments(spark, folder).select("ticker", r6c(M.sortino(C("mean_ret"), C("downside_sq"), C("n_ret"))).alias("sortino"))


def trade_stats(spark, folder):
    out = M.trade_stats(Market(spark, folder).trades, ["account"])
    return out.select("account", "n_trades", C("n_round_trips").cast("long").alias("n_round_trips"), r6c("win_rate").alias("win_rate"), r6c("avg_win", 2).alias("avg_win"),
                      r6c("avg_loss", 2).alias("avg_loss"), r6c("profit_factor", 4).alias("profit_factor"), r6c("total_commission", 4).alias("total_commission"))


METRICS = ["start_equity", "end_equity", "total_return", "cagr", "annual_vol", "sharpe", "sortino", "max_drawdown", "best_day", "worst_day", "calmar",
           "sharpe_se", "prob_sharpe_gt_zero", "min_track_years_95pct"]


def metrics(spark, folder):
    perf = M.metrics(curves(Market(spark, folder)), ["ticker"])
    return perf.select("ticker", "n_days", *[r6c(c).alias(c) for c in METRICS])


def beta_alpha(spark, folder):
    m = Market(spark, folder)
    market = m.marked.filter(C("ticker") == MARKET).select("bar_idx", C("mark").alias("benchmark"))
    paired = curves(m).join(per_day(market), "bar_idx")
    out = M.beta_alpha(paired.select("ticker", "bar_idx", "equity"), paired.select("ticker", "bar_idx", "benchmark"), ["ticker"])
    return out.select("ticker", r6c("beta").alias("beta"), r6c("alpha_annual").alias("alpha_annual"))


def norm_ppf_cdf(spark, folder):
    p = (C("l_quantity") + C("l_discount") + 0.001) / 52.0
    grid = Market(spark, folder).table("lineitem").groupBy(r6c(p, 9).alias("p")).agg(F.count("*").alias("n"))
    z = grid.withColumn("z", NO.norm_ppf(C("p")))
    return z.select("p", "n", r6c("z").alias("z"), r6c(NO.norm_cdf(C("z") * 2 - 0.3)).alias("cdf"))


def honesty_report(spark, folder):
    out = H.with_honesty(_moments(spark, folder))
    return out.select("ticker", C("n_ret").alias("n_obs"), *[r6c(c).alias(c) for c in ("sharpe_annual", "sharpe_se_annual", "psr_zero", "min_track_years", "skew", "kurt")])


def probabilistic_sharpe(spark, folder):
    """Against a benchmark Sharpe of 0.05 a day, with normal moments."""
    sr = F.try_divide("mean_ret", "sd_ret")
    m = _moments(spark, folder).withColumn("sr", sr).filter("sr IS NOT NULL")
    return m.select("ticker", r6c(H.sharpe_std_error(C("sr"), C("n_ret"), F.lit(0.0), F.lit(3.0))).alias("se"),
                    r6c(H.probabilistic_sharpe(C("sr"), F.lit(0.05), C("n_ret"), F.lit(0.0), F.lit(3.0))).alias("psr"))


def min_track_record(spark, folder):
    m = _moments(spark, folder).withColumn("sr", F.try_divide("mean_ret", "sd_ret")).filter("sr IS NOT NULL")
    return m.select("ticker", r6c(H.min_track_record_length(C("sr"), F.lit(0.01), F.lit(-0.3), F.lit(5.0), 0.9), 3).alias("bars"))


def deflated_sharpe(spark, folder):
    """Every ticker judged against all tickers of its sector as trials."""
    m = Market(spark, folder)
    named = P.with_sector(M.return_moments(curves(m), ["ticker"]), m.sectors).withColumn("sharpe", M.sharpe(C("mean_ret"), C("sd_ret"), C("n_ret")))
    trials = named.groupBy("sector").agg(F.count("sharpe").alias("n_trials"), F.stddev_samp("sharpe").alias("trial_sd"))
    out = H.with_honesty(named.join(trials, "sector"), n_trials="n_trials", trial_sd="trial_sd")
    return out.select("ticker", "n_trials", *[r6c(c).alias(c) for c in ("dsr", "expected_max_sharpe_annual")], r6c("min_backtest_years", 4).alias("min_backtest_years"))


# ---- walk-forward over four momentum settings -----------------------------------------------------
GRID = {"lookback": [126, 252], "top_n": [5, 10]}
TRAIN, TEST, WARM = 378, 126, 253
RETAIL = PRESETS["retail"]


def search(m: Market) -> WF.WalkForward:
    """Monthly equal-weight momentum, 95 % invested, for the four settings of the grid."""
    m.materialise()
    monthly = S.decision_dates(m.days, "monthly")
    scored = m.grid
    for lookback in GRID["lookback"]:
        scored = G.with_momentum_score(scored, lookback, 21, MARKET).withColumnRenamed("score", f"s{lookback}")
    rows = scored.select("date", "bar_idx", "ticker", *[f"s{n}" for n in GRID["lookback"]]).join(per_day(monthly.select("date")), "date", "left_semi")
    sets = F.array(*[F.struct(F.lit(i * 2 + j).alias("config"), F.lit(n).alias("limit"), C(f"s{lb}").alias("score"))
                     for i, lb in enumerate(GRID["lookback"]) for j, n in enumerate(GRID["top_n"])])
    spread = rows.select("date", "bar_idx", "ticker", F.explode(sets).alias("c")).select("date", "bar_idx", "ticker", "c.*")
    top = K.pick_top(spread, max(GRID["top_n"]), keys=["config", "date"]).filter(C("rank") <= C("limit"))
    weights = K.equal_weight(top, 0.95, ["config", "date"]).select("config", "bar_idx", "ticker", "weight")
    return WF.WalkForward(weights, monthly.select("bar_idx"), WF.folds(m.days, WARM, TRAIN, TEST), m.marked, 4, "sharpe", RETAIL)


def _long(df, *names):
    return df.withColumns({n: C(n).cast("long") for n in names})


def param_grid(spark, folder):
    """The search grid for every market segment that has customers."""
    segments = Market(spark, folder).table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return WF.param_grid(segments, {**GRID, "sizing": ["equal", "inverse_vol"]})


def folds(spark, folder):
    return WF.folds(Market(spark, folder).days, WARM, TRAIN, TEST)


def walk_forward_select(spark, folder):
    wf = search(Market(spark, folder))
    return _long(wf.trials, "config").select("fold", "config", r6c("sharpe", 5).alias("sharpe"), r6c("cagr", 5).alias("cagr"), r6c("end_equity", 2).alias("end_equity"))


def walk_forward_test(spark, folder):
    out = _long(search(Market(spark, folder)).tests, "config")
    return out.select("fold", "config", "train_start", "test_start", "test_end", "test_bars", r6c("train_score", 5).alias("train_score"), r6c("test_sharpe", 5).alias("test_sharpe"),
                      r6c("test_return", 5).alias("test_return"), r6c("test_max_drawdown", 5).alias("test_max_drawdown"))


def walk_forward_dsr(spark, folder):
    out = _long(search(Market(spark, folder)).winners, "config")
    return out.select("fold", "config", "n_trials", r6c("train_dsr", 5).alias("train_dsr"), r6c("train_cagr", 5).alias("train_cagr"))


def stitched_equity(spark, folder):
    return search(Market(spark, folder)).stitched.select("fold", "bar_idx", r6c("equity", 2).alias("equity"))


def walk_forward_efficiency(spark, folder):
    return search(Market(spark, folder)).efficiency().select("n_folds", "n_trials", *[r6c(c, 5).alias(c) for c in ("train_cagr", "oos_cagr", "efficiency")])


def parameter_drift(spark, folder):
    return search(Market(spark, folder)).parameter_drift().select(r6c("parameter_drift").alias("parameter_drift"), "n_folds", "n_trials_total")


def _tested(wf):
    out = _long(wf.tests, "config")
    return out.select("fold", "config", "n_trials", "train_start", "test_start", "test_end", r6c("train_score", 5).alias("train_score"), r6c("test_sharpe", 5).alias("test_sharpe"),
                      r6c("test_return", 5).alias("test_return"))


INVESTED = R.RiskLimits(max_weight=1.0, max_gross=0.95)
LOOKBACKS, ENTRIES = [252, 126, 900], [-1.0, -1.5, -2.0]


def walk_forward_lookback_grid(spark, folder):
    """A search over lookbacks of which one warms up beyond the first training windows; the first one starts the folds."""
    m = Market(spark, folder)
    strategy = get_strategy("momentum", {"lookback": LOOKBACKS}, top_n=5, sizing="equal", vol_target=0, max_per_sector=0, market_filter=None, filter_sma=50)
    return _tested(WF.walk_forward(Panel(m.grid, m.days), strategy, BacktestConfig(limits=INVESTED, benchmark=None), TRAIN, TEST))


def walk_forward_mean_reversion(spark, folder):
    """A search over a strategy with a memory: every training and test window starts without holdings."""
    m = Market(spark, folder)
    m.days = cut_lineage(m.days)
    strategy = get_strategy("mean_reversion", {"z_entry": ENTRIES}, max_names=3, rebalance="weekly")
    return _tested(WF.walk_forward(Panel(m.grid, m.days), strategy, BacktestConfig(limits=INVESTED, benchmark=None), TRAIN, TEST))


OOS = ("n_days", "start_equity", "end_equity", "cagr", "sharpe", "max_drawdown", "annual_turnover", "n_trades", "n_round_trips", "win_rate", "total_commission",
       "benchmark_total_return", "benchmark_cagr", "benchmark_sharpe", "beta", "alpha_annual")
COUNTS = ("n_days", "n_trades", "n_round_trips")


def walk_forward_metrics(spark, folder):
    """All out-of-sample days together, beside the benchmark over the same days."""
    out = replace(search(Market(spark, folder)), benchmark=MARKET).metrics()
    return out.select(*[C(c).cast("long").alias(c) if c in COUNTS else r6c(c, 4).alias(c) for c in OOS])


def walk_forward_benchmark(spark, folder):
    return replace(search(Market(spark, folder)), benchmark=MARKET).stitched_benchmark.select("fold", "bar_idx", r6c("benchmark", 2).alias("benchmark"))


QUERIES = {f.__name__: f for f in (
    walk_forward_lookback_grid, walk_forward_mean_reversion, walk_forward_metrics, walk_forward_benchmark, drawdown, cagr, sharpe, sortino, trade_stats, metrics, beta_alpha, norm_ppf_cdf, honesty_report, probabilistic_sharpe, min_track_record,
    deflated_sharpe, param_grid, folds, walk_forward_select, walk_forward_test, walk_forward_dsr, stitched_equity, walk_forward_efficiency, parameter_drift)}


# ---- SQL ------------------------------------------------------------------------------------------
def _poly(x: str, cs: list[float]) -> str:
    out = f"{cs[0]!r}::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    s = f"abs({x})"
    tail = f"""CASE WHEN {s} > 37 THEN 0.0::DOUBLE WHEN {s} < 7.07 THEN exp(-{s} * {s} / 2) * {_poly(s, NO.CDF_NUM)} / {_poly(s, NO.CDF_DEN)}
               ELSE exp(-{s} * {s} / 2) / sqrt(2 * pi()) / ({s} + 1 / ({s} + 2 / ({s} + 3 / ({s} + 4 / ({s} + 0.65))))) END"""
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE ({tail}) END)"


def ppf_sql(p: str) -> str:
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    c = f"({p} - 0.5)"
    r = f"({c} * {c})"
    return f"""(CASE WHEN {p} < 0.02425 THEN {_poly(lo, NO.PPF_C)} / {_poly(lo, NO.PPF_D)}
        WHEN {p} > 0.97575 THEN -({_poly(hi, NO.PPF_C)}) / {_poly(hi, NO.PPF_D)} ELSE {_poly(r, NO.PPF_A)} * {c} / {_poly(r, NO.PPF_B)} END)"""


CTES["curve"] = (["marked"], "SELECT ticker, bar_idx, mark AS equity FROM marked WHERE mark IS NOT NULL")
_STAT = metric_steps("curve", "ticker")
_VAR = "greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12::DOUBLE)"


def judged_steps(stat: str) -> dict[str, str]:
    return {"judged": f"""
        SELECT *, CASE WHEN ok THEN sr / se END AS z, CASE WHEN ok AND sr > 0 THEN 1 + {_VAR} * pow({ppf_sql('0.95::DOUBLE')} / sr, 2) ELSE 'inf'::DOUBLE END AS mtrl FROM (
          SELECT *, sqrt({_VAR} / (n - 1)) AS se FROM (SELECT *, n >= 3 AND sd > 0 AS ok, CASE WHEN sd > 0 THEN mean / sd END AS sr FROM {stat}) a) b"""}


def deflate_steps(judged: str, key: str) -> dict[str, str]:
    """Deflated part over `judged` rows that carry n_trials and trial_sd (annual)."""
    blend = f"({1 - NO.EULER_GAMMA!r}::DOUBLE * {ppf_sql('(1 - 1 / n_trials::DOUBLE)')} + {NO.EULER_GAMMA!r}::DOUBLE * {ppf_sql(f'(1 - 1 / (n_trials * {math.e!r}::DOUBLE))')})"
    return {"deflated": f"""
        SELECT *, CASE WHEN se > 0 THEN {cdf_sql('zz')} ELSE 0 END AS dsr, 2 * ln(n_trials) / pow(greatest(sr0 * sqrt(252.0::DOUBLE), 1e-9::DOUBLE), 2) AS mby FROM (
          SELECT *, (sr - sr0) / se AS zz FROM (
            SELECT *, trial_sd / sqrt(252.0::DOUBLE) * {blend} AS sr0 FROM {judged} WHERE n_trials > 1) d) e"""}


_TRIPS = {
    "ordered": "SELECT *, row_number() OVER (PARTITION BY account, ticker ORDER BY date, seq) AS rn FROM trades",
    "walk": """
        SELECT account, ticker, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS q, 0.0::DOUBLE AS basis, CAST(NULL AS DOUBLE) AS pnl FROM (SELECT DISTINCT account, ticker FROM trades) d
        UNION ALL
        SELECT account, ticker, rn, CASE WHEN side = 'buy' THEN q + quantity WHEN q - x <= 1e-12 THEN 0.0::DOUBLE ELSE q - x END,
               CASE WHEN side = 'buy' THEN basis + quantity * price + commission WHEN q - x <= 1e-12 THEN 0.0::DOUBLE ELSE basis - x * basis / q END,
               CASE WHEN side = 'sell' AND q > 0 THEN x * price - x * (basis / q) - commission END
        FROM (SELECT o.*, w.q, w.basis, least(o.quantity, w.q) AS x FROM walk w JOIN ordered o ON o.account = w.account AND o.ticker = w.ticker AND o.rn = w.rn + 1) s""",
}


def fold_rows(warm: int) -> str:
    """Training and test windows from bar `warm` on."""
    first = warm + TRAIN
    return f"""
        SELECT fold, {warm} + fold * {TEST} AS train_start, {first - 1} + fold * {TEST} AS train_end, {first} + fold * {TEST} AS test_start,
               least({first + TEST - 1} + fold * {TEST}, n - 1) AS test_end
        FROM (SELECT CAST(unnest(generate_series(0, 100)) AS BIGINT) AS fold) f, (SELECT count(*) AS n FROM cal) c
        WHERE {first + 1} + fold * {TEST} < n AND least({first + TEST - 1} + fold * {TEST}, n - 1) > {first} + fold * {TEST}"""


_WF_BASE = {
    "scores": " UNION ALL ".join(f"""
        SELECT {i} AS lb, ticker, date, bar_idx, s AS score FROM (
          SELECT *, lag(close, 21) OVER (PARTITION BY ticker ORDER BY bar_idx) / lag(close, {lb}) OVER (PARTITION BY ticker ORDER BY bar_idx) - 1 AS s FROM grid) x
        WHERE s IS NOT NULL AND close IS NOT NULL AND ticker <> '{MARKET}'""" for i, lb in enumerate(GRID["lookback"])),
    "cfgbook": " UNION ALL ".join(f"""
        SELECT {i * 2 + j} AS config, bar_idx, ticker, 0.95::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM (
          SELECT s.* FROM scores s JOIN monthly USING (date) WHERE lb = {i} QUALIFY row_number() OVER (PARTITION BY s.date ORDER BY score DESC, ticker) <= {n}) x"""
        for i, _ in enumerate(GRID["lookback"]) for j, n in enumerate(GRID["top_n"])),
    "foldt": fold_rows(WARM),
    "twin": f"""SELECT fold * 10 + c AS config, train_start AS first_idx, train_end AS last_idx, {RETAIL.penalty}::DOUBLE AS pen, 0.0::DOUBLE AS pct, 0.0::DOUBLE AS ps, 0.0::DOUBLE AS mn
        FROM foldt CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS c) k""",
    "tdec": "SELECT config, bar_idx FROM twin CROSS JOIN monthly",
    "tbook": "SELECT v.config, b.bar_idx, ticker, weight FROM twin v JOIN cfgbook b ON b.config = v.config % 10",
    **ledger_steps("tbook", "twin", "tdec", "t_"), **metric_steps("t_eq", "config", "t_"),
    "spread": "SELECT config // 10 AS fold, count(sharpe) AS n_trials, stddev_samp(sharpe) AS trial_sd FROM t_stat GROUP BY 1",
    "won": """
        SELECT t.*, t.config // 10 AS fold, t.config % 10 AS cfg, n_trials, trial_sd FROM t_stat t JOIN spread s ON s.fold = t.config // 10
        QUALIFY row_number() OVER (PARTITION BY t.config // 10 ORDER BY round(sharpe, 9) DESC, t.config) = 1""",
}
_WF_TEST = {
    "vwin": f"""SELECT won.config, test_start AS first_idx, test_end AS last_idx, {RETAIL.penalty}::DOUBLE AS pen, 0.0::DOUBLE AS pct, 0.0::DOUBLE AS ps, 0.0::DOUBLE AS mn
        FROM won JOIN foldt USING (fold)""",
    "vdec": "SELECT config, bar_idx FROM vwin CROSS JOIN monthly",
    "vbook": "SELECT v.config, b.bar_idx, ticker, weight FROM vwin v JOIN cfgbook b ON b.config = v.config % 10",
    **ledger_steps("vbook", "vwin", "vdec", "v_"), **metric_steps("v_eq", "config", "v_"),
    "stitch": """SELECT config // 10 AS fold, bar_idx, 100000.0::DOUBLE * exp(sum(ln(1 + coalesce(r, 0.0::DOUBLE))) OVER (ORDER BY config // 10, bar_idx)) AS equity FROM v_ret""",
}
_WF_USES = ("grid", "marked", "monthly", "cal")


def _metric(c: str) -> str:
    return {
        "total_return": "end_equity / start_equity - 1", "annual_vol": "coalesce(sd, 0) * sqrt(252.0::DOUBLE)",
        "sortino": "CASE WHEN down > 0 THEN mean / sqrt(down / n) * sqrt(252.0::DOUBLE) ELSE 0.0::DOUBLE END", "best_day": "best", "worst_day": "worst",
        "calmar": "CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0.0::DOUBLE END", "sharpe_se": "CASE WHEN ok THEN se * sqrt(252.0::DOUBLE) ELSE 'inf'::DOUBLE END",
        "prob_sharpe_gt_zero": f"CASE WHEN ok THEN {cdf_sql('z')} ELSE 0.0::DOUBLE END", "min_track_years_95pct": "mtrl / 252",
    }.get(c, c)


ORACLES = {
    "drawdown": sql(f"SELECT ticker, {r6('min(dd)')} AS max_drawdown, {r6('avg(dd)')} AS mean_drawdown FROM ret GROUP BY ticker", "curve", **_STAT),
    "cagr": sql(f"SELECT ticker, {r6('cagr')} AS cagr FROM stat", "curve", **_STAT),
    "sharpe": sql(f"SELECT ticker, CASE WHEN sd > 0 THEN {r6('(mean - 0.02::DOUBLE / 252) / sd * sqrt(252.0::DOUBLE)')} ELSE 0.0::DOUBLE END AS sharpe FROM stat", "curve", **_STAT),
    "sortino": sql(f"SELECT ticker, {r6(_metric('sortino'))} AS sortino FROM stat", "curve", **_STAT),
    "trade_stats": sql(f"""
        SELECT t.account, n_trades, n_round_trips, {r6('wins / n_round_trips')} AS win_rate, round(won / nullif(wins, 0), 2) AS avg_win, round(lost / nullif(n_round_trips - wins, 0), 2) AS avg_loss,
               round(won / -lost, 4) AS profit_factor, round(total_commission, 4) AS total_commission
        FROM (SELECT account, count(*) AS n_trades, sum(commission) AS total_commission FROM trades GROUP BY 1) t
        JOIN (SELECT account, count(pnl) AS n_round_trips, count(*) FILTER (pnl > 0) AS wins, sum(pnl) FILTER (pnl > 0) AS won, sum(pnl) FILTER (pnl <= 0) AS lost
              FROM walk GROUP BY 1) w USING (account)""", "trades", recursive=True, **_TRIPS),
    "metrics": sql(f"SELECT ticker, n_days, {', '.join(f'{r6(_metric(c))} AS {c}' for c in METRICS)} FROM judged", "curve", **_STAT, **judged_steps("stat")),
    "beta_alpha": sql(f"""
        SELECT ticker, {r6('beta')} AS beta, {r6('(mr - beta * mb) * 252')} AS alpha_annual FROM (
          SELECT ticker, regr_slope(r, b) AS beta, avg(r) AS mr, avg(b) AS mb FROM (
            SELECT c.ticker, c.equity / lag(c.equity) OVER w - 1 AS r, k.mark / lag(k.mark) OVER w - 1 AS b
            FROM curve c JOIN marked k ON k.ticker = '{MARKET}' AND k.bar_idx = c.bar_idx WINDOW w AS (PARTITION BY c.ticker ORDER BY c.bar_idx)) x
          WHERE r IS NOT NULL AND b IS NOT NULL GROUP BY ticker) y""", "curve"),
    "norm_ppf_cdf": sql(f"""
        SELECT p, n, {r6('z')} AS z, {r6(cdf_sql('zz'))} AS cdf FROM (SELECT *, z * 2 - 0.3::DOUBLE AS zz FROM (SELECT p, n, {ppf_sql('p')} AS z FROM (
          SELECT round((l_quantity + l_discount + 0.001::DOUBLE) / 52.0::DOUBLE, 9) AS p, count(*) AS n FROM lineitem GROUP BY 1) a) b) c"""),
    "honesty_report": sql(f"""
        SELECT ticker, n AS n_obs, {r6('coalesce(sr, 0) * sqrt(252.0::DOUBLE)')} AS sharpe_annual, {r6(_metric('sharpe_se'))} AS sharpe_se_annual,
               {r6(_metric('prob_sharpe_gt_zero'))} AS psr_zero, {r6('mtrl / 252')} AS min_track_years, {r6('skew')} AS skew, {r6('kurt')} AS kurt FROM judged""",
        "curve", **_STAT, **judged_steps("stat")),
    "probabilistic_sharpe": sql(f"""
        SELECT ticker, {r6('se')} AS se, {r6(cdf_sql('z'))} AS psr FROM (SELECT *, (sr - 0.05::DOUBLE) / se AS z FROM (
          SELECT ticker, sr, sqrt((1 + 0.5::DOUBLE * sr * sr) / (n - 1)) AS se FROM (SELECT *, mean / sd AS sr FROM stat WHERE sd > 0) a) b) c""", "curve", **_STAT),
    "min_track_record": sql(f"""
        SELECT ticker, CASE WHEN sr <= 0.01 THEN 'inf'::DOUBLE ELSE round(1 + greatest(1 + 0.3::DOUBLE * sr + sr * sr, 1e-12::DOUBLE) * pow({ppf_sql('0.9::DOUBLE')} / (sr - 0.01::DOUBLE), 2), 3) END AS bars
        FROM (SELECT *, mean / sd AS sr FROM stat WHERE sd > 0) a""", "curve", **_STAT),
    "deflated_sharpe": sql(f"""
        SELECT ticker, n_trials, {r6('dsr')} AS dsr, {r6('sr0 * sqrt(252.0::DOUBLE)')} AS expected_max_sharpe_annual, round(mby, 4) AS min_backtest_years
        FROM (SELECT ticker, n_trials FROM judged) j LEFT JOIN (SELECT ticker, dsr, sr0, mby FROM deflated) d USING (ticker)""",
        "curve", "sectors", **_STAT,
        tried="""SELECT *, count(sharpe) OVER (PARTITION BY sector) AS n_trials, stddev_samp(sharpe) OVER (PARTITION BY sector) AS trial_sd
                 FROM (SELECT stat.*, coalesce(sector, 'Unknown') AS sector FROM stat LEFT JOIN sectors USING (ticker)) s""",
        **judged_steps("tried"), **deflate_steps("judged", "ticker")),
    "param_grid": sql("""
        SELECT c_mktsegment, n, lookback, top_n, sizing, ((i - 1) * 2 + (j - 1)) * 2 + (k - 1) AS config FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) s,
          (SELECT unnest([126, 252]) AS lookback, unnest([1, 2])::BIGINT AS i) a, (SELECT unnest([5, 10]) AS top_n, unnest([1, 2])::BIGINT AS j) b,
          (SELECT unnest(['equal', 'inverse_vol']) AS sizing, unnest([1, 2])::BIGINT AS k) c"""),
    "folds": sql("SELECT * FROM foldt", "cal", foldt=_WF_BASE["foldt"]),
    "walk_forward_select": sql("""
        SELECT config // 10 AS fold, config % 10 AS config, round(sharpe, 5) AS sharpe, round(cagr, 5) AS cagr, round(end_equity, 2) AS end_equity FROM t_stat""",
        *_WF_USES, recursive=True, **_WF_BASE),
    "walk_forward_test": sql("""
        SELECT won.fold, cfg AS config, train_start, test_start, test_end, test_end - test_start + 1 AS test_bars, round(won.sharpe, 5) AS train_score, round(v.sharpe, 5) AS test_sharpe,
               round(v.end_equity / v.start_equity - 1, 5) AS test_return, round(v.max_drawdown, 5) AS test_max_drawdown
        FROM won JOIN foldt USING (fold) JOIN v_stat v ON v.config = won.config""", *_WF_USES, recursive=True, **_WF_BASE, **_WF_TEST),
    "walk_forward_dsr": sql("SELECT fold, cfg AS config, n_trials, round(dsr, 5) AS train_dsr, round(cagr, 5) AS train_cagr FROM deflated",
                            *_WF_USES, recursive=True, **_WF_BASE, **judged_steps("won"), **deflate_steps("judged", "fold")),
    "stitched_equity": sql("SELECT fold, bar_idx, round(equity, 2) AS equity FROM stitch", *_WF_USES, recursive=True, **_WF_BASE, **_WF_TEST),
    "walk_forward_efficiency": sql("""
        SELECT n_folds, n_trials, round(train_cagr, 5) AS train_cagr, round(oos, 5) AS oos_cagr, CASE WHEN train_cagr > 0 THEN round(oos / train_cagr, 5) END AS efficiency
        FROM (SELECT count(*) AS n_folds, CAST(sum(n_trials) AS BIGINT) AS n_trials, sum(cagr * (test_end - test_start + 1)) / sum(test_end - test_start + 1) AS train_cagr FROM won JOIN foldt USING (fold)) a,
             (SELECT pow(max_by(equity, bar_idx) / min_by(equity, bar_idx), 252.0::DOUBLE / (count(*) - 1)) - 1 AS oos FROM stitch) b""",
        *_WF_USES, recursive=True, **_WF_BASE, **_WF_TEST),
    "parameter_drift": sql(f"""
        SELECT {r6('avg(CASE WHEN prev IS NOT NULL THEN (CASE WHEN prev <> cfg THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END)')} AS parameter_drift, count(*) AS n_folds, count(*) * 4 AS n_trials_total
        FROM (SELECT cfg, lag(cfg) OVER (ORDER BY fold) AS prev FROM won) w""", *_WF_USES, recursive=True, **_WF_BASE),
}


# ---- SQL for the complete book metrics: accounting, statistics, round trips and benchmark ------------
_BOOK_TRIPS = {
    "ordered": "SELECT *, row_number() OVER (PARTITION BY config, ticker ORDER BY bar_idx) AS rn FROM trades",
    "walk": _TRIPS["walk"].replace("account", "config"),
    "trips": """
        SELECT config, count(pnl) AS n_round_trips, count(*) FILTER (pnl > 0) AS wins, sum(pnl) FILTER (pnl > 0) AS won, sum(pnl) FILTER (pnl <= 0) AS lost FROM walk GROUP BY 1""",
    "fees": "SELECT config, count(*) AS n_trades, sum(commission) AS total_commission FROM trades GROUP BY 1",
    "bench": BENCH, "bcurve": "SELECT config, bar_idx, benchmark AS equity FROM bench", **metric_steps("bcurve", "config", "b_"),
    "slope": """
        SELECT config, regr_slope(r, b) AS beta, (avg(r) - regr_slope(r, b) * avg(b)) * 252 AS alpha_annual FROM (
          SELECT x.config, x.r, y.r AS b FROM ret x JOIN b_ret y ON y.config = x.config AND y.bar_idx = x.bar_idx) z WHERE r IS NOT NULL AND b IS NOT NULL GROUP BY config""",
    "turn": TURN,
}
_PARTS = {
    **{c: f"j.{c}" if c in ("start_equity", "end_equity", "max_drawdown", "cagr", "sharpe") else _metric(c) for c in METRICS},
    "annual_turnover": "t.turnover", "win_rate": "wins / n_round_trips", "avg_win": "won / nullif(wins, 0)", "avg_loss": "lost / nullif(n_round_trips - wins, 0)",
    "profit_factor": "won / -lost", "total_commission": "total_commission", "benchmark_total_return": "b_end / b_start - 1", "benchmark_cagr": "b_cagr",
    "benchmark_sharpe": "b_sharpe", "benchmark_max_drawdown": "b_dd", "excess_cagr": "j.cagr - b_cagr", "beta": "beta", "alpha_annual": "alpha_annual",
}
ORACLES["portfolio_metrics"] = sql(f"""
    SELECT config, n_days, n_trades, n_round_trips, {', '.join(f"round({e}, 4) + 0.0::DOUBLE AS {n}" for n, e in _PARTS.items())}
    FROM judged j JOIN (SELECT config, avg(turnover) * 252 AS turnover FROM turn GROUP BY 1) t USING (config) JOIN trips USING (config) JOIN fees USING (config)
    JOIN (SELECT config, start_equity AS b_start, end_equity AS b_end, cagr AS b_cagr, sharpe AS b_sharpe, max_drawdown AS b_dd FROM b_stat) b USING (config) JOIN slope USING (config)""",
    *USES, recursive=True, **book_ledger(PRICY), **metric_steps("eq"), **judged_steps("stat"), **_BOOK_TRIPS)


# ---- SQL for searches with unlike warmups, with a memory, and for the out-of-sample numbers ----------
def _windows(warmups: list[int], which: str) -> str:
    """Training or test windows (config = fold * 10 + set) from a set's own warmup on, as far as any bar is left."""
    cost = f"{RETAIL.penalty}::DOUBLE AS pen, 0.0::DOUBLE AS pct, 0.0::DOUBLE AS ps, 0.0::DOUBLE AS mn"
    sets = f"(SELECT CAST(unnest({list(range(len(warmups)))}) AS BIGINT) AS c, CAST(unnest({warmups}) AS BIGINT) AS warm) k"
    pairs = f"foldt CROSS JOIN {sets}" if which == "train" else f"foldt JOIN won USING (fold) JOIN {sets} ON c = cfg"
    return f"SELECT fold * 10 + c AS config, greatest({which}_start, warm) AS first_idx, {which}_end AS last_idx, {cost} FROM {pairs} WHERE greatest({which}_start, warm) <= {which}_end"


def _search(warmups: list[int], schedule: str, book) -> dict[str, str]:
    """Steps of a search whose weights `book(windows, prefix)` gives as steps that end in `<prefix>book`."""
    return {"foldt": fold_rows(warmups[0]), "twin": _windows(warmups, "train"), "tdec": f"SELECT config, bar_idx FROM twin CROSS JOIN {schedule}", **book("twin", "t"),
            **ledger_steps("tbook", "twin", "tdec", "t_"), **metric_steps("t_eq", "config", "t_"), "spread": _WF_BASE["spread"], "won": _WF_BASE["won"],
            "vwin": _windows(warmups, "test"), "vdec": f"SELECT config, bar_idx FROM vwin CROSS JOIN {schedule}", **book("vwin", "v"),
            **ledger_steps("vbook", "vwin", "vdec", "v_"), **metric_steps("v_eq", "config", "v_")}


def _ranked_book(win: str, p: str) -> dict[str, str]:
    return {f"{p}book": f"SELECT v.config, b.bar_idx, ticker, weight FROM {win} v JOIN cfgbook b ON b.config = v.config % 10"}


def _kept_book(win: str, p: str) -> dict[str, str]:
    """Holdings week after week from none at the start of each window."""
    return {
        f"{p}walk": f"""
            SELECT v.config, v.last_idx, (SELECT min(k) FROM wk WHERE wk.bar_idx >= v.first_idx) - 1 AS k, CAST(-1 AS BIGINT) AS bar_idx, CAST([] AS VARCHAR[]) AS held FROM {win} v
            UNION ALL
            SELECT w.config, w.last_idx, wk.k, wk.bar_idx, coalesce(list_transform(list_filter(c.names, lambda n: n.e OR list_contains(w.held, n.t)), lambda n: n.t)[1:3], CAST([] AS VARCHAR[]))
            FROM {p}walk w JOIN wk ON wk.k = w.k + 1 AND wk.bar_idx <= w.last_idx LEFT JOIN cands c ON c.cfg = w.config % 10 AND c.k = wk.k""",
        f"{p}book": f"SELECT config, bar_idx, unnest(held) AS ticker, 0.95::DOUBLE / len(held) AS weight FROM {p}walk WHERE len(held) > 0",
    }


_SEEN = """
    SELECT fold, cfg AS config, n_trials, train_start, test_start, test_end, round(won.sharpe, 5) AS train_score, round(v.sharpe, 5) AS test_sharpe, round(v.end_equity / v.start_equity - 1, 5) AS test_return
    FROM won JOIN foldt USING (fold) JOIN v_stat v ON v.config = won.config"""
ORACLES["walk_forward_lookback_grid"] = sql(
    _SEEN, *_WF_USES, recursive=True,
    cfgbook=" UNION ALL ".join(f"""
        SELECT {i} AS config, bar_idx, ticker, 0.95::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM (
          SELECT * FROM (SELECT *, lag(close, 21) OVER (PARTITION BY ticker ORDER BY bar_idx) / lag(close, {lb}) OVER (PARTITION BY ticker ORDER BY bar_idx) - 1 AS score FROM grid) x
          SEMI JOIN monthly USING (date) WHERE score IS NOT NULL AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 5) y"""
                           for i, lb in enumerate(LOOKBACKS)),
    **_search([n + 1 for n in LOOKBACKS], "monthly", _ranked_book))
ORACLES["walk_forward_mean_reversion"] = sql(
    _SEEN, *_WF_USES, "weekly", "zs", recursive=True,
    wk="SELECT bar_idx, row_number() OVER (ORDER BY bar_idx) AS k FROM weekly",
    cands=f"""SELECT cfg, k, list({{'t': ticker, 'e': uptrend AND z < entry}} ORDER BY z, ticker) AS names
        FROM zs JOIN wk USING (bar_idx) CROSS JOIN (SELECT unnest({list(range(len(ENTRIES)))}) AS cfg, unnest({ENTRIES})::DOUBLE AS entry) e WHERE ok AND z < 0 GROUP BY cfg, k""",
    **_search([101] * len(ENTRIES), "weekly", _kept_book))

_OOS = {
    "bench": f"""SELECT v.config, m.bar_idx, mark / first_value(mark) OVER (PARTITION BY v.config ORDER BY m.bar_idx) * 100000.0::DOUBLE AS benchmark
        FROM vwin v JOIN marked m ON m.ticker = '{MARKET}' AND m.bar_idx BETWEEN first_idx AND last_idx""",
    "bstitch": """SELECT config // 10 AS fold, bar_idx, 100000.0::DOUBLE * exp(sum(ln(1 + coalesce(r, 0.0::DOUBLE))) OVER (ORDER BY config // 10, bar_idx)) AS benchmark
        FROM (SELECT config, bar_idx, benchmark / lag(benchmark) OVER (PARTITION BY config ORDER BY bar_idx) - 1 AS r FROM bench) b""",
    "oos": "SELECT 'oos' AS run, row_number() OVER (ORDER BY fold, bar_idx) AS bar_idx, equity FROM stitch",
    "other": "SELECT 'oos' AS run, row_number() OVER (ORDER BY fold, bar_idx) AS bar_idx, benchmark AS equity FROM bstitch",
    **metric_steps("oos", "run", "o_"), **metric_steps("other", "run", "b_"),
    "ordered": "SELECT *, row_number() OVER (PARTITION BY config, ticker ORDER BY bar_idx) AS rn FROM v_trades",
    "walk": _TRIPS["walk"].replace("account", "config").replace("FROM trades", "FROM v_trades"),
    "trips": "SELECT count(pnl) AS n_round_trips, count(*) FILTER (pnl > 0) AS wins FROM walk",
    "fees": "SELECT count(*) AS n_trades, sum(commission) AS total_commission FROM v_trades",
    "turned": """SELECT avg(coalesce(n, 0.0::DOUBLE) / equity) * 252 AS annual_turnover FROM v_eq e
        LEFT JOIN (SELECT config, bar_idx, sum(notional) AS n FROM v_trades GROUP BY ALL) t ON t.config = e.config AND t.bar_idx = e.bar_idx""",
    "slope": """SELECT regr_slope(r, b) AS beta, (avg(r) - regr_slope(r, b) * avg(b)) * 252 AS alpha_annual FROM (
        SELECT x.r, y.r AS b FROM o_ret x JOIN b_ret y ON y.bar_idx = x.bar_idx) z WHERE r IS NOT NULL AND b IS NOT NULL""",
}
_FROM = {"win_rate": "wins / n_round_trips", "benchmark_total_return": "b.end_equity / b.start_equity - 1", "benchmark_cagr": "b.cagr", "benchmark_sharpe": "b.sharpe",
         **{c: f"o.{c}" for c in ("n_days", "start_equity", "end_equity", "cagr", "sharpe", "max_drawdown")}}
ORACLES["walk_forward_metrics"] = sql(
    "SELECT " + ", ".join(f"{_FROM.get(c, c)} AS {c}" if c in COUNTS else f"round({_FROM.get(c, c)}, 4) + 0.0::DOUBLE AS {c}" for c in OOS) + " FROM o_stat o, b_stat b, trips, fees, turned, slope",
    *_WF_USES, recursive=True, **_WF_BASE, **_WF_TEST, **_OOS)
ORACLES["walk_forward_benchmark"] = sql("SELECT fold, bar_idx, round(benchmark, 2) AS benchmark FROM bstitch", *_WF_USES, recursive=True, **_WF_BASE, **_WF_TEST,
                                        **{k: _OOS[k] for k in ("bench", "bstitch")})

"""Searches over windows, strategies with a memory, and books that end where the cash does."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import costs as C
from barloom.operators import ledger as G
from barloom.operators import limits as R
from barloom.operators import panel as P
from barloom.operators import signals as SG
from barloom.plans import walkforward as WF
from barloom.plans.backtest import BacktestConfig, run_backtest
from barloom.plans.strategies import Panel, get_strategy
from barloom.sources import bars as B
from helpers import capped_account, rows, walk

PLAIN = {"market_filter": None, "filter_sma": 10, "skip": 2, "top_n": 2, "sizing": "equal", "vol_target": 0, "max_per_sector": 0}
HALF = R.RiskLimits(max_weight=0.5)


def test_a_set_that_warms_up_beyond_a_window_is_left_out(spark):
    panel = Panel.from_bars(walk(spark, list("ABC"), 260, holes=False))
    found = WF.walk_forward(panel, get_strategy("momentum", search={"lookback": [20, 120, 400]}, **PLAIN), BacktestConfig(benchmark=None, limits=HALF), train=60, test=40)
    folds = found.folds.orderBy("fold").collect()
    assert folds[0].train_start == 21   # the first set's warmup
    trained = {(r.fold, r.config): (r.first_idx, r.last_idx) for r in found.training.windows.collect()}
    assert all(a <= b for a, b in trained.values())
    assert {k for k in trained if k[1] == 1} == {(f.fold, 1) for f in folds if f.train_end >= 121} and not any(c == 2 for _, c in trained)
    assert 0 < sum(f.train_end < 121 for f in folds) < len(folds)
    bars = {(r.fold, r.config): (r.a, r.b) for r in found.training.equity.groupBy("fold", "config").agg(F.min("bar_idx").alias("a"), F.max("bar_idx").alias("b")).collect()}
    assert bars == trained
    tests = {r.fold: r for r in found.tests.collect()}
    assert set(tests) == {f.fold for f in folds}
    assert all(tests[f.fold].n_trials == (2 if f.train_end >= 121 else 1) and tests[f.fold].config < 2 for f in folds)


def test_a_window_in_which_nothing_can_trade_has_no_winner(spark):
    panel = Panel.from_bars(walk(spark, list("AB"), 200, holes=False))
    found = WF.walk_forward(panel, get_strategy("momentum", search={"lookback": [20]}, **PLAIN), BacktestConfig(benchmark=None, limits=HALF), train=60, test=40)
    late = WF.WalkForward(found.weights, found.decisions, found.folds, found.marks, 1, warmups=[1000])
    assert late.tests.count() == 0 and late.stitched.count() == 0


def test_a_strategy_with_a_memory_starts_empty_in_each_window(spark):
    panel = Panel.from_bars(walk(spark, list("ABCDEF"), 230))
    config = BacktestConfig(benchmark=None, limits=HALF)
    params = {"lookback": 10, "trend_sma": 30, "max_names": 2, "rebalance": 2}
    found = WF.walk_forward(panel, get_strategy("mean_reversion", search={"z_entry": [-0.3, -0.8]}, **params), config, train=70, test=50)
    days = {r.bar_idx: r.date for r in panel.calendar.collect()}
    windows = {(r.fold, r.config): r for r in found.training.windows.collect()}
    assert {c for _, c in windows} == {0, 1} and len(windows) >= 4
    for fold, number in ((0, 0), (1, 1)):
        w = windows[fold, number]
        alone = run_backtest(panel, get_strategy("mean_reversion", z_entry=(-0.3, -0.8)[number], **params), config, str(days[w.first_idx]), str(days[w.last_idx]))
        got = [r.equity for r in found.training.equity.filter(f"fold = {fold} AND config = {number}").orderBy("bar_idx").collect()]
        assert got == pytest.approx([r.equity for r in alone.equity.orderBy("bar_idx").collect()], rel=1e-12) and len(set(got)) > 10


def test_a_search_scores_the_panel_once_and_prices_held_names_only(spark, monkeypatch):
    """Parameter sets and windows share the scores of a pair of lengths; a name that never moves has no score and is never held."""
    bars = walk(spark, list("ABCDEF"), 230)
    flat = bars.filter("ticker = 'A'").withColumns({"ticker": F.lit("FLAT"), **{c: F.lit(50.0) for c in ("open", "high", "low", "close")}})
    panel = Panel.from_bars(bars.unionByName(flat))
    framed, score = [], SG.with_zscore
    monkeypatch.setattr(SG, "with_zscore", lambda grid, *lengths: framed.append(lengths[:2]) or score(grid, *lengths))
    strategy = get_strategy("mean_reversion", search={"lookback": [10, 15], "z_entry": [-0.3, -0.8]}, trend_sma=30, max_names=2, rebalance=2)
    found = WF.walk_forward(panel, strategy, BacktestConfig(benchmark=None, limits=HALF), train=70, test=50)
    assert found.tests.count() >= 2 and found.trials.count() >= 8
    assert framed == [(10, 30), (15, 30)]
    for book in (found.training, found.testing):
        held = {r.ticker for r in book.weights.select("ticker").distinct().collect()}
        assert held and "FLAT" not in held and {r.ticker for r in book.marks.select("ticker").distinct().collect()} == held


@pytest.mark.parametrize("model", [C.PRESETS["retail"], C.PRESETS["ibkr"], C.CostModel(0.01, 0.0, 0.002, 30.0, 20.0), C.PRESETS["zero"]])
def test_fully_invested_books_end_where_the_cash_does(spark, model):
    tickers = list("ABCDEF")
    grid = P.with_mark(B.align_panel(walk(spark, tickers, 150, seed=11)))
    rng = np.random.default_rng(5)
    decisions = [4, 11, 12, 13, 30, 31, 60, 90, 91, 120]
    weights = {d: dict(zip(map(str, rng.choice(["A", "C", "D", "E", "F"], 4, replace=False)), map(float, rng.dirichlet(np.ones(4))))) for d in decisions if d != 60}
    w = spark.createDataFrame([(0, d, t, v) for d, m in weights.items() for t, v in m.items()], "config int, bar_idx long, ticker string, weight double")
    dec = spark.createDataFrame([(0, d) for d in decisions], "config int, bar_idx long")
    win = C.with_costs(spark.createDataFrame([(0, 3, 149)], "config int, first_idx long, last_idx long"), model)
    book = G.Ledger(w, dec, win, grid, ["config"], 50_000.0, cap_cash=True)
    want, money = capped_account(grid.toPandas(), weights, set(decisions), 3, 149, 50_000.0, model)
    got = book.equity.orderBy("bar_idx").collect()
    assert [r.equity for r in got] == pytest.approx(want, rel=1e-9)
    assert [r.cash for r in got] == pytest.approx(money, abs=1e-4)
    least = min(r.cash for r in got)
    assert least > -1e-4 if not model.commission_min else least > -6 * model.commission_min
    assert book.periods.agg(F.max("residual")).first()[0] <= G.EXACT
    if model.is_free:
        assert least == pytest.approx(0.0, abs=1e-6)
    else:
        open_ = G.Ledger(w, dec, win, grid, ["config"], 50_000.0)
        assert open_.equity.agg(F.min("cash")).first()[0] < -1.0   # without the limit it goes overdrawn
        bought = book.trades.filter("side = 'buy'").agg(F.sum("notional")).first()[0]
        assert bought < open_.trades.filter("side = 'buy'").agg(F.sum("notional")).first()[0]


def test_the_cap_leaves_books_with_a_reserve_alone(spark):
    grid = P.with_mark(B.align_panel(walk(spark, list("AB"), 60, holes=False)))
    w = spark.createDataFrame([(0, 5, "A", .4), (0, 5, "B", .5), (0, 30, "B", .9)], "config int, bar_idx long, ticker string, weight double")
    dec = spark.createDataFrame([(0, 5), (0, 30)], "config int, bar_idx long")
    win = C.with_costs(spark.createDataFrame([(0, 0, 59)], "config int, first_idx long, last_idx long"), C.PRESETS["pessimistic"])
    a, b = (rows(G.Ledger(w, dec, win, grid, ["config"], 1000.0, cap_cash=cap).equity, "bar_idx") for cap in (False, True))
    assert a == b


def test_backtests_of_a_strategy_never_borrow(spark):
    panel = Panel.from_bars(walk(spark, list("ABCD"), 200, holes=False))
    strategy = get_strategy("momentum", **{**PLAIN, "lookback": 20, "rebalance": "weekly"})
    config = BacktestConfig(benchmark=None, limits=HALF, costs=C.PRESETS["pessimistic"])
    run = run_backtest(panel, strategy, config)
    assert run.equity.agg(F.min("cash")).first()[0] > -1e-4 and run.ledger.trades.count() > 20

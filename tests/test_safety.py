"""Checks that must fail when something is missing, costs that must be paid, and walk-forward from a panel."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.functions import costs as C
from barloom.operators import ledger as G
from barloom.operators import limits as R
from barloom.operators import monitor as V
from barloom.operators import orders as O
from barloom.operators import panel as P
from barloom.operators import schedule as S
from barloom.operators import signals as SG
from barloom.plans import strategies as ST
from barloom.plans import walkforward as WF
from barloom.plans.backtest import BacktestConfig, run_backtest
from barloom.plans.strategies import Panel, custom_strategy, get_strategy
from barloom.sources import bars as B
from barloom.sources import news as N
from helpers import day, rows, walk

NAN = float("nan")


def test_freshness_over_many_sessions(spark):
    df = spark.createDataFrame([(day("2025-06-26"), day("2025-07-28")), (day("2024-09-03"), day("2025-07-28")), (None, day("2025-07-28"))], "as_of date, today date").withColumn("account", F.lit(1))
    for n in (1, 20, 200):
        got = [r.status for r in V.freshness(df, None, n).orderBy("as_of").collect()]
        assert got == ["stale", "stale", "fresh" if n > 20 else "stale"]
    short = S.trading_calendar(df, "today")   # does not reach 20 sessions back
    assert {r.status for r in V.freshness(df, short, 20).collect()} == {"stale"}
    fails = V.freshness_failures(V.freshness(df, None, 200))
    assert fails.count() == 2 and fails.columns == ["account", "rule", "ticker", "value"]
    assert V.guard_report(spark.createDataFrame([(1,), (2,)], "account int"), [fails]).filter("passed").count() == 1


def test_unknown_values_never_pass_a_check(spark):
    accounts = spark.createDataFrame([(1, 1000.0), (2, None), (3, NAN), (4, -5.0), (6, 1000.0), (6, NAN)], "account int, equity double")
    orders = spark.createDataFrame([(k, "A", 1e6, 1e4) for k in (1, 2, 3, 4, 5)] + [(1, "B", -900.0, 1.0), (1, "C", NAN, 1.0), (1, "D", None, 1.0), (6, "A", 1.0, 1.0)],
                                   "account int, ticker string, quantity double, price double")
    fails = rows(V.order_limits(orders, accounts).select("account", "rule", "ticker"), "account", "rule", "ticker")
    assert fails == [(1, "gross_notional", None), (1, "no_price", "C"), (1, "no_price", "D"), (1, "order_notional", "A"), (1, "order_notional", "B"),
                     (2, "no_equity", None), (3, "no_equity", None), (4, "no_equity", None), (5, "unknown_account", None)]
    assert V.order_limits(orders.limit(0), accounts).count() == 0
    before = spark.createDataFrame([(1, NAN, 100.0), (2, 100.0, NAN), (3, None, 100.0), (4, 50.0, 100.0), (5, math.inf, 100.0), (6, 100.0, 0.0)], "account int, equity double, last_equity double")
    assert [r.status for r in V.daily_loss(before).orderBy("account").collect()] == ["unchecked"] * 3 + ["breach"] + ["unchecked"] * 2


def test_a_guard_run_without_a_result_is_no_pass(spark):
    fills = spark.createDataFrame([(1, "paper", day("2024-01-02"), "filled", 1.0)], "account int, broker string, as_of date, status string, filled_quantity double")
    log = spark.createDataFrame([(1, 1, True), (1, 2, None), (1, 3, True)], "account int, seq int, passed boolean")
    g = V.gate_status(fills, log, 1, 2).first()
    assert (g.clean_sessions, g.open) == (1, False)


def test_a_flat_account_is_a_baseline(spark):
    q = "account int, ticker string, quantity double"
    none = spark.createDataFrame([], q)
    recorded = V.state_snapshot(none, spark.createDataFrame([], "account int, ticker string, status string"), spark.createDataFrame([(1,), (2,)], "account int"))
    held = spark.createDataFrame([(1, "Q", 3.0), (3, "Q", 3.0)], q)
    fails = V.reconciliation(held, recorded, spark.createDataFrame([], "account int, ticker string"))
    assert rows(fails, "account") == [(1, "unexpected_position", "Q", 3.0)]


def test_nan_is_no_price(spark):
    quotes = spark.createDataFrame([("A", NAN), ("B", 4.0)], "ticker string, price double")
    closes = spark.createDataFrame([("A", 5.0), ("C", NAN)], "ticker string, price double")
    need = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    prices = O.price_fallback(need, quotes, closes)
    assert rows(prices, "ticker") == [("A", 5.0, True), ("B", 4.0, False), ("C", None, True)]
    targets = spark.createDataFrame([(1, "A", 0.5), (1, "B", NAN), (1, "C", 0.4)], "account int, ticker string, weight double")
    held = spark.createDataFrame([(1, "D", 1.0)], "account int, ticker string, quantity double")
    orders = O.order_diff(targets, held, prices.unionByName(spark.createDataFrame([("D", NAN, False)], "ticker string, price double, stale boolean")), spark.createDataFrame([(1, 100.0)], "account int, equity double"))
    assert [(r.ticker, r.quantity) for r in orders.collect()] == [("A", 10.0)]


@pytest.mark.parametrize("values", [[1.0, 2.0, math.inf], [-math.inf, 3.0, 4.0, math.inf], [1e12] + list(range(1, 1000)), [5.0] * 900 + [NAN, 7.0], [2.0, 2.0], [math.inf, math.inf]])
def test_median_with_outliers(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert V.exact_median(df, "v").first()[0] == pytest.approx(float(np.median([v for v in values if v == v])))


def _book(spark, model, cash=1000.0):
    grid = P.with_mark(B.align_panel(walk(spark, ["A", "B"], 60, holes=False)))
    weights = {5: {"A": .5, "B": .3}, 20: {"A": .52, "B": .28}, 40: {"B": .6}}
    w = spark.createDataFrame([(0, d, t, v) for d, m in weights.items() for t, v in m.items()], "config int, bar_idx long, ticker string, weight double")
    dec = spark.createDataFrame([(0, d) for d in weights], "config int, bar_idx long")
    win = C.with_costs(spark.createDataFrame([(0, 0, 59)], "config int, first_idx long, last_idx long"), model)
    return grid, weights, G.Ledger(w, dec, win, grid, ["config"], cash, 0 if model.is_free else 6)


@pytest.mark.parametrize("least", [0.0, 1.0, 25.0])
def test_order_minimum_is_paid(spark, least):
    model = C.CostModel(0.005, least, 0.0, 0.0, 0.0)
    grid, weights, book = _book(spark, model)
    ref = {(r.ticker, r.bar_idx): r.fill_ref for r in grid.collect()}
    mark = {(r.ticker, r.bar_idx): r.mark for r in grid.collect()}
    cash, held, want, pending = 1000.0, {}, [], None
    for i in range(60):
        if pending is not None:
            total = cash + sum(q * ref[t, i] for t, q in held.items())
            goal = {t: v * total / ref[t, i] for t, v in pending.items()}
            for t in sorted(set(goal) | set(held)):
                move = goal.get(t, 0.0) - held.get(t, 0.0)
                if abs(move):
                    cash -= move * ref[t, i] + max(least, abs(move) * 0.005)
            held, pending = goal, None
        want.append(cash + sum(q * mark[t, i] for t, q in held.items()))
        pending = weights.get(i)
    assert [r.equity for r in book.equity.orderBy("bar_idx").collect()] == pytest.approx(want, rel=1e-9)
    fees = book.trades.agg(F.sum("commission")).first()[0]
    assert fees >= 5 * least and book.periods.agg(F.max("residual")).first()[0] < 1e-9


def test_per_share_commission_alone_is_a_cost():
    assert not C.CostModel(0.01, 0.0, 0.0, 0.0, 0.0).is_free and not C.CostModel(0.0, 1.0, 0.0, 0.0, 0.0).is_free and C.PRESETS["zero"].is_free


def test_each_parameter_set_warms_up_by_itself(spark):
    panel = Panel.from_bars(walk(spark, list("ABC"), 200, holes=False))
    fixed = {"market_filter": None, "filter_sma": 10, "skip": 2, "top_n": 2, "sizing": "equal", "vol_target": 0, "max_per_sector": 0}
    both = run_backtest(panel, get_strategy("momentum", search={"lookback": [20, 120]}, **fixed), BacktestConfig(benchmark=None))
    firsts = dict(rows(both.equity.groupBy("config").agg(F.min("bar_idx")), "config"))
    alone = run_backtest(panel, get_strategy("momentum", lookback=120, **fixed), BacktestConfig(benchmark=None))
    assert firsts == {0: 21, 1: 121}
    assert [r.equity for r in both.equity.filter("config = 1").orderBy("bar_idx").collect()] == pytest.approx([r.equity for r in alone.equity.orderBy("bar_idx").collect()])
    with pytest.raises(ValueError, match="no bars"):
        run_backtest(panel, get_strategy("momentum", lookback=252)).check()


def _fold_by_hand(scored, z_entry, z_exit, most):
    held, out = set(), []
    for d in sorted({r.date for r in scored}):
        today = [r for r in scored if r.date == d and r.eligible and r.z is not None]
        keep = [r for r in today if (r.uptrend and r.z < z_entry) or (r.ticker in held and r.z < z_exit)]
        held = {r.ticker for r in sorted(keep, key=lambda r: (r.z, r.ticker))[:most]}
        out += [(d, t) for t in sorted(held)]
    return out


def test_mean_reversion_in_segments(spark):
    rng = np.random.default_rng(2)
    days = [day("2024-01-01") + dt.timedelta(days=k) for k in range(120)]
    table = [(d, f"T{k}", float(rng.normal(0, 1.5)), bool(rng.integers(3)), bool(rng.integers(8))) for d in days for k in range(7)]
    scored = spark.createDataFrame(table, "date date, ticker string, z double, uptrend boolean, eligible boolean")
    got = rows(SG.mean_reversion_holdings(scored, -1.5, 0.5, 3).select("date", "ticker"), "date", "ticker")
    assert got == _fold_by_hand(scored.collect(), -1.5, 0.5, 3)
    assert SG.mean_reversion_holdings(scored.limit(0)).count() == 0


def test_mean_reversion_of_many_settings(spark):
    """Settings of other entries, exits and caps share one rank, and each is held as if it were alone, in every run from none."""
    rng = np.random.default_rng(3)
    days = [day("2024-01-01") + dt.timedelta(days=k) for k in range(90)]
    draw = lambda: None if rng.random() < 0.05 else float(np.round(rng.normal(0, 1.5), 1))  # noqa: E731   (with ties and missing values)
    table = [(d, f"T{k:02d}", draw(), bool(rng.integers(3)), bool(rng.integers(8))) for d in days for k in range(14)]
    scored = spark.createDataFrame(table, "date date, ticker string, z double, uptrend boolean, eligible boolean")
    settings = {0: (-1.5, 0.5, 3), 1: (-0.5, 0.0, 2), 2: (-1.0, -1.2, 5), 3: (-9.0, 0.0, 2)}
    alive = SG.reverting(scored, settings)
    spans = [(i, j, days[j * 20], days[min(j * 20 + 44, 89)]) for i in settings for j in range(4)]
    runs = spark.createDataFrame([(i, j, d) for i, j, a, b in spans for d in days if a <= d <= b], "config int, run int, date date")
    got = SG.held_in_turn(alive, runs, ["run", "config"]).collect()
    seen = scored.collect()
    for i, j, a, b in spans:
        want = _fold_by_hand([r for r in seen if a <= r.date <= b], *settings[i])
        assert sorted((r.date, r.ticker) for r in got if (r.config, r.run) == (i, j)) == want and (want or i == 3)


def test_mean_reversion_starts_empty(spark):
    panel = Panel.from_bars(walk(spark, list("ABCDEF"), 260, holes=False))
    s = get_strategy("mean_reversion", z_entry=-0.5, z_exit=1.5, trend_sma=30, max_names=4)
    whole, late = s.weights(panel), s.weights(panel, "2020-10-01")
    assert late.filter("date < DATE'2020-10-01'").count() == 0
    first = late.agg(F.min("date")).first()[0]
    carried = {r.ticker for r in whole.filter(F.col("date") == F.lit(first)).collect()}
    assert {r.ticker for r in late.filter(F.col("date") == F.lit(first)).collect()} <= carried


def momentum_by_hand(panel, configs, params):
    """A user's strategy: the one name that rose most over `bars`."""
    from pyspark.sql import Window
    days = S.decision_dates(panel.calendar, params["rebalance"]).select("date")
    out = None
    for i, c in enumerate(configs):
        past = F.lag("close", int(c["bars"])).over(Window.partitionBy("ticker").orderBy("bar_idx"))
        scored = panel.grid.withColumn("score", F.col("close") / past - 1).join(days, "date", "left_semi").filter("score IS NOT NULL")
        best = scored.withColumn("rk", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))).filter("rk = 1")
        part = best.select(F.lit(i).alias("config"), "date", "bar_idx", "ticker", F.when(F.col("ticker") == "A", F.lit(NAN)).otherwise(F.lit(0.9)).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def test_a_user_strategy_can_be_tested_and_searched(spark):
    panel = Panel.from_bars(walk(spark, list("ABCD"), 300, holes=False))
    strategy = custom_strategy("mine", momentum_by_hand, warmup=lambda p: int(p["bars"]), search={"bars": [10, 40]})
    limits = R.RiskLimits(max_weight=0.5)
    run = run_backtest(panel, strategy, BacktestConfig(limits=limits, benchmark="A"))
    m = {r.config: r for r in run.metrics().collect()}
    assert set(m) == {0, 1} and all(r.n_trades > 0 and r.sharpe == r.sharpe for r in m.values())
    assert run.ledger.weights.agg(F.max("weight")).first()[0] <= 0.5 and run.ledger.weights.filter("ticker = 'A' AND weight <> 0").count() == 0

    found = WF.walk_forward(panel, strategy, BacktestConfig(limits=limits, benchmark="B"), train=120, test=60)
    tests = found.tests.orderBy("fold").collect()
    assert len(tests) >= 2 and all(t.n_trials == 2 for t in tests)
    curve = [r.equity for r in found.stitched.orderBy("fold", "bar_idx").collect()]
    total = found.metrics().first()
    assert total.end_equity == pytest.approx(curve[-1]) and total.n_days == len(curve) and total.n_trades > 0
    assert total.max_drawdown == pytest.approx(min(v / max(curve[:i + 1]) - 1 for i, v in enumerate(curve)))
    assert found.stitched_benchmark.count() == len(curve) and total.benchmark_total_return is not None
    with pytest.raises(ValueError, match="too short"):
        WF.walk_forward(panel, strategy, train=1000)


def test_integer_schedules_on_the_exchange(spark):
    days = S.trading_calendar(spark.createDataFrame([(day("2024-01-01"),)], "date date"))
    assert S.is_rebalance_day(days, 5).filter("NOT is_rebalance_day").count() == 0
    with pytest.raises(ValueError):
        S.is_rebalance_day(days, 0)


def test_news_stamps_with_offsets(spark):
    raw = spark.createDataFrame([(1, "2024-03-01T10:00:00-05:00"), (2, "2024-03-01T10:00:00Z"), (3, "half past ten"), (4, "2024-03-01 10:00:00"), (5, None)], "id long, created_at string")
    got = {r.id: r.created_at for r in N.normalize_news(raw).collect()}
    assert got == {1: dt.datetime(2024, 3, 1, 15), 2: dt.datetime(2024, 3, 1, 10), 4: dt.datetime(2024, 3, 1, 10)}


def test_a_story_keeps_its_month(spark, tmp_path):
    fields = "id long, created_at timestamp_ntz, updated_at timestamp_ntz, headline string, symbols array<string>"
    path = str(tmp_path / "news")
    N.write_news(N.normalize_news(spark.createDataFrame([(1, dt.datetime(2024, 1, 30), None, "first", [])], fields)), path)
    N.upsert_news(spark, path, spark.createDataFrame([(1, dt.datetime(2024, 2, 2), dt.datetime(2024, 2, 3), "moved", []), (2, dt.datetime(2024, 2, 2), None, "new", [])], fields))
    stored = spark.read.parquet(path)
    assert rows(stored.select("id", "headline", "month"), "id") == [(1, "first", "2024-01"), (2, "new", "2024-02")]
    plan = N.news_between(stored, "2024-02-01", "2024-02-28")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_no_silent_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_every_strategy_is_named_in_the_error():
    with pytest.raises(KeyError, match="momentum"):
        get_strategy("nope")
    assert set(ST.STRATEGIES) >= {"momentum", "sentiment"}


def test_lengths_share_one_frame_and_returns_are_of_chosen_names(spark):
    bars = walk(spark, list("ABC"), 60)
    panel = Panel.from_bars(bars)
    sums = P.with_recent(panel.grid, (5, 20, 5))
    got = {(r.ticker, r.bar_idx): (r._n_5, r._s_5, r._n_20, r._s_20) for r in sums.collect()}
    close = {(r.ticker, r.bar_idx): r.close for r in panel.grid.collect()}
    for (t, i), found in got.items():
        want = []
        for bars_ in (5, 20):
            ticks = [round(c * 1e8) for k in range(max(0, i - bars_ + 1), i + 1) if (c := close[t, k]) is not None]
            want += [len(ticks), sum(ticks)]
        assert found == tuple(want)
    chosen = spark.createDataFrame([("B",), ("B",), ("Z",)], "ticker string")
    some, all_ = panel.returns_of(chosen), panel.ready().filter("ticker = 'B'")
    assert rows(some.select("ticker", "bar_idx", "pad_ret"), "bar_idx") == rows(all_.select("ticker", "bar_idx", "pad_ret"), "bar_idx") and some.count() == 60


def test_rows_without_news_may_be_left_out_of_news_windows(spark):
    bars = walk(spark, list("AB"), 60, holes=False)
    days = S.decision_dates(B.trading_index(bars), "weekly")
    dates = [r.date for r in B.trading_index(bars).orderBy("date").collect()]
    news = spark.createDataFrame([("A", dates[k], 0.1 * k, -0.3, 2.0) for k in (3, 4, 17, 40)], "ticker string, date date, news_tone_sum double, news_neg_sum double, news_count double")
    panel = Panel.from_bars(bars, features=news)
    few = SG.news_rows(panel.grid, days)
    assert few.count() < panel.grid.count() / 3 and "news_count" not in panel.prices.columns
    for kind in ("tone", "neg"):
        some, whole = (SG.with_sentiment_score(g, 10, kind).join(days.select("date"), "date", "left_semi").select("ticker", "date", "score", "articles") for g in (few, panel.grid))
        assert rows(some, "ticker", "date") == rows(whole, "ticker", "date")
        assert whole.filter("score IS NOT NULL").count() == 6   # the decision dates within ten bars of some news

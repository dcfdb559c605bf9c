"""Walk-forward search: every fold and parameter set in one job, no driver loop.

Folds, parameter sets and days are rows. Training books of all (fold, config) pairs run through one
ledger, a rank picks the winner of each fold, and the winners' test books run through a second one.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.costs import CostModel, PRESETS, with_costs
from barloom.functions.scalars import safe_ratio
from barloom.operators import metrics as M
from barloom.operators.honesty import with_honesty
from barloom.operators import schedule as S
from barloom.operators.ledger import Ledger, benchmark_equity, daily_returns, drawdown_overlay
from barloom.plans.backtest import Backtest, BacktestConfig
from barloom.plans.strategies import Panel, Strategy
from barloom.session import cut_lineage

PAIR = ["fold", "config"]


def param_grid(frame: DataFrame, grid: dict[str, Sequence]) -> DataFrame:
    """All parameter combinations for each row of `frame`, numbered with the first parameter slowest."""
    out = frame
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    number, stride = F.lit(0), 1
    for name, values in reversed(list(grid.items())):
        spot = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)) - 1
        number, stride = number + spot * stride, stride * len(values)
    return out.withColumn("config", number.cast("long"))


def folds(calendar: DataFrame, warmup: int, train: int = 504, test: int = 126, step: int | None = None) -> DataFrame:
    """Rolling windows as bar positions, both ends included; the last test window is cut at the calendar's end."""
    step = step or test
    size = calendar.agg(F.max("bar_idx").alias("last"))
    last_fold = F.floor((F.col("last") - train - 1 - warmup) / step)
    rows = size.filter(F.col("last") - train - 1 >= warmup).select("last", F.explode(F.sequence(F.lit(0).cast("long"), last_fold)).alias("fold"))
    start = F.lit(warmup) + F.col("fold") * step
    out = rows.select(
        "fold", start.alias("train_start"), (start + train - 1).alias("train_end"), (start + train).alias("test_start"),
        F.least(start + train + test - 1, F.col("last")).alias("test_end"))
    return out.filter(F.col("test_end") > F.col("test_start"))


@dataclass
class WalkForward:
    """weights: (config, bar_idx, ticker, weight) for all parameter sets and decision bars.

    A parameter set whose warmup passes the end of a window has no bar to trade there: it has no book, no trial and cannot
    win. `weights_in(windows, keys)` replaces `weights` for strategies with a memory: it gives each window weights of its own.
    """

    weights: DataFrame | None
    decisions: DataFrame
    folds: DataFrame
    marks: DataFrame
    n_configs: int
    objective: str = "sharpe"
    costs: CostModel = field(default_factory=lambda: PRESETS["retail"])
    initial_cash: float = 100_000.0
    warmups: Sequence[int] = ()
    benchmark: str | None = None
    drawdown_control: tuple[float, float] | None = None
    weights_in: Callable[[DataFrame, list[str]], DataFrame] | None = None
    cap_cash: bool = False

    def _windows(self, pairs: DataFrame, first: str, last: str) -> DataFrame:
        warm = F.element_at(F.array(*[F.lit(int(w)) for w in self.warmups]), (F.col("config") + 1).cast("int")) if self.warmups else F.lit(0)
        spans = pairs.select(*PAIR, F.greatest(F.col(first), warm.cast("long")).alias("first_idx"), F.col(last).alias("last_idx"))
        return with_costs(spans.filter("first_idx <= last_idx"), self.costs)

    def _books(self, windows: DataFrame) -> Ledger:
        """One book per (fold, config): decisions and weights that fall into its window, starting flat. It is priced with the
        marks of the names it ever holds, so the panel is read once and never dealt for them."""
        bars = windows.select(*PAIR, F.explode(F.sequence("first_idx", "last_idx")).alias("bar_idx"))
        decided = bars.join(self.decisions.select("bar_idx"), "bar_idx")
        if self.weights_in is None:
            weights = self.weights.join(decided, ["config", "bar_idx"]).select(*PAIR, "bar_idx", "ticker", "weight")
        else:
            weights = self.weights_in(cut_lineage(windows), PAIR)
        weights = cut_lineage(weights)
        marks = cut_lineage(self.marks.join(weights.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "bar_idx", "date", "mark", "fill_ref"))
        book = Ledger(weights, decided.select(*PAIR, "bar_idx"), windows, marks, PAIR, self.initial_cash, 0 if self.costs.is_free else 4, self.cap_cash)
        return book if self.drawdown_control is None else drawdown_overlay(book, *self.drawdown_control)

    @cached_property
    def training(self) -> Ledger:
        configs = F.explode(F.array(*[F.lit(i) for i in range(self.n_configs)]))
        return self._books(self._windows(self.folds.withColumn("config", configs), "train_start", "train_end"))

    @cached_property
    def trials(self) -> DataFrame:
        """Training statistics of every (fold, config)."""
        m = M.return_moments(self.training.equity, PAIR)
        c = F.col
        return m.withColumns({
            "sharpe": M.sharpe(c("mean_ret"), c("sd_ret"), c("n_ret")), "sortino": M.sortino(c("mean_ret"), c("downside_sq"), c("n_ret")),
            "cagr": M.cagr(c("start_equity"), c("end_equity"), c("n_days")),
            "total_return": safe_ratio(c("end_equity"), c("start_equity")) - 1.0,
        })

    @cached_property
    def winners(self) -> DataFrame:
        """The best parameter set of each fold; the first of equals wins and NaN never does. Adds the deflated Sharpe.

        Scores equal to nine digits are equal: the last bits of a distributed sum depend on its order.
        """
        score = F.when(~F.isnan(self.objective), F.round(self.objective, 9))
        best = Window.partitionBy("fold").orderBy(score.desc_nulls_last(), "config")
        finite = F.when(~F.isnan("sharpe") & (F.abs("sharpe") != float("inf")), F.col("sharpe"))
        spread = self.trials.groupBy("fold").agg(F.count("*").alias("n_trials"), F.count(finite).alias("n_finite"), F.stddev_samp(finite).alias("trial_sd"))
        won = self.trials.withColumn("_rk", F.row_number().over(best)).filter(F.col("_rk") == 1).drop("_rk").join(spread, "fold")
        judged = with_honesty(won.withColumn("trial_sd", F.coalesce("trial_sd", F.lit(0.0))), n_trials="n_trials", trial_sd="trial_sd")
        return judged.select(
            *PAIR, F.col(self.objective).alias("train_score"), F.col("cagr").alias("train_cagr"),
            F.coalesce("dsr", "psr_zero").alias("train_dsr"), "n_trials").join(self.folds, "fold")

    @cached_property
    def testing(self) -> Ledger:
        return self._books(self._windows(self.winners, "test_start", "test_end"))

    @cached_property
    def tests(self) -> DataFrame:
        """One row per fold: windows, the chosen set and its training and test numbers."""
        m = M.return_moments(self.testing.equity, PAIR)
        c = F.col
        seen = m.select(
            *PAIR, M.sharpe(c("mean_ret"), c("sd_ret"), c("n_ret")).alias("test_sharpe"),
            (safe_ratio(c("end_equity"), c("start_equity")) - 1.0).alias("test_return"), c("max_drawdown").alias("test_max_drawdown"),
            M.cagr(c("start_equity"), c("end_equity"), c("n_days")).alias("test_cagr"))
        return self.winners.join(seen, PAIR).withColumn("test_bars", F.col("test_end") - F.col("test_start") + 1)

    @cached_property
    def stitched(self) -> DataFrame:
        """The out-of-sample curve: fold returns chained, each fold's first bar contributing nothing.

        One row per test day, so the running product over all folds is bounded by market history.
        """
        rets = daily_returns(self.testing.equity, PAIR)
        path = Window.orderBy("fold", "bar_idx").rowsBetween(Window.unboundedPreceding, 0)
        return rets.select("fold", "bar_idx", (F.product(1 + F.col("ret")).over(path) * self.initial_cash).alias("equity"))

    def efficiency(self) -> DataFrame:
        """Out-of-sample growth over the test-length-weighted training growth; null when the latter is not positive."""
        trained = self.tests.agg(
            (F.sum(F.col("train_cagr") * F.col("test_bars")) / F.sum("test_bars")).alias("train_cagr"), F.count("*").alias("n_folds"),
            F.sum("n_trials").alias("n_trials"))
        curve = self.stitched.withColumn("pos", F.row_number().over(Window.orderBy("fold", "bar_idx"))).agg(
            F.min_by("equity", "pos").alias("a"), F.max_by("equity", "pos").alias("b"), F.count("*").alias("n"))
        oos = curve.select(M.cagr(F.col("a"), F.col("b"), F.col("n")).alias("v")).scalar()
        return trained.withColumn("oos_cagr", oos).withColumn(
            "efficiency", F.when(F.col("train_cagr") > 0, F.col("oos_cagr") / F.col("train_cagr")))

    @cached_property
    def stitched_benchmark(self) -> DataFrame | None:
        """The benchmark over the same test days, its fold returns chained like those of the book."""
        if self.benchmark is None:
            return None
        rets = daily_returns(benchmark_equity(self.marks, self.benchmark, self.testing.windows, PAIR, self.initial_cash), PAIR, "benchmark")
        path = Window.orderBy("fold", "bar_idx").rowsBetween(Window.unboundedPreceding, 0)
        return rets.select("fold", "bar_idx", (F.product(1 + F.col("ret")).over(path) * self.initial_cash).alias("benchmark"))

    def metrics(self) -> DataFrame:
        """Out-of-sample numbers of all folds together, honesty of the stitched curve included: one row.

        Test days are numbered through, because windows that overlap repeat a bar.
        """
        order = Window.orderBy("fold", "bar_idx")
        whole = F.lit("oos").alias("run")
        days = self.stitched.select(whole, "fold", F.col("bar_idx").alias("_bar"), F.row_number().over(order).cast("long").alias("bar_idx"), "equity")
        at = days.select("fold", "_bar", "bar_idx")
        turnover = self.testing.turnover.withColumnRenamed("bar_idx", "_bar").join(at, ["fold", "_bar"]).select(whole, "bar_idx", "turnover")
        # A fold starts without positions, so a name of one fold is not the same holding as in another.
        trades = self.testing.trades.withColumnRenamed("bar_idx", "_bar").join(at, ["fold", "_bar"]).select(
            whole, "bar_idx", F.concat_ws("#", "ticker", "fold").alias("ticker"), "side", "quantity", "price", "commission")
        other = None
        if self.stitched_benchmark is not None:
            other = self.stitched_benchmark.withColumnRenamed("bar_idx", "_bar").join(at, ["fold", "_bar"]).select(whole, "bar_idx", "benchmark")
        return M.metrics(days.select("run", "bar_idx", "equity"), ["run"], turnover, trades, other)

    def parameter_drift(self) -> DataFrame:
        """Share of folds that chose other parameters than the fold before, and the number of trials."""
        order = Window.orderBy("fold")
        moved = self.winners.withColumn("_prev", F.lag("config").over(order))
        return moved.agg(
            F.coalesce(F.avg(F.when(F.col("_prev").isNotNull(), (F.col("_prev") != F.col("config")).cast("double"))), F.lit(0.0)).alias("parameter_drift"),
            F.count("*").alias("n_folds"), F.sum(F.lit(self.n_configs)).alias("n_trials_total"))


def walk_forward(panel: Panel, strategy: Strategy, config: BacktestConfig | None = None, train: int = 504, test: int = 126, step: int | None = None,
                 objective: str = "sharpe") -> WalkForward:
    """Search `strategy`'s parameter sets fold by fold over a panel, with the membership rule, limits and drawdown control of
    `config`. Raises if the history does not hold one fold."""
    config = config or BacktestConfig()
    run = Backtest(panel, strategy, config)
    schedule = config.rebalance if config.rebalance is not None else strategy.rebalance
    warmup = max(strategy.warmups[0], 0)   # the first parameter set decides where the folds begin
    windows = folds(run._stored.calendar, warmup, train, test, step)
    if not windows.take(1):
        raise ValueError(f"{strategy.name}: the history is too short for {warmup} bars of warmup, {train} of training and a test")
    return WalkForward(None if strategy.stateful else run.limited_weights, S.decision_dates(run._stored.calendar, schedule), windows, run._stored.grid, len(strategy.configs), objective,
                       config.costs, config.initial_cash, strategy.warmups, config.benchmark, config.drawdown_control, run.weights_in if strategy.stateful else None, not config.limits.allow_short)

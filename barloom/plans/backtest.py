"""A complete backtest: strategy weights, limits, accounting and statistics for all parameter sets."""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.costs import PRESETS, CostModel, with_costs
from barloom.operators import ledger as B
from barloom.operators import limits as R
from barloom.operators import metrics as M
from barloom.operators import panel as P
from barloom.operators import schedule as S
from barloom.operators import sizing as K
from barloom.plans.strategies import Panel, Strategy
from barloom.session import cut_lineage
from barloom.sources import sinks

CONFIG = ["config"]


@dataclass(frozen=True)
class BacktestConfig:
    initial_cash: float = 100_000.0
    costs: CostModel = field(default_factory=lambda: PRESETS["retail"])
    limits: R.RiskLimits = field(default_factory=R.RiskLimits)
    benchmark: str | None = "SPY"
    drawdown_control: tuple[float, float] | None = None
    rebalance: str | int | None = None


@dataclass
class Backtest:
    panel: Panel
    strategy: Strategy
    config: BacktestConfig = field(default_factory=BacktestConfig)
    start: str | None = None
    end: str | None = None

    @cached_property
    def _stored(self) -> Panel:
        """The marked panel with the strategy's signals, written once: decisions, fills and valuation all read it."""
        marked = Panel(P.with_mark(self.panel.grid), cut_lineage(self.panel.calendar), self.panel.sectors)
        return replace(marked, grid=cut_lineage(self._scheduled.signals(marked)))

    @property
    def windows(self) -> DataFrame:
        """First and last bar of each parameter set; a set that warms up longer starts later."""
        warm = F.explode(F.array(*[F.struct(F.lit(i).alias("config"), F.lit(int(w)).cast("long").alias("warm")) for i, w in enumerate(self.strategy.warmups)]))
        span = B.trading_window(self._stored.calendar, 0, self.start, self.end).select("first_idx", "last_idx", warm.alias("w"))
        return span.select(F.greatest("first_idx", "w.warm").alias("first_idx"), "last_idx", "w.config").filter("first_idx <= last_idx")

    def check(self) -> None:
        """Raise if there is no bar to trade, for instance because the history is shorter than the warmup. Runs a small job."""
        if not self.windows.take(1):
            raise ValueError(f"{self.strategy.name}: no bars are left to trade after the warmup of {self.strategy.warmup} bars and the given dates")

    @property
    def _scheduled(self) -> Strategy:
        if self.config.rebalance is None:
            return self.strategy
        return replace(self.strategy, params={**self.strategy.params, "rebalance": self.config.rebalance})

    def _limited(self, weights: DataFrame, keys: list[str]) -> DataFrame:
        """Weights of the decisions (keys, date) after the membership rule and the limits."""
        weights = cut_lineage(K.clean_weights(weights))
        if "member" in self._stored.grid.columns:
            weights = R.zero_non_members(weights.join(self._stored.grid.select("ticker", "bar_idx", "member"), ["ticker", "bar_idx"]))
        if self.panel.sectors is not None:
            weights = weights.join(self.panel.sectors.select("ticker", "sector"), "ticker", "left")
        return R.apply_limits(weights, self.config.limits, [*keys, "date"]).select(*keys, "bar_idx", "ticker", "weight")

    @cached_property
    def limited_weights(self) -> DataFrame:
        """Target weights after the membership rule and the limits; the strategy itself runs once."""
        return self._limited(self._scheduled.weights(self._stored, self.start), CONFIG)

    def weights_in(self, windows: DataFrame, keys: list[str]) -> DataFrame:
        """The same for a strategy with a memory, in windows (keys, first_idx, last_idx) that each start without holdings."""
        return self._limited(self._scheduled.weights_in(self._stored, windows, keys), keys)

    @cached_property
    def ledger(self) -> B.Ledger:
        schedule = self.config.rebalance if self.config.rebalance is not None else self.strategy.rebalance
        configs = F.explode(F.array(*[F.lit(i) for i in range(len(self.strategy.configs))]))
        decisions = S.decision_dates(self._stored.calendar, schedule).select("bar_idx", configs.alias("config"))
        windows = with_costs(self.windows, self.config.costs)
        book = B.Ledger(self.limited_weights, decisions, windows, self._stored.grid, CONFIG, self.config.initial_cash,
                        0 if self.config.costs.is_free else 4, not self.config.limits.allow_short)
        if self.config.drawdown_control is None:
            return book
        return B.drawdown_overlay(book, *self.config.drawdown_control)

    @property
    def equity(self) -> DataFrame:
        return self.ledger.equity

    @cached_property
    def benchmark(self) -> DataFrame | None:
        if self.config.benchmark is None:
            return None
        return B.benchmark_equity(self._stored.grid, self.config.benchmark, self.ledger.windows, CONFIG, self.config.initial_cash)

    def metrics(self) -> DataFrame:
        return M.metrics(self.equity, CONFIG, self.ledger.turnover, self.ledger.trades, self.benchmark)

    def save(self, path: str) -> None:
        sinks.save_backtest(path, self.equity, self.ledger.held.select("config", "bar_idx", "ticker", "shares"),
                            self.ledger.weights_at_close, self.ledger.trades, self.metrics(), self.benchmark)


def run_backtest(panel: Panel, strategy: Strategy, config: BacktestConfig | None = None, start: str | None = None,
                 end: str | None = None) -> Backtest:
    """A backtest whose parts run when they are asked for. History before `start` stays visible to the signals."""
    return Backtest(panel, strategy, config or BacktestConfig(), start, end)

"""Complete strategies: signal -> selection -> sizing for all decision dates and parameter sets at once.

A strategy turns a panel into rows (config, date, bar_idx, ticker, weight). `config` numbers the
parameter sets; trailing windows that several sets share are computed once.
"""
from __future__ import annotations

import itertools
from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import per_day
from barloom.operators import panel as P
from barloom.operators import schedule as S
from barloom.operators import signals as G
from barloom.operators import sizing as K
from barloom.session import cut_lineage
from barloom.sources import bars as B

KEYS = ["config", "date"]


@dataclass(frozen=True)
class Panel:
    """An aligned grid with its calendar and optional dimensions. `prices` is the grid before features were attached."""

    grid: DataFrame
    calendar: DataFrame
    sectors: DataFrame | None = None
    prices: DataFrame | None = None

    @classmethod
    def from_bars(cls, bars: DataFrame, start: str | None = None, end: str | None = None, sectors: DataFrame | None = None,
                  membership: DataFrame | None = None, features: DataFrame | None = None, min_bars: int = 0) -> Panel:
        """Align bars to their calendar and attach membership and feature columns."""
        scoped = bars
        if start is not None:
            scoped = scoped.filter(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            scoped = scoped.filter(F.col("date") <= F.lit(end).cast("date"))
        calendar = B.trading_index(scoped)
        grid = B.align_panel(scoped, min_bars=min_bars, calendar=calendar)
        prices = grid
        if membership is not None:
            grid = P.with_membership(grid, calendar, membership)
        if features is not None:
            grid = P.with_features(grid, features)
        return cls(P.with_eligible(grid), calendar, sectors, prices)

    def ready(self) -> DataFrame:
        """The grid with marks, padded returns and eligibility."""
        grid = self.grid if "eligible" in self.grid.columns else P.with_eligible(self.grid)
        return P.with_padded_returns(grid)

    def returns_of(self, chosen: DataFrame) -> DataFrame:
        """Padded returns of the names in `chosen`; the others are left out before their rows are framed."""
        prices = self.grid if self.prices is None else self.prices
        return P.with_padded_returns(prices).join(chosen.select("ticker").distinct(), "ticker", "left_semi")

    @cached_property
    def _tables(self) -> dict[Hashable, DataFrame]:
        return {}

    def kept(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        """A table made from this panel, stored when it is first asked for under `key`."""
        if key not in self._tables:
            self._tables[key] = cut_lineage(make())
        return self._tables[key]


def expand_grid(grid: dict[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations of parameter lists, the first parameter varying slowest."""
    if not grid:
        return [{}]
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def _spread_configs(rows: DataFrame, configs: Sequence[dict], score_of: Callable[[dict], str], keep: Sequence[str]) -> DataFrame:
    """One copy of each decision row per parameter set, carrying that set's score and name limit."""
    options = F.array(*[
        F.struct(F.lit(i).alias("config"), F.lit(int(c["top_n"])).alias("limit"), F.col(score_of(c)).alias("score"))
        for i, c in enumerate(configs)])
    return rows.select(*keep, F.explode(options).alias("_c")).select(*keep, "_c.config", "_c.limit", "_c.score")


def _select_and_size(rows: DataFrame, panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    """Rank, cap, size and volatility-target the scored decision rows of all parameter sets."""
    most = max(int(c["top_n"]) for c in configs)
    chosen = K.pick_top(rows, most, int(params["max_per_sector"] or 0), KEYS).filter(F.col("rank") <= F.col("limit"))
    if params["sizing"] == "inverse_vol" or params["vol_target"]:
        chosen = cut_lineage(chosen)   # at most `most` rows for each decision, whatever the number of names
        ready = panel.returns_of(chosen)
    if params["sizing"] == "inverse_vol":
        bars = int(params.get("vol_lookback", 60))
        measured = K.with_selected_vol(chosen, ready, bars, keys=KEYS, keep_path=bool(params["vol_target"]))
        sized = K.inverse_vol(cut_lineage(measured) if params["vol_target"] else measured, keys=KEYS)   # the target reads the book twice
    else:
        sized = K.equal_weight(chosen, keys=KEYS)
    if params["vol_target"]:
        sized = K.vol_target(sized, ready, float(params["vol_target"]), 1.0, int(params["vol_lookback"]), KEYS)
    return sized.select("config", "date", "bar_idx", "ticker", "weight")


def _at_decisions(scored: DataFrame, panel: Panel, params: dict) -> DataFrame:
    """Decision-date rows that pass the market filter, with sectors."""
    rows = scored.join(per_day(S.decision_dates(panel.calendar, params["rebalance"]).select("date")), "date", "left_semi")
    market = params.get("market_filter")
    if market:
        rows = G.apply_market_filter(rows, G.market_filter(panel.grid, market, int(params["filter_sma"])))
    if panel.sectors is None or not params.get("max_per_sector"):
        return rows.withColumn("sector", F.lit("Unknown"))
    return P.with_sector(rows, panel.sectors)


def momentum(panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    ready = panel.ready()
    wanted = sorted({(int(c["lookback"]), int(c["skip"])) for c in configs})
    scored = ready
    for lookback, skip in wanted:
        scored = G.with_momentum_score(scored, lookback, skip, params["market_filter"]).withColumnRenamed("score", f"score_{lookback}_{skip}")
    slim = scored.select("date", "bar_idx", "ticker", *[f"score_{a}_{b}" for a, b in wanted])
    rows = _at_decisions(slim, panel, params)
    spread = _spread_configs(rows, configs, lambda c: f"score_{int(c['lookback'])}_{int(c['skip'])}", ["date", "bar_idx", "ticker", "sector"])
    return _select_and_size(spread, panel, configs, params)


def sentiment(panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    if "news_count" not in panel.grid.columns:
        return panel.grid.limit(0).select(F.lit(0).alias("config"), "date", "bar_idx", "ticker", F.lit(0.0).alias("weight"))
    wanted = sorted({int(c["lookback"]) for c in configs})
    scored = G.news_rows(panel.ready(), S.decision_dates(panel.calendar, params["rebalance"]))
    for lookback in wanted:
        one = G.with_sentiment_score(scored, lookback, params["score"])
        one = G.ranked_sentiment(one, int(params["min_articles"]), params["market_filter"])
        scored = one.withColumnRenamed("score", f"score_{lookback}").drop("articles")
    slim = scored.select("date", "bar_idx", "ticker", *[f"score_{n}" for n in wanted])
    rows = _at_decisions(slim, panel, params)
    spread = _spread_configs(rows, configs, lambda c: f"score_{int(c['lookback'])}", ["date", "bar_idx", "ticker", "sector"])
    return _select_and_size(spread, panel, configs, params)


def sma_crossover(panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    named = [{**c, "top_n": c["max_names"]} for c in configs]
    wanted = sorted({(int(c["fast"]), int(c["slow"])) for c in configs})
    scored = P.with_recent(panel.ready(), itertools.chain(*wanted))
    for fast, slow in wanted:
        scored = G.with_sma_crossover(scored, fast, slow).withColumnRenamed("score", f"score_{fast}_{slow}").drop("sma_fast", "sma_slow")
    slim = scored.select("date", "bar_idx", "ticker", *[f"score_{a}_{b}" for a, b in wanted])
    rows = _at_decisions(slim, panel, params)
    spread = _spread_configs(rows, named, lambda c: f"score_{int(c['fast'])}_{int(c['slow'])}", ["date", "bar_idx", "ticker", "sector"])
    return _select_and_size(spread, panel, named, {**params, "max_per_sector": 0, "vol_target": 0})


def _z_of(c: dict) -> tuple[int, int]:
    return int(c["lookback"]), int(c["trend_sma"])


def mean_reversion_signals(panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    """The grid with z and uptrend on the decision dates for every pair of lengths, all in one frame, and without the bars' own
    fields: no decision reads them, so they need not be made, sorted or stored."""
    days = S.decision_dates(panel.calendar, params["rebalance"]).select("date", F.lit(True).alias("_decides"))
    out = P.with_running(panel.grid.join(per_day(days), "date", "left"), squares=True)
    for a, b in sorted({_z_of(c) for c in configs}):
        out = G.with_zscore(out, a, b, F.col("_decides")).withColumnsRenamed({"z": f"_z_{a}_{b}", "uptrend": f"_up_{a}_{b}"})
    return out.drop("_decides", "_tick", "_n", "_s", "_q", *B.BAR_FIELDS)


def _reverting(panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    """The rows that can be held under each parameter set, whatever the windows."""
    pairs = sorted({_z_of(c) for c in configs})
    grid = panel.grid if {f"_z_{a}_{b}" for a, b in pairs} <= set(panel.grid.columns) else mean_reversion_signals(panel, configs, params)
    today = grid.join(per_day(S.decision_dates(panel.calendar, params["rebalance"]).select("date")), "date", "left_semi")
    out = None
    for a, b in pairs:
        scored = today.select("date", "ticker", F.col(f"_z_{a}_{b}").alias("z"), F.col(f"_up_{a}_{b}").alias("uptrend"), "eligible")
        part = G.reverting(scored, {i: (c["z_entry"], c["z_exit"], c["max_names"]) for i, c in enumerate(configs) if _z_of(c) == (a, b)})
        out = part if out is None else out.unionByName(part)
    return out


def mean_reversion(panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    """Holdings start empty at `params["start"]` (a date) and after the warmup of each parameter set."""
    start = params.get("start")
    warm = [STRATEGIES["mean_reversion"].warmup(c) if start is not None else 0 for c in configs]
    sets = F.explode(F.array(*[F.struct(F.lit(i).alias("config"), F.lit(w).cast("long").alias("warm")) for i, w in enumerate(warm)]))
    days = panel.calendar if start is None else panel.calendar.filter(F.col("date") >= F.lit(start).cast("date"))
    span = days.agg(F.min("bar_idx").alias("a"), F.max("bar_idx").alias("b")).select("a", "b", sets.alias("c"))
    windows = span.select("c.config", F.greatest("a", "c.warm").alias("first_idx"), F.col("b").alias("last_idx")).filter(
        F.col("a").isNotNull() & (F.col("first_idx") <= F.col("last_idx")))
    return mean_reversion_runs(panel, configs, params, windows, ["config"])


def mean_reversion_runs(panel: Panel, configs: Sequence[dict], params: dict, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Holdings of every window (keys, config among them; first_idx, last_idx), each starting empty: one signal for all parameter sets."""
    every = S.decision_dates(panel.calendar, params["rebalance"])
    alive = panel.kept(("mean_reversion", params["rebalance"], *[(*_z_of(c), c["z_entry"], c["z_exit"], c["max_names"]) for c in configs]),
                       lambda: _reverting(panel, configs, params))
    days = windows.select(*keys, F.explode(F.sequence("first_idx", "last_idx")).alias("bar_idx")).join(per_day(every), "bar_idx")
    held = G.held_in_turn(alive, days.select(*keys, "date"), keys).join(per_day(every), "date")
    return K.equal_weight(held, keys=[*keys, "date"]).select(*keys, "date", "bar_idx", "ticker", "weight")


def buy_and_hold(panel: Panel, configs: Sequence[dict], params: dict) -> DataFrame:
    days = S.decision_dates(panel.calendar, params["rebalance"])
    out = None
    for i, c in enumerate(configs):
        names = c["tickers"].split(",") if isinstance(c["tickers"], str) else list(c["tickers"])
        held = G.buy_and_hold(panel.grid, [n for n in names if n.strip()]).join(per_day(days.select("date")), "date", "left_semi")
        part = held.select(F.lit(i).alias("config"), "date", "bar_idx", "ticker", "weight")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Spec:
    build: Callable[[Panel, Sequence[dict], dict], DataFrame]
    defaults: dict[str, Any]
    grid: dict[str, list] = field(default_factory=dict)
    warmup: Callable[[dict], int] = lambda p: 0
    runs: Callable[..., DataFrame] | None = None   # of a strategy whose holdings depend on earlier ones: the weights of many windows
    signals: Callable[[Panel, Sequence[dict], dict], DataFrame] | None = None   # the grid with columns that decisions read


def _sma_warmup(p: dict) -> int:
    if p["fast"] >= p["slow"]:
        raise ValueError(f"the fast average ({p['fast']} bars) has to be shorter than the slow one ({p['slow']} bars)")
    return int(p["slow"]) + 1


# Default parameters and search grids.
STRATEGIES: dict[str, Spec] = {
    "buy_and_hold": Spec(buy_and_hold, {"tickers": "SPY", "rebalance": "monthly"}),
    "sma_crossover": Spec(
        sma_crossover, {"fast": 50, "slow": 200, "sizing": "equal", "max_names": 30, "rebalance": "weekly"},
        {"fast": [20, 50], "slow": [100, 200]}, _sma_warmup),
    "momentum": Spec(
        momentum,
        {"lookback": 252, "skip": 21, "top_n": 10, "sizing": "inverse_vol", "vol_target": 0.15, "vol_lookback": 60,
         "max_per_sector": 3, "market_filter": "SPY", "filter_sma": 200, "rebalance": "monthly"},
        {"lookback": [126, 252], "top_n": [10, 20]}, lambda p: int(max(p["lookback"], p["filter_sma"])) + 1),
    "mean_reversion": Spec(
        mean_reversion,
        {"lookback": 20, "z_entry": -2.0, "z_exit": 0.0, "trend_sma": 100, "max_names": 10, "rebalance": "daily"},
        {"lookback": [10, 20], "z_entry": [-1.5, -2.0, -2.5]}, lambda p: int(max(p["lookback"], p["trend_sma"])) + 1, mean_reversion_runs,
        mean_reversion_signals),
    "sentiment": Spec(
        sentiment,
        {"lookback": 10, "min_articles": 3, "top_n": 20, "score": "tone", "sizing": "inverse_vol", "vol_target": 0.15,
         "vol_lookback": 60, "max_per_sector": 4, "market_filter": "SPY", "filter_sma": 200, "rebalance": "weekly"},
        {"lookback": [5, 10, 21], "top_n": [10, 20]},
        lambda p: int(max([p["lookback"], p["vol_lookback"]] + ([p["filter_sma"]] if p["market_filter"] else []))) + 1),
}


@dataclass(frozen=True)
class Strategy:
    """A named strategy with one or more parameter sets."""

    name: str
    params: dict[str, Any]
    configs: tuple[dict[str, Any], ...]
    spec: Spec | None = None   # of a strategy that is not registered

    @property
    def warmups(self) -> list[int]:
        """Bars that each parameter set needs before its first decision."""
        spec = self.spec or STRATEGIES[self.name]
        return [spec.warmup({**self.params, **c}) for c in self.configs]

    @property
    def warmup(self) -> int:
        """Bars needed before the first decision of any parameter set."""
        return min(self.warmups)

    @property
    def rebalance(self) -> str | int:
        return self.params["rebalance"]

    def weights(self, panel: Panel, start: str | None = None) -> DataFrame:
        """(config, date, bar_idx, ticker, weight) for every decision date. A strategy whose holdings depend on earlier
        holdings begins without any at `start`."""
        full = [{**self.params, **c} for c in self.configs]
        return (self.spec or STRATEGIES[self.name]).build(panel, full, self.params if start is None else {**self.params, "start": start})

    def signals(self, panel: Panel) -> DataFrame:
        """The panel's grid with the columns that decisions read, for a backtest to store with it: framed where the panel is
        built, while it still lies by ticker and in order."""
        spec = self.spec or STRATEGIES[self.name]
        return panel.grid if spec.signals is None else spec.signals(panel, [{**self.params, **c} for c in self.configs], self.params)

    @property
    def stateful(self) -> bool:
        """Whether what is held depends on what was held before, so that each window needs weights of its own."""
        return (self.spec or STRATEGIES[self.name]).runs is not None

    def weights_in(self, panel: Panel, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, date, bar_idx, ticker, weight) for the decisions of each window, every window starting without holdings."""
        full = [{**self.params, **c} for c in self.configs]
        return (self.spec or STRATEGIES[self.name]).runs(panel, full, self.params, windows, keys)


def custom_strategy(name: str, build: Callable[[Panel, Sequence[dict], dict], DataFrame], warmup: int | Callable[[dict], int] = 0,
                    search: dict[str, Sequence[Any]] | None = None, runs: Callable[..., DataFrame] | None = None, **params: Any) -> Strategy:
    """A user's strategy for `run_backtest` and `walk_forward`.

    `build(panel, configs, params)` returns (config, date, bar_idx, ticker, weight); `plans.custom` scores with column
    expressions or Python functions for it. `rebalance` defaults to monthly. A strategy that remembers what it held also
    gives `runs(panel, configs, params, windows, keys)`, its weights in windows that each start without holdings.
    """
    spec = Spec(build, params, warmup=warmup if callable(warmup) else lambda p: int(warmup), runs=runs)
    return Strategy(name, {"rebalance": "monthly", **params}, tuple(expand_grid(search or {})), spec)


def get_strategy(name: str, search: dict[str, Sequence[Any]] | None = None, **params: Any) -> Strategy:
    """A registered strategy with parameters over its defaults; `search` adds a grid of parameter sets."""
    if name not in STRATEGIES:
        raise KeyError(f"no strategy is called {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    spec = STRATEGIES[name]
    unknown = (set(params) | set(search or {})) - set(spec.defaults)
    if unknown:
        raise TypeError(f"{name} has no parameters {', '.join(sorted(unknown))}; it has {', '.join(sorted(spec.defaults))}")
    strategy = Strategy(name, {**spec.defaults, **params}, tuple(expand_grid(search or {})))
    for config in strategy.configs:
        spec.warmup({**strategy.params, **config})
    return strategy

"""Portfolio accounting without an event loop.

Weights decided at a close are traded at the next open. Between two such entries share counts do not
change, so everything inside a period is linear in the equity at its opening trade:

    equity(t) = equity_at_open * (1 - sum(w) - cost + sum(w * mark(t) / reference))

and the opening equities chain as a product of period growths. Only the cost of an entry depends on
the growth of the period before it, which contains the cost before that. Once it is known which legs
are bought and which are sold, an entry's cost is a - b / growth + fees / equity with three sums over its
legs (fees are the order minimums of orders too small for the proportional commission). All entries are computed at once
from the growths of the pass before: a cost moves by a few thousandths of what its growth is off, so each pass
shortens the error by that factor, however long the history is, and nothing walks through it.

The result is exact when no trade is suppressed: fractional shares, no trade band, no volume cap. Passes go on until no cost
changes by more than `EXACT`; the last change is kept as `residual`, and a book that does not settle is an error.

With `cap_cash` buys stop where the money ends: sales come first, then the purchases, fewest shares first, each with what
the ones before have left. A purchase that is cut short leaves its name below its target until the next entry. What an entry
can afford depends on the one before only through its costs, a few thousandths of what was traded, so repeating the sums
over all entries at once settles as fast as the costs do. Without it a book that wants more than all its equity plus costs
goes overdrawn; `periods` shows it as cash below 0.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.costs import commission, fill_price, loss_rate
from barloom.functions.scalars import safe_ratio
from barloom.session import cut_lineage

COSTS = ["penalty", "pct", "per_share", "per_order"]
TINY = 1e-12   # of equity; a smaller move is no trade
EXACT, MOST_PASSES = 1e-10, 25   # of equity


def trading_window(calendar: DataFrame, warmup: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: first and last bar to trade, given date bounds and the warmup of the strategy."""
    inside = calendar
    if start is not None:
        inside = inside.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside.filter(F.col("date") <= F.lit(end).cast("date"))
    return inside.agg(
        F.greatest(F.min("bar_idx"), F.lit(warmup).cast("long")).alias("first_idx"), F.max("bar_idx").alias("last_idx")
    ).filter(F.col("first_idx") <= F.col("last_idx"))


def entries_of(decisions: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decisions inside each window, moved to the next bar and numbered; the last bar's decision is void."""
    order = Window.partitionBy(*keys).orderBy("bar_idx")
    return decisions.join(windows, list(keys)).filter(
        (F.col("bar_idx") >= F.col("first_idx")) & (F.col("bar_idx") < F.col("last_idx"))
    ).select(
        *keys, "bar_idx", (F.col("bar_idx") + 1).alias("entry_idx"), F.row_number().over(order).alias("entry_no"),
        F.coalesce(F.lead("bar_idx").over(order), F.col("last_idx")).alias("until_idx"), *COSTS)


@dataclass
class Ledger:
    """The books of many configurations.

    weights    keys, bar_idx (of the decision), ticker, weight
    decisions  keys, bar_idx: every decision, also one that holds nothing
    windows    keys, first_idx, last_idx and the cost columns
    marks      ticker, bar_idx, date, mark, fill_ref
    """

    weights: DataFrame
    decisions: DataFrame
    windows: DataFrame
    marks: DataFrame
    keys: list[str]
    initial_cash: float = 100_000.0
    passes: int = 4   # before the first look at the residual; 0 without costs
    cap_cash: bool = False

    @cached_property
    def entries(self) -> DataFrame:
        return cut_lineage(entries_of(self.decisions, self.windows, self.keys))

    @cached_property
    def _wanted(self) -> DataFrame:
        """The legs as the targets want them; `goal` is the new weight, `rel` the price relative since the entry before."""
        k = self.keys
        entries = self.entries
        now = self.weights.filter(F.col("weight") != 0).join(entries.select(*k, "bar_idx", "entry_no"), [*k, "bar_idx"]).select(
            *k, "entry_no", "ticker", F.col("weight").alias("w"), F.lit(0.0).alias("w_prev"))
        then = now.select(*k, (F.col("entry_no") + 1).alias("entry_no"), "ticker", F.lit(0.0).alias("w"), F.col("w").alias("w_prev"))
        rows = now.unionByName(then).groupBy(*k, "entry_no", "ticker").agg(F.sum("w").alias("w"), F.sum("w_prev").alias("w_prev"))
        placed = rows.join(entries.drop("bar_idx"), [*k, "entry_no"])
        refs = self.marks.select("ticker", F.col("bar_idx").alias("entry_idx"), F.col("fill_ref").alias("ref")).filter(F.col("ref") > 0)
        path = Window.partitionBy(*k, "ticker").orderBy("entry_no")
        priced = placed.join(refs, ["ticker", "entry_idx"]).withColumn("rel", F.when(F.col("w_prev") != 0, F.col("ref") / F.lag("ref").over(path)))
        return cut_lineage(priced.withColumns({"wr": F.coalesce(F.col("w_prev") * F.col("rel"), F.lit(0.0)), "goal": F.col("w")}))

    @cached_property
    def _solved(self) -> tuple[DataFrame, DataFrame]:
        """Legs and periods: as wanted, or as far as the cash goes."""
        k = [*self.keys, "entry_no"]
        legs = self._wanted
        base = cut_lineage(self._base(legs))
        state, done = self._chained(base.withColumns({"cost": F.lit(0.0), "residual": F.lit(0.0)})), not self.passes
        for n in range(MOST_PASSES):
            if done:
                break
            state = self._pass(legs, base, state)
            if n + 1 >= self.passes:
                state = cut_lineage(state)
                done = not state.filter(F.col("residual") > EXACT).take(1)
        short = base.select(*k, "invested").join(state, k).filter(1 - F.col("invested") - F.col("cost") < -TINY)
        if done and self.cap_cash and short.take(1):
            done = False
            for _ in range(MOST_PASSES):
                legs = cut_lineage(self._affordable(legs, state))
                base = cut_lineage(self._base(legs))
                state = cut_lineage(self._pass(legs, base, state))
                if not state.filter(F.col("residual") > EXACT).take(1) and not legs.filter(F.col("changed") > EXACT).take(1):
                    done = True
                    break
        if not done:
            raise ArithmeticError(f"the costs of the entries do not settle within {MOST_PASSES} passes")
        return legs, cut_lineage(base.drop("gross").join(state.withColumnRenamed("equity", "open_equity"), k))

    @property
    def legs(self) -> DataFrame:
        """One row per (entry, ticker) that is held before or after it: new weight, old weight, price relative. Stored."""
        return self._solved[0]

    @property
    def periods(self) -> DataFrame:
        """One row per entry: growth since the previous one, cost and equity at the open before costs. Stored."""
        return self._solved[1]

    def _base(self, legs: DataFrame) -> DataFrame:
        """The entries with what they invest and their growth before costs."""
        k = [*self.keys, "entry_no"]
        sums = legs.groupBy(*k).agg(F.sum("w").alias("invested"), F.sum("w_prev").alias("_w_prev"), F.sum("wr").alias("_wr"))
        return self.entries.join(sums, k, "left").na.fill(0.0, ["invested", "_w_prev", "_wr"]).withColumn(
            "gross", 1 - F.col("_w_prev") + F.col("_wr")).drop("_w_prev", "_wr")

    def _pass(self, legs: DataFrame, base: DataFrame, state: DataFrame) -> DataFrame:
        """The chain with costs at the growths of `state`; `residual` is what that changed of a cost."""
        k = [*self.keys, "entry_no"]
        terms = self._cost_terms(legs, state)
        fees = F.when(F.col("fees") > 0, F.coalesce(safe_ratio(F.col("fees"), F.col("equity")), F.lit(0.0))).otherwise(0.0)
        cost = F.col("a") - F.coalesce(safe_ratio(F.col("b"), F.col("growth")), F.lit(0.0)) + fees
        new = terms.withColumn("_cost", cost).select(*k, F.col("_cost").alias("cost"), F.abs(F.col("_cost") - F.col("cost")).alias("residual"))
        return self._chained(base.join(new, k, "left").na.fill(0.0, ["cost", "residual"]))

    def _chained(self, rows: DataFrame) -> DataFrame:
        """Growth and opening equity of every entry: what the entry before cost is missing from its growth."""
        path = Window.partitionBy(*self.keys).orderBy("entry_no")
        grown = rows.withColumn("growth", F.col("gross") - F.coalesce(F.lag("cost").over(path), F.lit(0.0)))
        equity = F.lit(float(self.initial_cash)) * F.product("growth").over(path.rowsBetween(Window.unboundedPreceding, 0))
        return grown.withColumn("equity", equity).select(*self.keys, "entry_no", "growth", "cost", "equity", "residual")

    def _affordable(self, legs: DataFrame, state: DataFrame) -> DataFrame:
        """The legs with purchases cut to the cash that sales and earlier purchases leave, in fractions of the opening equity."""
        k = [*self.keys, "entry_no"]
        has = F.coalesce(safe_ratio(F.col("wr"), F.col("growth")), F.lit(0.0))
        rows = legs.join(state.select(*k, "growth", "equity"), k).withColumn("_has", has).withColumn("_move", F.col("goal") - F.col("_has"))
        size = F.abs("_move") * F.col("equity") / F.col("ref")
        fee = F.when(F.abs("_move") > TINY, F.greatest(size * F.col("per_share") + size * fill_price(F.col("ref"), F.signum("_move")) * F.col("pct"), F.col("per_order"))).otherwise(0.0)
        paid = F.col("_move") * (1 + F.signum("_move") * F.col("penalty")) + F.coalesce(safe_ratio(fee, F.col("equity")), F.lit(0.0))
        rows = rows.withColumns({"_paid": paid, "_buys": (F.col("_move") > 0).cast("int")})
        order = Window.partitionBy(*k).orderBy("_buys", F.col("_move") / F.col("ref"), "ticker")
        # Sales sort first, so what has been paid before a purchase holds all of them.
        left = 1 - F.sum("_has").over(Window.partitionBy(*k)) - F.coalesce(F.sum("_paid").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        unit = (1 + F.col("penalty")) * (1 + F.col("pct")) + F.col("per_share") / F.col("ref")
        cut = rows.withColumn("_left", left).withColumn("_w", F.when((F.col("_buys") == 1) & (F.col("_left") < F.col("_move") * unit), F.col("_has") + F.greatest(F.col("_left"), F.lit(0.0)) / unit).otherwise(F.col("goal")))
        path = Window.partitionBy(*self.keys, "ticker").orderBy("entry_no")
        out = cut.withColumns({"changed": F.abs(F.col("_w") - F.col("w")), "w_prev": F.when(F.col("rel").isNotNull(), F.lag("_w").over(path)).otherwise(0.0)}).withColumn("w", F.col("_w"))
        return out.withColumn("wr", F.coalesce(F.col("w_prev") * F.col("rel"), F.lit(0.0))).select(*[c for c in legs.columns if c != "changed"], "changed")

    def _cost_terms(self, legs: DataFrame, state: DataFrame) -> DataFrame:
        """Per entry the sums that make its cost a - b / growth + fees / equity, with sides and sizes by `state`.

        An order whose proportional commission is below the minimum pays the minimum instead.
        """
        k = [*self.keys, "entry_no"]
        move = F.col("w") - F.coalesce(safe_ratio(F.col("wr"), F.col("growth")), F.lit(0.0))
        rows = legs.join(state.select(*k, "growth", "equity", "cost"), k).withColumns({"_move": move, "_side": F.signum(move)})
        size = F.abs("_move") * F.col("equity") / F.col("ref")
        fee = size * F.col("per_share") + size * fill_price(F.col("ref"), F.col("_side")) * F.col("pct")
        least = (F.abs("_move") > TINY) & (fee < F.col("per_order"))
        rate = F.when(least, F.col("penalty")).otherwise(loss_rate(F.col("_side"), F.col("ref")))
        paid = F.col("_side") * rate
        return rows.groupBy(*k, "growth", "equity", "cost").agg(F.sum(paid * F.col("w")).alias("a"), F.sum(paid * F.col("wr")).alias("b"), F.sum(F.when(least, F.col("per_order")).otherwise(0.0)).alias("fees"))

    @cached_property
    def held(self) -> DataFrame:
        """Positions at every close: shares and market value per (bar, ticker)."""
        k = self.keys
        opened = self.periods.select(*k, "entry_no", "open_equity")
        spread = self.legs.filter(F.col("w") != 0).join(opened, [*k, "entry_no"]).select(
            *k, "ticker", (F.col("w") * F.col("open_equity") / F.col("ref")).alias("shares"),
            F.explode(F.sequence("entry_idx", "until_idx")).alias("bar_idx"))
        return spread.join(self.marks.select("ticker", "bar_idx", "mark"), ["ticker", "bar_idx"]).withColumn(
            "value", F.col("shares") * F.col("mark"))

    @cached_property
    def equity(self) -> DataFrame:
        """Cash and equity at every close of each window, flat at the initial cash before the first entry.

        Materialised, because statistics, turnover and the overlay read it again.
        """
        k = self.keys
        first = self.entries.groupBy(*k).agg(F.min("entry_idx").alias("_start"))
        idle = self.windows.join(first, list(k), "left").select(
            *k, F.col("first_idx").alias("_from"), F.coalesce(F.col("_start") - 1, F.col("last_idx")).alias("_to"),
            F.lit(float(self.initial_cash)).alias("cash"))
        busy = self.periods.select(
            *k, F.col("entry_idx").alias("_from"), F.col("until_idx").alias("_to"),
            (F.col("open_equity") * (1 - F.col("invested") - F.col("cost"))).alias("cash"))
        days = idle.unionByName(busy).select(*k, "cash", F.explode(F.sequence("_from", "_to")).alias("bar_idx"))
        value = self.held.groupBy(*k, "bar_idx").agg(F.sum("value").alias("_value"))
        return cut_lineage(days.join(value, [*k, "bar_idx"], "left").select(
            *k, "bar_idx", "cash", (F.col("cash") + F.coalesce("_value", F.lit(0.0))).alias("equity")))

    @cached_property
    def weights_at_close(self) -> DataFrame:
        return self.held.join(self.equity.select(*self.keys, "bar_idx", "equity"), [*self.keys, "bar_idx"]).select(
            *self.keys, "bar_idx", "ticker", "shares", safe_ratio(F.col("value"), F.col("equity")).alias("weight"))

    @cached_property
    def trades(self) -> DataFrame:
        """One row per entry and ticker whose share count changes."""
        k = [*self.keys, "entry_no"]
        rows = self.legs.join(self.periods.select(*k, "growth", "open_equity"), k)
        move = F.col("w") - F.coalesce(safe_ratio(F.col("wr"), F.col("growth")), F.lit(0.0))
        sign = F.signum(move)
        filled = rows.withColumns({"_move": move, "_sign": sign}).filter(F.abs("_move") > TINY).withColumns({
            "quantity": F.abs("_move") * F.col("open_equity") / F.col("ref"),
            "price": fill_price(F.col("ref"), F.col("_sign")),
        })
        return filled.select(
            *self.keys, F.col("entry_idx").alias("bar_idx"), "ticker",
            F.when(F.col("_sign") > 0, "buy").otherwise("sell").alias("side"), "quantity", "price",
            commission(F.col("quantity"), F.col("price")).alias("commission"), (F.col("quantity") * F.col("price")).alias("notional"))

    @cached_property
    def turnover(self) -> DataFrame:
        """Traded notional over closing equity for every bar of the window; most bars have none."""
        k = [*self.keys, "bar_idx"]
        traded = self.trades.groupBy(*k).agg(F.sum("notional").alias("_n"))
        return self.equity.join(traded, k, "left").select(
            *k, F.when(F.col("equity") > 0, F.coalesce("_n", F.lit(0.0)) / F.col("equity")).otherwise(0.0).alias("turnover"))


def benchmark_equity(marks: DataFrame, ticker: str, windows: DataFrame, keys: Sequence[str], initial_cash: float = 100_000.0) -> DataFrame:
    """The benchmark's last known close rebased to the initial cash; absent when it has no price somewhere in the window."""
    days = windows.select(*keys, "first_idx", "last_idx", F.explode(F.sequence("first_idx", "last_idx")).alias("bar_idx"))
    line = days.join(marks.filter(F.col("ticker") == ticker).select("bar_idx", "mark"), "bar_idx", "left")
    per = line.groupBy(*keys).agg(
        F.min_by("mark", "bar_idx").alias("_base"), F.count_if(F.col("mark").isNull()).alias("_holes")
    ).filter((F.col("_holes") == 0) & (F.col("_base") > 0))
    return line.join(per, list(keys)).select(*keys, "bar_idx", (F.col("mark") / F.col("_base") * initial_cash).alias("benchmark"))


def daily_returns(equity: DataFrame, keys: Sequence[str], value: str = "equity") -> DataFrame:
    """Add `ret`, the change since the previous bar, 0 on the first."""
    order = Window.partitionBy(*keys).orderBy("bar_idx")
    return equity.withColumn("ret", F.coalesce(safe_ratio(F.col(value), F.lag(value).over(order)) - 1.0, F.lit(0.0)))


def drawdown_overlay(ledger: Ledger, halve_at: float = 0.10, flat_at: float = 0.20) -> Ledger:
    """The same book with exposure cut while the unthrottled curve is below its peak.

    The peak starts at the initial cash. The scale of a decision comes from the first pass, so the
    second pass needs no feedback from its own equity.
    """
    from barloom.operators.limits import drawdown_scale

    upto = Window.partitionBy(*ledger.keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("equity").over(upto), F.lit(float(ledger.initial_cash)))
    scale = ledger.equity.select(*ledger.keys, "bar_idx", drawdown_scale(1.0 - F.col("equity") / peak, halve_at, flat_at).alias("_scale"))
    cut = ledger.weights.join(scale, [*ledger.keys, "bar_idx"]).withColumn("weight", F.col("weight") * F.col("_scale")).drop("_scale")
    return Ledger(cut, ledger.decisions, ledger.windows, ledger.marks, ledger.keys, ledger.initial_cash, ledger.passes, ledger.cap_cash)

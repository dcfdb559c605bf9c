"""Portfolio limits applied to target weights, and the drawdown budget."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import safe_ratio
from barloom.session import cut_lineage

SLACK = 1e-9
ROUNDS = 5


@dataclass(frozen=True)
class RiskLimits:
    max_weight: float = 0.25
    max_gross: float = 1.0
    max_net: float | None = None
    allow_short: bool = False
    min_weight: float = 0.0
    max_sector_weight: float | None = None


def zero_non_members(weights: DataFrame) -> DataFrame:
    """Names that are not index members today cannot be targeted."""
    return weights.withColumn("weight", F.when(F.col("member"), F.col("weight")).otherwise(0.0))


def _rebalanced(weight: Column, plan: Column, max_weight: float) -> Column:
    """A name's weight after the rounds in `plan`: scale with its sector, then take its share of the excess."""
    def one_round(w: Column, p: Column) -> Column:
        cut = w * p["factor"]
        size = F.abs(cut)
        share = F.least(
            p["excess"] * safe_ratio(size, p["takers"]), F.greatest(F.lit(max_weight) - size, F.lit(0.0)),
            p["sector_room"] * safe_ratio(size, p["sector_size"]))
        gain = F.when(p["takes"] & (size > 0), share).otherwise(0.0)
        return cut + F.when(cut >= 0, gain).otherwise(-gain)

    return F.aggregate(plan, weight, one_round)


def cap_sectors(weights: DataFrame, cap: float, max_weight: float = 1.0, keys: Sequence[str] = ("date",),
                rounds: int = ROUNDS) -> DataFrame:
    """Scale sectors above `cap` down to it and hand the excess pro rata to names that still have room.

    A name's room is its own limit and its share of its sector's remaining room; a sector that was cut
    stays closed; what nobody can take becomes cash. Names without a sector are exempt and may receive.

    What a round does to a name follows from sector totals alone. So every round is a pre-aggregated sum
    per (decision, sector), a few rows per decision, whose outcome is added to a plan that is joined
    back; names are never gathered, however many one decision holds. Most decisions are settled by the
    first round: their plans are set aside and later rounds read the names of the others only.
    """
    orphan = "\u0000"
    names = cut_lineage(weights.withColumn("_sector", F.coalesce("sector", F.lit(orphan))))
    on = [*keys, "_sector"]
    decision = Window.partitionBy(*keys)
    known = F.col("_sector") != orphan
    none = F.array().cast("array<struct<factor:double,takes:boolean,excess:double,takers:double,sector_room:double,sector_size:double>>")
    state, settled = None, []
    for _ in range(rounds):
        if state is None:
            totals = names.groupBy(*on).agg(F.sum(F.abs("weight")).alias("_tot")).withColumns(
                {"_plan": none, "_closed": F.lit(False), "_done": F.lit(False)})
        else:
            now = names.join(state, on).withColumn("_w", _rebalanced(F.col("weight"), F.col("_plan"), max_weight))
            totals = now.groupBy(*on).agg(
                F.sum(F.abs("_w")).alias("_tot"), F.first("_plan").alias("_plan"), F.first("_closed").alias("_closed"), F.first("_done").alias("_done"))
        over = known & ~F.col("_done") & (F.col("_tot") > cap * (1 + SLACK))
        cut = totals.withColumn("_over", over).withColumn("_factor", F.when(F.col("_over"), F.lit(cap) / F.col("_tot")).otherwise(1.0))
        cut = cut.withColumns({
            "_size": F.col("_tot") * F.col("_factor"), "_closed": F.col("_closed") | F.col("_over"),
            "_excess": F.sum(F.when(F.col("_over"), F.col("_tot") - cap).otherwise(0.0)).over(decision),
        })
        taker = ~F.col("_closed") & (F.col("_size") > 0)
        cut = cut.withColumns({"_takes": taker, "_takers": F.sum(F.when(taker, F.col("_size")).otherwise(0.0)).over(decision)})
        live = (F.col("_excess") > 0) & (F.col("_takers") > 0)
        step = F.struct(
            F.col("_factor").alias("factor"), (F.col("_takes") & live).alias("takes"), F.col("_excess").alias("excess"), F.col("_takers").alias("takers"),
            F.when(known, F.greatest(F.lit(cap) - F.col("_size"), F.lit(0.0))).otherwise(float("inf")).alias("sector_room"), F.col("_size").alias("sector_size"))
        state = cut_lineage(cut.select(*on, F.concat("_plan", F.array(step)).alias("_plan"), "_closed", (F.col("_done") | ~live).alias("_done")))
        settled.append(state.filter("_done"))
        state = state.filter("NOT _done")
        if not state.take(1):
            break
    plans = state
    for part in settled:
        plans = plans.unionByName(part)
    done = names.join(plans.select(*on, "_plan"), on).withColumn("weight", _rebalanced(F.col("weight"), F.col("_plan"), max_weight))
    return done.select(*weights.columns)


def apply_limits(weights: DataFrame, limits: RiskLimits = RiskLimits(), keys: Sequence[str] = ("date",)) -> DataFrame:
    """Clip shorts, clip single names, drop dust, cap sectors, then scale gross and net, in this order.

    The gross and net of a decision are pre-aggregated and joined back.
    """
    w = F.col("weight")
    low = F.lit(-limits.max_weight if limits.allow_short else 0.0)
    out = weights.withColumn("weight", F.least(F.greatest(w, low), F.lit(limits.max_weight)))
    if limits.min_weight > 0:
        out = out.withColumn("weight", F.when(F.abs(w) < limits.min_weight, 0.0).otherwise(w))
    if limits.max_sector_weight is not None and "sector" in weights.columns:
        out = cap_sectors(out, limits.max_sector_weight, limits.max_weight, keys)
    totals = out.groupBy(*keys).agg(F.sum(F.abs("weight")).alias("_gross"), F.abs(F.sum("weight")).alias("_net"))
    scale = F.when(F.col("_gross") > limits.max_gross, F.lit(limits.max_gross) / F.col("_gross")).otherwise(1.0)
    totals = totals.withColumn("_scale", scale)
    if limits.max_net is not None:
        net = F.col("_net") * F.col("_scale")
        totals = totals.withColumn("_scale", F.when(net > limits.max_net, F.col("_scale") * (F.lit(limits.max_net) / net)).otherwise(F.col("_scale")))
    return out.join(totals.select(*keys, "_scale"), list(keys)).withColumn("weight", w * F.col("_scale")).select(*weights.columns)


def drawdown_scale(drawdown: Column, halve_at: float = 0.10, flat_at: float = 0.20) -> Column:
    """Exposure multiplier for a drawdown given as a positive fraction."""
    return F.when(drawdown >= flat_at, 0.0).when(drawdown >= halve_at, 0.5).otherwise(1.0)


def drawdown_from_history(history: DataFrame, keys: Sequence[str] = ("account",), order: str = "as_of",
                          halve_at: float = 0.10, flat_at: float = 0.20) -> DataFrame:
    """Per account: how far the last recorded equity is below the highest one, and the exposure that leaves."""
    known = history.filter(F.col("equity").isNotNull() & ~F.isnan("equity"))
    last = known.groupBy(*keys).agg(F.max("equity").alias("peak"), F.max_by("equity", order).alias("last_equity"))
    dd = F.when(F.col("peak") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - safe_ratio(F.col("last_equity"), F.col("peak"))))
    return last.withColumn("drawdown", dd).withColumn("scale", drawdown_scale(F.col("drawdown"), halve_at, flat_at))

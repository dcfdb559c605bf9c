"""Cross-sectional selection and position sizing.

Inputs are rows per (keys..., ticker), where the keys name one decision: usually a date, or a
configuration and a date.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import is_infinite, safe_ratio
from barloom.operators.panel import trailing

YEAR = 252


def pick_top(scored: DataFrame, top_n: int, max_per_sector: int = 0, keys: Sequence[str] = ("date",),
             ascending: bool = False) -> DataFrame:
    """The best `top_n` scores of each decision with at most `max_per_sector` of any known sector; ties go by ticker.

    Taking names greedily with a sector quota equals two ranks: first within the sector, then within
    the decision. Both ranks are bounded by a literal, so Spark keeps only the leading rows of every
    task before the shuffle and a crowded date never travels whole.
    """
    order = [F.asc("score") if ascending else F.desc("score"), F.asc("ticker")]
    ranked = scored.filter(F.col("score").isNotNull())
    if max_per_sector > 0:
        by_sector = Window.partitionBy(*keys, "sector").orderBy(*order)
        ranked = ranked.withColumn("_sector_rank", F.row_number().over(by_sector)).filter(F.col("_sector_rank") <= top_n)
        ranked = ranked.filter((F.col("_sector_rank") <= max_per_sector) | (F.col("sector") == "Unknown")).drop("_sector_rank")
    overall = Window.partitionBy(*keys).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= top_n)


def equal_weight(selected: DataFrame, gross: float = 1.0, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Add `weight` = gross / number of names of the decision."""
    return selected.withColumn("weight", F.lit(gross) / F.count("*").over(Window.partitionBy(*keys)))


def with_trailing_vol(grid: DataFrame, bars: int = 60, min_periods: int = 20) -> DataFrame:
    """Add `vol`: deviation of the padded returns of the last `bars` bars, null below `min_periods` or when flat."""
    w = trailing(bars)
    vol = F.stddev_samp("pad_ret").over(w)
    return grid.withColumn("vol", F.when((F.count("pad_ret").over(w) >= min_periods) & (vol > 0), vol))


def past_returns(rows: DataFrame, returns: DataFrame, bars: int, keys: Sequence[str], *carry: str) -> DataFrame:
    """Pair each row with the padded returns of its ticker's last `bars` bars.

    Only selected names are spread, so the join moves names x bars rows per decision and the panel is
    read once in place, instead of framing `bars` rows around every cell of it.
    """
    first = F.greatest(F.col("bar_idx") - (bars - 1), F.lit(0).cast("long"))
    past = rows.select(*keys, "ticker", *carry, F.explode(F.sequence(first, F.col("bar_idx"))).alias("bar_idx"))
    return past.join(returns.select("ticker", "bar_idx", "pad_ret"), ["ticker", "bar_idx"], "left")


def with_selected_vol(selected: DataFrame, returns: DataFrame, bars: int = 60, min_periods: int = 20,
                      keys: Sequence[str] = ("date",), keep_path: bool = False) -> DataFrame:
    """`with_trailing_vol` for selected rows only. `keep_path` also keeps the returns it is made of, at most `bars` of them,
    as `path` for `vol_target`, so that the panel is joined once."""
    path = F.collect_list(F.struct("bar_idx", F.coalesce("pad_ret", F.lit(0.0)).alias("r")))
    stats = past_returns(selected, returns, bars, keys).groupBy(*keys, "ticker").agg(
        F.count("pad_ret").alias("_n"), F.stddev_samp("pad_ret").alias("_sd"), *([path.alias("path")] if keep_path else []))
    vol = F.when((F.col("_n") >= min_periods) & (F.col("_sd") > 0), F.col("_sd"))
    return selected.join(stats.select(*keys, "ticker", vol.alias("vol"), *(["path"] if keep_path else [])), [*keys, "ticker"], "left")


def inverse_vol(selected: DataFrame, gross: float = 1.0, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Weights proportional to 1 / vol; names without a usable vol are dropped."""
    usable = selected.filter(F.col("vol").isNotNull()).withColumn("_inv", F.lit(1.0) / F.col("vol"))
    total = F.sum("_inv").over(Window.partitionBy(*keys))
    return usable.withColumn("weight", F.col("_inv") / total * F.lit(gross)).drop("_inv")


def realised_vol(weights: DataFrame, returns: DataFrame, bars: int = 60, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Annual volatility that today's book would have had over the last `bars` bars (those in `path`, if it was kept)."""
    if "path" in weights.columns:
        rows = weights.select(*keys, "weight", F.explode("path").alias("p")).select(*keys, "weight", "p.bar_idx", F.col("p.r").alias("pad_ret"))
    else:
        rows = past_returns(weights, returns, bars, keys, "weight")
    daily = rows.groupBy(*keys, "bar_idx").agg(F.sum(F.col("weight") * F.coalesce("pad_ret", F.lit(0.0))).alias("book_ret"))
    return daily.groupBy(*keys).agg((F.stddev_samp("book_ret") * F.sqrt(F.lit(float(YEAR)))).alias("realised"))


def vol_target(weights: DataFrame, returns: DataFrame, target: float = 0.15, max_leverage: float = 1.0,
               bars: int = 60, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Scale every decision so that its realised volatility meets the target, never beyond `max_leverage`.

    A book without realised volatility is left alone.
    """
    gross = F.greatest(F.sum(F.abs("weight")).over(Window.partitionBy(*keys)), F.lit(1e-12))
    both = weights.withColumn("_gross", gross).join(realised_vol(weights, returns, bars, keys), list(keys), "left")
    scale = F.least(F.lit(target) / F.col("realised"), F.lit(max_leverage) / F.col("_gross"))
    return both.withColumn("weight", F.when(F.col("realised") > 0, F.col("weight") * scale).otherwise(F.col("weight"))).drop("_gross", "realised")


def clean_weights(weights: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Null, NaN and infinite weights become 0; names outside the universe go."""
    w = F.col("weight")
    bad = w.isNull() | F.isnan(w) | is_infinite(w)
    out = weights.withColumn("weight", F.when(bad, 0.0).otherwise(w))
    return out if universe is None else out.join(universe.select("ticker").distinct(), "ticker", "left_semi")


__all__ = ["YEAR", "clean_weights", "equal_weight", "inverse_vol", "pick_top", "realised_vol", "safe_ratio", "vol_target", "with_selected_vol", "with_trailing_vol"]

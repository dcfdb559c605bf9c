"""Panel projections and point-in-time access.

All trailing views are window frames that end at the current row, so a value for a date cannot
depend on a later one.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scalars import finite_or_null, per_day, safe_ratio


def by_ticker() -> WindowSpec:
    """A ticker's rows in calendar order."""
    return Window.partitionBy("ticker").orderBy("bar_idx")


def trailing(bars: int) -> WindowSpec:
    """The last `bars` rows of a ticker up to and including the current one."""
    return by_ticker().rowsBetween(-(bars - 1), 0)


def in_ticks(price: Column | str) -> Column:
    """A price in whole hundred-millionths. Sums of such numbers are exact, in any order; NaN is missing."""
    price = F.col(price) if isinstance(price, str) else price
    return F.when(~F.isnan(price), F.rint(price * F.lit(1e8)).cast("long"))


def with_running(grid: DataFrame, squares: bool = False) -> DataFrame:
    """Add the close in ticks (`_tick`) and its running count `_n`, sum `_s` and, if wanted, sum of squares `_q`."""
    upto = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    wide = F.col("_tick").cast("decimal(19,0)")
    out = grid.withColumn("_tick", in_ticks("close"))
    return out.withColumns({
        "_n": F.count("_tick").over(upto), "_s": F.coalesce(F.sum("_tick").over(upto), F.lit(0).cast("long")),
        **({"_q": F.coalesce(F.sum(wide * wide).over(upto), F.lit(0).cast("decimal(38,0)"))} if squares else {}),
    })


def recent(running: str, bars: int) -> Column:
    """What a running total of `with_running` gained in the last `bars` rows: the total of the trailing frame, whatever its length."""
    return F.col(running) - F.coalesce(F.lag(running, bars).over(by_ticker()), F.lit(0).cast("long"))


def with_recent(grid: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """Add `_n_<bars>` and `_s_<bars>`: count and sum of the closes in ticks of the last `bars` rows, for all lengths in one frame."""
    out = grid if "_s" in grid.columns else with_running(grid)
    return out.withColumns({f"{of}_{bars}": recent(of, bars) for bars in sorted(set(lengths)) for of in ("_n", "_s")})


def panel_slice(grid: DataFrame, calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows between two dates, both included, with positions counted from the new first bar."""
    out = grid
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    if start is None:
        return out
    origin = calendar.filter(F.col("date") >= F.lit(start).cast("date")).agg(F.min("bar_idx")).scalar()
    return out.withColumn("bar_idx", F.col("bar_idx") - origin)


def select_tickers(grid: DataFrame, tickers: DataFrame) -> DataFrame:
    """Keep the listed tickers; unknown names are ignored."""
    return grid.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def snapshot_of_date(calendar: DataFrame, membership: DataFrame) -> DataFrame:
    """(date, snapshot): the latest membership snapshot at or before each calendar date, null before the first."""
    snaps = membership.select(F.col("date"), F.col("date").alias("snapshot"), F.lit(False).alias("_bar")).distinct()
    days = calendar.select("date", F.lit(None).cast("date").alias("snapshot"), F.lit(True).alias("_bar"))
    upto = Window.orderBy("date", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.unionByName(snaps).withColumn("snapshot", F.last("snapshot", ignorenulls=True).over(upto))
    return filled.filter("_bar").select("date", "snapshot")


def membership_intervals(calendar: DataFrame, membership: DataFrame) -> DataFrame:
    """(ticker, first, last): unbroken runs of dates on which the latest snapshot holds the ticker.

    Only snapshots that are some calendar date's latest count, and they are numbered; a ticker's consecutive numbers
    make one interval. So a name that stays is one row, however often snapshots are taken.
    """
    order = Window.orderBy("snapshot")   # one row for each snapshot that counts, at most one a day
    valid = snapshot_of_date(calendar, membership).filter("snapshot IS NOT NULL").groupBy("snapshot").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    numbered = valid.withColumn("_no", F.row_number().over(order)).withColumnRenamed("snapshot", "date")
    held = membership.select("ticker", "date").distinct().join(per_day(numbered), "date")
    run = F.col("_no") - F.row_number().over(Window.partitionBy("ticker").orderBy("_no"))
    return held.withColumn("_run", run).groupBy("ticker", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def with_membership(grid: DataFrame, calendar: DataFrame, membership: DataFrame) -> DataFrame:
    """Add `member`: true when the ticker belonged to the latest snapshot at or before the date.

    The as-of step runs on calendar dates and snapshots only. What remains is a join with a ticker's disjoint intervals on the
    key that the panel is already partitioned by; each row meets at most one of them. The intervals of a task's names are few
    and go into a hash table, so the panel is not sorted for it.
    """
    spans = membership_intervals(calendar, membership).select(F.col("ticker").alias("_name"), "first", "last")
    inside = (F.col("ticker") == F.col("_name")) & F.col("date").between(F.col("first"), F.col("last"))
    return grid.join(spans.hint("shuffle_hash"), inside, "left").withColumn("member", F.col("_name").isNotNull()).drop("_name", "first", "last")


def all_members(membership: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every ticker that appears in a snapshot dated inside the range."""
    out = membership
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out.select("ticker").distinct()


def with_eligible(grid: DataFrame) -> DataFrame:
    """Add `eligible`: there is a close today and, when membership is attached, the name is a member today."""
    ok = F.col("close").isNotNull()
    if "member" in grid.columns:
        ok = ok & F.col("member")
    return grid.withColumn("eligible", ok)


def with_features(grid: DataFrame, features: DataFrame, names: list[str] | None = None,
                  fill_value: float | None = 0.0) -> DataFrame:
    """Attach named (ticker, date) columns to the grid; missing cells take `fill_value`."""
    names = names if names is not None else [c for c in features.columns if c not in ("ticker", "date")]
    unknown = [n for n in names if n not in features.columns]
    if unknown:
        raise KeyError(f"the feature table lacks {unknown}; it holds {', '.join(sorted(set(features.columns) - {'ticker', 'date'}))}")
    out = grid.join(features.select("ticker", "date", *names), ["ticker", "date"], "left")
    if fill_value is None:
        return out
    return out.withColumns({n: F.coalesce(finite_or_null(F.col(n).cast("double")), F.lit(fill_value)) for n in names})


def with_min_history(grid: DataFrame, min_bars: int) -> DataFrame:
    """Drop tickers with fewer than `min_bars` closes."""
    counted = grid.withColumn("_closes", F.count("close").over(Window.partitionBy("ticker")))
    return counted.filter(F.col("_closes") >= min_bars).drop("_closes")


def with_returns(grid: DataFrame) -> DataFrame:
    """Simple returns between adjacent bars; a hole makes both neighbours null."""
    return grid.withColumn("ret", safe_ratio(F.col("close"), F.lag("close").over(by_ticker())) - 1.0)


def with_mark(grid: DataFrame) -> DataFrame:
    """Add `mark`, the last known close, and `fill_ref`, today's open or else the previous mark."""
    upto = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    before = by_ticker().rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumns({
        "mark": F.last("close", ignorenulls=True).over(upto),
        "fill_ref": F.coalesce("open", F.last("close", ignorenulls=True).over(before)),
    })


def with_padded_returns(grid: DataFrame) -> DataFrame:
    """Returns on the last known close: a hole gives 0, and the first bar after it the whole move."""
    if "pad_ret" in grid.columns:
        return grid
    marked = grid if "mark" in grid.columns else with_mark(grid)
    return marked.withColumn("pad_ret", safe_ratio(F.col("mark"), F.lag("mark").over(by_ticker())) - 1.0)


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """Add `sector`, 'Unknown' for unmapped tickers."""
    return rows.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Unknown"))
    )


def eligible_share(grid: DataFrame) -> DataFrame:
    """Average over days of the share of loaded names that are members."""
    member = F.col("member").cast("double")
    return grid.groupBy("date").agg(F.avg(member).alias("share")).agg(F.avg("share").alias("eligible_share"))


def full_window(value: Column, over: WindowSpec, bars: int, agg=F.avg) -> Column:
    """An aggregate that is null unless the frame holds `bars` non-null values."""
    return F.when(F.count(value).over(over) == bars, agg(value).over(over))

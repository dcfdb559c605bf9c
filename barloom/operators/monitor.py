"""Checks over holdings, orders and logs, for many accounts in one pass.

Each check returns the rows that fail: (account, rule, ticker, value). An account without a row passes.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import finite_or_null, per_day, safe_ratio
from barloom.operators.schedule import trading_calendar

NEVER_STALE = 260


def _failure(rule: str, value: Column, ticker: Column | None = None) -> list[Column]:
    return ["account", F.lit(rule).alias("rule"), (ticker if ticker is not None else F.lit(None).cast("string")).alias("ticker"),
            value.cast("double").alias("value")]


def freshness(books: DataFrame, exchange_days: DataFrame | None = None, max_stale_sessions: int = 1) -> DataFrame:
    """Add `allowed` and `status` to rows with as_of and today: 'future', 'stale' or 'fresh'.

    The oldest allowed bar is the n-th exchange day strictly before today, found by its session number. Without
    `exchange_days` a calendar is built that reaches far enough back. A row whose oldest allowed day is unknown,
    because the given calendar does not reach it or a date is missing, is stale.
    """
    if exchange_days is None:
        exchange_days = trading_calendar(books, "today", min(max_stale_sessions, NEVER_STALE))
    days = exchange_days.select(F.col("date").alias("today"), (F.col("session_idx") - F.col("is_trading_day").cast("int")).alias("_before"))
    numbered = exchange_days.filter("is_trading_day").select(F.col("session_idx").alias("_nth"), F.col("date").alias("allowed"))
    looked = books.join(per_day(days), "today", "left").withColumn("_nth", F.col("_before") - (max_stale_sessions - 1))
    known = looked.join(per_day(numbered), "_nth", "left").drop("_before", "_nth")
    if max_stale_sessions == 0:
        known = known.withColumn("allowed", F.col("today"))
    stale = F.lit(False) if max_stale_sessions > NEVER_STALE else F.coalesce(F.col("as_of") < F.col("allowed"), F.lit(True))
    return known.withColumn("status", F.when(F.col("as_of") > F.col("today"), "future").when(stale, "stale").otherwise("fresh"))


def freshness_failures(checked: DataFrame) -> DataFrame:
    """Rows of `freshness` (with an account) that are not fresh, as failures; the value is the age in days."""
    return checked.filter("status <> 'fresh'").select(*_failure("bars", F.datediff("today", "as_of")))


def daily_loss(accounts: DataFrame, max_loss: float = 0.03) -> DataFrame:
    """Add `pnl` and `status`: 'breach' below the limit, 'unchecked' without a known equity now and before, else 'ok'."""
    def known(value: str) -> Column:
        return F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

    pnl = F.when(known("equity") & known("last_equity") & (F.col("last_equity") > 0), safe_ratio(F.col("equity"), F.col("last_equity")) - 1.0)
    return accounts.withColumn("pnl", pnl).withColumn(
        "status", F.when(F.col("pnl").isNull(), "unchecked").when(F.col("pnl") < -max_loss, "breach").otherwise("ok"))


def order_limits(orders: DataFrame, accounts: DataFrame, max_orders: int = 60, max_order: float = 0.30,
                 max_gross: float = 1.10) -> DataFrame:
    """Failures of an order list: too many, too large, too large together, unpriced, no equity, or no such account.

    An equity that is null, NaN or not positive is none, and an order without a quantity has no price to speak of. Sizes
    count by their absolute value. Several rows of one account count as the smallest equity among them.
    """
    known = accounts.groupBy("account").agg(F.min(F.when(~F.isnan("equity"), F.col("equity"))).alias("equity"), F.lit(True).alias("_known"))
    rows = orders.select("account", "ticker", "quantity", "price").join(known, "account", "left")
    priced = F.col("price").isNotNull() & ~F.isnan("price") & (F.col("price") > 0) & ~F.isnan(F.coalesce("quantity", F.lit(float("nan"))))
    rows = rows.withColumn("_n", F.when(priced, F.abs(F.col("quantity") * F.col("price"))))
    there, solvent = F.coalesce("_known", F.lit(False)), F.coalesce(F.col("equity") > 0, F.lit(False))
    totals = rows.groupBy("account").agg(F.count("*").alias("_k"), F.max("equity").alias("equity"), F.sum("_n").alias("_gross"), F.max("_known").alias("_known"))

    def fails(rule: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), value.cast("double").alias("value")))

    def listed(df: DataFrame, ticker: Column, *checks: Column) -> DataFrame:
        return df.select("account", ticker.alias("ticker"), F.explode(F.filter(F.array(*checks), lambda f: f.isNotNull())).alias("f")).select(
            "account", "f.rule", "ticker", "f.value")

    share = safe_ratio(F.col("_n"), F.col("equity"))
    gross = safe_ratio(F.col("_gross"), F.col("equity"))
    return listed(
        totals, F.lit(None).cast("string"), fails("order_count", F.col("_k") > max_orders, F.col("_k")), fails("unknown_account", ~there, F.col("_k")), fails("no_equity", there & ~solvent, F.col("equity")),
        fails("gross_notional", solvent & (F.col("_gross") > max_gross * F.col("equity")), gross)
    ).unionByName(listed(
        rows, F.col("ticker"), fails("no_price", solvent & F.col("_n").isNull(), F.col("quantity")),
        fails("order_notional", solvent & (F.col("_n") > max_order * F.col("equity")), share)))


def reconciliation(positions: DataFrame, recorded: DataFrame, pending: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Broker positions against the last recorded ones; names with orders under way are exempt.

    Accounts that were never recorded have no baseline and are not checked. An account recorded as holding nothing has a
    header row (ticker null, see `state_snapshot`), and any position of it is unexpected.
    """
    based = positions.join(recorded.select("account").distinct(), "account", "left_semi")
    both = based.select("account", "ticker", F.col("quantity").alias("held")).join(
        recorded.filter(F.col("ticker").isNotNull()).select("account", "ticker", F.col("quantity").alias("noted")), ["account", "ticker"], "full"
    ).join(pending.select("account", "ticker"), ["account", "ticker"], "left_anti")
    drift = F.abs(F.col("held") - F.col("noted")) / F.greatest(F.abs("noted"), F.lit(1e-9))
    kind = (
        F.when(F.col("noted").isNull(), "unexpected_position")
        .when(F.col("held").isNull() & (F.abs("noted") > 1e-9), "position_gone")
        .when(drift > tolerance, "quantity_drift"))
    value = F.coalesce("held", "noted")
    return both.withColumn("rule", kind).filter(F.col("rule").isNotNull()).select("account", "rule", "ticker", value.cast("double").alias("value"))


def guard_report(accounts: DataFrame, failures: list[DataFrame]) -> DataFrame:
    """Per account: number of failures and whether everything passed."""
    every = failures[0].select("account", "rule")
    for part in failures[1:]:
        every = every.unionByName(part.select("account", "rule"))
    counted = every.groupBy("account").agg(F.count("*").alias("n_failures"))
    return accounts.select("account").join(counted, "account", "left").select(
        "account", F.coalesce("n_failures", F.lit(0).cast("long")).alias("n_failures"), F.col("n_failures").isNull().alias("passed"))


def gate_status(fills: DataFrame, guard_log: DataFrame, min_fills: int = 100, min_sessions: int = 20, paper_only: bool = True) -> DataFrame:
    """Per account: paper fills, their sessions, the run of passes at the end of the guard log, and whether both suffice.

    The trailing run is what follows the last failure, so two small aggregates replace an ordered scan.
    """
    done = F.col("status").isin("filled", "partially_filled") | (F.coalesce("filled_quantity", F.lit(0.0)) > 0)
    mine = fills.filter(done & (F.contains("broker", F.lit("paper")) if paper_only else F.lit(True)))
    filled = mine.groupBy("account").agg(
        F.count("*").alias("fills"), F.count_distinct("as_of").alias("fill_sessions"), F.min("as_of").alias("first_fill"), F.max("as_of").alias("last_fill"))
    runs = guard_log.filter(F.contains("broker", F.lit("paper"))) if paper_only and "broker" in guard_log.columns else guard_log
    no_pass = ~F.coalesce("passed", F.lit(False))   # a run without a result did not pass
    broken = runs.filter(no_pass).groupBy("account").agg(F.max("seq").alias("_last_fail"))
    clean = runs.join(broken, "account", "left").groupBy("account").agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("_last_fail").isNull() | (F.col("seq") > F.col("_last_fail"))).alias("clean_sessions"))
    both = filled.join(clean, "account", "full").na.fill(0, ["fills", "fill_sessions", "clean_sessions", "total_runs"])
    return both.withColumn("open", (F.col("fills") >= min_fills) & (F.col("clean_sessions") >= min_sessions))


def with_slippage(fills: DataFrame) -> DataFrame:
    """Fills that have both prices and a quantity, with signed basis points and cost; paying more is positive."""
    usable = (F.col("filled_price") != 0) & (F.col("modelled_price") != 0) & (F.col("filled_quantity") > 0)
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return fills.filter(usable).withColumns({
        "slip_bps": sign * (F.col("filled_price") / F.col("modelled_price") - 1.0) * 1e4,
        "cost": sign * (F.col("filled_price") - F.col("modelled_price")) * F.col("filled_quantity"),
    })


def exact_median(df: DataFrame, value: str, accuracy: int = 10_000, keys: Sequence[str] = ()) -> DataFrame:
    """The median of a column (by `keys`) without bringing all values together.

    Two approximate quantiles, a few parts in `accuracy` below and above the middle, bracket it whatever the values'
    spread is. Values below the bracket are counted, and only the distinct values inside are ordered: at most about
    six parts in `accuracy` of the rows. Missing values do not count; infinite ones do, at their end of the order.
    Every group has a bracket of its own, so one group's outliers mean nothing to the others; brackets are one row for
    each group, and a group without values has no row.
    """
    known = df.select(*keys, finite_or_null(F.col(value).cast("double")).alias("v")).filter("v IS NOT NULL")
    ends = F.approx_percentile("v", F.array(F.lit(0.5 - 2 / accuracy), F.lit(0.5 + 2 / accuracy)), accuracy)
    place = F.when(F.col("v") < F.col("lo"), F.lit(None).cast("double")).otherwise(F.col("v"))
    if keys:
        span = known.groupBy(*keys).agg(ends.alias("e"), F.count("*").alias("n")).select(*keys, F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"), "n")
        inside = known.join(span, list(keys)).filter(F.col("v") <= F.col("hi"))
    else:
        span = known.agg(ends.alias("e"), F.count("*").alias("n")).select(F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"), "n")
        lo, hi, n = (span.select(c).scalar() for c in ("lo", "hi", "n"))
        inside = known.filter(F.col("v") <= hi).withColumns({"lo": lo, "n": n})
    counts = inside.groupBy(*keys, "n", place.alias("v")).agg(F.count("*").alias("c"))   # null: all values below
    upto = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    spread = counts.withColumn("upto", F.sum("c").over(upto))
    first, last = F.col("upto") - F.col("c"), F.col("upto")
    low_rank, high_rank = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    low = F.max(F.when((first <= low_rank) & (low_rank < last), F.col("v")))
    high = F.max(F.when((first <= high_rank) & (high_rank < last), F.col("v")))
    return spread.groupBy(*keys).agg(F.when(low == high, low).otherwise((low + high) / 2).alias("median"))


def shortfall(fills: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of usable fills, mean and median slippage in basis points and total cost: one row, or one for each of `keys`."""
    slipped = with_slippage(fills)
    totals = slipped.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("slip_bps").alias("mean_bps"), F.sum("cost").alias("total_cost"))
    if keys:
        return totals.join(exact_median(slipped, "slip_bps", keys=keys).withColumnRenamed("median", "median_bps"), list(keys), "left")
    return totals.withColumn("median_bps", exact_median(slipped, "slip_bps").scalar())


def worst_fills(fills: DataFrame, top: int = 5) -> DataFrame:
    """The fills that slipped most."""
    return with_slippage(fills).orderBy(F.desc("slip_bps"), "as_of", "ticker", "filled_quantity").limit(top)


def state_snapshot(positions: DataFrame, results: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """What is recorded after a run: every held or ordered name with its quantity, and whether its order may still fill.

    With `accounts`, each of them also gets a header row without a ticker, so that a flat account is known as recorded.
    """
    open_orders = results.filter(F.col("status") != "rejected").select("account", "ticker", F.lit(True).alias("pending")).distinct()
    rows = positions.select("account", "ticker", "quantity").join(open_orders, ["account", "ticker"], "full").select(
        "account", "ticker", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("pending", F.lit(False)).alias("pending"))
    if accounts is None:
        return rows
    heads = accounts.select("account", F.lit(None).cast("string").alias("ticker"), F.lit(0.0).alias("quantity"), F.lit(False).alias("pending")).distinct()
    return rows.unionByName(heads)

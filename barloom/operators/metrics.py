"""Performance statistics: grouped aggregates over equity curves and fills."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import safe_ratio
from barloom.operators.honesty import with_honesty

YEAR = 252


def with_drawdown(equity: DataFrame, keys: Sequence[str], order: str = "bar_idx") -> DataFrame:
    """Add `drawdown` = equity over its running maximum less one."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("drawdown", safe_ratio(F.col("equity"), F.max("equity").over(upto)) - 1.0)


def cagr(first: Column, last: Column, n: Column, year: int = YEAR) -> Column:
    """Compound yearly growth; 0 without two points or a positive start, -1 after a total loss."""
    total = safe_ratio(last, first)
    return F.when((n < 2) | (first <= 0), 0.0).when(total <= 0, -1.0).otherwise(F.pow(total, F.lit(float(year)) / (n - 1)) - 1.0)


def sharpe(mean: Column, sd: Column, n: Column, year: int = YEAR, rf_annual: float = 0.0) -> Column:
    ratio = safe_ratio(mean - rf_annual / year, sd) * F.sqrt(F.lit(float(year)))
    return F.when((n >= 2) & (sd > 0), ratio).otherwise(0.0)


def sortino(mean: Column, downside_sq: Column, n: Column, year: int = YEAR) -> Column:
    """Mean over the root of the squared losses spread over all returns; 0 without losses."""
    dd = F.sqrt(safe_ratio(downside_sq, n.cast("double")))
    return F.when((n >= 2) & (dd > 0), safe_ratio(mean, dd) * F.sqrt(F.lit(float(year)))).otherwise(0.0)


def return_moments(equity: DataFrame, keys: Sequence[str], order: str = "bar_idx") -> DataFrame:
    """Per key the aggregates that every statistic is built from. Missing returns are skipped."""
    seq = Window.partitionBy(*keys).orderBy(order)
    upto = seq.rowsBetween(Window.unboundedPreceding, 0)
    curve = equity.withColumns({
        "_r": safe_ratio(F.col("equity"), F.lag("equity").over(seq)) - 1.0,
        "_dd": safe_ratio(F.col("equity"), F.max("equity").over(upto)) - 1.0,
    })
    loss = F.when(F.col("_r") < 0, F.col("_r") * F.col("_r")).otherwise(0.0)
    return curve.groupBy(*keys).agg(
        F.min_by("equity", order).alias("start_equity"), F.max_by("equity", order).alias("end_equity"),
        F.count("*").alias("n_days"), F.count("_r").alias("n_ret"), F.avg("_r").alias("mean_ret"), F.stddev_samp("_r").alias("sd_ret"),
        F.sum(loss).alias("downside_sq"), F.skewness("_r").alias("skew_pop"), F.kurtosis("_r").alias("kurt_pop"),
        F.max("_r").alias("best"), F.min("_r").alias("worst"), F.min("_dd").alias("max_drawdown"),
    )


def metrics(equity: DataFrame, keys: Sequence[str], turnover: DataFrame | None = None, trades: DataFrame | None = None,
            benchmark: DataFrame | None = None, year: int = YEAR) -> DataFrame:
    """One row per key with every performance number the inputs allow."""
    m = return_moments(equity, keys)
    c = F.col
    root = F.sqrt(F.lit(float(year)))
    out = m.withColumns({
        "total_return": safe_ratio(c("end_equity"), c("start_equity")) - 1.0,
        "cagr": cagr(c("start_equity"), c("end_equity"), c("n_days"), year),
        "annual_vol": F.when(c("n_ret") > 1, c("sd_ret") * root).otherwise(0.0),
        "sharpe": sharpe(c("mean_ret"), c("sd_ret"), c("n_ret"), year),
        "sortino": sortino(c("mean_ret"), c("downside_sq"), c("n_ret"), year),
        "best_day": F.coalesce("best", F.lit(0.0)), "worst_day": F.coalesce("worst", F.lit(0.0)),
    }).withColumn("calmar", F.when(c("max_drawdown") < 0, c("cagr") / F.abs("max_drawdown")).otherwise(0.0))
    out = with_honesty(out, year).withColumnsRenamed({
        "sharpe_se_annual": "sharpe_se", "psr_zero": "prob_sharpe_gt_zero", "min_track_years": "min_track_years_95pct"})
    out = out.drop("mean_ret", "sd_ret", "downside_sq", "skew_pop", "kurt_pop", "best", "worst", "n_ret", "skew", "kurt", "sharpe_annual")
    if turnover is not None:
        out = out.join(turnover.groupBy(*keys).agg((F.avg("turnover") * year).alias("annual_turnover")), list(keys), "left")
    if trades is not None:
        out = out.join(trade_stats(trades, keys), list(keys), "left")
    if benchmark is not None:
        out = out.join(_benchmark_metrics(equity, benchmark, keys, year), list(keys), "left").withColumn(
            "excess_cagr", c("cagr") - c("benchmark_cagr"))
    return out


def _benchmark_metrics(equity: DataFrame, benchmark: DataFrame, keys: Sequence[str], year: int) -> DataFrame:
    b = return_moments(benchmark.withColumnRenamed("benchmark", "equity"), keys)
    c = F.col
    own = b.select(
        *keys, (safe_ratio(c("end_equity"), c("start_equity")) - 1.0).alias("benchmark_total_return"),
        cagr(c("start_equity"), c("end_equity"), c("n_days"), year).alias("benchmark_cagr"),
        sharpe(c("mean_ret"), c("sd_ret"), c("n_ret"), year).alias("benchmark_sharpe"), c("max_drawdown").alias("benchmark_max_drawdown"))
    return own.join(beta_alpha(equity, benchmark, keys, year), list(keys), "left")


def beta_alpha(equity: DataFrame, benchmark: DataFrame, keys: Sequence[str], year: int = YEAR) -> DataFrame:
    """Slope and annual intercept of daily returns on the benchmark's, from at least three common returns."""
    seq = Window.partitionBy(*keys).orderBy("bar_idx")
    both = equity.select(*keys, "bar_idx", "equity").join(benchmark.select(*keys, "bar_idx", "benchmark"), [*keys, "bar_idx"])
    moved = both.select(
        *keys, (safe_ratio(F.col("equity"), F.lag("equity").over(seq)) - 1.0).alias("r"),
        (safe_ratio(F.col("benchmark"), F.lag("benchmark").over(seq)) - 1.0).alias("b")).dropna(subset=["r", "b"])
    g = moved.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.covar_samp("r", "b").alias("_cov"), F.var_samp("b").alias("_var"), F.avg("r").alias("_mr"), F.avg("b").alias("_mb"))
    g = g.filter((F.col("_n") > 2) & (F.col("_var") > 0)).withColumn("beta", F.col("_cov") / F.col("_var"))
    return g.select(*keys, "beta", ((F.col("_mr") - F.col("beta") * F.col("_mb")) * year).alias("alpha_annual"))


SHARE_UNITS = 100_000_000   # share counts are whole numbers of this part of a share, so that sums of fills are exact; a fill below half a unit counts as none
CHUNK_ROWS = 10_000
SCAN = 64


def running_affine(rows: DataFrame, keys: Sequence[str], levels: int = 2) -> DataFrame:
    """What comes in at each step of a chain of maps v -> scale * v + add that starts at 0: (keys, no, value_in).

    `rows` has keys, no (0, 1, 2, ... by key), scale and add. Maps compose, so runs of `SCAN` steps are joined to one map each,
    the runs are chained the same way one level up, and every run is then walked from its start. The work grows with the
    number of steps, and no list is longer than `SCAN` but the topmost, which has one entry for SCAN ** levels steps.
    """
    own = F.struct("no", "scale", "add").alias("m")
    block = F.floor(F.col("no") / SCAN).cast("long") if levels else F.lit(0).cast("long")
    lines = rows.select(*keys, block.alias("_block"), own).groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("m")).alias("line"))
    if levels:
        whole = F.aggregate("line", F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("add")), lambda s, m: F.struct(
            (s["scale"] * m["scale"]).alias("scale"), (s["add"] * m["scale"] + m["add"]).alias("add")))
        starts = running_affine(lines.select(*keys, F.col("_block").alias("no"), whole.alias("w")).select(*keys, "no", "w.scale", "w.add"), keys, levels - 1)
        lines = lines.join(starts.withColumnRenamed("no", "_block"), [*keys, "_block"])
    else:
        lines = lines.withColumn("value_in", F.lit(0.0))

    def walk(done: Column, m: Column) -> Column:
        last = F.element_at(done, F.lit(-1))
        return F.concat(done, F.array(last * m["scale"] + m["add"]))

    path = F.aggregate("line", F.array("value_in"), walk)
    steps = lines.select(*keys, F.explode(F.arrays_zip(F.col("line.no").alias("no"), F.slice(path, 1, F.size("line")).alias("value_in"))).alias("z"))
    return steps.select(*keys, "z.no", "z.value_in")


def round_trips(trades: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Average-cost profit and loss of sells, summed per (keys, ticker, chunk).

    A position is a recursion over ordered fills. A name with more than `chunk_rows` fills is split into
    chunks of a day and a block of `seq`, so that it is worked on in many tasks. What a chunk does to the
    incoming state composes: the share count maps as max(floor, q + shift), exactly, because shares are
    counted in whole units of 1e-8 (so a sale of .3 closes buys of .1 and .2 in any split), and once the share count
    is known the cost basis maps as scale * basis + add. So: fold each chunk to its maps, chain the
    chunks of a name (`running_affine`), and fold each chunk again from its true starting state.
    """
    name = [*keys, "ticker"]
    stamp = F.col("date") if "date" in trades.columns else F.col("bar_idx")
    seq = F.col("seq").cast("long") if "seq" in trades.columns else F.lit(0).cast("long")
    busy = trades.groupBy(*name).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows).select(*name, F.lit(True).alias("_busy"))
    split = F.coalesce("_busy", F.lit(False))
    fills = trades.join(busy, name, "left").select(
        *name, F.struct(F.when(split, stamp).alias("at"), F.when(split, F.floor(seq / chunk_rows)).otherwise(0).alias("block")).alias("chunk"),
        F.struct(
            stamp.alias("at"), seq.alias("seq"), (F.col("side") == "buy").alias("buy"), F.round(F.col("quantity").cast("double") * SHARE_UNITS).cast("long").alias("q"),
            F.col("price").cast("double").alias("p"), F.col("commission").cast("double").alias("c")).alias("fill"))
    chunks = fills.groupBy(*name, "chunk").agg(F.array_sort(F.collect_list("fill")).alias("fills"))

    none, zero_units = F.lit(None).cast("long"), F.lit(0).cast("long")   # a null floor: no sale so far
    shape = F.aggregate("fills", F.struct(zero_units.alias("shift"), none.alias("floor")), lambda s, f: F.struct(
        F.when(f["buy"], s["shift"] + f["q"]).otherwise(s["shift"] - f["q"]).alias("shift"),
        F.when(f["buy"], s["floor"] + f["q"]).otherwise(F.greatest(zero_units, s["floor"] - f["q"])).alias("floor")))
    path = Window.partitionBy(*name).orderBy("chunk")
    upto = path.rowsBetween(Window.unboundedPreceding, 0)
    shifted = chunks.select(*name, "chunk", shape.alias("m")).select(*name, "chunk", "m.*").withColumn("_sum", F.sum("shift").over(upto))
    # the share count after a chunk in closed form: running shift over the highest floor so far
    after = F.col("_sum") + F.greatest(zero_units, F.max(F.col("floor") - F.col("_sum")).over(upto))
    started = shifted.withColumn("_after", after).select(*name, "chunk", F.coalesce(F.lag("_after").over(path), zero_units).alias("q_in"))
    opened = chunks.join(started, [*name, "chunk"])

    def sold(q: Column, f: Column) -> Column:
        return F.least(f["q"], q)

    def left(q: Column, f: Column) -> Column:
        return q - sold(q, f)

    def shares(units: Column) -> Column:
        return units / F.lit(float(SHARE_UNITS))

    def basis_step(s: Column, f: Column) -> Column:
        keep = F.when(s["q"] > 0, left(s["q"], f).cast("double") / s["q"]).otherwise(0.0)
        buy = f["buy"]
        return F.struct(
            F.when(buy, s["q"] + f["q"]).otherwise(F.when(s["q"] > 0, left(s["q"], f)).otherwise(s["q"])).alias("q"),
            F.when(buy, s["scale"]).otherwise(s["scale"] * keep).alias("scale"),
            F.when(buy, s["add"] + shares(f["q"]) * f["p"] + f["c"]).otherwise(s["add"] * keep).alias("add"))

    basis = F.aggregate("fills", F.struct(F.col("q_in").alias("q"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("add")), basis_step)
    numbered = opened.select(*name, "chunk", basis.alias("b"), (F.row_number().over(path) - 1).cast("long").alias("no"))
    incoming = running_affine(numbered.select(*name, "no", "b.scale", "b.add"), name)
    starts = numbered.select(*name, "no", "chunk").join(incoming, [*name, "no"]).select(*name, "chunk", F.col("value_in").alias("cost_in"))

    zero = F.struct(F.col("q_in").alias("q"), F.col("cost_in").alias("basis"), *[F.lit(0).alias(n) for n in ("wins", "losses")],
                    *[F.lit(0.0).alias(n) for n in ("won", "lost")])

    def settle(s: Column, f: Column) -> Column:
        buy = f["buy"]
        live = ~buy & (s["q"] > 0)
        x = shares(sold(s["q"], f))
        each = F.when(s["q"] > 0, s["basis"] / shares(s["q"])).otherwise(0.0)
        pnl = x * f["p"] - x * each - f["c"]
        rest = left(s["q"], f)
        good, bad = live & (pnl > 0), live & (pnl <= 0)
        return F.struct(
            F.when(buy, s["q"] + f["q"]).when(live, rest).otherwise(s["q"]).alias("q"),
            F.when(buy, s["basis"] + shares(f["q"]) * f["p"] + f["c"]).when(live & (rest == 0), 0.0).when(live, s["basis"] - x * each).otherwise(s["basis"]).alias("basis"),
            (s["wins"] + F.when(good, 1).otherwise(0)).alias("wins"), (s["losses"] + F.when(bad, 1).otherwise(0)).alias("losses"),
            (s["won"] + F.when(good, pnl).otherwise(0.0)).alias("won"), (s["lost"] + F.when(bad, pnl).otherwise(0.0)).alias("lost"))

    settled = opened.join(starts, [*name, "chunk"]).select(*name, "chunk", F.aggregate("fills", zero, settle).alias("s"))
    return settled.select(*name, "chunk", "s.wins", "s.losses", "s.won", "s.lost")


def trade_stats(trades: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Counts, win rate, mean win and loss, profit factor and commission per key. A zero result is a loss."""
    totals = trades.groupBy(*keys).agg(F.count("*").alias("n_trades"), F.sum("commission").alias("total_commission"))
    pnl = round_trips(trades, keys, chunk_rows).groupBy(*keys).agg(
        F.sum("wins").alias("_w"), F.sum("losses").alias("_l"), F.sum("won").alias("_won"), F.sum("lost").alias("_lost"))
    both = totals.join(pnl, list(keys), "left")
    n = F.col("_w") + F.col("_l")
    factor = F.when(-F.col("_lost") > 0, F.col("_won") / -F.col("_lost")).when(F.col("_w") > 0, float("inf")).otherwise(0.0)
    return both.select(
        *keys, "n_trades", n.alias("n_round_trips"), F.coalesce(safe_ratio(F.col("_w").cast("double"), n.cast("double")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(safe_ratio(F.col("_won"), F.col("_w").cast("double")), F.lit(0.0)).alias("avg_win"),
        F.coalesce(safe_ratio(F.col("_lost"), F.col("_l").cast("double")), F.lit(0.0)).alias("avg_loss"),
        factor.alias("profit_factor"), "total_commission")

"""Scores per (ticker, date) from trailing windows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import per_day, safe_ratio
from barloom.operators.panel import by_ticker, full_window, recent, trailing, with_eligible, with_recent, with_running
from barloom.operators.sizing import pick_top
from barloom.session import cut_lineage


def _ready(grid: DataFrame) -> DataFrame:
    return grid if "eligible" in grid.columns else with_eligible(grid)


def _not_market(market: str | None) -> Column:
    return F.lit(True) if not market else F.col("ticker") != market


def with_momentum_score(grid: DataFrame, lookback: int = 252, skip: int = 21, market: str | None = None) -> DataFrame:
    """Add `score`: the return from `lookback` bars ago to `skip` bars ago, for names eligible today."""
    past = F.lag("close", skip).over(by_ticker()) if skip > 0 else F.col("close")
    raw = safe_ratio(past, F.lag("close", lookback).over(by_ticker())) - 1.0
    return _ready(grid).withColumn("score", F.when(F.col("eligible") & _not_market(market), raw))


def market_filter(grid: DataFrame, market: str, bars: int = 200) -> DataFrame:
    """(date, risk_on): false when the market closes below its own mean over a full window.

    Any missing close inside the window leaves the filter open. One ticker's rows only.
    """
    closes = grid.filter(F.col("ticker") == market)
    mean = full_window(F.col("close"), trailing(bars), bars)
    return closes.select("date", F.coalesce(F.col("close") >= mean, F.lit(True)).alias("risk_on"))


def apply_market_filter(rows: DataFrame, gate: DataFrame | None) -> DataFrame:
    """Drop rows of risk-off dates; a date the gate does not know passes."""
    if gate is None:
        return rows
    return rows.join(per_day(gate.filter(~F.col("risk_on")).select("date")), "date", "left_anti")


def with_sma_crossover(grid: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Add `score`: fast mean over slow mean less one, where the fast mean is above. Both need full windows.

    The means are compared as sums of closes in ticks, so that equal ones are equal whatever the order of addition.
    """
    if fast >= slow:
        raise ValueError(f"a fast average over {fast} bars is not shorter than a slow one over {slow}")
    ready = _ready(grid)
    out = ready if f"_s_{fast}" in ready.columns and f"_s_{slow}" in ready.columns else with_recent(ready, (fast, slow))
    n, s = ({bars: F.col(f"{of}_{bars}") for bars in (fast, slow)} for of in ("_n", "_s"))
    mean = {bars: s[bars].cast("double") / F.lit(float(bars)) for bars in (fast, slow)}
    above = s[fast].cast("decimal(19,0)") * slow > s[slow].cast("decimal(19,0)") * fast
    up = F.col("eligible") & (n[fast] == fast) & (n[slow] == slow) & above
    scored = out.withColumns({
        "sma_fast": F.when(n[fast] == fast, mean[fast] / F.lit(1e8)), "sma_slow": F.when(n[slow] == slow, mean[slow] / F.lit(1e8)),
        "score": F.when(up, safe_ratio(mean[fast], mean[slow]) - 1.0),
    })
    return scored.select(*ready.columns, "sma_fast", "sma_slow", "score")


def with_zscore(grid: DataFrame, lookback: int = 20, trend_sma: int = 100, at: Column | None = None) -> DataFrame:
    """Add `z`, the close's distance from its trailing mean in standard deviations, and `uptrend`.

    Means skip missing closes; a flat window has no z-score. Both come from exact sums of closes in ticks, so no order of
    addition decides. With `at` only its rows get them: the others have no z and no uptrend.
    """
    ready = _ready(grid)
    gains = {"_zn": ("_n", lookback), "_zs": ("_s", lookback), "_zq": ("_q", lookback), "_tn": ("_n", trend_sma), "_ts": ("_s", trend_sma)}
    sums = (ready if "_q" in ready.columns else with_running(ready, squares=True)).withColumns({
        name: recent(*of) if at is None else F.when(at, recent(*of)) for name, of in gains.items()})

    def wide(col: str) -> Column:
        return F.col(col).cast("decimal(38,0)")

    spread = wide("_zn") * wide("_zq") - wide("_zs") * wide("_zs")   # n (n - 1) times the variance
    out = sums.withColumn("_spread", spread.cast("double")).withColumn("_off", (F.col("_tick") * F.col("_zn") - F.col("_zs")).cast("double"))
    z = F.col("_off") / F.sqrt(F.col("_spread") * F.col("_zn") / (F.col("_zn") - 1))
    return out.select(
        *ready.columns, F.when(F.col("_spread") > 0, z).alias("z"),
        F.coalesce(F.col("_tick") * F.col("_tn") > F.col("_ts"), F.lit(False)).alias("uptrend"))


def reverting(scored: DataFrame, settings: Mapping[int, tuple[float, float, int]]) -> DataFrame:
    """The rows that can be held under each of `settings` (config -> z_entry, z_exit, max_names): config, limit, date, ticker, z, entry, stay.

    `scored` has one row per (date, ticker) of the decision dates with z, uptrend and eligible; it is stored, as it is read for
    the ranks and for the names. An entry outside its date's `max_names` most oversold entries cannot be held, and a name can
    only stay from such an entry until its first exit. One rank serves all settings, because the entries of a stricter one come
    first among those of the loosest. After it only names that enter somewhere are left: their number grows with dates, not with names.

    z counts to nine decimals, so windows of the same shape at different prices tie and go by ticker.
    """
    ok = F.coalesce(F.col("eligible") & F.col("z").isNotNull(), F.lit(False))
    rows = cut_lineage(scored.select("date", "ticker", F.round("z", 9).alias("z"), ok.alias("ok"), F.coalesce(ok & F.col("uptrend"), F.lit(False)).alias("up")))
    loosest, most = max(float(s[0]) for s in settings.values()), max(int(s[2]) for s in settings.values())
    best = Window.partitionBy("date").orderBy("z", "ticker")
    first = cut_lineage(rows.filter(F.col("up") & (F.col("z") < loosest)).select(
        "date", "ticker", F.row_number().over(best).alias("_rk")).filter(F.col("_rk") <= most))
    named = rows.join(first.select("ticker").distinct(), "ticker", "left_semi").join(first, ["date", "ticker"], "left")
    options = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(float(enter)).alias("enter"), F.lit(float(leave)).alias("leave"), F.lit(int(n)).alias("limit"))
                        for i, (enter, leave, n) in settings.items()])
    spread = named.withColumn("_c", F.explode(options)).select(
        "_c.config", "_c.limit", "date", "ticker", "z",
        F.coalesce(F.col("up") & (F.col("z") < F.col("_c.enter")), F.lit(False)).alias("entry"),
        F.coalesce(F.col("ok") & (F.col("z") < F.col("_c.leave")), F.lit(False)).alias("stay"), "_rk")
    seed = F.coalesce(F.col("entry") & (F.col("_rk") <= F.col("limit")), F.lit(False))
    return _since_entry(spread.withColumn("_seed", seed), "config")


def _since_entry(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of names that had an entry to be held for (`_seed`) and no exit after it."""
    event = F.when(F.col("_seed"), True).when(~F.col("stay"), False)
    since = Window.partitionBy(*by, "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_alive", F.coalesce(F.last(event, ignorenulls=True).over(since), F.lit(False))).filter("_alive").drop("_alive", "_rk")


def held_in_turn(alive: DataFrame, runs: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Names held at each date, given the rows of `reverting`: entries, and those held before that stay, most oversold first.

    What is held depends on what was held before and on the cap, so this is an ordered fold over dates. The dates are cut into
    segments: one starts wherever every surviving name enters on that very date, because what was held before cannot matter
    there. Segments are folded in parallel.

    With `runs` (keys, date) each run, named by `keys`, holds nothing before the first of its dates: the rows are copied to the
    runs that have their date (and config, if it is among the keys), and a run starts a segment of its own.
    """
    if runs is not None:
        on = [k for k in (*keys, "date") if k in alive.columns]
        alive = _since_entry(alive.join(runs.select(*keys, "date"), on), *keys)
    days = alive.groupBy(*keys, "date").agg(F.every("entry").alias("_fresh"))
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)   # one small row per calendar day
    segments = days.select(*keys, "date", F.count_if("_fresh").over(upto).alias("segment"))
    per_date = alive.join(segments if keys else per_day(segments), [*keys, "date"]).groupBy(*keys, "segment", "date").agg(
        F.array_sort(F.collect_list(F.struct("z", "ticker", "entry", "stay"))).alias("names"), F.max("limit").alias("limit"))
    timeline = per_date.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("date", "names", "limit"))).alias("timeline"))

    empty = F.array().cast("array<struct<date:date,held:array<string>>>")

    def step(path: Column, day: Column) -> Column:
        before = F.coalesce(F.try_element_at(path, F.lit(-1))["held"], F.array().cast("array<string>"))
        stays = F.filter(day["names"], lambda n: n["entry"] | (n["stay"] & F.array_contains(before, n["ticker"])))
        held = F.transform(F.slice(stays, 1, day["limit"]), lambda n: n["ticker"])
        return F.concat(path, F.array(F.struct(day["date"].alias("date"), held.alias("held"))))

    path = timeline.select(*keys, F.explode(F.aggregate("timeline", empty, step)).alias("day"))
    return path.select(*keys, "day.date", F.explode("day.held").alias("ticker"))


def mean_reversion_holdings(scored: DataFrame, z_entry: float = -2.0, z_exit: float = 0.0, max_names: int = 10,
                            runs: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Names held at each decision date: enter oversold uptrends, keep them until z recovers, most oversold first.

    `scored` and `runs` as `reverting` and `held_in_turn` want them.
    """
    return held_in_turn(reverting(scored, {0: (z_entry, z_exit, max_names)}).drop("config"), runs, keys)


def news_rows(grid: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows that windows of news at decision dates are made of: the dates' own and all with news. The others add nothing to a sum."""
    news = F.lit(False)
    for c in ("news_count", "news_tone_sum", "news_neg_sum"):
        news = news | F.coalesce(F.col(c) != 0, F.lit(False))
    days = per_day(decisions.select("date", F.lit(True).alias("_decides")))
    return grid.join(days, "date", "left").filter(F.col("_decides").isNotNull() | news).drop("_decides")


def with_sentiment_score(grid: DataFrame, lookback: int = 10, kind: str = "tone") -> DataFrame:
    """Add `score` and `articles`: mean tone (or minus mean negativity) of the news of the last sessions. Rows without news may be missing."""
    w = by_ticker().rangeBetween(-(lookback - 1), 0)
    articles = F.sum("news_count").over(w)
    total = -F.sum("news_neg_sum").over(w) if kind == "neg" else F.sum("news_tone_sum").over(w)
    return grid.withColumns({"articles": articles, "score": safe_ratio(total, articles)})


def ranked_sentiment(grid: DataFrame, min_articles: int = 3, market: str | None = None) -> DataFrame:
    """Blank the score of names that are not eligible, have too little news, or are the market itself."""
    enough = F.col("eligible") & (F.col("articles") >= min_articles) & _not_market(market)
    return _ready(grid).withColumn("score", F.when(enough, F.col("score")))


def buy_and_hold(grid: DataFrame, tickers: list[str]) -> DataFrame:
    """Equal weight over the listed tickers that are eligible on each date."""
    names = [t.strip().upper() for t in tickers]
    live = _ready(grid).filter(F.col("ticker").isin(names) & F.col("eligible"))
    return live.select("date", "bar_idx", "ticker", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def sentiment_report(scored: DataFrame, sectors: DataFrame, top: int = 10, min_articles: int = 3) -> DataFrame:
    """The `top` most positive and most negative names on the last date, with their sectors."""
    last = scored.agg(F.max("date")).scalar()
    today = scored.filter((F.col("date") == last) & F.col("score").isNotNull() & (F.col("articles") >= min_articles))
    best = today.orderBy(F.desc("score"), "ticker").limit(top).withColumn("side", F.lit("most positive"))
    worst = today.orderBy(F.asc("score"), "ticker").limit(top).withColumn("side", F.lit("most negative"))
    both = best.unionByName(worst).select("side", "ticker", "score", "articles")
    return both.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


__all__ = [
    "apply_market_filter", "buy_and_hold", "held_in_turn", "market_filter", "mean_reversion_holdings", "news_rows", "pick_top", "ranked_sentiment",
    "reverting", "sentiment_report", "with_momentum_score", "with_sentiment_score", "with_sma_crossover", "with_zscore",
]

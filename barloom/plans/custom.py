"""User-defined strategies.

A score can be a column expression over trailing windows, which stays inside Spark, or a Python
function of one ticker's recent bars. Either way the function never holds a later bar.
"""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import per_day
from barloom.sources.bars import BAR_FIELDS

SCORED = "ticker string, date date, bar_idx long, score double"


def score_with_columns(grid: DataFrame, decisions: DataFrame, score: Callable[[], Column]) -> DataFrame:
    """Score decision dates with an expression whose windows end at the current row."""
    return grid.withColumn("score", score()).join(per_day(decisions.select("date")), "date", "left_semi")


def score_with_function(grid: DataFrame, decisions: DataFrame, score: Callable[[pd.DataFrame], float | None], lookback: int,
                        fields: list[str] | None = None) -> DataFrame:
    """Score decision dates with a Python function of the last `lookback` bars of one ticker.

    One group is one ticker's history, which the calendar bounds. The function is called once per
    decision with a slice that ends there.
    """
    fields = fields or BAR_FIELDS
    flagged = grid.join(per_day(decisions.select("date", F.lit(True).alias("_decide"))), "date", "left").select(
        "ticker", "date", "bar_idx", *fields, F.coalesce("_decide", F.lit(False)).alias("_decide"))

    def per_ticker(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_idx").reset_index(drop=True)
        out = []
        for at in bars.index[bars["_decide"]]:
            recent = bars.loc[max(0, at - lookback + 1):at, ["date", "bar_idx", *fields]]
            value = score(recent)
            if value is not None and value == value:
                out.append((bars.at[at, "ticker"], bars.at[at, "date"], bars.at[at, "bar_idx"], float(value)))
        return pd.DataFrame(out, columns=["ticker", "date", "bar_idx", "score"])

    return flagged.groupBy("ticker").applyInPandas(per_ticker, SCORED)


def allocate_with_function(scored: DataFrame, allocate: Callable[[pd.DataFrame], pd.Series], most: int) -> DataFrame:
    """Turn the `most` best-scored names of each date into weights with a Python function.

    The function gets one date's rows, best first, and returns weights in their order.
    """
    best = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    top = scored.filter(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)

    def per_date(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        return rows[["date", "bar_idx", "ticker"]].assign(weight=pd.Series(allocate(rows)).to_numpy(dtype="float64"))

    return top.select("date", "bar_idx", "ticker", "score", "rank").groupBy("date").applyInPandas(
        per_date, "date date, bar_idx long, ticker string, weight double")

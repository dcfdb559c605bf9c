"""Signals do not depend on the order of addition: equal means are equal and windows of the same shape tie."""
from pyspark.sql import functions as F

from barloom.operators import signals as SG


def grid_of(spark, **closes):
    rows = [(t, i, f"2020-01-{i + 1:02d}", float(c)) for t, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "ticker string, bar_idx long, date string, close double").withColumn("date", F.to_date("date"))


def test_zscore_ties(spark):
    """One fall in a flat window has the same z at any price, so the names tie and go by ticker; a close at its mean is no uptrend."""
    flat = {t: [p] * 9 + [p * 0.9] for t, p in (("A", 0.3), ("B", 7.7), ("C", 33.3), ("D", 1234.5678), ("E", 0.1))}
    scored = SG.with_zscore(grid_of(spark, **flat), 10, 5)
    last = scored.filter("bar_idx = 9").withColumn("uptrend", F.lit(True)).orderBy("ticker")
    assert {round(r["z"], 9) for r in last.collect()} == {round(-0.9 / 0.1 ** 0.5, 9)}
    held = SG.mean_reversion_holdings(last, -1.5, 0.0, 3)
    assert sorted(r["ticker"] for r in held.collect()) == ["A", "B", "C"]
    noisy = SG.with_zscore(grid_of(spark, F=[0.1] * 10, G=[0.7] * 10), 10, 10)
    assert noisy.filter("uptrend OR z IS NOT NULL").count() == 0


def test_sma_of_equal_means(spark):
    """Means of the same closes in another order are equal, so neither is above."""
    closes = [0.1, 0.2, 0.3, 0.3, 0.2, 0.1, 0.3, 0.1, 0.2]
    scored = SG.with_sma_crossover(grid_of(spark, A=closes, B=[c * 10 for c in closes]), 3, 6)
    assert scored.filter("bar_idx >= 5 AND bar_idx <> 7 AND score IS NOT NULL").count() == 0
    assert scored.filter("bar_idx = 8 AND sma_slow IS NOT NULL").count() == 2

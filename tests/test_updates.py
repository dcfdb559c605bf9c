"""Tables that are replaced or renewed in part, logs with bad lines, grouped medians, membership and long chains."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics as M
from barloom.operators import monitor as V
from barloom.operators import panel as P
from barloom.operators import sentiment as X
from barloom.session import cut_lineage
from barloom.sources import bars as B
from barloom.sources import logs, sinks
from barloom.sources import news as N
from barloom.sources.lexicon import Lexicon
from helpers import business_days, day, rows, walk


def test_a_version_counts_once_its_job_has_ended(spark, tmp_path):
    root = str(tmp_path / "bars")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, root)
    assert sinks.write_version(spark.range(3), root) == 0
    os.makedirs(f"{root}/v-1")   # a job that was killed: files, but no mark of success
    spark.range(9).write.parquet(f"{root}/half")
    for f in os.listdir(f"{root}/half"):
        if f.endswith(".parquet"):
            os.link(f"{root}/half/{f}", f"{root}/v-1/{f}")
    assert sinks.read_version(spark, root).count() == 3
    assert sinks.write_version(sinks.read_version(spark, root).select(F.col("id") + 1), root) == 1   # from the old one
    assert sorted(r[0] for r in sinks.read_version(spark, root).collect()) == [1, 2, 3]
    assert sinks.write_version(spark.range(1), root) == 2 and sinks.drop_versions(spark, root) == [0]
    assert sinks.read_version(spark, root, 1).count() == 3 and sinks.read_version(spark, root).count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, root, 0)


def test_a_disagreeing_history_is_replaced_whole(spark):
    cached = walk(spark, ["A", "B", "C"], 40, holes=False)
    moved = cached.withColumn("close", F.when(F.col("ticker") == "B", F.col("close") / 2).otherwise(F.col("close")))
    late = business_days("2020-01-01", 40)[20]
    fresh = moved.filter((F.col("date") >= F.lit(late)) & (F.col("ticker") != "C"))
    new = B.replace_history(cached, fresh, B.history_disagreement(cached, fresh))
    assert dict(rows(new.groupBy("ticker").count(), "ticker")) == {"A": 40, "B": 20, "C": 40}
    assert new.join(moved.select("ticker", "date", F.col("close").alias("want")), ["ticker", "date"]).filter("close <> want").count() == 0


def test_malformed_lines_are_set_aside(spark, tmp_path):
    path = str(tmp_path / "log")
    os.makedirs(path)
    with open(f"{path}/a.json", "w") as f:
        f.write('{"ts": "1", "as_of": "2024-01-02", "equity": 5.0}\n\n{"ts": "2", "as_of": "2024-01-03", "equ\nnonsense\n')
    with open(f"{path}/b.json", "w") as f:
        f.write('{"ts": "3", "as_of": "2024-01-04", "equity": null, "more": [1]}\n')
    with open(f"{path}/c.json", "w") as f:
        f.write('{"ts": "4", "as_of": "2024-01-05", "equity": "high"}\n')
    good, bad = logs.read_checked_log(spark, path, logs.EQUITY_LOG)
    assert [(r.ts, str(r.as_of), r.equity) for r in good.orderBy("ts").collect()] == [("1", "2024-01-02", 5.0), ("3", "2024-01-04", None)]
    assert sorted((os.path.basename(r.file), r.line[:8]) for r in bad.collect()) == [("a.json", "nonsense"), ("a.json", '{"ts": "'), ("c.json", '{"ts": "')]
    assert tuple(logs.log_health(good, bad).first()) == (2, 3, 2)
    good, bad = logs.read_checked_log(spark, str(tmp_path / "none"), logs.EQUITY_LOG)
    assert good.count() == bad.count() == 0


def test_medians_by_group(spark):
    rng = np.random.default_rng(8)
    groups = {1: rng.normal(size=2001), 2: [5.0] * 300, 3: [1e12, -1e12, 3.0, 4.0], 4: [float("inf"), 1.0], 5: [7.0]}
    data = [(k, float(v)) for k, values in groups.items() for v in values] + [(6, None), (6, float("nan"))]
    got = {r.k: r.median for r in V.exact_median(spark.createDataFrame(data, "k int, v double"), "v", keys=["k"]).collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()})
    fills = spark.createDataFrame([(1, "buy", 1.0, 11.0, 10.0), (1, "buy", 1.0, 10.0, 10.0), (2, "sell", 2.0, 9.0, 10.0)],
                                  "account int, side string, filled_quantity double, filled_price double, modelled_price double")
    assert [(r.account, r.n, round(r.median_bps), round(r.total_cost, 9)) for r in V.shortfall(fills, ["account"]).orderBy("account").collect()] == [(1, 2, 500, 1.0), (2, 1, 1000, 2.0)]


def test_membership_by_intervals(spark):
    rng = np.random.default_rng(6)
    days = business_days("2021-01-01", 120)
    bars = spark.createDataFrame([(t, d, 1.0, 1.0, 1.0, 1.0, 1.0) for t in "ABCDE" for d in days], "ticker string, date date, open double, high double, low double, close double, volume double")
    cal = B.trading_index(bars)
    stays = {t: sorted(rng.choice(120, 4, replace=False)) for t in "ABCD"}
    daily = [(d, t) for i, d in enumerate(business_days("2020-12-20", 150)) for t in "ABCD" if any(a <= i < b for a, b in (stays[t][:2], stays[t][2:]))]
    weekend = [(day("2021-02-06"), "E"), (day("2021-02-07"), "A"), (day("2019-01-01"), "E"), (day("2030-01-01"), "E")]   # two between the same two bars; only the later counts
    snaps = daily + weekend + daily[:5]
    grid = P.with_membership(B.align_panel(bars, calendar=cal), cal, spark.createDataFrame(snaps, "date date, ticker string"))
    dates = sorted({d for d, _ in snaps})
    want = {(d, t) for d in days for t in "ABCDE" if (max((s for s in dates if s <= d), default=None), t) in set(snaps)}
    assert {(r.date, r.ticker) for r in grid.filter("member").collect()} == want and grid.count() == 600 and len(want) > 50
    spans = P.membership_intervals(cal, spark.createDataFrame(snaps, "date date, ticker string"))
    assert spans.count() <= 4 * 3 + 2   # a stay is one row, not one for each day
    assert P.with_membership(grid.drop("member"), cal, spark.createDataFrame([], "date date, ticker string")).filter("member").count() == 0
    assert "array_contains" not in grid._jdf.queryExecution().toString()


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_long_chains_of_maps(spark, levels):
    rng = np.random.default_rng(7)
    data, want = [], {}
    for key, n in (("x", 1), ("y", 64), ("z", 5000)):
        v = 0.0
        for i in range(n):
            scale, add = float(rng.choice([0.0, 0.5, 0.99, 1.0], p=[.01, .09, .4, .5])), float(rng.normal())
            want[key, i] = v
            data.append((key, i, scale, add))
            v = scale * v + add
    got = M.running_affine(spark.createDataFrame(data, "k string, no long, scale double, add double"), ["k"], levels)
    assert {(r.k, r.no): r.value_in for r in got.collect()} == pytest.approx(want, rel=1e-9, abs=1e-9)


WORDS = Lexicon(positive=frozenset({"GOOD"}), negative=frozenset({"BAD"}), uncertainty=frozenset(), negators=frozenset({"NOT"}))
NEWS = "id long, created_at timestamp_ntz, updated_at timestamp_ntz, headline string, summary string, source string, url string, symbols array<string>, ingest_seq int"


def test_features_after_an_edited_story(spark, tmp_path):
    path = str(tmp_path / "scores")
    import datetime as dt
    rng = np.random.default_rng(2)
    raw = []
    for k in range(200):
        at = dt.datetime(2024, 1, 25) + dt.timedelta(hours=int(rng.integers(0, 24 * 80)))
        raw.append((k, at, at, " ".join(rng.choice(["good", "bad", "not", "plain"], 6)), "", "s", "", [str(x) for x in rng.choice(["A", "B", "C"], 2, replace=False)], 0))
    news = N.with_month(N.normalize_news(spark.createDataFrame(raw, NEWS))).cache()
    X.rescore(news, news.select("month").distinct(), WORDS, path)
    features = X.sentiment_by_ticker(spark.read.parquet(path)).cache()
    edit = F.col("id").isin(3, 50, 51) | ((F.month("created_at") == 2) & (F.dayofmonth("created_at") > 26))
    edited = news.withColumn("headline", F.when(edit, "good good").otherwise(F.col("headline"))).withColumn("symbols", F.when(F.col("id") == 3, F.array(F.lit("D"))).otherwise(F.col("symbols")))
    months = news.filter(edit).select("month")
    sessions = X.refresh_scores(spark, edited, months, WORDS, path)
    table = spark.read.parquet(path)
    got = cut_lineage(X.refresh_features(features, table, sessions))   # the next refresh writes new files
    whole = X.sentiment_by_ticker(X.score_articles(edited, WORDS))
    a, b = ({(r.date, r.ticker): (r.news_tone_sum, r.news_neg_sum, r.news_count) for r in df.collect()} for df in (got, whole))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)
    assert 0 < sessions.count() < features.select("date").distinct().count()
    plan = X.refresh_features(features, table, sessions.limit(1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [month" in plan
    # nothing changed: nothing is summed anew
    none = X.refresh_scores(spark, edited, months, WORDS, path)
    assert none.count() == 0 and X.refresh_features(got, spark.read.parquet(path), none).count() == got.count()


def test_a_span_of_news_opens_its_months_only(spark, tmp_path):
    import datetime as dt
    at = [dt.datetime(2024, m, 5) for m in range(1, 7)]
    N.write_news(N.normalize_news(spark.createDataFrame([(k, t, t, "h", "s", "x", "", ["A"], 0) for k, t in enumerate(at)], NEWS)), str(tmp_path / "news"))
    part = N.news_between(spark.read.parquet(str(tmp_path / "news")), "2024-02-10", "2024-04-30")
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert [r.id for r in part.orderBy("id").collect()] == [2, 3] and len(part.inputFiles()) >= 2

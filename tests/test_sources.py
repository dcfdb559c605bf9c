import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.sources import bars as B
from barloom.sources import lexicon as L
from barloom.sources import logs
from barloom.sources import news as N
from barloom.sources import universe as U
from helpers import day, rows, walk


def test_normalize_keeps_the_last_duplicate_and_drops_missing_closes(spark):
    raw = spark.createDataFrame([
        ("aapl", "2024-01-02T16:00:00-05:00", 1, 2, 0.5, 1.5, 10, 1), ("aapl", "2024-01-02", 1, 2, 0.5, 1.7, 10, 2),
        ("aapl", "2024-01-03", 1, 2, 0.5, None, 10, 1)], "Ticker string, Date string, Open int, High int, Low double, `Adj Close` double, Volume int, ingest_seq int")
    assert rows(B.normalize_bars(raw).select("ticker", "date", "close"), "date") == [("AAPL", day("2024-01-02"), 1.7)]
    with pytest.raises(ValueError):
        B.normalize_bars(raw.drop("Open"))


def test_merge_replaces_and_store_round_trip(spark, tmp_path):
    old = walk(spark, ["A", "B"], 300, holes=False)
    cut = day("2021-01-15")
    fresh = old.filter(F.col("date") >= F.lit(cut)).withColumn("close", F.lit(1.0))
    merged = B.merge_bars(old, fresh)
    assert merged.count() == old.count() and merged.filter("close = 1.0").count() == fresh.count()
    path = str(tmp_path / "bars")
    B.write_bars(old, path)
    B.upsert_bars(spark, path, fresh)
    stored = B.read_bars(spark, path)
    assert stored.exceptAll(merged.select(stored.columns)).count() == 0 and stored.count() == merged.count()
    assert B.read_bars(spark, path, ["a"]).select("ticker").distinct().count() == 1


def test_history_disagreement_ignores_the_newest_days(spark):
    old = walk(spark, ["A", "B", "C"], 30, holes=False)
    tail = old.filter(F.col("date") >= F.lit(day("2020-02-03")))
    last = tail.agg(F.max("date")).first()[0]
    fresh = tail.withColumn("close", F.col("close") * F.when((F.col("ticker") == "A") & (F.col("date") == F.lit(last)), 1.2).when(F.col("ticker") == "B", 1.03).otherwise(1.0))
    flags = dict(rows(B.history_disagreement(old, fresh).select("ticker", "disagrees"), "ticker"))
    assert flags == {"A": False, "B": True, "C": False}
    merge, replace = B.split_refresh(fresh, B.history_disagreement(old, fresh))
    assert {r.ticker for r in replace.collect()} == {"B"} and {r.ticker for r in merge.collect()} == {"A", "C"}


def test_refresh_plan(spark):
    plan = B.refresh_plan(spark.createDataFrame([("a",), ("NEW",)], "ticker string"), B.bar_coverage(walk(spark, ["A"], 5, "2024-01-01", holes=False)), "1990-01-01")
    assert rows(plan, "ticker") == [("A", "incremental", day("2023-12-29")), ("NEW", "full", day("1990-01-01"))]


def test_import_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,open,high,low,close,volume,Name\n2013-02-08,1,2,1,1.5,100,aapl\n2013-02-08,1,2,1,2.5,100,brk.b\n")
    got = B.import_long_csv(spark, str(tmp_path / "x.csv"))
    assert [r[0] for r in rows(got, "ticker")] == ["AAPL", "BRK-B"]


def test_source_fallback_takes_whole_tickers(spark):
    first = walk(spark, ["A"], 3, holes=False)
    got = B.source_fallback([first, walk(spark, ["A", "B"], 5, holes=False)])
    assert rows(got.groupBy("ticker", "priority").count(), "ticker") == [("A", 0, 3), ("B", 1, 5)]


def test_align_panel_is_dense_and_bounded(spark):
    bars = walk(spark, ["A", "B", "C"], 100)
    grid = B.align_panel(bars)
    assert grid.count() == 300 and grid.filter("close IS NOT NULL").count() == bars.count()
    assert grid.filter("ticker = 'B' AND bar_idx < 40 AND close IS NOT NULL").count() == 0
    assert B.align_panel(bars, min_bars=80).select("ticker").distinct().count() == 2
    cut = B.align_panel(bars, "2020-02-03", "2020-03-31")
    assert cut.agg(F.min("bar_idx"), F.min("date"), F.max("date")).first() == (0, day("2020-02-03"), day("2020-03-31"))


def _articles(spark, items):
    return spark.createDataFrame([(i, c, u, h, s, q) for q, (i, c, u, h, s) in enumerate(items)],
                                 "id long, created_at timestamp_ntz, updated_at timestamp_ntz, headline string, symbols array<string>, ingest_seq int")


def test_news_normalisation_and_windows(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    raw = _articles(spark, [
        (9, t("2024-03-01 10:00"), t("2024-03-01 11:00"), "new", ["x"]), (9, t("2024-03-01 10:00"), t("2024-03-01 10:00"), "old", ["x"]),
        (2, t("2024-01-03 21:00"), None, None, ["brk.b", "AAPL"]), (3, None, None, "gone", None), (4, t("2024-01-31 23:59:59"), None, "edge", None)])
    news = N.normalize_news(raw)
    got = {r.id: r for r in news.collect()}
    assert sorted(got) == [2, 4, 9] and got[9].headline == "new" and got[2].symbols == ["BRK-B", "AAPL"] and got[2].headline == ""
    assert got[2].updated_at == got[2].created_at and got[4].symbols == []
    assert N.month_rows(news, "2024-01").count() == 2
    assert [r.id for r in N.news_between(news, "2024-01-01", "2024-02-10", ["aapl"]).collect()] == [2]


def test_news_store_upsert(spark, tmp_path):
    t = dt.datetime(2024, 1, 5)
    path = str(tmp_path / "news")
    N.write_news(N.normalize_news(_articles(spark, [(1, t, None, "a", []), (2, dt.datetime(2024, 2, 5), None, "b", [])])), path)
    N.upsert_news(spark, path, N.normalize_news(_articles(spark, [(1, t, None, "a2", []), (3, t, None, "c", [])])))
    stored = {r.id: r.headline for r in spark.read.parquet(path).collect()}
    assert stored == {1: "a2", 2: "b", 3: "c"}


def test_news_refresh_plan(spark):
    cover = spark.createDataFrame([("2024-01", 3, dt.datetime(2024, 1, 30)), ("2024-03", 1, dt.datetime(2024, 3, 9, 12))], "month string, articles long, last_created timestamp_ntz")
    plan = {r.month: r for r in N.news_refresh_plan(cover, "2024-01-10", "2024-03-10 12:00:00").collect()}
    assert {m: r.action for m, r in plan.items()} == {"2024-01": "skip", "2024-02": "fetch", "2024-03": "fetch"}
    assert plan["2024-02"].fetch_from == dt.datetime(2024, 2, 1) and plan["2024-03"].fetch_from == dt.datetime(2024, 3, 8, 12)


def test_universe_membership_and_sectors(spark, tmp_path):
    (tmp_path / "m.csv").write_text('date,tickers\n2019-07-08,"EEL,OX.A"\n2021-02-03,"YAK,EEL,GNU"\n')
    long = U.read_membership(spark, str(tmp_path / "m.csv"))
    assert rows(long, "date", "ticker") == [(day("2019-07-08"), x) for x in ("EEL", "OX-A")] + [(day("2021-02-03"), x) for x in ("EEL", "GNU", "YAK")]
    (tmp_path / "c.csv").write_text("Symbol,Security,GICS Sector\nBRK.B,Berkshire,Financials\nNVDA,Nvidia,Information Technology\n")
    sectors = dict(rows(U.sector_map([U.etf_sectors(spark), U.read_constituents(spark, str(tmp_path / "c.csv"))]), "ticker"))
    assert sectors["BRK-B"] == "Financials" and sectors["SPY"] == "ETF"
    (tmp_path / "u.txt").write_text("brk.b\n aapl \n\nAAPL\n")
    assert rows(U.read_universe_file(spark, str(tmp_path / "u.txt")), "ticker") == [("AAPL",), ("BRK-B",)]
    (tmp_path / "u.csv").write_text("Symbol,Security\nmsft,Microsoft\n")
    assert rows(U.read_universe_file(spark, str(tmp_path / "u.csv")), "ticker") == [("MSFT",)]


def test_lexicon_years_and_limits(spark):
    raw = spark.createDataFrame([("amber", 0, 1998, 0, 0), ("coal", 2003, 0, 0, 0), ("tin", -2016, 2003, 0, 0), ("mist", 0, 0, 2011, 0), ("court", 0, 0, 0, 1998)],
                                "Word string, Negative int, Positive int, Uncertainty int, Litigious int")
    lex = L.collect_lexicon(L.lexicon_long(raw))
    assert lex.positive == {"AMBER", "TIN"} and lex.negative == {"COAL"} and lex.uncertainty == {"MIST"} and lex.litigious == {"COURT"} and len(lex) == 3
    with pytest.raises(ValueError):
        L.lexicon_long(raw.drop("Negative"))


def test_json_logs_skip_bad_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"as_of":"2024-01-02","equity":100.5}\nnot json\n{"as_of":"2024-01-03","equity":101}\n')
    assert [r.equity for r in logs.read_json_log(spark, str(tmp_path / "log"), logs.EQUITY_LOG).orderBy("as_of").collect()] == [100.5, 101.0]
    assert logs.read_json_log(spark, str(tmp_path / "missing"), logs.EQUITY_LOG).count() == 0

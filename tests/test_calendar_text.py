import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import text as T
from barloom.operators import schedule as S
from barloom.operators import sentiment as X
from barloom.sources import bars as B
from barloom.sources import news as N
from barloom.sources.lexicon import Lexicon
from helpers import business_days, day, rows, walk

LEX = Lexicon(positive=frozenset({"SUNNY", "CALM", "BRIGHT"}), negative=frozenset({"STORM", "FLOOD", "FROST", "GALE"}),
              uncertainty=frozenset({"PERHAPS", "CLOUDY"}))
NEGATORS = {"NO", "NOT", "NEVER", "NEITHER", "NONE", "NOBODY", "NOTHING", "NOR", "WITHOUT"}


def plain_scores(words, lexicon, negators, reach=3):
    """Counts by a loop over words: a positive word shortly after a negator counts as negative."""
    good = bad = 0
    for i, w in enumerate(words):
        if w in lexicon.positive:
            if any(v in negators for v in words[max(0, i - reach):i]):
                bad += 1
            else:
                good += 1
        elif w in lexicon.negative:
            bad += 1
    return good, bad


@pytest.fixture(scope="module")
def exchange(spark):
    span = spark.createDataFrame([(day("1970-01-01"),), (day("2030-12-31"),)], "date date")
    return {r.date: r for r in S.trading_calendar(span).collect()}


def test_holidays(exchange):
    closed = ["2024-03-29", "2024-07-04", "2024-11-28", "2023-01-02", "2024-06-19", "2024-09-14", "2022-06-20", "2021-07-05", "2021-12-24", "2000-04-21"]
    opened = ["2024-11-29", "2021-12-31", "2021-06-18", "2022-12-23", "1985-01-21"]
    assert not any(exchange[day(d)].is_trading_day for d in closed)
    assert all(exchange[day(d)].is_trading_day for d in opened)
    assert exchange[day("2024-03-28")].next_trading_day == day("2024-04-01")
    assert exchange[day("2021-12-30")].next_trading_day == day("2021-12-31")
    assert exchange[day("2026-09-14")].prev_trading_day == day("2026-09-11")
    assert exchange[day("2024-03-30")].session == day("2024-04-01") and exchange[day("2024-04-01")].session == day("2024-04-01")


def test_calendar_agrees_with_the_holiday_rules_of_pandas(exchange):
    import pandas as pd
    from pandas.tseries import holiday as h

    class Rules(h.AbstractHolidayCalendar):
        rules = [h.Holiday("n", month=1, day=1, observance=h.sunday_to_monday), h.USMartinLutherKingJr, h.USPresidentsDay, h.GoodFriday, h.USMemorialDay,
                 h.Holiday("j", month=6, day=19, observance=h.nearest_workday, start_date="2022-01-01"), h.Holiday("i", month=7, day=4, observance=h.nearest_workday),
                 h.USLaborDay, h.USThanksgivingDay, h.Holiday("c", month=12, day=25, observance=h.nearest_workday)]

    off = {d.date() for d in Rules().holidays("1970-01-01", "2030-12-31")}
    wrong = [d for d, r in exchange.items() if 1970 <= d.year <= 2030 and r.is_trading_day != (d.weekday() < 5 and d not in off)]
    assert wrong == []


def test_rebalance_days_on_the_exchange(spark):
    days = S.trading_calendar(spark.createDataFrame([(day("2022-01-01"),), (day("2024-12-31"),)], "date date"))
    flag = lambda name: {r.date: r.is_rebalance_day for r in S.is_rebalance_day(days, name).collect()}
    monthly, weekly, quarterly = flag("monthly"), flag("weekly"), flag("quarterly")
    assert monthly[day("2024-03-28")] and not monthly[day("2024-03-27")] and monthly[day("2024-12-31")] and monthly[day("2022-12-30")]
    assert not weekly[day("2024-07-03")] and weekly[day("2024-07-05")]
    assert quarterly[day("2024-06-28")] and not quarterly[day("2024-05-31")]


def _calendar(spark, start, n):
    return B.trading_index(spark.createDataFrame([(d,) for d in business_days(start, n)], "date date"))


def test_rebalance_masks(spark):
    chosen = [r.date for r in S.decision_dates(_calendar(spark, "2021-01-01", 86), "monthly").orderBy("date").collect()]
    assert chosen == [day(d) for d in ("2021-01-29", "2021-02-26", "2021-03-31", "2021-04-30")]
    three_weeks = _calendar(spark, "2021-01-04", 15)
    assert S.decision_dates(three_weeks, "weekly").count() == 3 and S.decision_dates(three_weeks, "daily").count() == 15
    assert [r.bar_idx for r in S.decision_dates(three_weeks, 5).orderBy("bar_idx").collect()] == [0, 5, 10]
    assert S.decision_dates(three_weeks, "quarterly").count() == 1
    for bad in ("hourly", 0):
        with pytest.raises(ValueError):
            S.rebalance_mask(three_weeks, bad)


def test_sessions_follow_the_new_york_close(spark):
    # every 37 minutes over the change to summer time of 2023 and over a long weekend, against the zone rules of Python
    from zoneinfo import ZoneInfo

    utc = dt.timezone.utc
    stamps = [dt.datetime(2023, 3, 9, tzinfo=utc) + dt.timedelta(minutes=37 * k) for k in range(200)]
    stamps += [dt.datetime(2023, 9, 1, 19, 58, tzinfo=utc) + dt.timedelta(seconds=31 * k) for k in range(10)]
    closed = {day("2023-09-04")}
    want = []
    for s in stamps:
        local = s.astimezone(ZoneInfo("America/New_York"))
        d = local.date() + dt.timedelta(days=int((local.hour, local.minute, local.second) > (16, 0, 0)))
        while d.weekday() > 4 or d in closed:
            d += dt.timedelta(days=1)
        want.append(d)
    news = spark.createDataFrame([(i, s.replace(tzinfo=None)) for i, s in enumerate(stamps)], "id int, created_at timestamp_ntz")
    assert [r.session for r in S.news_session(news).orderBy("id").collect()] == want


def _one(spark, text):
    return spark.createDataFrame([(text,)], "t string")


def test_tokens(spark):
    text = "At 7 o'clock: 40% of \"half-open\" gates (no. B2) creak."
    got = _one(spark, text).select(T.tokenize(F.col("t"))).first()[0]
    assert "HALF-OPEN" in got and "GATES" in got and got[-1] == "CREAK" and not any(ch.isdigit() for w in got for ch in w)
    assert _one(spark, None).select(T.tokenize(F.col("t"))).first()[0] == []


@pytest.mark.parametrize("seed", range(4))
def test_scores(spark, seed):
    import random

    pick = random.Random(seed)
    words = [pick.choice(["sunny", "calm", "storm", "frost", "not", "never", "hill", "river", "perhaps", "road"]) for _ in range(40)] if seed else ["hill", "road"]
    text = " ".join(words)
    positive, negative = plain_scores([w.upper() for w in words], LEX, NEGATORS)
    r = T.with_scores(_one(spark, text), F.col("t"), LEX).first()
    assert (r.positive, r.negative) == (positive, negative)
    s = positive + negative
    assert r.tone == ((positive - negative) / s if s else 0.0) and r.negativity == negative / r.n_tokens
    words = spark.createDataFrame([("positive", w) for w in LEX.positive] + [("negative", w) for w in LEX.negative], "category string, word string")
    joined = T.score_with_table(_one(spark, text).withColumn("id", F.lit(1)), "id", F.col("t"), words).first()
    assert (joined.positive, joined.negative, joined.n_tokens) == (positive, negative, r.n_tokens)


def test_daily_sentiment(spark):
    rng = np.random.default_rng(8)
    names, days = ["P", "Q", "R"], business_days("2023-05-08", 4)
    items = []
    for i in range(30):   # morning items count for their own day, evening ones for the next of four days
        d, evening, who = int(rng.integers(3)), bool(rng.integers(2)), [str(x) for x in rng.choice(["P", "Q", "R", "OTHER"], int(rng.integers(1, 3)), replace=False)]
        tone = int(rng.integers(2))
        items.append((i, dt.datetime.combine(days[d], dt.time(23 if evening else 13, 5)), "calm day" if tone else "frost and gale", who, d + evening, 1.0 if tone else -1.0))
    raw = spark.createDataFrame([x[:4] for x in items], "id long, created_at timestamp_ntz, headline string, symbols array<string>")
    grid = B.align_panel(walk(spark, names, 4, "2023-05-08", holes=False))
    scored = X.score_articles(N.normalize_news(raw), LEX)
    got = {(r.ticker, r.date): (r.news_count, r.news_tone_sum) for r in X.daily_sentiment(scored, grid).collect()}
    for n in names:
        for k, d in enumerate(days):
            mine = [x[5] for x in items if n in x[3] and x[4] == k]
            assert got[n, d] == (float(len(mine)), pytest.approx(sum(mine)))
    info = X.news_feature_info(scored, X.daily_sentiment(scored, grid)).first()
    assert (info.articles, info.articles_tagged) == (30, sum(len(x[3]) for x in items))

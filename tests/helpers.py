"""Fixture builders and a sequential ledger to check the set-based one against."""
import datetime as dt

import numpy as np
import pandas as pd


def business_days(start, n):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def walk(spark, tickers, n=320, start="2020-01-01", seed=7, holes=True):
    """Seeded random-walk bars with a late listing and a hole."""
    rng = np.random.default_rng(seed)
    days = business_days(start, n)
    rows = []
    for k, t in enumerate(tickers):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.015, n)))
        open_ = close * (1 + rng.normal(0, 0.004, n))
        for i, d in enumerate(days):
            if holes and ((k == 1 and i < 40) or (k == 2 and i % 37 == 5)):
                continue
            rows.append((t, d, float(open_[i]), float(max(open_[i], close[i])), float(min(open_[i], close[i])), float(close[i]), 1e6))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def day(text):
    return dt.date.fromisoformat(text)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def sequential_ledger(marks, weights, decisions, first, last, cash, penalty, pct, per_share):
    """Day by day: fill yesterday's decision at today's reference, then mark. Returns the equity path."""
    ref = {(r.ticker, r.bar_idx): r.fill_ref for r in marks.itertuples()}
    mark = {(r.ticker, r.bar_idx): r.mark for r in marks.itertuples()}
    shares, pending, path = {}, None, []
    for i in range(first, last + 1):
        if pending is not None:
            total = cash + sum(q * ref[t, i] for t, q in shares.items())
            goal = {t: w * total / ref[t, i] for t, w in pending.items() if w}
            for t in sorted(set(goal) | set(shares)):
                move = goal.get(t, 0.0) - shares.get(t, 0.0)
                side = 1 if move > 0 else -1
                price = ref[t, i] * (1 + side * penalty)
                cash -= move * price + abs(move) * (per_share + price * pct)
            shares, pending = goal, None
        path.append(cash + sum(q * mark[t, i] for t, q in shares.items()))
        if i in decisions and i < last:
            pending = weights.get(i, {})
    return path


def capped_account(marks, weights, decisions, first, last, cash, model):
    """Day by day with a cash limit: sales first, then purchases, fewest shares first, each with what is left. Equity and cash paths."""
    ref = {(r.ticker, r.bar_idx): r.fill_ref for r in marks.itertuples()}
    mark = {(r.ticker, r.bar_idx): r.mark for r in marks.itertuples()}
    shares, pending, path, money = {}, None, [], []
    for i in range(first, last + 1):
        if pending is not None:
            total = cash + sum(q * ref[t, i] for t, q in shares.items())
            moves = {t: pending.get(t, 0.0) * total / ref[t, i] - shares.get(t, 0.0) for t in set(pending) | set(shares)}
            for t, d in sorted(moves.items(), key=lambda x: (x[1] > 0, x[1], x[0])):
                if abs(d) * ref[t, i] < 1e-12 * total:
                    continue
                price = ref[t, i] * (1 + (model.penalty if d > 0 else -model.penalty))
                if d > 0:
                    d = min(d, max(cash, 0.0) / (price + model.commission_per_share + price * model.commission_pct))
                if d:
                    cash -= d * price + max(abs(d) * (model.commission_per_share + price * model.commission_pct), model.commission_min)
                    shares[t] = shares.get(t, 0.0) + d
            shares, pending = {t: q for t, q in shares.items() if abs(q) > 1e-12}, None
        path.append(cash + sum(q * mark[t, i] for t, q in shares.items()))
        money.append(cash)
        if i in decisions and i < last:
            pending = weights.get(i, {})
    return path, money

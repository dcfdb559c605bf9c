"""Hard negatives, importance resampling and language-model scores against plain Python."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import gru, negatives, recurrent, resampling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAN, INF = float("nan"), float("inf")


# ---- hard negatives --------------------------------------------------------------------------------
def plain_negatives(rows, anchors, p):
    """rows of (id, label, vector): every pair by hand."""
    fine = [(i, y, [math.floor(p.scale * c) for c in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, y, v in fine:
        if i % anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, y == z) for j, z, w in fine if j != i]
        for s, j, _ in sorted(x for x in scored if x[2])[:p.positives]:
            fit = sorted(x[:2] for x in scored if not x[2] and p.low * -s <= 100 * -x[0] <= p.high * -s)
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit[:p.window])]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2.0, "x", "y") for i, y, v in rows], "vec_id long, embedding array<float>, label int, block long, score double, id string, w string")


def mined(df, anchors, p):
    out = negatives.hard_negatives(df, F.col("id") % anchors == 0, params=p)
    return Counter(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block_values", [1 << 17, 300, 10])
def test_hard_negatives(spark, block_values):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 11)).astype(np.float32)
    x[50:90] = x[50]   # a large group of equal vectors: ties by id
    x[100:110] *= 30   # long ones
    x[120:140, 3:] = 0   # sparse ones
    labels = rng.integers(0, 3, 240)
    rows = [(int(i), int(labels[i]), [float(c) for c in x[i]]) for i in range(240)]
    rows += [(300, None, [1.0] * 11), (301, 1, None), (302, 1, [NAN] * 11), (303, 1, [1.0, None]), (304, 1, [INF, 0.0]), (None, 1, [1.0] * 11), (306, 9, [1.0] * 11), (308, 1, []), (310, 2, [2.5, -1.0])]
    p = negatives.Params(positives=3, window=4, block_values=block_values)
    want = plain_negatives(rows, 10, p)
    assert len(want) > 100 and mined(vectors(spark, rows), 10, p) == want


def test_hard_negatives_of_small_and_odd_tables(spark):
    p = negatives.Params()
    assert not mined(vectors(spark, []), 1, p)
    assert not mined(vectors(spark, [(1, 1, [1.0]), (2, 2, [-1.0])]), 1, p)   # no positives
    rows = [(0, 1, [1.0, 0.0]), (2, 1, [-1.0, 0.0]), (3, 2, [0.5, 0.0]), (4, 1, [0.0, 1.0]), (5, 2, [0.0, 0.5])]
    assert mined(vectors(spark, rows), 1, p) == plain_negatives(rows, 1, p)   # scores of 0 and below
    twice = [(0, 1, [1.0]), (1, 1, [0.9]), (1, 1, [0.9]), (3, 2, [0.5]), (3, 2, [0.5])]
    assert sum(mined(vectors(spark, twice), 10, p).values()) == sum(plain_negatives(twice, 10, p).values()) == 4
    with pytest.raises(Exception, match="Overflow|overflow|ARITHMETIC"):
        mined(vectors(spark, [(0, 1, [1e15]), (1, 1, [1e15]), (2, 2, [1e14])]), 1, p)


def test_bounds_leave_out_coordinates_but_lose_no_pair():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 40)) * 100 * np.geomspace(0.1, 3, 40)).astype(np.int64)
    index, q = negatives.Index(x), x[:30]
    exact = x @ q.T
    for floor in (exact.max() * 0.2, exact.max() * 0.7, 1.0, 0.0, -1e6):
        row, anchor, score = index.scores(q, np.full(30, float(floor)))
        assert sorted(zip(row.tolist(), anchor.tolist(), [int(s) for s in score])) == sorted((i, a, int(exact[i, a])) for i, a in zip(*np.nonzero(exact >= floor)))
    high = float(exact.max() * 0.3)
    before = negatives.norms(np.pad(q, ((0, 0), (0, 0))))
    start = (index.before * (before / high).max(0) < 1).sum(1) - 1
    assert (start > 0).mean() > 0.5   # most rows have coordinates that are not in the index


# ---- importance resampling -------------------------------------------------------------------------
def plain_resample(docs, target, p):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    runs = lambda w: [" ".join(w[i:i + n]) for n in range(1, p.longest + 1) for i in range(len(w) - n + 1)]
    of = lambda t: [zlib.crc32(x.encode()) % p.buckets for x in runs(words(t))]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (t_all * 0 + s_all + p.buckets)) / ((s[b] + 1) * (t_all + p.buckets))))
    out = []
    for k, x in docs:
        b = of(x)
        h = int(hashlib.sha256(f"{p.seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, b))
        out.append([k, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(words(x)) >= p.min_words])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(order[:len(order) * p.percent // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("p", [resampling.Params(min_words=3, percent=30, buckets=50), resampling.Params(min_words=2, percent=100, longest=3, buckets=997),
                               resampling.Params(min_words=3, percent=10, margin=1e-9), resampling.Params(min_words=10_000_000)])
def test_resampling(spark, edge_docs, edge_rows, p):
    rng = np.random.default_rng(4)
    pool = ["Alpha", "beta", "gamma", "delta-x", "eps", "é9", "zeta", "eta"]
    more = [(100 + k, " ".join(rng.choice(pool, rng.integers(0, 30)))) for k in range(150)] + [(500, "beta gamma eta")] * 20
    docs = edge_docs.select("doc_id", "text", "key", "hits", "score").union(spark.createDataFrame([(k, t, "a", "b", 0.0) for k, t in more], "doc_id long, text string, key string, hits string, score double"))
    target = ["beta GAMMA beta", None, "", "é9 zeta"]
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), params=p)
    assert Counter(tuple(r) for r in got.collect()) == plain_resample([r[:2] for r in edge_rows] + more, target, p)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_empty_tables(spark, edge_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(edge_docs.limit(0), none).count() == 0
    assert resampling.resample(edge_docs, none).count() == 15


def test_ranks_of_one_score(spark):
    """A score that very many rows share is one range of keys after another."""
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("key"), F.lit(3).alias("score"), F.col("id").alias("row"))
    got = resampling.in_order(rows, *resampling.order()).select("key", "rank").collect()
    assert all(r["rank"] == r["key"] + 1 for r in got) and len(got) == 5000


# ---- language models -------------------------------------------------------------------------------
SMALL = recurrent.Params(vocabulary=12, hidden=4, inner=3, classes=3, block_tokens=500, buffer_tokens=700, share=1)


def plain_base(rows, held):
    split = [(k, (t or "").translate(FOLD)) for k, t in rows]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t) + [None] for _, t in split]
    c = Counter(x for (k, _), w in zip(split, tokens) if not held(k) for x in w)
    n, v = sum(c.values()), len(c)
    return n, Counter((k, held(k), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w), 6)) for (k, _), w in zip(split, tokens))


def test_base_scores(spark, edge_docs, edge_rows):
    held = F.col("doc_id") % 3 == 1
    got = recurrent.score_documents(edge_docs, held, params=SMALL)
    n, want = plain_base([r[:2] for r in edge_rows], lambda k: k is not None and k % 3 == 1)
    rows = got.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert recurrent.score_documents(edge_docs.limit(0), held, params=SMALL).count() == 0
    assert recurrent.score_documents(edge_docs, F.lit(True), params=SMALL).filter("train_tokens = 0 AND n_known = 0").count() == 15


def test_the_network_learns_what_word_counts_cannot(spark):
    """Words in a fixed cycle: each is as frequent as the others, and each follows from the one before."""
    cycle = [f"w{k}" for k in range(8)]
    docs = [(k, " ".join(cycle[(k + i) % 8] for i in range(10 + k % 37))) for k in range(400)]
    p = recurrent.Params(vocabulary=20, hidden=12, inner=6, classes=4, share=1, rounds=6, slots=16, steps=12, rate=0.3, buffer_tokens=5000)
    rows = recurrent.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), F.col("doc_id") % 5 == 1, params=p).filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > 0.6 * sum(r.base_score for r in rows) / tokens


def model(seed=2, tokens=11):
    counts = np.arange(tokens, 0, -1).astype(float) ** 2
    return gru.Model.start(gru.Shape(tokens, 5, 4, gru.classes(counts, 4)), counts, seed)


def test_every_window_is_learned_from():
    p = recurrent.Params()
    texts = [np.arange(n) % 11 for n in (1, 5, 700, 90, 33)]
    seen = gru.Learner(model(), np.full(model().flat().size, p.squares), p.rate).learn(texts, 10, 2, p.steps, p.share)
    assert seen == sum(len(t) for t in texts)


def test_probabilities_sum_to_one():
    m = model()
    h = np.random.default_rng(0).normal(size=(7, 5)).astype(np.float32)
    total = sum(np.exp(m.output(h, np.full(7, y))[0]) for y in range(11))
    assert np.allclose(total, 1, atol=1e-5)
    start = np.array([np.exp(m.output(np.zeros((1, 5), np.float32), np.array([y]))[0][0]) for y in range(11)])
    counts = np.arange(11, 0, -1.0) ** 2
    assert np.allclose(start, counts / counts.sum(), atol=1e-6)   # before learning: the frequencies


def test_gradients_match_differences():
    m = model()
    for k in m.w:
        m.w[k] = m.w[k].astype(np.float64)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 11, (6, 3)), rng.integers(0, 11, (6, 3))
    fresh, valid = rng.random((6, 3)) < 0.3, rng.random((6, 3)) < 0.8
    h = rng.normal(size=(3, 5))
    g, _ = m.gradients(x, y, fresh, valid, h, 18)

    def loss():
        states = m.read(x, fresh, h, [])
        return -m.output(states[valid], y[valid])[0].sum() / 18

    for k, w in m.w.items():
        for at in rng.choice(w.size, min(6, w.size), replace=False):
            was = w.flat[at]
            w.flat[at] = was + 1e-2
            up = loss()
            w.flat[at] = was - 1e-2
            down = loss()
            w.flat[at] = was
            assert abs(g[k].flat[at] - (up - down) / 2e-2) < 3e-4, k


@pytest.mark.parametrize("slots,steps", [(1, 4), (3, 5), (50, 64)])
def test_state_is_carried_through_whole_texts(slots, steps):
    """Any slots and windows give the score of reading each text alone from its start."""
    m, rng = model(), np.random.default_rng(3)
    texts = [rng.integers(0, 11, n).astype(np.uint16) for n in (1, 2, 30, 7, 1, 55, 4, 19)]
    want = []
    for t in texts:
        h, total = np.zeros((1, 5), np.float32), 0.0
        for k, token in enumerate(t):
            h = m.read(np.array([[10 if k == 0 else int(t[k - 1])]]), np.array([[k == 0]]), h)[-1]
            total += m.output(h, np.array([int(token)]))[0][0]
        want.append(total)
    assert np.allclose(gru.score_texts(m, texts, 10, slots, steps), want, rtol=1e-4)
    assert gru.score_texts(m, [], 10).shape == (0,)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_scores_are_those_of_any_pieces(monkeypatch, rows):
    """A window's logits are taken some rows at a time; where it is cut is of no matter, and no row is lost."""
    m, rng = model(), np.random.default_rng(7)
    texts = [rng.integers(0, 11, n).astype(np.uint16) for n in (1, 40, 7, 1, 23)]
    want = gru.score_texts(m, texts, 10, 2, 6)
    monkeypatch.setattr(gru, "ROWS", rows)
    assert np.allclose(gru.score_texts(m, texts, 10, 2, 6), want, rtol=1e-6) and (want < 0).all()


def test_gradients_leave_out_words_of_classes_that_do_not_occur():
    """A window with few words costs what its words need; a step by these rows is a step by all."""
    m, rng = model(), np.random.default_rng(4)
    x, y, fresh, valid = np.array([[10, 10], [1, 1]]), np.array([[0, 1], [1, 0]]), np.array([[True, True], [False, False]]), np.ones((2, 2), bool)
    h = np.zeros((2, 5), np.float32)
    some, _ = m.slopes(x, y, fresh, valid, h, 4)
    whole, _ = m.gradients(x, y, fresh, valid, h, 4)
    assert list(some["embed"][0]) == [1, 10] and len(some["word"][0]) < 11
    moved = []
    for g in (some, whole):
        learner = gru.Learner(m.restore(m.flat()), np.full(m.flat().size, 1e-3), 0.1)
        learner.step(g)
        moved.append(learner.model.flat())
    assert np.array_equal(*moved) and not np.array_equal(moved[0], m.flat())


def test_a_gate_is_one_piece_of_memory():
    """With a column for each slot, a step's loops run over whole gates and not over a few units of one slot after another."""
    m, x, kept = model(), np.arange(12).reshape(3, 4) % 11, []
    states = m.read(x, x == 0, np.zeros((4, 5), np.float32), kept)
    assert states.shape == (3, 4, 5) and states.transpose(0, 2, 1).flags.c_contiguous
    assert all(k.flags.c_contiguous and k.shape[::2] == (3, 4) for k in kept)


@pytest.mark.filterwarnings("error")
def test_states_of_saturated_gates():
    """Sums beyond the range of single-precision exponentials, and texts that begin inside a window."""
    m, rng = model(), np.random.default_rng(6)
    m.w["into"] *= 300
    x, fresh, h = rng.integers(0, 11, (6, 4)), rng.random((6, 4)) < 0.3, rng.normal(size=(4, 5)).astype(np.float32)
    w, before = {k: v.astype(np.float64) for k, v in m.w.items()}, h.astype(np.float64)
    for t, got in enumerate(m.read(x, fresh, h)):
        before = np.where(fresh[t][:, None], 0, before)
        given, again = np.column_stack([w["embed"][x[t]], np.ones(4)]) @ w["into"], before @ w["again"]
        r, z = np.split(0.5 + 0.5 * np.tanh((given + again)[:, :10] / 2), 2, 1)
        n = np.tanh(given[:, 10:] + r * again[:, 10:])
        before = (1 - z) * n + z * before
        assert np.abs(given).max() > 100 and np.allclose(got, before, atol=1e-4)


def test_probabilities_of_far_logits():
    """Logits beyond the range of single-precision exponentials."""
    m = model()
    m.w["word"] *= 4000
    h = np.random.default_rng(5).normal(size=(7, 5)).astype(np.float32)
    total = sum(np.exp(m.output(h, np.full(7, y))[0]) for y in range(11))
    assert np.allclose(total, 1, atol=1e-4)

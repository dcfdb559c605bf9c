"""Operators on documents: brute force on small tables, and the edge cases that the docstrings define."""
import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import LONG, documents  # noqa: F401  (tests/llm/conftest.py)
from pyspark.sql import functions as F

from barloom.llm import decontam, mixing, neardup, quality, secrets, sharding, substrings, toxicity, urls, warc
from barloom.llm.common import free_name

FOLDER = "/root/testdata/sf0.001"
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


# toxicity

def test_toxicity_learns_held_out_texts(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(300)]
    rows = []
    for k in range(500):
        body = list(rng.choice(words, 60))
        if k % 4 == 0:
            body[int(rng.integers(60))] = str(rng.choice(["blockhead", "numbskull", "dunce"]))
        rows.append((k, " ".join(body)))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(500) if k % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    score = free_name(docs, "score")
    got = {r.doc_id: r[score] for r in docs.withColumn(score, toxicity.score_column(model, F.col("text"))).collect()}
    held = [k for k in range(500) if k % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held]) >= 0.97
    assert all(0 <= v <= 1 for v in got.values())
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_toxicity_edges(spark, edge_docs):
    labels = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, labels)
    got = edge_docs.select("doc_id", "text", toxicity.score_column(model, F.col("text")).alias("s")).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if not (r.text or "").strip()}) == 1
    none = toxicity.fit(edge_docs.limit(0), labels.limit(0))
    assert none.score(None) == none.score("abc") == 0.5
    one = toxicity.fit(edge_docs, labels.filter("toxic = 1"))
    assert one.score("x") == pytest.approx(2 / 3)


def test_toxicity_reads_long_texts_whole(spark):
    p = toxicity.Params()
    whole = " ".join(f"w{k}" for k in range(90_000))
    assert len(whole) > 2 * toxicity.PIECE
    low = f" {whole} "
    want = set()
    for n in p.orders:
        codes = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for j in range(n):
            h = h * toxicity.STRIDE + codes[j:len(codes) - n + 1 + j]
        want |= set((((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - p.bits)).tolist())
    assert set(toxicity.buckets(whole, p).tolist()) == want


# quality

def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines))


def test_quality_measures(spark, edge_rows):
    some = [t for _, t in texts(spark)[:60]] + [r[1] for r in edge_rows] + ["a b a b a b", "x\ny\nx\n\n", "\x1c \x85 \xa0 w", "a a a", "a a a a"]
    for t in some:
        assert quality.measure_text((t or "").encode()) == plain_measures(t), repr((t or "")[:50])


def test_quality_ledger_and_policies(spark, edge_docs):
    ledger = quality.build_ledger(edge_docs, keep=("doc_id", "score", "a.b"))
    got = ledger.collect()
    assert len(got) == edge_docs.count()
    for r in got:
        m = r.asDict()
        bits = sum(1 << x.bit for x in quality.RULES if eval(x.fails.replace(" AND ", " and "), {}, m))
        assert r.fail_bits == bits
    kept = quality.apply_policies(ledger).collect()
    for r in kept:
        for v, p in quality.POLICIES.items():
            failed = [x.name for x in quality.RULES if r.fail_bits >> x.bit & 1]
            assert r[f"kept_{v}"] == (sum(n in p.rules for n in failed) <= p.allowed and not set(failed) & set(p.fatal))
    policy = quality.POLICIES["v1"]
    out = {r.rule: r for r in quality.ablations(ledger, policy).collect()}
    assert set(out) == set(policy.rules)
    names = [[x.name for x in quality.RULES if r.fail_bits >> x.bit & 1 and x.name in policy.rules] for r in got]
    for rule, r in out.items():
        assert r.n_failed == sum(rule in n for n in names) and r.n_only_this == sum(n == [rule] for n in names)
        assert r.n_dropped == sum(bool(n) for n in names)
    assert quality.ablations(ledger.limit(0), policy).count() == 0


# mixing

def plain_mixture(rows, limit, seed=0):
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    some = {s: n for s, n in tokens.items() if n}
    lo, hi = 0.0, 1.0
    for _ in range(32):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (max(some.values()) / min(some.values())) ** (1 - mid) <= limit else (mid, hi)
    most = max(some.values())
    copies = Counter()
    for s, n in tokens.items():
        budget = round(most * n ** hi / most ** hi) if n else 0
        epochs, rest = (budget // n, budget % n) if n else (1, 0)
        mine = sorted((int(hashlib.md5(f"{seed}|{epochs}|{k}".encode()).hexdigest()[:15], 16), k, w) for k, t, w in rows if t == s)
        used = 0
        for place, k, w in mine:
            used += w
            copies[k] += epochs + (rest > 0 and used <= rest)
    return copies


@pytest.mark.parametrize("block_tokens", [50, 1_000_000])
def test_mixing_matches_plain_python(spark, block_tokens):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), f"s{min(int(rng.integers(0, 9)), 5)}") for k in range(400)]
    docs = documents(spark, rows)
    got = mixing.mixed_sequence(docs, mixing.Target(repeats=1.7), block_tokens=block_tokens).collect()
    want = plain_mixture([(k, s, len(t.split())) for k, t, s in rows], 1.7)
    assert Counter(r.doc_id for r in got) == want
    assert all(v >= 1 for v in want.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.source, r.epoch, r.block].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    mixed = mixing.mix_documents(docs, mixing.Target(repeats=1.7), block_tokens=block_tokens)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.select("doc_id").collect()) == want


def test_mixing_meets_an_entropy(spark):
    shares = spark.createDataFrame([(900,), (60,), (30,), (10,)], "tokens long")
    a = mixing.exponent(shares, mixing.Target(entropy=0.8))
    w = np.array([900, 60, 30, 10.0]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.8 * np.log(4), abs=1e-6)
    assert mixing.exponent(shares, mixing.Target(entropy=0.1)) == 1.0
    assert mixing.exponent(shares, mixing.Target(repeats=100)) < 1e-6


def test_mixing_edges(spark, edge_docs):
    got = mixing.mixed_sequence(edge_docs, mixing.Target(repeats=2.0)).collect()
    rows = Counter(r.doc_id for r in edge_docs.select("doc_id").collect())
    assert set(Counter(r.doc_id for r in got)) == set(rows)
    assert all(Counter(r.doc_id for r in got)[k] >= n for k, n in rows.items())
    assert mixing.mixed_sequence(edge_docs.limit(0), mixing.Target(entropy=0.5)).count() == 0
    empty = documents(spark, [(1, None, "a"), (2, "", None)])
    assert sorted(r.doc_id for r in mixing.mixed_sequence(empty, mixing.Target(repeats=3.0)).collect()) == [1, 2]


# decontamination

def plain_hits(text, items, width=10):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(UPPER))

    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(width, len(w))
        wins = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1 if n else 0):
            if tuple(doc[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(doc), hit, sorted(found)


@pytest.mark.parametrize("block_words", [20, 2_000_000])
def test_decontamination(spark, edge_rows, block_words):
    items = [(1, "The quick, brown fox jumps over the lazy dog and then!"), (2, "é ü"), (3, None), (4, "..."), (None, "word1 OF1 word2 of2"), (1, "sleeps a long while"), (12, "one")]
    rows = edge_rows + [(20, "x the Quick brown fox jumps over the lazy dog and"), (21, "quick brown fox"), (22, "one two one")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = free_name(docs, "hits")
    got = decontam.scan_documents(docs, bench, out=out, block_words=block_words).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = plain_hits(r.text, items)
        assert (r[out].n_words, {i for s in r[out].spans for i in range(s.start, s.end)}, sorted(r[out]["items"])) == (n, hit, found)
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench, block_words=block_words).collect()}
    assert cut[22] == " two " and cut[20] == "x " and cut[1] is None and cut[21] == "quick brown fox"
    kept = decontam.remove_documents(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, t, *_ in rows if not plain_hits(t, items)[1])
    assert decontam.remove_documents(docs, bench.limit(0)).count() == len(rows)
    assert decontam.remove_documents(docs.limit(0), bench).count() == 0


# secrets

def test_secrets(spark):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows = [(1, f"é password = 'hunter2hunter2' {key} and {'0f' * 16}", "a"), (2, f"TOKEN:{'9ab' * 14}", "a"), (3, f"x {key}", "b"), (4, f"x {key}", "c"), (5, "token=short secret: x", "a"),
            (6, None, None), (7, "", "b"), (8, "tok\u212Aen=abcdefghijkl pa\u017Fsword=abcdefghijkl", "a"), (9, "password=secret:abcdefgh12", "a"), (2, f"TOKEN:{'9ab' * 14}", "a")]
    docs = documents(spark, rows)
    got = secrets.secret_report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(f.kind, f.start, f.end) for f in by[1].found] == [("assign", 2, 28), ("access", 30, 50), ("hex", 55, 87)]
    assert by[1].n_copied == 1 and by[3].n_copied == 1 and by[3].most_owners == 3 and by[2].n_copied == 0
    assert [f.kind for f in by[2].found] == ["assign", "hex"]
    assert not by[5].found and not by[6].found and not by[7].found and not by[8].found
    assert not by[9].found   # the match ends at the colon, is too short, and is used up
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_private_keys_count_by_their_bodies(spark):
    def pem(body, kind="RSA "):
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"

    bodies = ["MIIEowIBAAKCAQEA" + base64.b64encode(hashlib.sha512(str(k).encode()).digest()).decode() for k in range(6)]
    rows = [(k, f"key: {pem(bodies[k])} end", f"owner{k}") for k in range(5)]
    rows += [(10 + k, "x " + pem(bodies[5] if k else bodies[5][:20] + "\r\n " + bodies[5][20:]), f"o{k}") for k in range(4)]   # one example, wrapped in two ways
    rows += [(20 + k, "-----BEGIN PRIVATE KEY----- ...", f"p{k}") for k in range(2)] + [(30, pem("AAAA") + pem("BBBB", ""), "q"), (31, "-----BEGIN PRIVATE KEY-----" * 3000 + "A" * 100_000, "r")]
    by = {r.doc_id: r for r in secrets.secret_report(documents(spark, rows)).collect()}
    assert all((by[k].n_copied, by[k].n_live, by[k].most_owners) == (0, 1, 1) for k in range(5))   # five keys of five owners
    assert all((by[10 + k].n_copied, by[10 + k].n_live, by[10 + k].most_owners) == (1, 0, 4) for k in range(4))
    assert all(by[20 + k].n_live == 0 for k in range(2)) and len(by[31].found) == 3000
    assert [(f.start, f.end) for f in by[0].found if f.kind == "pem"] == [(5, 5 + len(pem(bodies[0])))]
    assert [f.kind for f in by[30].found] == ["pem", "pem"]


# near duplicates

def plain_components(rows, percent=85):
    sets, n = {}, {}
    for k, t in rows:
        w = (t or "").encode().translate(UPPER).split()
        n[k] = 0
        if w and k is not None:
            sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
            n[k] = len(sets[k])
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (n[k], find(k)) for k, _ in rows}


@pytest.mark.parametrize("unit_bytes", [6_000, 16 << 20])
def test_near_duplicates(spark, unit_bytes):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(2_000)]
    rows, k = [], 0
    for family, size, edits in ((0, 40, 2), (1, 12, 5), (2, 5, 1), (3, 60, 3)):
        base = list(rng.choice(words, 150))
        for _ in range(size):
            copy = list(base)
            for at in rng.integers(0, 150, int(rng.integers(0, edits + 1))):
                copy[at] = str(rng.choice(words))
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k + i, " ".join(rng.choice(words, 80))) for i in range(40)]
    want = plain_components(rows)
    assert len({c for _, c in want.values()}) < len(rows)
    docs = documents(spark, [rows[i] for i in rng.permutation(len(rows))])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, unit_bytes=unit_bytes).collect()}
    assert got == want


def test_near_duplicate_edges(spark, edge_docs, edge_rows):
    got = neardup.near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[6].component_id == by[7].component_id == by[8].component_id == 6
    assert by[4].component_id == by[5].component_id == 4 and not by[5].kept
    assert all(by[k].n_shingles == 0 and by[k].kept and by[k].component_id == k for k in (1, 2, 3))
    assert by[9].n_shingles == 1
    lone = [r for r in got if r.doc_id is None]
    assert len(lone) == 2 and all(r.component_id is None and r.kept for r in lone)
    assert neardup.near_duplicates(edge_docs.limit(0)).count() == 0


def test_shingles_of_long_texts():
    text = LONG.encode()
    words = text.split()
    want = len({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    assert len(words) > neardup.PIECE_WORDS and len(neardup.shingles(text)) == want


# repeated substrings

def plain_repeats(rows, length):
    first = {}
    for k, b in rows:
        for p in range(len(b) - length + 1) if k is not None else ():
            w = b[p:p + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1) if k is not None else ():
            if first[b[p:p + length]] < k:
                gone[p:p + length] = True
        edges = np.diff(np.concatenate(([0], gone.view(np.int8))))
        out.append((k, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, block_bytes", [(50, 16 << 20), (20, 2_000), (120, 5_000)])
def test_repeated_substrings(spark, length, block_bytes):
    rng = np.random.default_rng(7)
    passage = "".join(rng.choice(list("abcdef é"), 260))
    rows = [(None, passage), (3, None), (4, ""), (5, "a" * 400), (6, "a" * 130), (6, passage + "zz"), (7, passage[:length - 1]), (8, passage[:length]), (8, passage[:length])]
    for k in range(20, 60):
        at, n = int(rng.integers(0, 200)), int(rng.integers(10, 160))
        noise = ["".join(rng.choice(list("abcdef é"), int(rng.integers(0, 90)))) for _ in range(2)]
        rows.append((k, noise[0] + passage[at:at + n] + noise[1]))
    rows += [(k + 100, t) for k, t in rows[10:15]]
    got = substrings.repeated_substrings(documents(spark, rows), length=length, block_bytes=block_bytes).collect()
    want = plain_repeats([(k, (t or "").encode()) for k, t in rows], length)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want
    assert all(sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed and len(r.starts) == r.n_spans for r in got)


def test_repeated_substring_edges(spark, edge_docs, edge_rows):
    got = {r.doc_id: r for r in substrings.repeated_substrings(edge_docs).collect() if r.doc_id is not None}
    # LONG repeats itself after 30,287 words, so the space after its last word also follows the same bytes further up
    assert got[5].n_bytes == len(LONG) + 4 and got[5].n_removed == len(LONG) + 1 and got[7].n_removed == got[7].n_bytes and got[6].n_removed == 0
    assert got[12].n_removed == 120 and got[11].n_removed == 0
    assert substrings.repeated_substrings(edge_docs.limit(0)).count() == 0


# sharding

def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_loop():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 3_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_sharding(spark, edge_docs, edge_rows):
    got = sharding.shard_documents(edge_docs, shards=3, bucket_rows=2).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in edge_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_documents(edge_docs.limit(0)).count() == 0
    many = sharding.with_shard(spark.range(20_000), "id", 8).groupBy("shard").count().collect()
    assert len(many) == 8 and all(2_200 < r["count"] < 2_800 for r in many)


# URLs

def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


@pytest.mark.parametrize("block_rules", [3, 200_000])
def test_url_rules(spark, block_rules):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/private"), ("allow", "a.example.net", "/en/private/x/"), ("block", "org", ""), ("allow", "org", "")]
    links = ["http://example.net/en/1", "HTTPS://WWW.Example.NET/en/private2?q=/en/", "https://a.example.net/en/private/x/y", "http://net", "http://net/", "x.net/en/", None, "", "http://b.org#frag",
             "http://anet/", "ftp://u@c.net:80/", "//net/", "http://é.net/é", "a://b://net/", "http://.net/", "http://x.net/\n/en", "http://x.net/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(links + links[-1:])], "page_id long, url string, host string, verdict string")
    got = urls.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), block_rules=block_rules)
    assert got.columns == ["page_id", "url", "host", "verdict", "host_", "path", "rule", "verdict_"]
    rows = got.collect()
    assert len(rows) == len(links) + 1
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].encode().translate(UPPER).decode(), m[2]) if m else ("", "")
        assert (r["host_"], r.path, r.rule, r["verdict_"]) == (host, path, *plain_rule(host, path, rules)), r.url
    none = urls.judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string")).collect()
    assert {r["verdict_"] for r in none} == {"allow"} and {r.rule for r in none} == {None}


# WARC

def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://h{k}/", t) for k, t in enumerate(["a", "b", "a", "", None, "é" * 10, "a", "x" * 300_000, "\r\n\r\nWARC/1.0\r\n"])] + [(2, "u\nv", "a"), (None, None, "b"), (None, "z", "only"), (None, "z", "only")]
    pages = spark.createDataFrame([(k, u, t, "x", "y") for k, u, t in rows], "page_id long, url string, html string, digest string, archive string").repartition(3)
    folder = str(tmp_path)
    records = warc.write_archives(pages, folder, archive_bytes=100_000)
    archives = warc.normalise(records, folder)
    got = warc.read_archives(archives, folder).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()) for k, _, t in rows)
    assert sorted((str(r.key), r.bytes, r.digest) for r in got) == want
    for digest in {r.digest for r in got}:
        group = [r for r in got if r.digest == digest]
        lead = [r for r in group if r.type == "response"]
        keys = [r.key for r in group if r.key is not None]
        assert len(lead) == 1 and lead[0].key == (min(keys) if keys else None)
        assert all(r.refers == lead[0].key for r in group if r.type == "revisit") and lead[0].refers is None
    small = {r.digest: 0 for r in got if r.bytes < 5}
    apart = warc.read_archives(warc.normalise(records, folder, revisit_bytes=5), folder).collect()
    assert all(r.type == "response" for r in apart if r.digest in small) and sum(r.type == "revisit" for r in apart) == 0
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0), folder), folder), folder).count() == 0


def test_damaged_streams_are_an_error():
    import gzip
    import io
    whole = gzip.compress(b"".join(warc.record({"WARC-Type": "response"}, [b"body"])))
    assert len(list(warc.split_records(warc.inflate(io.BytesIO(whole + whole))))) == 2
    for cut in (1, 4, 8, 20):
        with pytest.raises(ValueError, match="ends"):
            list(warc.split_records(warc.inflate(io.BytesIO(whole + whole[:-cut]))))


def test_archives_of_empty_pages_end(spark, tmp_path):
    pages = spark.createDataFrame([(k, None, None) for k in range(300)], "page_id long, url string, html string").coalesce(1)
    records = warc.write_archives(pages, str(tmp_path), archive_bytes=10_000)
    sizes = [r["count"] for r in records.groupBy("archive").count().collect()]
    assert max(sizes) < 60 and sum(sizes) == 300
    got = warc.read_archives(warc.normalise(records, str(tmp_path)), str(tmp_path)).collect()
    assert sorted(r.key for r in got) == list(range(300)) and {r.bytes for r in got} == {0} and sum(r.type == "response" for r in got) == 1


def test_a_mixture_has_one_target():
    for wrong in ({}, {"entropy": 0.5, "repeats": 2.0}):
        with pytest.raises(ValueError):
            mixing.Target(**wrong)


def test_warc_members_can_be_read_alone(spark, tmp_path):
    import gzip
    import json
    pages = spark.createDataFrame([(k, "u", f"payload {k}") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    archives = warc.normalise(warc.write_archives(pages, str(tmp_path)), str(tmp_path)).collect()
    (a,) = archives
    data = (tmp_path / "warc" / a.archive).read_bytes()
    index = [json.loads(x) for x in (tmp_path / "warc" / f"{a.archive}.idx").read_text().splitlines()]
    assert a["size"] == len(data) and len(index) == 5
    whole = gzip.decompress(data)
    assert b"".join(gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]) for e in index) == whole
    assert all(gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]).startswith(b"WARC/1.0\r\n") for e in index)

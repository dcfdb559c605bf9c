"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set are its distinct shingles of five words (after lower-casing A-Z; a shorter text is one shingle).
Equal sets collapse into a class first. Each class posts its 64 MinHash values under (coordinate, value). A value of
one class only can match nothing and goes. A pair above the match threshold agrees in `matches` of the 64 coordinates,
so it must meet in any 64 - matches + 1 of them: each class keeps only that many lists, the shortest first, and the
long lists are skipped. Classes that meet in a list form a family, found by linking each list's members to its smallest.
Inside a family collisions are counted on whole signatures, pairs above the threshold retained and confirmed on the
whole sets, so that no pair of rows is ever emitted; what leaves are the links of a spanning forest.

A family's sets fill one unit of work of about `unit_bytes`. A larger family is dealt into chunks: every chunk is
compared with itself and with the family's smallest member; chunks that hold members which did not end up
with that member are then compared with each other chunk as well.

The match threshold lies five standard deviations below the expected matches at the similarity limit: a pair exactly
at the limit is missed with a probability of about 2 in a million, a closer pair practically never.

Rows with the same doc_id count as one document. Texts without words (null and empty ones) and rows without a doc_id
are linked with nothing, stand for themselves and are kept.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, byte_codes, column, mix
from barloom.llm.components import connected_components
from barloom.session import cut_lineage

COORDINATES = 64
CODES = byte_codes(11)
FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
SHIFTS = mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))
BASE, INVERSE = 0x9E3779B97F4A7C15 | 3, pow(0x9E3779B97F4A7C15 | 3, -1, 1 << 64)
PIECE_WORDS = 1 << 16
POWERS = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next text."""
    have = POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 14), base, np.uint64)
        have[0] = 1
        have = POWERS[base] = np.cumprod(have)
    return have[:n]


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; long texts in overlapping pieces."""
    words = text.translate(LOWER).split()
    found = []
    for at in range(0, max(1, len(words) - width + 1), PIECE_WORDS):
        part = words[at:at + PIECE_WORDS + width - 1]
        if not part:
            break
        codes = np.frombuffer(b" ".join(part), np.uint8)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(CODES[codes] * powers(BASE, len(codes)), out=sums[1:])
        gaps = np.flatnonzero(codes == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(codes)]))
        n = min(width, len(part))
        starts, ends = starts[:len(starts) - n + 1], ends[n - 1:]
        found.append((sums[ends] - sums[starts]) * powers(INVERSE, len(codes) + 1)[starts])
    if not found:
        return np.zeros(0, np.uint64)
    h = np.sort(mix(np.concatenate(found)))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signature(h: np.ndarray) -> np.ndarray:
    """The smallest 64-bit value of each coordinate's hash over the shingles: equal ones come from equal shingles."""
    least = np.full(COORDINATES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 4096):
        values = np.multiply.outer(FACTORS, h[at:at + 4096]) + SHIFTS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least.view(np.int64)


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two sums of scrambled hashes."""
    return tuple(int(mix(h ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


DIGEST = "key bigint, n bigint, k1 bigint, k2 bigint, sig array<bigint>"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: key, size of its set, name of the set, signature (null for an empty set)."""
    for batch in batches:
        out = {"key": batch["key"], "n": [], "k1": [], "k2": [], "sig": []}
        for text in batch["text"].cast(pa.large_binary()):
            h = shingles(text.as_py() or b"")
            k1, k2 = set_key(h) if len(h) else (None, None)
            for c, v in zip(("n", "k1", "k2", "sig"), (len(h), k1, k2, signature(h) if len(h) else None)):
                out[c].append(v)
        types = {"n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "sig": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([out[c] if c == "key" else pa.array(out[c], types[c]) for c in out], list(out))


def confirm(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], matches: int, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members' similarity graph.

    Walks each component from its smallest member; a member is compared with the members not reached so far: first by
    counted signature collisions, then by exact set sizes. `side`, when it has two values, admits pairs across them only.
    """
    order = np.argsort(ids, kind="stable")
    ids, side, sets = ids[order], side[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    local = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    sigs = np.stack([signature(s) for s in sets])
    mark = np.zeros(int(local.max()) + 1, bool)
    across = len(np.unique(side)) > 1
    left = np.arange(len(ids))
    links = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = (sigs[left] == sigs[x]).sum(axis=1) >= matches
            if across:
                close &= side[left] != side[x]
            near = left[close]
            if not len(near):
                continue
            mine = local[ends[x] - sizes[x]:ends[x]]
            mark[mine] = True
            common = np.array([np.count_nonzero(mark[local[ends[y] - sizes[y]:ends[y]]]) for y in near])
            mark[mine] = False
            linked = near[100 * common >= percent * (sizes[near] + sizes[x] - common)]
            if len(linked):
                links += [(int(ids[x]), int(ids[y])) for y in linked]
                queue += list(linked)
                left = left[~np.isin(left, linked)]
    return links


def unit_links(matches: int, percent: int):
    """A function for one unit of work: texts of one or more families to links of their forests."""
    def link(group: pa.Table) -> pa.Table:
        families, a, b = {}, [], []
        for fam, part, key, k1, k2, text in zip(*(group[c].to_pylist() for c in ("family", "part", "key", "k1", "k2")), group["text"].cast(pa.large_binary()).to_pylist()):
            held = families.setdefault(fam, {})
            if (key, part) not in held:
                h = shingles(text or b"")
                if set_key(h) == (k1, k2):   # another text under the same doc_id has another name
                    held[key, part] = h
        for held in families.values():
            if len(held) > 1:
                for x, y in confirm(np.array([k for k, _ in held]), np.array([p for _, p in held]), list(held.values()), matches, percent):
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def least_matches(percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - 5 * math.sqrt(COORDINATES * p * (1 - p))))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85, unit_bytes: int = 16 << 20) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable over links) and kept (it is the key itself) of each row.

    Documents whose sets share `percent` of their union are linked. `key` is a whole number.
    """
    matches = least_matches(percent)
    rows = docs.select(column(key).cast("long").alias("key"), column(text).alias("text"))
    digests = cut_lineage(rows.mapInArrow(digest, DIGEST))
    classes = cut_lineage(digests.filter("n > 0 AND key IS NOT NULL").groupBy("k1", "k2").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.any_value("sig").alias("sig")))

    posts = classes.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", F.shiftleft(F.col("at").cast("long"), 58).bitwiseXOR(F.col("value")).alias("post"))   # a minimum's top bits are mostly free
    lengths = posts.groupBy("post").agg(F.count("*").alias("length")).filter("length > 1")
    ranked = (posts.join(lengths.hint("merge"), "post").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("length", "post"))).alias("lists"))   # at most 64
              .filter(F.size("lists") >= matches).select("rep", F.explode(F.slice("lists", F.lit(1), F.size("lists") - matches + 1)).alias("l")))
    prefix = cut_lineage(ranked.select("rep", "l.post"))
    heads = prefix.groupBy("post").agg(F.min("rep").alias("head"), F.count("*").alias("length")).filter("length > 1")
    families = connected_components(prefix.join(heads, "post").select(F.col("rep").alias("a"), F.col("head").alias("b")))

    members = families.join(classes.select(F.col("rep").alias("node"), "n", "k1", "k2"), "node").select(
        F.col("node").alias("key"), F.col("component").alias("family"), (8 * F.col("n")).alias("bytes"), "k1", "k2")
    sizes = members.groupBy("family").agg(F.sum("bytes").alias("total")).select("family", F.ceil(F.col("total") / unit_bytes).alias("chunks"))
    members = cut_lineage(members.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks"))))
    total, most = members.agg(F.sum("bytes"), F.max("chunks")).first()
    units = max(1, -(-(total or 0) // unit_bytes))
    held = rows.join(members.hint("merge"), "key")   # members grow with the documents: no broadcast at any size
    if (most or 1) > 1:
        held = cut_lineage(held)
    small = held.filter("chunks = 1").select("*", F.pmod(F.xxhash64("family"), F.lit(units)).cast("string").alias("unit"))
    run = unit_links(matches, percent)
    columns = ("unit", "family", F.lit(0).alias("part"), "key", "k1", "k2", "text")

    def linked(units: DataFrame) -> DataFrame:
        return units.groupBy("unit").applyInArrow(run, "a bigint, b bigint")

    links = linked(small.select(*columns))
    if (most or 1) > 1:
        links = links.union(large_families(held.filter("chunks > 1"), linked, columns))
    components = connected_components(links)

    named = classes.select("k1", "k2", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    whole = digests.select("key", "n", "k1", "k2", F.col("key").isNull().alias("lone"))
    out = whole.join(named, ["k1", "k2"], "left").select("key", F.col("n").alias("n_shingles"), F.when(F.col("lone"), F.lit(None)).otherwise(F.coalesce("component", "key")).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def large_families(held: DataFrame, linked, columns: tuple) -> DataFrame:
    """Links inside the families that fill more than one unit: first each chunk with the family's head, then chunk by
    chunk where members are left that the head's component does not hold."""
    heads = held.filter("key = family").select(*[F.col(c).alias(f"head_{c}") for c in ("key", "k1", "k2", "text")])
    chunks = held.select("family", "chunk").distinct()
    guests = heads.join(chunks, F.col("head_key") == F.col("family")).select(
        "family", "chunk", F.col("head_key").alias("key"), F.col("head_k1").alias("k1"), F.col("head_k2").alias("k2"), F.col("head_text").alias("text"))
    own = held.select("family", "chunk", "key", "k1", "k2", "text").union(guests)
    first = cut_lineage(linked(own.withColumn("unit", F.concat_ws(":", "family", "chunk")).select(*columns)))
    settled = connected_components(first).withColumnRenamed("node", "key")
    open_chunks = (held.select("family", "chunk", "key").join(settled, "key", "left").filter(~F.col("component").eqNullSafe(F.col("family")))
                   .select("family", F.col("chunk").alias("open")).distinct())
    pairs = open_chunks.join(chunks, "family").filter("open <> chunk").select("family", F.least("open", "chunk").alias("i"), F.greatest("open", "chunk").alias("j")).distinct()
    sides = pairs.select("family", "i", "j", F.explode(F.array("i", "j")).alias("chunk"))
    both = held.select("family", "chunk", "key", "k1", "k2", "text").join(sides, ["family", "chunk"])
    wide = (*columns[:2], F.col("chunk").alias("part"), *columns[3:])
    return first.union(linked(both.withColumn("unit", F.concat_ws(":", "family", "i", "j")).select(*wide)))

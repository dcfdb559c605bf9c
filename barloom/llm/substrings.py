"""Exact repeats of long substrings across documents, by prefix doubling over ranks of positions.

A string of `length` bytes is removed wherever it also starts in a document with a smaller key; what is removed is judged
on the input. Positions are ranked by the strings that start there, first short ones, then, by pairs of ranks at growing
offsets, twice as long ones until `length`; a position whose rank no other document shares drops out on the way.

Not every position takes part from the start. In every window of `length` bytes the short string with the smallest hash
is its anchor; equal windows have equal anchors, so the first round ranks anchors only, about one in thirteen
positions, and only windows with a shared anchor go on to the doubling.

Documents are dealt into blocks of about `block_bytes`. In each round a block sends its distinct ranks, sorted, to the
range they hash to (Spark's shuffle), the range merges the blocks' lists and sends back one bit per rank. There are as
many ranges as blocks, so very large inputs want larger blocks, as memory allows. A string
that stands in very many documents is thus sent once per block and no task gathers its occurrences. Whole copies are
settled before by a digest of the text. Ranks are 64-bit names and ranges are chosen by an independent hash, so that
two strings are confused only if both agree.

Nulls are empty texts; texts shorter than `length` lose nothing. Rows with a null key neither lose bytes nor make others
lose any; equal keys are not smaller than each other. Long texts are worked on in overlapping pieces.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import byte_codes, column, mix, runs
from barloom.session import cut_lineage

CODES = byte_codes(23)
STEP = 0x9E3779B97F4A7C15 | 3
FIRSTS, ASK, MEMO, ANSWER = range(4)
LETTER = "dest bigint, block bigint, kind int, n int, a binary, b binary"
SCHEMA = pa.schema([("dest", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
PIECE = 1 << 18
SHORT = np.uint64(24)   # bits that the letters of a pruning round leave out: a rank taken for shared by chance only costs work


def lengths_to(length: int, least: int = 24) -> list[int]:
    """Lengths of the rounds: halves of `length`, rounded up, as long as they reach `least`; the last is `length`."""
    steps = [length]
    while (steps[0] + 1) // 2 >= least:
        steps.insert(0, (steps[0] + 1) // 2)
    return steps if len(steps) > 1 else [max(1, (length + 1) // 2), length]


def names(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit name of the n bytes from each place, by the binary digits of n."""
    have, h, factor, done, size = codes, np.zeros(len(codes) + 1, np.uint64), STEP, 0, 1
    while size <= n:
        if n & size:
            m = len(codes) - done - size + 1
            h = h[:m] * np.uint64(factor) + have[done:done + m]
            done += size
        if size * 2 <= n:
            have = have[:len(have) - size] * np.uint64(factor) + have[size:]
        factor, size = factor * factor % (1 << 64), size * 2
    return mix(h)


def doubled(short: np.ndarray, offset: int) -> np.ndarray:
    """Rank of the longer string from each place: the pair of ranks here and `offset` further on."""
    m = max(0, len(short) - offset)
    return mix(short[:m] * np.uint64(0xD6E8FEB86659FD93) + (short[offset:offset + m] ^ np.uint64(0xA0761D6478BD642F)))


def pack(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed; planes of equal bytes cost nothing."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int, kind=np.uint64) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def range_of(ranks: np.ndarray, ranges: int) -> np.ndarray:
    """The range a rank is sent to, by another hash than the one that made it."""
    return ((mix(ranks ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)


def lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have, size = h, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have


class Block:
    """The documents of one block that are the first of their text, by key."""

    def __init__(self, docs: pa.Table, letters: pa.Table, length: int):
        kinds = letters["kind"].to_numpy(zero_copy_only=False)
        first = {k for i in np.flatnonzero(kinds == FIRSTS) for k in np.frombuffer(letters["a"][int(i)].as_py(), np.int64).tolist()}
        held = {(k, pa.decompress(z, n, codec="zstd", asbytes=True) if n else b"") for k, n, z in zip(*(docs[c].to_pylist() for c in ("key", "n", "packed"))) if k in first}
        rows = sorted(held)
        self.keys, self.texts, self.length = np.array([k for k, _ in rows], np.int64), [t for _, t in rows], length
        self.memo = next((np.frombuffer(letters["a"][int(i)].as_py(), np.int64).reshape(3, -1) for i in np.flatnonzero(kinds == MEMO)), None)
        self.answers = {int(letters["dest"][int(i)].as_py()): np.unpackbits(np.frombuffer(letters["a"][int(i)].as_py(), np.uint8)).view(bool) for i in np.flatnonzero(kinds == ANSWER)}

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, document, place, valid) of batches of joined texts: valid where a whole window starts."""
        batch, size = [], 0
        spans = [(d, at, t) for d, t in enumerate(self.texts) for at in range(0, len(t) - self.length + 1, PIECE)]
        for i, (d, at, t) in enumerate(spans):
            part = np.frombuffer(t, np.uint8)[at:at + PIECE + self.length - 1]
            batch.append((d, at, part))
            size += len(part)
            if size >= PIECE or i == len(spans) - 1:
                lens = np.array([len(p) for *_, p in batch])
                start = np.cumsum(lens) - lens
                inside = np.arange(size) - np.repeat(start, lens)
                yield (CODES[np.concatenate([p for *_, p in batch])], np.repeat([d for d, *_ in batch], lens), inside + np.repeat([a for _, a, _ in batch], lens),
                       inside + self.length <= np.repeat(lens, lens))
                batch, size = [], 0

    def anchors(self, short: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rank of the anchor, document, first, last place) of runs of windows with one anchor."""
        for codes, doc, place, valid in self.segments():
            m = lowest(names(codes, short), self.length - short + 1)
            valid = valid[:len(m)]
            cut = np.ones(len(m), bool)
            cut[1:] = (m[1:] != m[:-1]) | (doc[1:len(m)] != doc[:len(m) - 1]) | (valid[1:] != valid[:-1]) | (place[1:len(m)] != place[:len(m) - 1] + 1)
            begin = np.flatnonzero(cut)
            end = np.append(begin[1:], len(m)) - 1
            ok = valid[begin]
            yield m[begin[ok]], doc[begin[ok]], place[begin[ok]], place[end[ok]]

    def ranked(self, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank, document, place) at the last of `lengths`, for the places of the memo."""
        out = []
        docs, starts, stops = self.memo
        for d, s, e in zip(docs.tolist(), starts.tolist(), stops.tolist()):
            for at in range(s, e + 1, PIECE):
                upto = min(e, at + PIECE - 1)
                ranks = names(CODES[np.frombuffer(self.texts[d], np.uint8)[at:upto + self.length]], lengths[0])
                for shorter, longer in zip(lengths, lengths[1:]):
                    ranks = doubled(ranks, longer - shorter)
                n = upto - at + 1
                out.append((ranks[:n], np.full(n, d, np.int32), np.arange(at, upto + 1, dtype=np.int32)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))


class Ranks:
    """Distinct ranks of a block by range, each with the smallest and largest key that has it."""

    def __init__(self, ranks: np.ndarray, docs: np.ndarray, keys: np.ndarray, ranges: int):
        order = np.argsort(ranks, kind="stable")
        to = range_of(ranks, ranges)
        order = order[np.argsort(to[order], kind="stable")]   # by range, then rank, then document
        self.order, self.ranks, to = order, ranks[order], to[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.ranks[1:] != self.ranks[:-1]) | (to[1:] != to[:-1])
        self.group = np.cumsum(new, dtype=np.int32) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(order))[:len(begin)] - 1
        owner = keys[docs[order]] if len(order) else np.zeros(0, np.int64)
        self.begin, self.to, self.low, self.high = begin, to[begin], owner[begin], owner[end]

    def letters(self, block: int, last: bool) -> dict:
        """One letter per range: the ranks, and whether several documents have them (or, in the last round, the smallest key)."""
        out = {c: [] for c in SCHEMA.names}
        edges = np.flatnonzero(np.diff(self.to, prepend=-1))
        for s, e in zip(edges, np.append(edges[1:], len(self.to))):
            extra = pack(self.low[s:e]) if last else np.packbits(self.low[s:e] != self.high[s:e]).tobytes()
            ranks = self.ranks[self.begin[s:e]]
            ranks = ranks if last else ranks >> SHORT
            for c, v in zip(out, (int(self.to[s]), block, ASK, int(e - s), pack(np.diff(ranks, prepend=np.uint64(0))), extra)):
                out[c].append(v)
        return out

    def bits(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """The answered bit of each rank, in this order."""
        got = np.zeros(len(self.to), bool)
        edges = np.flatnonzero(np.diff(self.to, prepend=-1))
        for s, e in zip(edges, np.append(edges[1:], len(self.to))):
            got[s:e] = answers[int(self.to[s])][:e - s]
        return got


def post(letters: dict) -> pa.Table:
    return pa.table({f.name: pa.array(letters[f.name], f.type) for f in SCHEMA})


def ask_anchors(length: int, lengths: list[int], ranges: int):
    def run(key: tuple, docs: pa.Table, letters: pa.Table) -> pa.Table:
        block = Block(docs, letters, length)
        parts = [(r, d) for r, d, *_ in block.anchors(lengths[0])]
        ranks, owner = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return post(Ranks(ranks, owner, block.keys, ranges).letters(key[0].as_py(), False))

    return run


def ask_longer(length: int, lengths: list[int], level: int, ranges: int):
    """Round `level`: drop what the round before left unshared, rank the rest at twice the length, keep its places as a memo."""
    last = level == len(lengths) - 1

    def run(key: tuple, docs: pa.Table, letters: pa.Table) -> pa.Table:
        block = Block(docs, letters, length)
        if level == 1:
            parts = list(block.anchors(lengths[0]))
            ranks, owner, first, final = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 4
            owner = owner.astype(np.int64)
            table = Ranks(ranks, owner, block.keys, ranges)
            good = np.zeros(len(ranks), bool)
            good[table.order] = table.bits(block.answers)[table.group] if len(ranks) else False
            memo = np.stack([owner[good], first[good].astype(np.int64), final[good].astype(np.int64)])
            join = np.flatnonzero(np.append(True, (memo[0, 1:] != memo[0, :-1]) | (memo[1, 1:] != memo[2, :-1] + 1))) if memo.shape[1] else np.zeros(0, np.int64)
            block.memo = np.stack([memo[0, join], memo[1, join], memo[2, np.append(join[1:], memo.shape[1]) - 1]]) if len(join) else memo
        else:
            ranks, owner, place = block.ranked(lengths[:level])
            table = Ranks(ranks, owner, block.keys, ranges)
            good = np.zeros(len(ranks), bool)
            good[table.order] = table.bits(block.answers)[table.group] if len(ranks) else False
            owner, place = owner[good], place[good]
            cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))) if len(owner) else np.zeros(0, np.int64)
            block.memo = np.stack([owner[cut], place[cut], place[np.append(cut[1:], len(owner)) - 1]]) if len(cut) else np.zeros((3, 0), np.int64)
        out = Ranks(*block.ranked(lengths[:level + 1])[:2], block.keys, ranges).letters(key[0].as_py(), last)
        for c, v in zip(out, (key[0].as_py() % ranges, key[0].as_py(), MEMO, block.memo.shape[1], block.memo.astype(np.int64).tobytes(), b"")):
            out[c].append(v)
        return post(out)

    return run


def answer(last: bool):
    """Merge the lists of one range: is a rank shared by documents, or, in the last round, is there a smaller key elsewhere?"""
    def run(letters: pa.Table) -> pa.Table:
        kinds = letters["kind"].to_numpy()
        asks = np.flatnonzero(kinds == ASK)
        out = {c: [] for c in SCHEMA.names}
        for i in np.flatnonzero(kinds == MEMO):
            for c in out:
                out[c].append(letters[c][int(i)].as_py())
        sizes = letters["n"].to_numpy()
        lists = [np.cumsum(unpack(letters["a"][int(i)].as_py(), int(sizes[i])), dtype=np.uint64) for i in asks]
        if lists:
            ranks, ends = np.concatenate(lists), np.cumsum([len(x) for x in lists])
            order = np.argsort(ranks, kind="stable")
            begin = np.flatnonzero(np.append(True, ranks[order][1:] != ranks[order][:-1]))
            count = np.diff(np.append(begin, len(ranks)))
            extra = [letters["b"][int(i)].as_py() for i in asks]
            if last:
                low = np.concatenate([unpack(x, len(r), np.int64) for x, r in zip(extra, lists)])
                bit = np.empty(len(ranks), bool)
                bit[order] = np.repeat(np.minimum.reduceat(low[order], begin), count) < low[order]
            else:
                several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:len(r)] for x, r in zip(extra, lists)])
                bit = np.empty(len(ranks), bool)
                bit[order] = np.repeat((count > 1) | (np.add.reduceat(several[order].astype(np.int64), begin) > 0), count)
            for i, s, e in zip(asks, ends - [len(x) for x in lists], ends):
                for c, v in zip(out, (letters["dest"][int(i)].as_py(), letters["block"][int(i)].as_py(), ANSWER, int(e - s), np.packbits(bit[s:e]).tobytes(), b"")):
                    out[c].append(v)
        return post(out)

    return run


RESULT = "key bigint, sha string, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>"


def cover(length: int, lengths: list[int], ranges: int):
    """Removed runs of each document, from the answers of the last round."""
    def run(key: tuple, docs: pa.Table, letters: pa.Table) -> pa.Table:
        block = Block(docs, letters, length)
        hits: dict[int, np.ndarray] = {}
        if block.memo is not None and block.memo.shape[1]:
            ranks, owner, place = block.ranked(lengths)
            table = Ranks(ranks, owner, block.keys, ranges)
            earlier = table.bits(block.answers)[table.group] | (block.keys[owner[table.order]] > table.low[table.group])
            hit = np.zeros(len(ranks), bool)
            hit[table.order] = earlier
            owner, place = owner[hit], place[hit]
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            hits = {int(owner[s]): place[s:e] for s, e in zip(cut, np.append(cut[1:], len(owner)))}
        rows = []
        for d, (k, text) in enumerate(zip(block.keys.tolist(), block.texts)):
            starts = ends = np.zeros(0, np.int64)
            kept = text
            if d in hits:
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, hits[d], 1)
                np.add.at(edge, hits[d] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts, ends = runs(gone)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((k, hashlib.sha256(text).hexdigest(), int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), ends.tolist()))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        cols = zip(*rows) if rows else [[]] * 7
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=["key", "sha", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    return run


def repeated_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, and starts and ends of the removed byte runs."""
    body = F.encode(F.coalesce(column(text), F.lit("")), "utf-8")
    rows = docs.select(column(key).cast("long").alias("key"), body.alias("text"))
    digests = cut_lineage(rows.select("key", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    firsts = cut_lineage(digests.filter("key IS NOT NULL").groupBy("sha").agg(F.min("key").alias("first"), F.max("n_bytes").alias("n")))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    lengths = lengths_to(length)

    def block_of(k: str):
        return F.pmod(F.xxhash64(k), F.lit(blocks))

    def squeeze(bodies: pa.Array) -> pa.Array:
        return pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in bodies.to_pylist()], pa.binary())

    # The texts are shuffled once, compressed; all rounds reuse that exchange.
    texts = rows.filter("key IS NOT NULL").select(block_of("key").alias("block"), "key", F.octet_length("text").alias("n"), F.arrow_udf(squeeze, "binary")("text").alias("packed")).repartition(blocks, "block")
    packed = firsts.filter(F.col("n") >= 0).select(block_of("first").alias("block"), "first").groupBy("block").agg(F.collect_list("first").alias("keys"))   # bounded by the block

    def joined(keys: pa.Array) -> pa.Array:
        return pa.array([np.asarray(k, np.int64).tobytes() for k in keys.to_pylist()], pa.binary())

    heads = packed.select(F.lit(-1).cast("long").alias("dest"), "block", F.lit(FIRSTS).alias("kind"), F.size("keys").alias("n"), F.arrow_udf(joined, "binary")("keys").alias("a"), F.lit(b"").alias("b"))

    def per_block(letters: DataFrame, run, schema: str) -> DataFrame:
        return texts.groupBy("block").cogroup(letters.groupBy("block")).applyInArrow(run, schema)

    def answered(asked: DataFrame, last: bool) -> DataFrame:
        return heads.union(asked.groupBy("dest").applyInArrow(answer(last), LETTER))

    letters = answered(per_block(heads, ask_anchors(length, lengths, blocks), LETTER), False)
    for level in range(1, len(lengths)):
        letters = answered(per_block(letters, ask_longer(length, lengths, level, blocks), LETTER), level == len(lengths) - 1)
    found = per_block(letters, cover(length, lengths, blocks), RESULT)
    chosen = found.join(firsts.select(F.col("sha").alias("of"), F.col("first")), (F.col("sha") == F.col("of")) & (F.col("key") == F.col("first"))).drop("key", "of")
    out = digests.join(chosen, "sha", "left")
    own, whole = F.col("key") == F.col("first"), (F.col("key") > F.col("first")) & (F.col("n_bytes") >= length)
    no, nothing = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    return out.select(
        F.col("key").alias(key), "n_bytes",
        F.when(own, F.col("n_removed")).when(whole, F.col("n_bytes")).otherwise(no).alias("n_removed"),
        F.when(own, F.col("n_spans")).when(whole, no + 1).otherwise(no).alias("n_spans"),
        F.when(own, F.col("kept_sha256")).when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(own, F.col("starts")).when(whole, F.array(no)).otherwise(nothing).alias("starts"),
        F.when(own, F.col("ends")).when(whole, F.array("n_bytes")).otherwise(nothing).alias("ends"))

"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, looked up in every document.

Words are runs of letters and digits after lower-casing A-Z; every byte outside ASCII is a letter. A window is `width`
consecutive words of an item; an item with fewer words, but not none, is one window. Windows of a document are hashed
by word numbers, hits are verified word by word, and the covered words, or the documents, can be removed.

Nulls and texts without words have no windows and are never hit. A null item_id is listed as an empty string, repeated
items count once, an empty benchmark hits nothing.
"""
from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, free_name, mix, octets, runs
from barloom.session import cut_lineage

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Every byte to what a word is made of: A-Z to a-z, digits, a-z and bytes above ASCII to themselves, the rest to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)
HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
HITS_TYPE = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


class WindowSet:
    """Windows of some benchmark items: their hashes per length, and which items hold each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.holders: dict[bytes, set[str]] = {}
        lengths: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            words = text.encode().translate(FOLD).split()
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.uint32)
            n = min(width, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                self.holders.setdefault(ids[at:at + n].tobytes(), set()).add(item)
            if n:
                lengths.setdefault(n, []).append(self.hashes(ids, n))
        self.known = {n: np.unique(np.concatenate(h)) for n, h in lengths.items()}

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        codes = mix(ids.astype(np.uint64) * STEP)
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = h * STEP + codes[k:len(ids) - n + 1 + k]
        return h

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items that hit them."""
        words = text.translate(FOLD).split()
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.uint32, len(words))
        foreign = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, known in self.known.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(foreign[n:] == foreign[:-n])   # windows made of benchmark words only
            if not len(at):
                continue
            h = self.hashes(ids, n)[at]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for start in at[known[place] == h]:
                holders = self.holders.get(ids[start:start + n].tobytes())
                if holders:
                    hit[start:start + n] = True
                    items |= holders
        return len(words), hit, items


def scanner(windows):
    """A column function that scans texts with a broadcast window set and adds to the hits found before."""
    def look(texts: pa.Array, before: pa.Array) -> pa.Array:
        rows = []
        for t, b in zip(octets(texts), before.to_pylist()):
            n, hit, found = windows.value.scan(t)
            for s in b["spans"] if b else ():
                hit[s["start"]:s["end"]] = True
            rows.append({"n_words": n, "spans": [{"start": int(s), "end": int(e)} for s, e in zip(*runs(hit))], "items": sorted(found.union(b["items"] if b else ()))})
        return pa.array(rows, HITS)

    return F.arrow_udf(look, HITS_TYPE)


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", item: str = "item_id", item_text: str = "text",
                   width: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """`docs` with a struct column `out`: n_words, spans of hit words (start, end exclusive) and the items found.

    A benchmark of at most `block_words` words is one broadcast set. A larger one is split by item into blocks of about
    that size; each block scans all documents in a pass of its own and hits add up. No shuffle of documents.
    """
    items = benchmark.select(F.coalesce(column(item).cast("string"), F.lit("")).alias("item"), column(item_text).alias("t")).filter("t IS NOT NULL").distinct()
    n_words = items.agg(F.sum(F.size(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-n_words // block_words))
    result = docs.withColumn(out, F.lit(None).cast(HITS_TYPE))
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        windows = docs.sparkSession.sparkContext.broadcast(WindowSet(sorted(tuple(r) for r in mine.collect()), width))
        result = result.withColumn(out, scanner(windows)(column(text), column(out)))
        if blocks > 1:
            result = cut_lineage(result)
    return result


def cut_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at:places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join(kept) + text[at:]


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """`docs` with hit words cut out of the texts; columns as before."""
    hits = free_name(docs, "_hits")

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_spans(t.encode(), f["spans"]).decode() for t, f in zip(texts.to_pylist(), found.to_pylist())], pa.string())

    marked = scan_documents(docs, benchmark, text, hits, **how)
    return marked.withColumn(text, F.arrow_udf(cut, "string")(column(text), column(hits))).drop(hits)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """`docs` without the documents in which any window occurs."""
    hits = free_name(docs, "_hits")
    marked = scan_documents(docs, benchmark, text, hits, **how)
    return marked.filter(F.size(column(hits)["spans"]) == 0).select(*[column(c) for c in docs.columns])

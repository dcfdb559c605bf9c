"""URL filter: a trie over reversed host labels, then path segments, where the longest rule decides.

A rule is (verdict, host, path). It fits a URL when the URL's host is the rule's host or a subdomain of it
and the URL's path starts with the rule's path. Of several fitting rules the one with most characters in
host and path wins; of equally long ones the one with the longer host, and of two entries for the same
place the block.

Nulls and URLs without "://" have an empty host and path, fit no rule with a host, and get the default verdict.
An empty rule table gives every URL the default. Repeated rows are judged one by one.
"""
from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, free_name
from barloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
BEST = pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("length", pa.int32()), ("host_length", pa.int32())])
BEST_TYPE = "struct<rule:string,verdict:string,length:int,host_length:int>"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


class UrlTrie:
    """Hosts by label from the right; below each host its paths by segment. A path that ends inside a segment
    hangs as a partial segment at the node before it."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed((host or "").translate(str.maketrans(UPPER, LOWER)).split(".")) if host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, rest = (path or "").split("/")
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            held = node.setdefault("rules", {})
            if held.get(rest, (None, "allow"))[1] != "block":
                held[rest] = ((host or "") + (path or ""), verdict, len((host or "") + (path or "")), len(host or ""))

    def match(self, host: str, path: str) -> tuple | None:
        best, node = None, self.root
        segments = path.split("/")
        for label in (None, *(reversed(host.split(".")) if host else ())):
            if label is not None:
                node = node.get("hosts", {}).get(label)
                if node is None:
                    break
            at = node.get("paths")
            for segment in segments if at else ():
                for part, entry in at.get("rules", {}).items():
                    if segment.startswith(part) and (best is None or entry[2:] > best[2:]):
                        best = entry
                at = at.get("next", {}).get(segment)
                if at is None:
                    break
        return best


def matcher(trie):
    """A column function that looks host and path up in a broadcast trie."""
    def lookup(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = (trie.value.match(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist()))
        return pa.array([dict(zip(("rule", "verdict", "length", "host_length"), b)) if b else None for b in found], BEST)

    return F.arrow_udf(lookup, BEST_TYPE)


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", block_rules: int = 200_000) -> DataFrame:
    """All columns of `df` plus `host`, `path`, `rule` and `verdict` (underscores are added to taken names).

    `rules` has the columns verdict, host, path. At most `block_rules` of them are broadcast as one trie; a longer
    list is split by a hash of the host into blocks of about that size, each block judges all rows in a pass of
    its own, and the best entry so far travels with the row.
    """
    rules = rules.select("verdict", "host", "path").distinct()
    blocks = max(1, -(-rules.count() // block_rules))
    names = {n: free_name(df, n) for n in ("host", "path", "rule", "verdict")}
    best = free_name(df, "_best")
    out = df.withColumn(names["host"], host_of(column(url))).withColumn(names["path"], path_of(column(url)))
    out = out.withColumn(best, F.lit(None).cast(BEST_TYPE))
    for k in range(blocks):
        mine = rules.filter(F.pmod(F.xxhash64("host"), F.lit(blocks)) == k) if blocks > 1 else rules
        trie = df.sparkSession.sparkContext.broadcast(UrlTrie(tuple(r) for r in mine.collect()))
        new = matcher(trie)(column(names["host"]), column(names["path"]))
        if blocks == 1:
            out = out.withColumn(best, new)
        else:
            fresh = free_name(out, "_new")
            out = out.withColumn(fresh, new)
            rank = [F.struct(F.coalesce(column(c)["length"], F.lit(-1)), F.coalesce(column(c)["host_length"], F.lit(-1))) for c in (best, fresh)]
            out = cut_lineage(out.withColumn(best, F.when(rank[1] > rank[0], column(fresh)).otherwise(column(best))).drop(fresh))
    return (out.withColumn(names["rule"], column(best)["rule"])
            .withColumn(names["verdict"], F.coalesce(column(best)["verdict"], F.lit(default))).drop(best))

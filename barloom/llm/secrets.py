"""Secret scans with corpus-wide ownership frequency.

Candidates are found row by row; each candidate's hashed value is then counted over the whole corpus by distinct
repositories and owners. A value that many owners hold is a copied example; one that few hold and that looks random
is a live-looking credential of its owner. Values leave the scan only as hashes.

The corpus tables name no repository, so `repository` is a column that divides an owner's documents (the language, in the
registered query). A private key counts by its body up to the END line.

Nulls and empty texts have no candidates. Texts of any length are scanned whole, and an empty table gives none. Other columns
of `docs` are not read. Repeated rows are separate rows of one owner. A null owner or repository
counts as one owner or repository of its own.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column
from barloom.session import cut_lineage

# Kinds in their order; pattern, the group that holds the value, its least length, and text that must occur.
KINDS = ("assign", "access", "hex", "pem", "jwt", "github", "slack")
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8, ("passw", "secret", "token", "api")),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16, ("AKIA",)),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32, ()),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:([A-Za-z0-9+/=:,\x20\x09-\x0D]+)-----END [A-Z ]*PRIVATE KEY-----)?"), 1, 0, ("PRIVATE KEY-----",)),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 1, ("eyJ",)),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1, ("xox",)),
}
BASE = ("assign", "access", "hex")
HEADER = "-----BEGIN PRIVATE KEY-----"   # stands for every private key without a body
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])
SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,value:string,random:boolean>>"


def looks_random(value: str, least_bits: float = 3.0) -> bool:
    """Long enough and of high enough entropy per character to be a generated credential."""
    n = len(value)
    return n >= 16 and sum(-c / n * math.log2(c / n) for c in Counter(value).values()) >= least_bits


def find_secrets(text: str | None) -> list[tuple]:
    """(kind, start, end, hashed value, looks random) by start, then kind; leftmost and non-overlapping per kind."""
    text = text or ""
    lower = text.lower()
    found = []
    for k, kind in enumerate(KINDS):
        pattern, group, least, needs = PATTERNS[kind]
        if needs and not any(n in (lower if kind == "assign" else text) for n in needs):
            continue
        for m in pattern.finditer(text):
            # A private key is its body, however it is wrapped; a header without one is the same placeholder everywhere.
            value = m[group] if kind != "pem" else "".join((m[1] or "").split()) or HEADER
            if len(value) >= least:
                found.append((m.start(), k, m.end(), hashlib.sha256(value.encode()).hexdigest(), value != HEADER and looks_random(value)))
    return [(KINDS[k], s, e, v, r) for s, k, e, v, r in sorted(found)]


def scan(texts: pa.Array) -> pa.Array:
    names = SPAN.names
    return pa.array([[dict(zip(names, f)) for f in find_secrets(t)] for t in texts.to_pylist()], pa.list_(SPAN))


def secret_report(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "lang", copied_owners: int = 3) -> DataFrame:
    """Per row: key, found (the candidates), n_copied and n_live (its distinct values of either class).

    A repository is named by owner and `repository` together. A value with at least `copied_owners` owners is copied;
    another one is live-looking if it looks random. The texts are read once and not shuffled; what is shuffled are
    hashed values, each owner and repository once per value and task.
    """
    found = cut_lineage(docs.select(column(key).alias("key"), column(owner).cast("string").alias("owner"), column(repository).cast("string").alias("repository"),
                                    F.arrow_udf(scan, SPAN_TYPE)(column(text)).alias("found"))
                        .withColumn("row", F.monotonically_increasing_id()))
    values = (found.filter(F.size("found") > 0)
              .select("row", "owner", "repository", F.explode(F.array_distinct(F.transform("found", lambda f: F.struct(f["value"].alias("value"), f["random"].alias("random"))))).alias("f"))
              .select("row", "owner", "repository", "f.value", "f.random"))
    by_owner = values.groupBy("value", "owner", "repository").agg(F.count("*").alias("rows")).groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("rows").alias("rows"))
    spread = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("rows").alias("n_rows"))
    per_row = (values.join(spread, "value").groupBy("row")
               .agg(F.sum((F.col("n_owners") >= copied_owners).cast("long")).alias("n_copied"),
                    F.sum(((F.col("n_owners") < copied_owners) & F.col("random")).cast("long")).alias("n_live"),
                    F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories")))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_copied", "n_live", "most_owners", "most_repositories")}
    return found.join(per_row, "row", "left").select(F.col("key").alias(key), "found", *[v.alias(c) for c, v in zero.items()])

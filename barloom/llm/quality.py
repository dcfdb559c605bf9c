"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. The ledger keeps, per document, the measurements and one long whose bit k says
that rule k failed. A policy is a named version: a mask of rules and how many of them a document may fail.
Policies are applied, compared and ablated on the bits alone, without reading a text again.

Nulls and empty texts have no words and fail the rules on length. Repeated rows are measured one by one.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, column, free_name, octets

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MEASURE_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside any three-word window that occurs at least twice, its first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, place, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    """The numbers of MEASURES for one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(text.translate(None, SPACE).decode()), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def measure(texts: pa.Array) -> pa.Array:
    rows = np.array([measure_text(t) for t in octets(texts)], np.int64).reshape(len(texts), len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], list(MEASURES))


@dataclass(frozen=True)
class Rule:
    """Bit `bit` is set where `fails`, a SQL condition over MEASURES, holds."""
    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document passes if it fails at most `allowed` of the rules in `rules`, and none of those in `fatal`."""
    version: str
    rules: tuple[str, ...]
    fatal: tuple[str, ...] = ()
    allowed: int = 0


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeats_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "4 * n_symbols > n_words"),
    Rule(3, "repeats_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "some_repeats", "100 * n_repeat_words > 30 * n_words"),
)
BASE = ("too_short", "repeats_words")
POLICIES = {
    "base": Policy("base", BASE, BASE),
    "v1": Policy("v1", BASE + ("symbols", "repeats_lines", "short_words", "long_words"), BASE),
    "v2-lenient": Policy("v2-lenient", BASE + ("symbols", "repeats_lines", "short_words", "long_words", "some_repeats"), BASE, allowed=1),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def build_ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, the measurements and `fail_bits`. One pass over the texts, no shuffle."""
    m = free_name(docs, "_m")
    measured = docs.select(*[column(c) for c in keep], F.arrow_udf(measure, MEASURE_TYPE)(column(text)).alias(m)).select(*[column(c) for c in keep], f"{m}.*")
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def passes(policy: Policy, bits: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    failed = F.bit_count(bits.bitwiseAND(F.lit(mask(policy.rules, rules)).cast("long")))
    return (failed <= policy.allowed) & (bits.bitwiseAND(F.lit(mask(policy.fatal, rules)).cast("long")) == 0)


def apply_policies(ledger: DataFrame, policies: dict[str, Policy] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a boolean column kept_<version> for each policy."""
    return ledger.select("*", *[passes(p, rules=rules).alias(f"kept_{v}") for v, p in policies.items()])


def ablations(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that the policy drops, and that would pass without it.

    Documents are counted by their bits first, so that at most 2^rules rows are looked at however many there are.
    """
    by_bits = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    parts = []
    for r in rules:
        if r.name in policy.rules:
            less = Policy(policy.version, tuple(n for n in policy.rules if n != r.name), tuple(n for n in policy.fatal if n != r.name), policy.allowed)
            parts.append(F.struct(F.lit(r.name).alias("rule"), F.col("fail_bits").bitwiseAND(F.lit(1 << r.bit).cast("long")).alias("hit"),
                                  passes(less, rules=rules).alias("without")))
    full = passes(policy, rules=rules)
    return (by_bits.select("n", "fail_bits", full.alias("with_it"), F.explode(F.array(*parts)).alias("a"))
            .groupBy(F.col("a.rule").alias("rule")).agg(
                F.sum(F.when(F.col("a.hit") != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                F.sum(F.when(~F.col("with_it"), F.col("n")).otherwise(0)).alias("n_dropped"),
                F.sum(F.when(~F.col("with_it") & F.col("a.without"), F.col("n")).otherwise(0)).alias("n_only_this"),
                F.bit_or(F.when(F.col("a.hit") != 0, F.col("fail_bits")).otherwise(F.lit(0).cast("long"))).alias("seen_with")))

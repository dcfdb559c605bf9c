"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets the weight p^a / sum(p^a). The exponent a between 0 (all sources alike) and 1 (as they
are) is bisected to the smallest that keeps the entropy of the weights at or below a target, or the repetitions of every
source at or below a limit. The token budget is the least at which no source is passed less than once, or a given one.

Each pass over a source is a permutation: documents sort by a hash of seed, pass and key, and the hash range is cut into
blocks of about `block_tokens`. A source's last, partial pass takes documents in that order as long as the budget lasts;
block totals say in which block it runs out, and only that block is looked at row by row. So a source with most of the
rows is cut by blocks, never gathered.

A null source is a source of its own. Nulls and empty texts have no tokens and use no budget; a source without any
tokens is passed once. Rows with equal keys stand at the same place of a permutation and are taken together.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import column
from barloom.session import cut_lineage

STEPS, ROUNDS = 8, 4   # bisection steps per pass over the shares, and passes
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """Exactly one of them: entropy as a share of the largest possible, or the most passes over any source."""
    entropy: float | None = None
    repeats: float | None = None

    def __post_init__(self) -> None:
        if (self.entropy is None) == (self.repeats is None):
            raise ValueError("a target is either an entropy or a number of repeats")


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place_of(seed: int, epoch: Column, key: Column) -> Column:
    """Place in the permutation of a pass: 60 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def block_of(place: Column, blocks: Column) -> Column:
    return F.floor(place.cast("double") * blocks / F.lit(float(1 << 60))).cast("long")


def exponent(shares: DataFrame, target: Target, budget: int | None = None) -> float:
    """The smallest exponent that meets the target. `shares` has one row per source with tokens (column tokens).

    Each pass over the shares evaluates all midpoints of the next eight bisection steps, so four small jobs halve the
    interval 32 times; only their totals come to the driver.
    """
    totals = shares.agg(F.count("*").alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not totals["n"]:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        width = (hi - lo) / (1 << STEPS)
        grid = [lo + width * k for k in range(1, 1 << STEPS)]
        x = F.log(F.col("tokens") / F.lit(totals["all"]))
        sums = shares.select(x.alias("x"), F.explode(F.array(*[F.lit(a) for a in grid])).alias("a")).groupBy("a").agg(
            F.sum(F.exp(F.col("a") * F.col("x"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("x")) * F.col("a") * F.col("x")).alias("zx")).collect()
        met = set()
        for r in sums:
            entropy = math.log(r["z"]) - r["zx"] / r["z"]
            if target.entropy is not None:
                fine = entropy <= target.entropy * math.log(totals["n"])
            elif budget is None:
                fine = (totals["most"] / totals["least"]) ** (1 - r["a"]) <= target.repeats
            else:
                fine = budget * math.exp(r["a"] * math.log(totals["least"] / totals["all"])) / r["z"] / totals["least"] <= target.repeats
            if fine:
                met.add(r["a"])
        first = next((k for k, a in enumerate(grid, 1) if a in met), 1 << STEPS)   # what is met stays met further on
        lo, hi = lo + width * (first - 1), lo + width * first
    return hi


def mixing_plan(docs: DataFrame, target: Target, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 0,
                budget: int | None = None, block_tokens: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(plan, rows): plan has per source tokens, weight, budget, epochs (full passes), blocks and cut (the last place that
    the partial pass takes, -1 for none); rows has per input row key, source and n_tokens."""
    rows = cut_lineage(docs.select(column(key).alias("key"), column(source).cast("string").alias("source"), tokens_of(column(text)).alias("n_tokens")))
    shares = cut_lineage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    some = shares.filter("tokens > 0")
    a = exponent(some, target, budget)
    z, most = some.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))), F.max("tokens")).first()
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z or 1.0)).otherwise(F.lit(0.0))
    full = float(budget) if budget is not None else (float(most) / (float(most) ** a / z) if most else 0.0)
    plan = (shares.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * F.lit(full)).cast("long"))
            .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div greatest(tokens, 1)")).otherwise(F.lit(1)).cast("long"))
            .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))
            .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long")))
    plan = cut_lineage(plan)
    small = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    last = (rows.join(small.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).filter("rest > 0")
            .select("source", "rest", "n_tokens", "blocks", place_of(seed, F.col("epochs"), F.col("key")).alias("place")).withColumn("block", block_of(F.col("place"), F.col("blocks"))))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = last.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("upto", F.sum("n").over(before))
    edge = totals.filter("upto > rest AND upto - n <= rest").select(F.col("source").alias("of"), F.col("block").alias("at"), (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))
    inside = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = last.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).withColumn("used", F.sum("n_tokens").over(inside))
    # The first place that no longer fits; the block before it is taken whole.
    cuts = near.filter("used > room").groupBy("source").agg((F.min("place") - 1).alias("cut")).withColumnRenamed("source", "of")
    cut = F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(1 << 60))).otherwise(F.lit(-1)).cast("long")
    plan = cut_lineage(plan.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("cut_at", cut)
                       .select("source", "tokens", "weight", "budget", "epochs", "blocks", F.col("cut_at").alias("cut")))
    return plan, rows


def copies_of(plan: DataFrame, rows: DataFrame, seed: int, key: str = "key", source: str = "source") -> DataFrame:
    """`rows` with the plan's columns (prefixed p_) and `p_copies`, how often each row is taken. The rows are not shuffled
    where the plan has at most BROADCAST_SOURCES sources."""
    named = plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns])
    named = F.broadcast(named) if plan.count() <= BROADCAST_SOURCES else named
    extra = (place_of(seed, F.col("p_epochs"), column(key)) <= F.col("p_cut")).cast("long")
    return rows.join(named, column(source).cast("string").eqNullSafe(F.col("p_source"))).withColumn("p_copies", F.col("p_epochs") + extra)


def mixed_sequence(docs: DataFrame, target: Target, key: str = "doc_id", seed: int = 0, **how) -> DataFrame:
    """One row per taken document and pass: key, source, n_tokens, epoch, block, slot (place in the block, from 0)."""
    plan, rows = mixing_plan(docs, target, key=key, seed=seed, **how)
    taken = copies_of(plan, rows, seed).filter("p_copies > 0").select("key", "source", "n_tokens", "p_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_copies") - 1)).alias("epoch"))
    placed = taken.withColumn("place", place_of(seed, F.col("epoch"), F.col("key"))).withColumn("block", block_of(F.col("place"), F.col("p_blocks")))
    order = Window.partitionBy("source", "epoch", "block").orderBy("place", "key", "n_tokens")
    return placed.select(F.col("key").alias(key), "source", "n_tokens", "epoch", "block", (F.row_number().over(order) - 1).cast("long").alias("slot"))


def mix_documents(docs: DataFrame, target: Target, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 0, **how) -> DataFrame:
    """`docs` with each row as often as the mixture takes it; columns as before, texts not shuffled."""
    plan, _ = mixing_plan(docs, target, text, key, source, seed, **how)
    inner = docs.select(*[column(c).alias(f"d{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    taken = copies_of(plan, inner, seed, at[key], at[source]).filter("p_copies > 0")
    return taken.withColumn("p_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_copies")))).select(*[F.col(at[c]).alias(c) for c in docs.columns])

"""Target-distribution importance resampling: documents that look like the target get a higher chance of being drawn.

Words are lower-cased in A-Z; features are the runs of 1 to `longest` consecutive words, hashed into buckets. A bucket's gain
is the log ratio of its smoothed shares in the target and in the corpus, in thousandths, rounded down. The gains form one
array of `buckets` numbers, and a document's weight is the sum of the array's entries over its features. Weight plus Gumbel
noise from a keyed hash is the score; the highest scores are a draw without replacement in proportion to exp(weight).

The number to draw is exact. A quantile sketch brackets the cutoff, counts outside and inside the bracket validate it, a
bracket that misses is widened, and only its rows are sorted. The rows drawn are then ranked in parallel: they are dealt
out by ranges of (score, key), and the sizes of the ranges give each its first rank.

Null, empty and wordless texts have no features and weight 0. Texts of any length are read whole. A null key hashes as an
empty one and comes last among ties. Rows that share a key have the same noise and are ranked one after another. Without
rows nothing is drawn; without target texts every gain comes from the corpus alone. Other columns of `docs` are not read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import column
from barloom.session import cut_lineage

# Fixed value: words, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Params:
    longest: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024
    margin: float = 0.002   # half the first bracket's width, as a share of the rows


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def bucket_table(docs: DataFrame, key: str, text: str, p: Params) -> DataFrame:
    """row, key, n_words and the bucket of every feature of each document; stored, as texts are cut into words only once."""
    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % p.buckets).cast("int")

    def run_of(n: int):
        return lambda i: bucket(F.concat_ws(" ", *[F.get("w", i + j) for j in range(n)]))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(key).alias("key"), words(column(text)).alias("w"))
    found = [F.transform("w", bucket)]
    for n in range(2, p.longest + 1):
        at = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        # Single elements are read in constant time; slices would copy the whole array for each run of a very long text.
        found.append(F.transform(at, run_of(n)))
    return cut_lineage(rows.select("row", "key", F.size("w").cast("long").alias("n_words"), (F.concat(*found) if len(found) > 1 else found[0]).alias("b")))


def totals(table: DataFrame, p: Params) -> list[int]:
    """Features by bucket: at most `buckets` rows reach the driver."""
    out = [0] * p.buckets
    for r in table.select(F.explode("b").alias("b")).groupBy("b").count().collect():
        out[r[0]] = r[1]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    size, s_all, t_all = float(len(corpus)), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log(((t + 1.0) * (s_all + size)) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus, target)]


def weight_of(buckets: Column, gain: list[int]) -> Column:
    """Sum of the array's entries over a document's features."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")   # folded to one constant
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))


def noise_of(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and key."""
    head = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(head, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", params: Params = Params()) -> DataFrame:
    """row, key, n_words, n_features, weight and score of every document."""
    table = bucket_table(docs, key, text, params)
    aim = bucket_table(target.select(F.lit(0).alias("k"), column(target_text).alias("t")), "k", "t", params)
    gain = gains(totals(table, params), totals(aim, params))
    weighed = table.select("row", "key", "n_words", F.size("b").cast("long").alias("n_features"), weight_of(F.col("b"), gain).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise_of(F.col("key"), params.seed))


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with their rank from 1 in a total order of all rows, in column `rank`.

    Ranges of the order are sorted in parallel and stored with each row's place; the sizes of the ranges, one row each,
    give the first rank of each range. `order` must tell all rows apart, so that equal keys cannot fill one range.
    """
    sorted_ = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row for each range, not for each document
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.col("place") - F.shiftleft(part, 33)
    return sorted_.withColumn("part", part).join(F.broadcast(first), "part").withColumn("rank", F.col("first") + inside + 1).drop("part", "place", "first")


def cutoff(rows: DataFrame, take: int, margin: float):
    """score, key and row of the last of the first `take` rows; `rows` has more than 0 and `take` is between 1 and their number."""
    n = rows.count()
    while True:
        at = 1 - take / n
        low, high = rows.agg(F.percentile_approx("score", F.array(F.lit(max(0.0, at - margin)), F.lit(min(1.0, at + margin))), F.lit(10_000))).first()[0]
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < take <= above + inside:
            break
        margin *= 4   # at 1 the bracket runs from the least to the highest score
    bracket = in_order(rows.filter(F.col("score").between(low, high)), *order())
    return bracket.filter(F.col("rank") == take - above).first()


def order() -> list[Column]:
    """Highest score first, ties by key, then by the stored row number."""
    return [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row").asc()]


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", params: Params = Params()) -> DataFrame:
    """The key, n_features, weight, score and rank of every document; the rank is null where it is not drawn."""
    rows = cut_lineage(scored(docs, target, key, text, target_text, params))
    able = rows.filter(F.col("n_words") >= params.min_words)
    take = able.count() * params.percent // 100
    out = [F.col("key").alias(key), "n_features", "weight", "score"]
    if not take:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last = cutoff(able, take, params.margin)
    # Ties at the cutoff go by key, nulls last, then by row.
    tied = F.col("row") <= last["row"]
    if last["key"] is None:
        tied = F.col("key").isNotNull() | tied
    else:
        tied = (F.col("key") < F.lit(last["key"])) | ((F.col("key") == F.lit(last["key"])) & tied)
    drawn = F.coalesce((F.col("n_words") >= params.min_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tied)), F.lit(False))
    ranked = in_order(rows.filter(drawn), *order())
    return ranked.select(*out, "rank").unionAll(rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))

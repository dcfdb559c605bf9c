"""Hard-negative mining by threshold joins with suffix-norm bounds over an inverted index.

Vectors are quantised to integers; a row's score for an anchor is their inner product. Rows and anchors are packed into
blocks of bounded size, and every block of anchors meets every block of rows once in a pass. Within such a pair the rows
are indexed by panels of eight coordinates, the lively coordinates last. A row is posted from the panel on at which the
coordinates before it, by their norm and the anchors' norm over them, could reach the threshold by themselves; earlier
ones are left out of the index. Panels are read from the last one, partial scores accumulate, and a row goes as soon as
no anchor can reach its threshold with the norms that remain. Survivors are completed with the coordinates left out, so
scores are exact.

Thresholds start high and are lowered until the windows fill: each anchor meets one block of rows first, its threshold
falls until the block holds as many fitting rows as are wanted or the window's floor is reached, and the score of the
last one is a threshold that holds for the whole table. One pass finds the positives, the second the negatives of each
positive's window. A pair of blocks hands on at most the rows wanted by each window, the best by (score, smaller id), so
ties and large groups of equal vectors lose nothing.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors of different lengths
are filled up with zeros; empty vectors score 0. Rows that share an id stay rows of their own; none of them is a partner of
an anchor with that id. Products beyond 2^53 are computed with Python integers, and a score beyond 62 bits raises an
OverflowError. Anchors without positives, and positives whose window is empty (all negative scores), return nothing.
Columns other than the three named are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import column
from barloom.session import cut_lineage

PANEL, TILE = 8, 32
BLOCK = "block long, n int, ids binary, labels binary, dims int, data binary, energy array<double>"
HIT = ["block", "slot", "w", "anchor", "partner", "partner_score", "id", "score"]


@dataclass(frozen=True)
class Params:
    """`positives` rows of the anchor's label; for each of them `window` rows of other labels from low to high percent of its score."""
    positives: int = 5
    window: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block_values: int = 1 << 17


def quantise(rows: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """id, label and v, an array of floor(scale * component), of the rows that take part."""
    def finite(c: Column) -> Column:
        return F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))   # NaN counts as larger

    named = rows.select(column(key).cast("long").alias("id"), label.cast("long").alias("label"), column(vector).alias("x"))
    return (named.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(F.forall("x", finite))
            .select("id", "label", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")))


def pack(per: int):
    """Blocks of `per` rows: ids, labels and components as bytes, and the sum of squares of each coordinate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, waiting, rows = 0, [], 0

        def block(t: pa.Table) -> pa.RecordBatch:
            lists = t["v"].combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            x = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
            x[np.arange(x.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
            ids, labels = (t[c].to_numpy().astype(np.int64).tobytes() for c in ("id", "label"))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()), "n": pa.array([len(x)], pa.int32()), "ids": [ids], "labels": [labels],
                "dims": pa.array([x.shape[1]], pa.int32()), "data": [small(x)], "energy": [np.square(x, dtype=np.float64).sum(0).tolist()]},
                schema=pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("dims", pa.int32()), ("data", pa.binary()), ("energy", pa.list_(pa.float64()))]))

        for b in batches:
            waiting.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            while rows >= per:
                t = pa.concat_tables(waiting)
                yield block(t.slice(0, per))
                made, waiting, rows = made + 1, [t.slice(per)], rows - per
        if rows:
            yield block(pa.concat_tables(waiting))

    return run


def small(x: np.ndarray) -> bytes:
    """Components in the narrowest of three integer widths."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def matrix(data: bytes, n: int, dims: int, order: np.ndarray) -> np.ndarray:
    """Rows of integers, coordinates in the given order and filled up with zeros to its length."""
    full = np.zeros((n, len(order)), np.int64)
    if dims:
        full[:, :dims] = np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * dims)]).reshape(n, dims)
    return full[:, order]


class Index:
    """Rows of a block, posted by panels of coordinates, and their norms up to each panel."""

    def __init__(self, x: np.ndarray):
        self.x = np.pad(x, ((0, 0), (0, -x.shape[1] % PANEL)))
        self.most = int(np.abs(self.x).max(initial=0))
        self.before = norms(self.x)

    def scores(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, anchor and exact score of every pair whose score reaches the anchor's floor."""
        q = np.pad(q, ((0, 0), (0, self.x.shape[1] - q.shape[1])))
        exact = self.most * int(np.abs(q).max(initial=0)) * self.x.shape[1] < 1 << 53
        x, q = (self.x.astype(np.float64), q.astype(np.float64)) if exact else (self.x.astype(object), q.astype(object))
        if floor.min() <= 0:   # no norm is below such a floor: nothing can be left out
            s = x @ q.T
            row, anchor = np.nonzero((s >= floor).astype(bool))
            return row, anchor, in_range(s[row, anchor])
        before_q, panels = norms(q), x.shape[1] // PANEL
        least = floor - 1e-9 * floor - 1e-6   # bounds are rounded, floors are not
        reach = (before_q / least[:, None]).max(0)
        # The panel each row is posted from: the coordinates before it cannot reach any floor.
        start = (self.before * reach < 1).sum(1) - 1
        acc = np.zeros((len(x), len(q)), x.dtype)
        live = np.flatnonzero(start < panels)
        for p in range(panels - 1, -1, -1):
            here = start[live] <= p
            posted = live[here]
            acc[posted] += x[posted, p * PANEL:(p + 1) * PANEL] @ q[:, p * PANEL:(p + 1) * PANEL].T
            able = (acc[posted].astype(np.float64) + self.before[posted, p, None] * before_q[:, p] >= least).any(1)
            live = np.concatenate([live[~here], posted[able]])
        bound = acc[live].astype(np.float64) + self.before[live, start[live]][:, None] * before_q[:, start[live]].T
        at, anchor = np.nonzero(bound >= least)
        row = live[at]
        s = acc[row, anchor]
        for p in range(int(start[row].max(initial=0))):   # the coordinates that were left out
            more = start[row] > p
            s[more] += (x[row[more], p * PANEL:(p + 1) * PANEL] * q[anchor[more], p * PANEL:(p + 1) * PANEL]).sum(1)
        good = (s >= floor[anchor]).astype(bool)
        return row[good], anchor[good], in_range(s[good])


def in_range(scores: np.ndarray) -> np.ndarray:
    """The scores, which the windows' bounds and the result's columns must be able to hold."""
    if scores.dtype == object and any(abs(s) >= ANY for s in scores):
        raise OverflowError("a score is beyond 62 bits")
    return scores


def norms(x: np.ndarray) -> np.ndarray:
    """Norm of the coordinates before each panel, and of all of them."""
    square = np.square(x.astype(np.float64)).reshape(len(x), -1, PANEL).sum(2)
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), square.cumsum(1)], 1))


NONE, ANY = -(1 << 62), 1 << 62   # bounds of a window that is open below or above


def best(ids: np.ndarray, scores: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the first `wanted` rows: highest score first, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:wanted], np.int64)
    return np.lexsort((ids, -scores))[:wanted]


def windows(index: Index, ids: np.ndarray, labels: np.ndarray, q: dict, asks: dict, same: bool, wanted: int, lowering: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ask, row and score of what each window finds among the rows of one block.

    An ask is a window of one anchor (slot): scores from `low` to `high`, of which only those from `floor` on matter.
    With `lowering` a threshold starts at half the highest possible score and falls until the window is full or all of it
    has been seen; else the floors are the thresholds.
    """
    bottom = np.maximum(asks["low"], asks["floor"])
    of: dict[int, list[int]] = {}
    for k, slot in enumerate(asks["slot"]):
        of.setdefault(int(slot), []).append(k)
    like = sorted(of, key=lambda slot: min(bottom[of[slot]]))   # anchors with like thresholds share a tile
    for at in range(0, len(like), TILE):
        waiting, share = {slot: of[slot] for slot in like[at:at + TILE]}, 0.5
        while waiting:
            slots = np.array(list(waiting))
            floor = np.array([min(bottom[of_]) for of_ in waiting.values()], np.float64)
            if lowering and share > 0.02:
                floor = np.maximum(floor, share * index.before[:, -1].max(initial=0.0) * q["norm"][slots])
            rows, which, scores = index.scores(q["x"][slots], floor)
            by = np.argsort(which, kind="stable")
            rows, scores, ends = rows[by], scores[by], np.searchsorted(which[by], np.arange(len(slots) + 1))
            short: dict[int, list[int]] = {}
            for i, slot in enumerate(slots):
                r, s = rows[ends[i]:ends[i + 1]], scores[ends[i]:ends[i + 1]]
                able = ((labels[r] == q["labels"][slot]) == same) & (ids[r] != q["ids"][slot])
                r, s = r[able], s[able]
                for k in waiting[int(slot)]:
                    fit = ((s >= bottom[k]) & (s <= asks["high"][k])).astype(bool)
                    first = best(ids[r[fit]], s[fit], wanted)
                    if lowering and len(first) < wanted and floor[i] > bottom[k]:
                        short.setdefault(int(slot), []).append(k)
                    else:
                        yield k, r[fit][first], s[fit][first]
            waiting, share = short, share * 0.6


def meet(order: np.ndarray, same: bool, wanted: int, lowering: bool):
    """Each row of a batch is a block of anchors with its asks and a block of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "asks"}
                if at != r["block"]:
                    index, at = Index(matrix(r["data"], r["n"], r["dims"], order)), r["block"]
                    ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                x = matrix(r["q_data"], r["q_n"], r["q_dims"], order)
                q = {"x": x, "norm": np.sqrt(np.square(x.astype(np.float64)).sum(1)), "ids": np.frombuffer(r["q_ids"], np.int64), "labels": np.frombuffer(r["q_labels"], np.int64)}
                wishes = batch.column("asks")[i].values
                asks = {f.name: wishes.field(f.name).to_numpy(zero_copy_only=False) for f in wishes.type}
                found = list(windows(index, ids, labels, q, asks, same, wanted, lowering))
                k = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(k), r["q_block"]), pa.int64()), *(pa.array(asks[c][k], pa.int64()) for c in ("slot", "w")), pa.array(q["ids"][asks["slot"][k]], pa.int64()),
                    *(pa.array(asks[c][k], pa.int64()) for c in ("partner", "partner_score")), pa.array([int(v) for f in found for v in ids[f[1]]], pa.int64()),
                    pa.array([int(v) for f in found for v in f[2]], pa.int64())], names=HIT)

    return run


def blocks(rows: DataFrame, values: int, dims: int, n: int) -> DataFrame:
    """`rows` (n of them) in stored blocks of about `values` components each."""
    per = max(1, values // max(1, dims))
    return cut_lineage(rows.repartition(max(1, -(-n // per))).mapInArrow(pack(per), BLOCK))


def search(rows: DataFrame, anchors: DataFrame, asks: DataFrame, order: np.ndarray, parts: int, same: bool, wanted: int, first: bool) -> DataFrame:
    """What the windows in `asks` (a row each) find in all blocks of rows, or with `first` in one block for each block of anchors."""
    wishes = asks.groupBy(F.col("block").alias("q_block")).agg(F.collect_list(F.struct("slot", "w", "partner", "partner_score", "floor", "low", "high")).alias("asks"))   # bounded by the block
    q = anchors.select(F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data")).join(wishes, "q_block")
    part = F.shiftright("block", 32)
    if first:
        left, right = rows.filter(F.col("block") == F.shiftleft(part, 32)).withColumn("lane", part), q.withColumn("lane", F.pmod(F.shiftright("q_block", 32), F.lit(parts)))
    else:   # rows stay where they are; anchors are copied once for each lane, and there are as many lanes as tasks
        lanes = min(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left, right = rows.withColumn("lane", F.pmod(part, F.lit(lanes))), q.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    return left.drop("energy").join(right, "lane").drop("lane").mapInArrow(meet(order, same, wanted, first), ", ".join(f"{c} long" for c in HIT))


def ranked(hits: DataFrame, wanted: int) -> DataFrame:
    place = Window.partitionBy("block", "slot", "w").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= wanted)


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", label: Column | None = None, vector: str = "embedding", params: Params = Params()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `anchors` is a condition on the column id (the key); `label` an expression over `rows`, by default its column label.
    """
    p = params
    taking = quantise(rows, key, column("label") if label is None else label, vector, p.scale)
    n, m, dims = taking.agg(F.count("*"), F.count_if(anchors), F.max(F.size("v"))).first()
    packed, q = blocks(taking, p.block_values, dims or 0, n), blocks(taking.filter(anchors), p.block_values // 4, dims or 0, m)
    energy = {r["pos"]: r["e"] for r in packed.select(F.posexplode("energy").alias("pos", "e")).groupBy("pos").agg(F.sum("e").alias("e")).collect()}   # a row for each coordinate
    order = np.array(sorted(range(dims or 0), key=lambda d: (energy[d], d)), np.int64)
    parts = max(1, -(-n // max(1, p.block_values // max(1, dims or 0))))

    def filled(asks: DataFrame, same: bool, wanted: int) -> DataFrame:
        """The windows' rows over the whole table, from thresholds that one block of rows has shown to be low enough."""
        seen = search(packed, q, asks, order, parts, same, wanted, True).groupBy("block", "slot", "w").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        sure = seen.filter(F.col("n") >= wanted).drop("n")
        lower = asks.join(sure, ["block", "slot", "w"], "left").withColumn("floor", F.coalesce("least", "low")).drop("least")
        return cut_lineage(ranked(search(packed, q, lower, order, parts, same, wanted, False), wanted))

    no = F.lit(0).cast("long")
    each = q.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long"))).alias("slot"))
    bounds = [F.lit(x).cast("long").alias(name) for name, x in (("floor", NONE), ("low", NONE), ("high", ANY))]
    positive = filled(each.select("block", "slot", no.alias("w"), no.alias("partner"), no.alias("partner_score"), *bounds), True, p.positives)
    wide = positive.filter("score >= 0").select(
        "block", "slot", F.col("rank").cast("long").alias("w"), F.col("id").alias("partner"), F.col("score").alias("partner_score"), F.lit(NONE).cast("long").alias("floor"),
        F.expr(f"(score * {p.low} + 99) div 100").alias("low"), F.expr(f"score * {p.high} div 100").alias("high"))
    return filled(wide, False, p.window).select(F.col("anchor").alias("anchor_id"), F.col("partner").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                F.col("partner_score").alias("positive_score"), F.col("score").alias("negative_score"))

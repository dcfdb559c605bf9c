"""Scoring documents by language models: a unigram base and a gated recurrent network with a class-factored softmax.

Texts are lower-cased in A-Z and cut at white space; each ends with an end token. Documents are packed into blocks of about
`block_tokens` tokens, each with a dictionary of its own words. Words are counted over the training documents of all blocks;
the counts come back to the blocks by one row for each word and block, so no word is more than one row of a block, however
frequent. The `vocabulary` most frequent words have outputs of their own in the network; the others share one output, times
their smoothed share of all such words, so every word of every text has a probability.

The network learns from all training documents: in each of `rounds`, every partition learns from its share of them,
starting from the same weights, and the weights are averaged by the tokens learned from. Texts are read whole and the state
is carried through them; gradients, cut at windows of `steps` tokens, are taken in every window (`share` above 1: in one window of so many, see gru.Model). The
weights (bounded by `vocabulary` and `hidden`) are all that reaches the driver.

Null and empty texts have the end token alone. Very long texts stay one row; they are scored window by window. A null key
is held out or not as the condition says, a null condition counts as not held out. Repeated rows are documents of their own.
Without training documents every count is 0 and the network keeps its start, the smoothed frequencies. Other columns of
`docs` are not read. Words longer than 32 bytes are told apart by their 256-bit hash. The network depends on how rows are
dealt to partitions, as that decides which documents are averaged.
"""
from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import gru
from barloom.llm.common import LOWER, column, octets
from barloom.session import cut_lineage

END = b""   # no word is empty


@dataclass(frozen=True)
class Params:
    vocabulary: int = 4094
    hidden: int = 16
    inner: int = 12
    classes: int = 40
    steps: int = 16
    slots: int = 128
    share: int = 1
    rounds: int = 4
    rate: float = 0.1
    squares: float = 1e-3
    seed: int = 1
    block_tokens: int = 1 << 22
    buffer_tokens: int = 1 << 20
    chunk: int = 8192


def name_of(word: bytes) -> bytes:
    """At most 33 bytes that stand for the word; only hashed ones have 33."""
    return word if len(word) <= 32 else b"#" + hashlib.sha256(word).digest()


def planes(ids: np.ndarray) -> bytes:
    """Numbers by byte planes: the high planes are mostly zeros and compress well."""
    return np.ascontiguousarray(ids.view(np.uint8).reshape(len(ids), ids.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def cut_words(block_tokens: int, schema: pa.Schema):
    """Rows of documents (row >= 0) and of their block's dictionary (row < 0): a word and its count in training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        state: dict = {}

        def fresh() -> None:
            numbers = defaultdict(itertools.count().__next__)
            numbers[END]
            state.update(numbers=numbers, counts=np.zeros(1, np.int64), tokens=0, rows=0)

        def dictionary() -> pa.RecordBatch:
            n = len(state["numbers"])
            counts = np.zeros(n, np.int64)
            counts[:len(state["counts"])] = state["counts"][:n]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), pa.array(np.full(n, -1), pa.int64()), pa.nulls(n, schema.field("key").type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
                                               pa.array([name_of(w) for w in state["numbers"]], pa.binary()), pa.array(np.arange(n), pa.int64()), pa.array(counts)], schema=schema)

        fresh()
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            learned: list[np.ndarray] = []
            keys, held = batch.column(0), batch.column(2).to_pylist()
            number = state["numbers"].__getitem__
            at = 0

            def documents(upto: int) -> pa.RecordBatch:
                n = len(rows[0])
                if learned:   # the dictionary is long: it is gone through once for a batch, not for each document
                    c = np.bincount(np.concatenate(learned))
                    if len(c) > len(state["counts"]):
                        state["counts"] = np.concatenate([state["counts"], np.zeros(2 * len(c) - len(state["counts"]), np.int64)])
                    state["counts"][:len(c)] += c
                    learned.clear()
                return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), keys.slice(at, n), pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.binary()),
                                                   pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

            for i, body in enumerate(octets(batch.column(1))):
                words = body.translate(LOWER).split()
                words.append(END)
                ids = np.fromiter(map(number, words), np.uint32, len(words))
                if not held[i]:
                    learned.append(ids)
                for column_, value in zip(rows, (block, state["rows"], held[i], planes(ids))):
                    column_.append(value)
                state["tokens"], state["rows"] = state["tokens"] + len(ids), state["rows"] + 1
                if state["tokens"] >= block_tokens:
                    yield documents(i + 1)
                    yield dictionary()
                    rows, at, block = [[], [], [], []], i + 1, block + 1
                    fresh()
                    number = state["numbers"].__getitem__
            if rows[0]:
                yield documents(batch.num_rows)
        if state["rows"]:
            yield dictionary()

    return run


def encode(tokens: int, kinds: int, rare: int, rare_kinds: int, rare_id: int, end_id: int, schema: pa.Schema):
    """Documents of one block with its dictionary of counts: base score, rare words' part of the score, and the network's tokens."""
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        local = words["local"].to_numpy()
        count, own = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        count[local] = words["count"].to_numpy()
        own[local] = words["own"].to_numpy()   # -1: no output of its own
        own[0] = end_id
        base = np.log10((count + 0.5) / (tokens + 0.5 * (kinds + 1)))
        share = np.where(own < 0, np.log10((count + 0.5) / (rare + 0.5 * (rare_kinds + 1))), 0.0)
        own[own < 0] = rare_id
        rows = [from_planes(d, np.uint32) for d in docs["ids"].to_pylist()]
        out = [[len(r) for r in rows], [int((count[r] > 0).sum()) for r in rows], [float(base[r].sum()) for r in rows], [float(share[r].sum()) for r in rows], [planes(own[r].astype(np.uint16)) for r in rows]]
        return pa.table([docs["block"], docs["row"], docs["key"], docs["held"], *out], schema=schema)

    return run


def buffered(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows and their tokens, about `tokens` at a time."""
    waiting, texts, n = [], [], 0
    for b in batches:
        for i, ids in enumerate(b.column("ids").to_pylist()):
            texts.append(from_planes(ids, np.uint16))
            waiting.append((b, i))
            n += len(texts[-1])
            if n >= tokens:
                yield waiting, texts
                waiting, texts, n = [], [], 0
    if texts:
        yield waiting, texts


@dataclass
class Prepared:
    """Encoded documents, the start of the network, and the number of training tokens."""
    docs: DataFrame
    model: gru.Model
    end: int
    tokens: int


def prepare(docs: DataFrame, held_out: Column, key: str, text: str, p: Params) -> Prepared:
    named = docs.select(column(key).alias("key"), column(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    kind = named.schema["key"].dataType.simpleString()
    schema = f"block long, row long, key {kind}, held boolean, ids binary, word binary, local long, count long"
    arrow = named.select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"), "key", "held", F.lit(b"").alias("ids"), F.lit(b"").alias("word"), F.lit(0).cast("long").alias("local"), F.lit(0).cast("long").alias("count")).limit(0).toArrow().schema
    parts = cut_lineage(named.mapInArrow(cut_words(p.block_tokens, nullable(arrow)), schema))
    entries = parts.filter("row < 0").select("block", "word", "local", "count")
    counts = cut_lineage(entries.filter("count > 0").groupBy("word").agg(F.sum("count").alias("count")))
    tokens, kinds, ends = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("count"))), F.lit(0))).first()
    top = counts.filter(F.col("word") != END).orderBy(F.col("count").desc(), "word").limit(p.vocabulary).collect()   # bounded by the parameter
    rare, rare_kinds = tokens - ends - sum(r["count"] for r in top), kinds - (ends > 0) - len(top)
    # Falling frequency; the shared output of the other words and the end token have their places among the words.
    outputs = sorted([(r["count"], bytes(r["word"])) for r in top] + [(ends, END), (rare, None)], key=lambda x: -x[0])
    number = {w: i for i, (_, w) in enumerate(outputs)}
    frequency = np.array([max(n, 0.5) for n, _ in outputs])
    known = docs.sparkSession.createDataFrame([(bytearray(w), i) for w, i in number.items() if w is not None], "word binary, own long")
    words = (entries.select("block", "word", "local").join(counts, "word", "left").join(F.broadcast(known), "word", "left")
             .select(F.col("block").alias("of"), "local", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("own", F.lit(-1)).alias("own")))
    texts = parts.filter("row >= 0").select("block", "row", "key", "held", "ids")
    out = f"block long, row long, key {kind}, held boolean, n_tokens long, n_known long, base double, rare double, ids binary"
    fields = [nullable(arrow).field(c) for c in ("block", "row", "key", "held")] + [pa.field(c, t) for c, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("rare", pa.float64()), ("ids", pa.binary()))]
    coded = cut_lineage(texts.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(encode(tokens, kinds, rare, rare_kinds, number[None], number[END], pa.schema(fields)), out))
    shape = gru.Shape(len(outputs), p.hidden, p.inner, gru.classes(frequency, p.classes))
    return Prepared(coded, gru.Model.start(shape, frequency, p.seed), number[END], tokens)


def nullable(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, f.type) for f in schema])


def learn(ready: Prepared, p: Params) -> gru.Model:
    """Weights after all rounds; each averages what the partitions have learned from their documents of that round."""
    model, squares = ready.model, np.full(ready.model.flat().size, p.squares)
    size, end = len(squares), ready.end
    for k in range(p.rounds):
        def run(batches: Iterator[pa.RecordBatch], model=model, squares=squares) -> Iterator[pa.RecordBatch]:
            learner, seen = gru.Learner(model.restore(model.flat()), squares, p.rate), 0
            for _, texts in buffered(batches, p.buffer_tokens):
                seen += learner.learn(texts, end, p.slots, p.steps, p.share)
            if seen:
                both = np.concatenate([learner.model.flat(), np.concatenate([v.ravel() for v in learner.squares.values()])]).astype(np.float64)
                for at in range(0, len(both), p.chunk):
                    yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "seen": pa.array([float(seen)]), "v": pa.array([both[at:at + p.chunk]], pa.list_(pa.float64()))})

        mine = ready.docs.filter(~F.col("held") & (F.pmod(F.xxhash64("block", "row"), F.lit(p.rounds)) == k)).select("ids")
        learned = mine.mapInArrow(run, "at long, seen double, v array<double>")
        # A chunk of the weights from each partition, averaged in the executors as rows arrive.
        mean = learned.groupBy("at").agg(Summarizer.mean(array_to_vector("v"), F.col("seen")).alias("v")).select("at", vector_to_array("v").alias("v")).collect()
        if mean:
            both = np.concatenate([r["v"] for r in sorted(mean, key=lambda r: r["at"])])
            model, squares = model.restore(both[:size]), both[size:]
    return model


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; scores are log10 probabilities."""
    ready = prepare(docs, held_out, key, text, params)
    model, end = learn(ready, params), ready.end
    kept = ["key", "held", "n_tokens", "n_known", "base", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in buffered(batches, params.buffer_tokens):
            logs = gru.score_texts(model, texts, end) / np.log(10)
            at = 0
            for batch, own in itertools.groupby(rows, key=lambda r: id(r[0])):
                own = list(own)
                part = own[0][0].slice(own[0][1], len(own)).select(kept)
                score = logs[at:at + len(own)] + part.column("rare").to_numpy()
                at += len(own)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept[:-1]), pa.array(score)], names=[*kept[:-1], "score"])

    kind = ready.docs.schema["key"].dataType.simpleString()
    done = ready.docs.select(*kept, "ids").mapInArrow(run, f"key {kind}, held boolean, n_tokens long, n_known long, base double, score double")
    return done.select(F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(ready.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")

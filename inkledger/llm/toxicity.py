"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, word pairs and pairs with one word between, as present or not, hashed into 2^bits coordinates.
FTRL-proximal keeps a learning rate for each coordinate and an L1 term that leaves most weights exactly zero, so what
travels to the executors is a short list of (coordinate, weight), bounded by 2^bits entries whatever the corpus.

Training reads at most ``max_train`` labelled documents, those with the smallest hash of their id. Features are
computed where the text lies and dealt into shards of ``shard_rows`` documents. In each pass every shard streams its own
documents through FTRL from the common state, holding nothing but that state; then the states are averaged by coordinate (iterative
parameter mixing). The L1 penalty is shared among the shards, as it stands against sums of gradients; with one shard this is
plain FTRL. Scoring is a narrow map.

Defined results: a null or empty text is scored by the intercept; without labels, or with one class only, every score
is the smoothed share of toxic labels, 0 if there are none; labels without id or value are ignored and of repeated labels
the highest counts; a null id is held out; repeated rows are scored each, and of rows that repeat a labelled id one is learned; a long text is scored
whole, in a piece of its own; other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import _IS_WORD, Scratch, chunks, crc_fold, hash_words, mix, release, segment_ids, small_batches

#: Words are runs of anything but white space and ASCII punctuation.
WORD_BYTES = _IS_WORD.copy()
WORD_BYTES[[b for b in range(33, 128) if not chr(b).isalnum()]] = False
FOLDS = 5
MAX_TRAIN = 50_000
#: Documents of a shard, and what a change of 1 counts in sums.
SHARD_ROWS, UNIT = 4096, 1 << 32


@dataclass(frozen=True)
class Ftrl:
    """Hyperparameters: alpha and beta set the rate of a coordinate, l1 and l2 the penalties; positives may weigh more."""

    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 40.0
    l2: float = 0.1
    passes: int = 4
    positive_weight: float = 2.0


@dataclass
class Model:
    bits: int
    bias: float
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float64))

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.bits)
        table[self.index] = self.weight
        return table


def feature_stream(data: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, coordinate) arrays for words, pairs and skip pairs."""
    words, bounds = hash_words(data, starts, is_word=WORD_BYTES)
    text, shift = segment_ids(bounds), np.uint64(64 - bits)
    yield text, (words >> shift).astype(np.int64)
    for gap, odd in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(words) > gap:
            same = text[:-gap] == text[gap:]
            pair = mix(words[:-gap] * np.uint64(odd) + words[gap:])
            yield text[gap:][same], (pair[same] >> shift).astype(np.int64)


def feature_lists(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct coordinates of each text."""
    out = []
    for first, end, data, starts in chunks(texts):
        parts = list(feature_stream(data, starts, bits))
        pairs = np.unique(np.concatenate([(t << bits) | c for t, c in parts]))
        cut = np.searchsorted(pairs, np.arange(end - first + 1) << bits)
        out += [(pairs[a:b] & ((1 << bits) - 1)).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


class Learner:
    """FTRL-proximal, one example at a time, from a state (z, root); root is the square root of a coordinate's summed squared
    gradients. The intercept has no penalty."""

    def __init__(self, p: Ftrl, z: np.ndarray, root: np.ndarray, bias: float, bias_n: float):
        self.p, self.z, self.root, self.bias, self.bias_n = p, z.copy(), root.copy(), bias, bias_n
        self.w = weights(p, z, root)

    def learn(self, x: np.ndarray, y: int) -> None:
        p = self.p
        g = 1 / (1 + np.exp(-np.clip(self.bias + self.w[x].sum(), -35, 35))) - y
        g *= p.positive_weight if y else 1.0
        self.bias_n += g * g
        self.bias -= p.alpha * g / (p.beta + np.sqrt(self.bias_n)) / 10
        old = self.root[x]
        root = np.sqrt(old * old + g * g)
        self.z[x] += g - (root - old) / p.alpha * self.w[x]
        self.root[x] = root
        self.w[x] = weights(p, self.z[x], root)


def weights(p: Ftrl, z: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The weights of a state: zero where the penalty is not overcome."""
    return np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + root) / p.alpha + p.l2))


def prior(positive: int, n: int) -> float:
    return float(np.log(positive / (n - positive)))


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(shard, coordinates, label) in order, one for each document id. Columns: shard, rank, _id, y, x."""
    last = None
    for b in batches:
        shard, ids, y = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
        for k, blob in enumerate(b.column(4)):
            if (shard[k], ids[k]) != last:
                last = shard[k], ids[k]
                yield shard[k], np.frombuffer(blob.as_buffer(), np.int32), y[k]


def one_pass(table: DataFrame, p: Ftrl, state: tuple[np.ndarray, np.ndarray, float, float]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Every shard learns from the state on its own; the next state is the mean of theirs. Sums are of integers, so reruns agree."""

    def changes(m: Learner) -> pa.RecordBatch:
        at = np.flatnonzero(m.root != state[1])
        dz, droot = (np.rint(x * UNIT).astype(np.int64) for x in (m.z[at] - state[0][at], m.root[at] - state[1][at]))
        bias = np.rint(np.array([m.bias - state[2], m.bias_n - state[3]]) * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(dz, bias[0])), pa.array(np.append(droot, bias[1]))], ["i", "z", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m = None, None
        for shard, x, y in examples(batches):
            if shard != now:
                if m:
                    yield changes(m)
                now, m = shard, Learner(p, *state)
            m.learn(x, y)
        if m:
            yield changes(m)

    sums = table.mapInArrow(run, "i long, z long, root long").groupBy("i").agg(F.sum("z").alias("z"), F.sum("root").alias("root"), F.count("*").alias("n"))
    i, dz, droot, n = (c.to_numpy() for c in sums.toArrow().columns)
    real, last = i >= 0, int(np.argmin(i))
    z, root, scale = state[0].copy(), state[1].copy(), UNIT * int(n[last])
    z[i[real]] += dz[real] / scale
    root[i[real]] += droot[real] / scale
    return z, root, state[2] + dz[last] / scale, state[3] + droot[last] / scale


def train(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), max_train: int = MAX_TRAIN, target: str = "toxic", shard_rows: int = SHARD_ROWS) -> Model:
    """Learns from labelled documents that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(target).cast("int").alias("y")).withColumn("rank", F.xxhash64("_id"))
    known = scratch.write(known.orderBy("rank", "_id").limit(max_train), "known")
    shards = max(1, -(-known.count() // shard_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(known), "_id")
    rows = rows.select(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(shards)).cast("int").alias("shard"), "rank", "_id", "y", "text")
    bits = params.bits

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x.tobytes() for x in feature_lists(b.column(4), bits)], pa.binary())], ["shard", "rank", "_id", "y", "x"])
        release()

    features = rows.mapInArrow(featurize, "shard int, rank long, _id long, y int, x binary")
    table = scratch.write(features.repartition(shards, "shard").sortWithinPartitions("shard", "rank", "_id", "x"), "features")
    n, positive = table.select("_id", "y").distinct().agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Model(bits, -np.inf)
    if positive in (0, n):
        return Model(bits, float(np.log((positive + 1) / (n - positive + 1))))
    state, params = (np.zeros(1 << bits), np.zeros(1 << bits), prior(positive, n), 0.0), replace(params, l1=params.l1 / shards)
    for _ in range(params.passes):
        state = one_pass(table, params, state)
    scratch.drop()
    w = weights(params, state[0], state[1])
    index = np.flatnonzero(w)
    return Model(bits, state[2], index, w[index])


def score_texts(texts: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, end, data, starts in chunks(texts):
        hits = [(t[used] << model.bits) | c[used] for t, c in feature_stream(data, starts, model.bits) if (used := table[c] != 0).any()]
        if hits:
            pairs = np.unique(np.concatenate(hits))
            out[first:end] += np.bincount(pairs >> model.bits, table[pairs & ((1 << model.bits) - 1)], end - first)
    if np.isneginf(model.bias):  # nothing was learned
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score_texts(b.column(2), model, table))], ["doc_id", "held_out", "score"])
        release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for b in batches:
            yield b.filter(pa.array(score_texts(b.column(at), model, table) < threshold))
        release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)

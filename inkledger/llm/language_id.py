"""Language spans: script ranges narrow the candidates, Viterbi over per-word scores labels the words.

A word's score for a language is the log probability of its character 3- and 4-grams (hashed, with the blanks around
it). Languages in which the word's script is not written are ruled out first. Viterbi then finds the best sequence
of labels where every change of language costs ``switch``; runs of one label are the spans of a mixed text, and the
language with most letters is the text's. The score is that language's share of the letters.

The model is a table of 2^bits entries for every language (0.26 MB each), learned from at most ``per_lang``
training documents of each language (those with the smallest hash of their id), whatever the size of the corpus.

Defined results: a null text or one without a letter is ``und`` with score 0; without training documents all is ``und``;
letters of a script that no language uses are neutral; training ignores null lang, null and empty texts; a null id
is in fold 0, not held out; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.llm.common import SPACES, crc_fold, small_batches

FOLDS, HELD, SALTS = 4, 2, 64

#: First code point of each block, in order, and its script (0: common).
SCRIPT_STARTS = [0x0000, 0x0041, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B80, 0x0C00, 0x0E00, 0x0E80, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFE70, 0xFF00, 0x20000, 0x30000]
SCRIPT_OF = [0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 1, 2, 0, 19, 0, 20, 0, 17, 0, 20, 6, 6, 0, 20, 0]
SCRIPTS = 21


@dataclass(frozen=True)
class Params:
    bits: int = 16
    per_lang: int = 2000
    switch: float = 8.0
    smooth: float = 0.5
    worst: float = -12.0
    script_share: float = 0.01


@dataclass
class Model:
    params: Params
    langs: list[str]
    table: np.ndarray  # 2^bits x languages: log probability of an n-gram
    allowed: np.ndarray  # scripts x languages


#: Code points from here on are no letters in any version of Unicode so far; all count as the last one before.
LETTER_POINTS = 0x34000


class Letters:
    """Lookup tables over code points; built once for each process."""

    made = None

    def __init__(self) -> None:
        points = range(LETTER_POINTS)
        text = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in points]
        self.lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in text], dtype=np.uint32)
        self.letter = np.array([c.isalpha() for c in text])
        self.script = np.repeat(np.array(SCRIPT_OF, dtype=np.int8), np.diff([*SCRIPT_STARTS, 0x110000]))[: len(text)]
        self.space = np.zeros(len(text), dtype=bool)
        self.space[[ord(c) for c in SPACES]] = True

    @classmethod
    def get(cls) -> Letters:
        cls.made = cls.made or cls()
        return cls.made


@dataclass
class Words:
    """Words of several texts: begin and end (in one array of code points), first word of each text, letters, script."""

    grams: list[np.ndarray]
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    starts: np.ndarray


def read_words(texts: list[str | None], bits: int) -> Words:
    t = Letters.get()
    parts = [x or "" for x in texts]
    points = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    starts = np.concatenate([[1], 1 + np.cumsum([len(x) + 1 for x in parts])])
    points = np.minimum(points, len(t.lower) - 1)
    points = np.where(t.space[points], np.uint32(32), t.lower[points])
    inside = points != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8)))
    begin, end = edges[::2] + 1, edges[1::2] + 1
    wide = points.astype(np.uint64)
    grams = []
    for n in (3, 4):
        h = np.zeros(max(0, len(wide) - n + 1), dtype=np.uint64)
        for i in range(n):
            h = (h + wide[i : len(wide) - n + 1 + i] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        grams.append((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int32))
    letter = t.letter[points]
    count = np.add.reduceat(letter, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
    if len(begin):  # reduceat runs to the next word's begin, over blanks only
        at = np.maximum.reduceat(np.where(letter, t.script[points], 0), begin)
    else:
        at = np.zeros(0, np.int8)
    return Words(grams, begin, end, np.searchsorted(begin, starts), count, at, starts)


def gram_words(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram positions with words at their head, the word of each): grams start at the blank before the word and end
    at the blank after it."""
    n = 3 + k
    first, last = w.begin - 1, np.maximum(w.end + 1 - n, w.begin - 1)
    last = np.minimum(last, len(w.grams[k]) - 1)
    many = np.maximum(last - first + 1, 0)
    word = np.repeat(np.arange(len(w.begin)), many)
    return np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + first[word], word


def train(docs: DataFrame, params: Params = Params()) -> Model:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (crc_fold(F.col("_id"), FOLDS) != HELD))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    # the first of each salt, then the first of all: no task ranks more of a language than its salt or salts * per_lang
    chosen, order = rows.select("_id", "lang", F.pmod(F.xxhash64("_id", "text"), F.lit(SALTS)).alias("salt")), (F.xxhash64("_id"), F.col("_id"))
    for keys in (("lang", "salt"), ("lang",)):
        chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= params.per_lang)
    sample = rows.join(F.broadcast(chosen.select("_id").distinct()), "_id").select("lang", "text")
    bits, number = params.bits, {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = (1 << bits) + SCRIPTS
        for b in batches:
            seen, letters = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = read_words([text], bits)
                for k in range(2):
                    at, _ = gram_words(w, k)
                    seen.append(w.grams[k][at].astype(np.int64) + number[lang] * width)
                scripts = np.bincount(w.script, w.letters, SCRIPTS).astype(np.int64)
                letters += [(number[lang] * width + (1 << bits) + x, scripts[x]) for x in np.flatnonzero(scripts)]
            key, n = np.unique(np.concatenate(seen or [np.zeros(0, np.int64)]), return_counts=True)
            key = np.concatenate([key, np.array([x for x, _ in letters], np.int64)])
            n = np.concatenate([n, np.array([x for _, x in letters], np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(key // width), pa.array(key % width), pa.array(n)], ["l", "i", "n"])

    if not langs:
        return Model(params, [], np.zeros((1 << bits, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    got: pd.DataFrame = sample.mapInArrow(count, "l long, i long, n long").groupBy("l", "i").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(langs), (1 << bits) + SCRIPTS))
    both[got["l"], got["i"]] = got["n"]
    grams, scripts = both[:, : 1 << bits], both[:, 1 << bits :]
    table = np.log((grams + params.smooth) / (grams.sum(1, keepdims=True) + params.smooth * (1 << bits)))
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(params, langs, np.ascontiguousarray(table.T.astype(np.float32)), share.T >= params.script_share)


def word_scores(w: Words, m: Model) -> np.ndarray:
    """words x languages: log probabilities relative to the best, no lower than ``worst``; 0 for neutral words."""
    out = np.zeros((len(w.begin), len(m.langs)), np.float32)
    for k in range(2):
        at, word = gram_words(w, k)
        if len(at):
            full, heads = np.unique(word, return_index=True)
            out[full] += np.add.reduceat(m.table[w.grams[k][at]], heads, axis=0)
    allowed = m.allowed[w.script]
    out = np.where(allowed, out, -np.inf)
    neutral = (w.letters == 0) | ~allowed.any(1)
    out[neutral] = 0
    out = np.maximum(out - out.max(1, keepdims=True), m.params.worst)
    return np.where(allowed | neutral[:, None], out, 2 * m.params.worst).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The label of each word. All texts take a step together, longest first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    base, length = first[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), side="left")
    jumped, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    state = np.zeros((len(length), scores.shape[1]), np.float32)
    label, out = np.zeros(len(length), np.int64), np.zeros(len(scores), np.int64)
    for t in range(steps):
        at, s = base[: alive[t]] + t, state[: alive[t]]
        top = s.argmax(1)
        jump = (s[np.arange(len(s)), top] - switch)[:, None]
        jumped[at], best[at] = jump > s, top
        state[: alive[t]] = np.maximum(s, jump) + scores[at]
    if steps:
        label = state.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = base[:n] + t
        out[at] = label[:n]
        label[:n] = np.where(jumped[at, label[:n]], best[at], label[:n])
    return out


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score; with ``spans`` also the runs of one language as (start, end, lang) in code points."""
    small_batches(docs.sparkSession)
    kinds = "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "text")

    def some(texts: list[str | None]) -> tuple[list[str], np.ndarray, list]:
        w = read_words(texts, model.params.bits)
        if not model.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        labels = viterbi(word_scores(w, model), w.first, model.params.switch)
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        n = len(model.langs)
        letters = np.bincount(doc * n + labels, w.letters, len(texts) * n).reshape(len(texts), n)
        total, top = letters.sum(1), letters.argmax(1)
        name = [model.langs[x] if k else "und" for x, k in zip(top, total, strict=True)]
        runs: list = [[] for _ in texts]
        if spans and len(labels):
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(labels) != 0) | (np.diff(doc) != 0)]))
            for x, y in zip(heads, [*heads[1:], len(labels)], strict=True):
                if total[doc[x]]:
                    o = w.starts[doc[x]]
                    runs[doc[x]].append({"start": int(w.begin[x] - o), "end": int(w.end[y - 1] - o), "lang": model.langs[labels[x]]})
        return name, letters[np.arange(len(texts)), top] / np.maximum(total, 1), runs

    limit = 2_000_000 * 64 // max(64, len(model.langs))  # scores are words x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column(2).to_pylist(), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") < limit):
                    held += len(texts[end] or "")
                    end += 1
                name, score, runs = some(texts[at:end])
                columns = [b.column(0).slice(at, end - at), b.column(1).slice(at, end - at), pa.array(name, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    columns.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "spans"][: len(columns)])
                at = end

    return rows.mapInArrow(run, kinds)

"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. A window of ``window`` sequences gives each queue a quantum in proportion to its
weight; what a quantum leaves over (the fraction of a token, or everything once the queue is empty) is carried to the next
window, so after w windows a queue has been served floor(share * v) tokens, v growing by the same step in every window
until a queue runs dry. That closed form lets every task place its
own documents: a document's place in its queue follows from the tokens before it in its partition plus a small table of
tokens per (partition, source), which is how deficits pass from one partition to the next. When a queue runs dry, the
others share its quantum from the following window on. Every source has a queue of its own, however many there are: windows grow
with the queues, and a queue whose share of a window is less than a least piece (512 tokens) saves its deficit until it can pay for
one, so many sources do not grind documents to single tokens. Documents are cut where a quantum or a sequence ends, so only the
last sequence has padding.

The text is tokenised once; token ids are written as a table, and pieces come from a narrow pass over it.

Defined results: a null or empty text is the end id alone; a null source is a queue of its own; null or repeated ids are
separate documents; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.llm.common import Scratch, release

#: Up to so many queues are summed one by one; with more, the starts of all queues in a window are kept, in so many numbers.
FEW_QUEUES, KEPT_STARTS = 64, 1 << 23
#: Tokens of a window for each queue, at least, and the least that a queue is paid if its share of a window is smaller.
SHARE, LEAST = 64, 512
#: ASCII punctuation.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class WordTokens:
    """Token ids of texts, as bytes. No token of these vocabularies spans white space, so each word is encoded once and
    kept; words not met for ``keep`` / 2 others are forgotten. Where the tokenizer itself folds case and cuts a run of
    punctuation from the letters before it, words that differ so share their ids. New words of letters are encoded together, as
    each ends with the one token that is marked as a word's end."""

    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        size = self.tokenizer.get_vocab_size()
        self.wide = np.uint16 if size <= 1 << 16 else np.uint32
        self.young, self.old = {}, {}
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.folds, self.cuts = ids("Ab C") == ids("ab c"), all(ids(f"ab{x} c1{x}") == ids(f"ab {x} c1 {x}") for x in (".", ",", "!?", "'", "'-'", "%%", "...", "_", "|>"))

    def encode(self, words: list[bytes]) -> None:
        plain = [w.decode() for w in words]
        apart, joint = [w for w in plain if not w.isalpha()], [w for w in plain if w.isalpha()]
        for at in range(0, len(joint), 4000):
            some = joint[at : at + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.wide)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or (len(ends) and ends[-1] != len(ids)):
                apart += some
                continue
            blob, size = ids.tobytes(), ids.itemsize
            self.young.update((w.encode(), blob[x * size : y * size]) for w, x, y in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        for w, e in zip(apart, self.tokenizer.encode_batch_fast(apart, add_special_tokens=False), strict=True):
            self.young[w.encode()] = np.array(e.ids, self.wide).tobytes()

    def learn(self, words: set[bytes]) -> None:
        known = words & self.old.keys()
        self.young.update((w, self.old[w]) for w in known)
        words -= known
        stems = {w: stem for w in words if len(stem := w.rstrip(MARKS)) < len(w) and stem[-1:].isalnum() and b"<" not in w} if self.cuts else {}
        if stems:
            self.learn({x for w, stem in stems.items() for x in (stem, w[len(stem) :])} - self.young.keys())
        self.encode(list(words - stems.keys()))
        self.young.update((w, self.young[stem] + self.young[w[len(stem) :]]) for w, stem in stems.items())

    def batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > self.keep // 2:
            self.young, self.old = {}, self.young
        raw = [(t or "").encode() for t in texts]
        # names of special tokens are matched before case is folded
        words = [(r.lower() if self.folds and b"<" not in r else r).split() for r in raw]
        found = [list(map(self.young.get, ws)) for ws in words]
        gaps = [[k for k, i in enumerate(ids) if i is None] if None in ids else [] for ids in found]
        self.learn({ws[k] for ws, own in zip(words, gaps, strict=True) for k in own})
        for ws, ids, own in zip(words, found, gaps, strict=True):
            for k in own:
                ids[k] = self.young[ws[k]]
        return list(map(b"".join, found))


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each worker process, so that words met by earlier tasks are known."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


class Rounds:
    """How many tokens of each queue the first w windows hold, and the reverse. Queues without a weight are served alike
    once all others are dry. Phases are pairs of numbers, so memory is in proportion to the queues."""

    def __init__(self, totals: list[int], weights: list[float], window: int, least: int = 1):
        self.totals, share = np.array(totals, dtype=np.int64), np.array(weights, dtype=float)
        self.late = ~(share > 0)
        self.share = np.where(self.late, 1.0, share)
        per_window = self.share * window / max(self.share[(self.totals > 0) & ~self.late].sum() or self.share.sum(), 1e-300)
        self.unit = np.where(per_window < least, least, 1)  # what a queue is paid in: single tokens, or a least piece at a time
        first, self.starts = 0, {}
        self.phases: list[np.ndarray] = []  # for queues with and without a weight: first window, v there, step of v
        for late in (False, True):
            mine = np.flatnonzero((self.late == late) & (self.totals > 0))
            v, phases = 0.0, [(0, 0.0, 0.0)]
            while len(mine):
                step = window / self.share[mine].sum()
                phases.append((first, v, step))
                ahead = max(1, int(np.ceil(((self.totals[mine] / self.share[mine]).min() - v) / step - 1e-9)))
                first, v = first + ahead, v + ahead * step
                mine = mine[self.reached(mine, np.full(len(mine), v)) < self.totals[mine]]
            phases.append((first, v, 0.0))
            self.phases.append(np.array(phases))
        self.windows = first

    def reached(self, queue: np.ndarray, v: np.ndarray) -> np.ndarray:
        paid, total, unit = np.floor(self.share[queue] * v * (1 + 1e-13) + 1e-9).astype(np.int64), self.totals[queue], self.unit[queue]
        return np.where(paid >= total, total, paid // unit * unit)

    def served(self, queue: np.ndarray, windows: np.ndarray) -> np.ndarray:
        v = np.zeros(len(windows))
        for late, phases in enumerate(self.phases):
            at = np.searchsorted(phases[:, 0], windows, side="right") - 1
            v = np.where(self.late[queue] == bool(late), phases[at, 1] + (windows - phases[at, 0]) * phases[at, 2], v)
        return self.reached(queue, v)

    def window_of(self, queue: int, place: np.ndarray) -> np.ndarray:
        """The last window that starts at or before a place in the queue."""
        low, high, q = np.zeros(len(place), dtype=np.int64), np.full(len(place), self.windows), np.full(len(place), queue)
        while (high - low > 1).any():
            middle = (low + high) // 2
            started = self.served(q, middle) <= place
            low, high = np.where(started, middle, low), np.where(started, high, middle)
        return low

    def before(self, queue: int, windows: np.ndarray) -> np.ndarray:
        """Where the queue's part of a window starts in the packed stream."""
        if len(self.totals) <= FEW_QUEUES:
            return sum((self.served(np.full(len(windows), j), windows + (j < queue)) for j in range(len(self.totals))), np.zeros(len(windows), dtype=np.int64))
        each, which = np.unique(windows, return_inverse=True)
        return np.array([self.starts_of(w)[queue] for w in each.tolist()], dtype=np.int64)[which]

    def starts_of(self, window: int) -> np.ndarray:
        """Where each queue's part of a window starts."""
        if window not in self.starts:
            if len(self.starts) * len(self.totals) > KEPT_STARTS:
                self.starts.clear()
            every = np.arange(len(self.totals))
            opens, ends = (self.served(every, np.full(len(every), w)) for w in (window, window + 1))
            part = ends - opens
            self.starts[window] = opens.sum() + np.cumsum(part) - part
        return self.starts[window]


def cut(rounds: Rounds, queue: int, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first token, end token, place in the packed stream) of the pieces of documents at [start, end)."""
    first, last = rounds.window_of(queue, start), rounds.window_of(queue, end - 1)
    doc = np.repeat(np.arange(len(start)), last - first + 1)
    w = np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[doc]
    q = np.full(len(w), queue)
    opens = rounds.served(q, w)
    a, b = np.maximum(start[doc], opens), np.minimum(end[doc], rounds.served(q, w + 1))
    place, full = rounds.before(queue, w) + a - opens, b > a
    doc, a, b, place = doc[full], a[full], b[full], place[full]
    head, tail = place // length, (place + (b - a) - 1) // length
    many = tail - head + 1
    piece = np.repeat(np.arange(len(doc)), many)
    seq = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many) + head[piece]
    x, y = np.maximum(place[piece], seq * length), np.minimum((place + (b - a))[piece], (seq + 1) * length)
    shift = (a - place)[piece] - start[doc[piece]]
    return doc[piece], x + shift, y + shift, x


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, window: int = 16, end_id: int = 1, weights: dict[str | None, float] | None = None, least: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``weights`` are target
    proportions of tokens by source; without them windows get the corpus's own proportions. ``least`` is what a queue is paid at a
    time if its share of a window is smaller: 512 tokens; given weights hold in every window to the token, unless it is given too."""
    scratch = Scratch(docs.sparkSession, "pack")
    queue = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ahead, part = word_tokens(tokenizer), {}, TaskContext.get().partitionId()
        end, size = np.array([end_id], tokens.wide).tobytes(), np.dtype(tokens.wide).itemsize
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = [x + end for x in tokens.batch(some.column(2).to_pylist())]
                n, before = [len(x) // size for x in ids], []
                for q, k in zip(some.column(1).to_pylist(), n, strict=True):
                    before.append(ahead.get(q, 0))
                    ahead[q] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "part", "ahead", "n", "ids"],
                )
        release()

    encoded = scratch.write(rows.mapInArrow(encode, "doc_id long, queue string, part int, ahead long, n long, ids binary"), "encoded")
    counts = encoded.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))), "offsets")
    lanes = sorted((r[0], r[1]) for r in offsets.groupBy("queue").agg(F.sum("n")).collect())
    totals = [n for _, n in lanes]
    named = {("null" if k is None else f"={k}"): v for k, v in (weights or {}).items()}
    # a window grows with the queues, so that working out where its parts start costs less than its tokens
    least = min(length, least or (1 if weights else LEAST))
    tokens = max(window * length, SHARE * len(lanes) if least > 1 else 0)
    rounds = Rounds(totals, [float(named.get(k, 0.0)) for k, _ in lanes] if weights else [float(n) for n in totals], tokens, least)
    number = {k: i for i, (k, _) in enumerate(lanes)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokens.clear()
        release()
        for b in batches:
            doc_id, lane_of, start, n, blobs = b.column(0), b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4)
            own = np.array([number[x] for x in lane_of], dtype=np.int64)
            by_queue = np.argsort(own, kind="stable")
            for mine in np.split(by_queue, np.flatnonzero(np.diff(own[by_queue])) + 1) if len(own) else []:
                doc, first, end, at = cut(rounds, int(own[mine[0]]), start[mine], start[mine] + n[mine], length)
                doc, crc, last, ids = mine[doc], [], -1, None
                for d, x, y in zip(doc.tolist(), first.tolist(), end.tolist(), strict=True):
                    if d != last:
                        blob = blobs[d].as_py()
                        ids, last = np.frombuffer(blob, dtype=np.uint16 if len(blob) == 2 * n[d] else np.uint32).astype("<u4"), d
                    crc.append(zlib.crc32(ids[x:y].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(doc)), pa.array(first), pa.array(end - first), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(at // length), pa.array(at % length)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    placed = encoded.join(offsets.select("part", "queue", "before"), ["part", "queue"])
    placed = placed.select("doc_id", "queue", (F.col("before") + F.col("ahead")).alias("start"), "n", "ids")
    return placed.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

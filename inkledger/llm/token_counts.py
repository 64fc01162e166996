"""Token counts of a unigram tokenizer without building tokens.

Words (split at ASCII white space, a word-start mark put before each) are segmented one by one. An Aho-Corasick automaton
enumerates the vocabulary pieces that end at each character; dynamic programming keeps, for each prefix, the best score, the
number of pieces and whether the last one is unknown. The tie rules are those of the public unigram tokenizers: a later
candidate must be strictly better, so the longest piece wins a tie; a character without a piece of its own costs the worst
score less ten; neighbouring unknown characters count as one token.

The vocabulary is read from a sentencepiece model file on each worker (the path is a parameter): its ordinary pieces with
their scores. Counts of words are kept between texts, so most words cost one lookup.

Defined results: null and empty texts have no tokens; repeated rows are counted each; null ids are kept; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import small_batches

MARK = "\u2581"
UNKNOWN = 1 << 32


def vocabulary(path: str) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class Counter:
    def __init__(self, pieces: dict[str, float], keep: int = 1_000_000):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        if pieces:
            self.machine.make_automaton()
        self.pieces, self.lost = pieces, min(pieces.values(), default=0.0) - 10.0
        self.keep, self.young, self.old = keep, {}, {}

    def pack(self, text: str) -> int:
        """Tokens of a text without blanks, plus UNKNOWN for each unknown one among them."""
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        if self.pieces:
            for end, piece in self.machine.iter(text):
                ends[end].append(piece)
        scores, counts, unknown = [0.0], [0], [False]
        for end, found in enumerate(ends):
            best, count, lost, single = None, 0, False, False
            for size, score in sorted(found, reverse=True) if len(found) > 1 else found:
                single |= size == 1
                start = end + 1 - size
                if best is None or score + scores[start] > best:
                    best, count = score + scores[start], counts[start] + 1
            if not single and (best is None or self.lost + scores[end] > best):
                best, lost = self.lost + scores[end], True
                count = counts[end] if unknown[end] else counts[end] + 1 + UNKNOWN
            scores.append(best)
            counts.append(count)
            unknown.append(lost)
        return counts[-1]

    def batch(self, texts: list[str | None]) -> list[int]:
        words = [(t or "").encode().split() for t in texts]
        if len(self.young) > self.keep // 2:
            self.young, self.old = {}, self.young
        for w in set().union(*words) - self.young.keys():
            self.young[w] = self.old[w] if w in self.old else self.pack(MARK + w.decode())
        get = self.young.__getitem__
        return [sum(map(get, ws)) for ws in words]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                found = count.batch(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x % UNKNOWN for x in found], pa.int64()), pa.array([x // UNKNOWN for x in found], pa.int64())], ["doc_id", "n_tokens", "n_unknown"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_unknown long")

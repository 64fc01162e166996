"""Repeated passages by blockwise suffix sorting with a difference cover.

A byte goes when a ``length``-byte string that covers it also starts elsewhere in the corpus. Sorting all suffixes of a corpus
is out of reach, so suffixes are first dealt into buckets that can be sorted one at a time:

1. The bucket of a suffix is the least-hashed ``gram`` within its first ``length`` bytes. Equal strings have it at the same
   place, so they meet in one bucket, and the suffixes of one document in one bucket are a run of neighbouring starts. A run
   (its bucket, the hash of the bytes it spans, where it lies) is one row for about 185 bytes of text.
2. Runs with equal bytes collapse to a class by an aggregate. A bucket with a single run is unique; in a bucket with a
   single class all runs repeat. Neither needs sorting, which leaves the edges of repeated passages.
3. The bytes of one run of each class in the other buckets are fetched, and every bucket is sorted in one task: by leading
   bytes, then three-way partitions in which long ties are settled by ranks of a difference cover's sample, computed once for
   the block. Starts whose first ``length`` bytes tie with another's repeat. A bucket with more than ``bucket_rows`` classes
   (an edge of a passage that very many documents share) is first split by longer keys, in the end by whole strings.
4. Results go back from classes to runs and from runs to documents. All texts move once, to be written apart by whether a
   bucket of theirs repeats; only those with such a bucket move again.

`cut_repeats` gives the remaining bytes and the removed spans, `remove_repeats` figures that it derives from them.

Strings are compared as bytes in step 3; steps 1 and 2 rely on 128 bits of hash. Memory is bounded by the bucket size.

Defined results: a null or short text has nothing to remove; identical texts of at least ``length`` bytes lose all; rows that
repeat an id are documents of their own, null ids as well; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import _INVERSE, _ROOT, _VALUES, Scratch, chunks, mix, powers

LENGTH, GRAM = 400, 32
PERIOD = 32


# ---------------------------------------------------------------- runs of starts


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[begin]) * powers(_INVERSE, len(prefix))[begin] + (end - begin).astype(np.uint64))


def window_least(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of each window, from prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, window)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - window + 1], head[window - 1 : n])


def runs_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, bucket, print, anchor, first, last): starts first..last of a text have the gram at ``anchor``."""
    sizes = np.diff(starts) - 1
    if len(data) < length or not (sizes >= length).any():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers(_ROOT, len(data)), out=prefix[1:])
    at = np.arange(len(data) - gram + 1)
    hashes = range_hash(prefix, at, at + gram)
    least = window_least((hashes >> np.uint64(36) << np.uint64(36)) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64((1 << 36) - 1)).astype(np.int64)
    ok = np.zeros(len(anchor), dtype=bool)
    text = np.zeros(len(anchor), dtype=np.int64)
    for d in np.flatnonzero(sizes >= length):
        ok[starts[d] : starts[d] + sizes[d] - length + 1] = True
        text[starts[d] : starts[d] + sizes[d] - length + 1] = d
    place = np.flatnonzero(ok)
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(anchor[place]) != 0) | (np.diff(text[place]) != 0)]))
    first, last = place[heads], place[np.append(heads[1:], len(place)) - 1]
    a, d = anchor[first], text[first]
    shape = mix((a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    return d, hashes[a].view(np.int64), mix(range_hash(prefix, first, last + length) + shape).view(np.int64), a - starts[d], first - starts[d], last - starts[d]


def find_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rows: doc_id, k, text. Gives doc_id, k, bucket, print, anchor, first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, data, starts in chunks(b.column(2), 2 << 20):
                text, *rest = runs_of(data, starts, length, gram)
                own = pa.array(text + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "k", "bucket", "print", "anchor", "first", "last"])

    return rows.mapInArrow(run, "doc_id long, k long, bucket long, print long, anchor long, first long, last long")


# ---------------------------------------------------------------- sorting a bucket


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo the period occurs between two of them."""
    cover = [0, 1]
    while len(have := {(a - b) % period for a in cover for b in cover}) < period:
        gain = {c: len(have | {(c - x) % period for x in cover} | {(x - c) % period for x in cover}) for c in range(period) if c not in cover}
        cover.append(max(gain, key=gain.get))
    return sorted(cover)


COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: For two residues, the least shift that takes both into the cover.
SHIFT = np.array([[next(s for s in range(PERIOD) if _IN_COVER[(a + s) % PERIOD] and _IN_COVER[(b + s) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of ranks, order-preserving."""
    out = np.unique(keys[0], return_inverse=True)[1].astype(np.uint64)
    for k in keys[1:]:
        out = np.unique(out << np.uint64(32) | np.unique(k, return_inverse=True)[1].astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return out


class Block:
    """Text of some buckets with the ranks of its cover sample to a depth that ends within ``length``."""

    def __init__(self, data: np.ndarray, length: int):
        self.length = length
        padded = np.concatenate([data, np.zeros(2 * length + 2 * PERIOD + 8, dtype=np.uint8)])
        n = len(data) + length + 2 * PERIOD
        self.word = np.zeros(n, dtype=np.uint64)
        for i in range(8):
            self.word |= padded[i : n + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.depth = (length - PERIOD) // PERIOD * PERIOD
        self.sample = np.flatnonzero(_IN_COVER[np.arange(n) % PERIOD])
        where = np.zeros(n, dtype=np.int64)
        where[self.sample] = np.arange(len(self.sample))
        ahead = lambda by: np.minimum(self.sample + by, self.sample[-1])
        last = n - 1
        rank = ranks(*(self.word[np.minimum(self.sample + i, last)] for i in range(0, PERIOD, 8)))
        deep = PERIOD
        while deep * 2 <= self.depth:
            step = ahead(deep)
            rank = ranks(rank, rank[where[np.where(_IN_COVER[step % PERIOD], step, self.sample[-1])]])
            deep *= 2
        if deep < self.depth:
            step = ahead(self.depth - deep)
            rank = ranks(rank, rank[where[np.where(_IN_COVER[step % PERIOD], step, self.sample[-1])]])
        self.rank = np.zeros(n, dtype=np.uint64)
        self.rank[self.sample] = rank

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the first ``length`` bytes at b lie before, equal or after those at a; 8 bytes are known equal."""
        out = np.zeros(len(a), dtype=np.int8)
        tail = range(self.length - (self.length - self.depth + 7) // 8 * 8, self.length, 8)
        for step in (*range(8, PERIOD, 8), None, *tail):
            at = SHIFT[a % PERIOD, b % PERIOD] if step is None else step
            x, y = (self.rank[a + at], self.rank[b + at]) if step is None else (self.word[a + at], self.word[b + at])
            out = np.where(out == 0, (y > x).astype(np.int8) - (y < x).astype(np.int8), out)
        return out

    def classes(self, starts: np.ndarray) -> np.ndarray:
        """A number for each start, equal where the first ``length`` bytes are equal: leading bytes deal the starts
        out, then each part is split around a pivot until all of it ties."""
        group = ranks(self.word[starts]).astype(np.int64)
        active, number = np.arange(len(starts)), int(group.max(initial=-1)) + 1
        while len(active):
            order = active[np.argsort(group[active], kind="stable")]
            head = np.concatenate([[True], np.diff(group[order]) != 0])
            sizes = np.diff(np.append(np.flatnonzero(head), len(order)))
            order, pivot = order[np.repeat(sizes > 1, sizes)], np.repeat(order[head], sizes)[np.repeat(sizes > 1, sizes)]
            side = self.compare(starts[pivot], starts[order])
            apart = side != 0
            active = order[apart]
            if len(active):
                parts = group[active] * 3 + side[apart] + 1
                group[active] = number + np.unique(parts, return_inverse=True)[1]
                number = int(group[active].max()) + 1
        return group


def repeated_starts(rows: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each (bytes, weight) of some buckets, which of its starts repeat."""
    sizes = np.array([len(x) for x, _ in rows])
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    many = sizes - length + 1
    starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offset, many)
    group = Block(np.frombuffer(b"".join(x for x, _ in rows), dtype=np.uint8), length).classes(starts)
    _, group = np.unique(group, return_inverse=True)
    held = np.bincount(group, np.repeat([w for _, w in rows], many))
    return np.split(held[group] > 1, np.cumsum(many)[:-1])


def sort_buckets(rows: DataFrame, length: int, block_bytes: int = 1 << 20) -> DataFrame:
    """rows: bucket, print, weight, low, bytes, sorted by bucket within a partition, where low is the distance from the anchor
    of the last start. Gives bucket, print, spans: distances (from, to) of repeated starts, from >= to."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        spans = []
        for (_, _, _, low, text), again in zip(held, repeated_starts([(r[4], r[2]) for r in held], length), strict=True):
            edges = np.flatnonzero(np.diff(again.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            high = low + len(text) - length
            spans.append([{"high": int(high - x), "low": int(high - y + 1)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        kind = pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held]), pa.array([r[1] for r in held]), pa.array(spans, kind)], ["bucket", "print", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= block_bytes and r[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[4]), r[0]
        if held:
            yield solve(held)

    return rows.mapInArrow(run, "bucket long, print long, spans array<struct<high:long,low:long>>")


# ---------------------------------------------------------------- the operator


def cover_of(high: Column, low: Column, length: int) -> Column:
    """The bytes, relative to the anchor, that starts at distances high..low cover."""
    return F.struct((-high).alias("from"), (F.lit(length) - low).alias("to"))


def split_buckets(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Splits runs into blocks of ``width`` distances and their buckets by the bytes all starts of a block share.
    rows: bucket, print, owner columns, weight, low, bytes."""
    high = F.col("low") + F.octet_length("bytes") - length
    blocks = rows.withColumn("high", high).withColumn("block", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"high div {width}"))))
    low2, high2 = F.greatest("low", F.col("block") * width), F.least("high", F.col("block") * width + width - 1)
    part = F.substr("bytes", (F.col("high") - high2 + 1).cast("int"), (high2 - low2 + length).cast("int"))
    core = F.substr("bytes", (F.col("high") - F.col("block") * width + 1).cast("int"), F.lit(length - width + 1))
    return blocks.select("home_bucket", "home_print", F.xxhash64("bucket", "block", core).alias("bucket"), F.xxhash64(F.lit(1), part, low2, high2).alias("print"), "weight", low2.alias("low"), part.alias("bytes"))


def repeated_spans(fetched: DataFrame, length: int, bucket_rows: int, scratch: Scratch) -> DataFrame:
    """home_bucket, home_print, high, low: ranges of repeated starts of each class. fetched: bucket, print, weight, low, bytes."""
    now, out = fetched.withColumns({"home_bucket": F.col("bucket"), "home_print": F.col("print")}), []
    for step, width in enumerate((64, 8, 1, None)):
        classes = now.groupBy("bucket", "print").agg(F.least(F.sum("weight"), F.lit(2)).alias("weight"), F.first("low").alias("low"), F.first("bytes").alias("bytes"))
        sizes = now.select("bucket", "print").distinct().groupBy("bucket").agg(F.count("*").alias("n"))
        sized = scratch.write(now.groupBy("bucket", "print").agg(F.sum("weight").alias("w")).join(sizes, "bucket"), f"sizes-{step}")
        homes = scratch.write(now.select("home_bucket", "home_print", "bucket", "print", "low", (F.octet_length("bytes") - length + F.col("low")).alias("high")), f"homes-{step}")
        whole = homes.join(sized.filter("w > 1"), ["bucket", "print"])
        out.append(whole.select("home_bucket", "home_print", "high", "low"))
        unsure = sized.filter("n > 1").groupBy("bucket").agg(F.max("n").alias("n"), F.min("w").alias("least")).filter("least < 2").select("bucket", "n")
        small = classes.join(unsure.filter(F.col("n") <= bucket_rows).select("bucket"), "bucket")
        small = small.select("bucket", "print", "weight", "low", "bytes").repartition("bucket").sortWithinPartitions("bucket")
        solved = scratch.write(sort_buckets(small, length), f"solved-{step}")
        spans = homes.drop("high", "low").join(solved, ["bucket", "print"]).select("home_bucket", "home_print", F.inline("spans"))
        out.append(spans)
        large = unsure.filter(F.col("n") > bucket_rows).select("bucket")
        if width is None or large.isEmpty():
            break
        now = scratch.write(split_buckets(now.join(large, "bucket"), length, width), f"split-{step}")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, kept (the remaining bytes), spans (the maximal removed runs by place, as bytes start..end,
    end exclusive)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(3), text, "doc_id").alias("k"), text.alias("text"))
    runs = scratch.write(find_runs(rows, length, gram), "runs")

    first_run = F.struct("k", "doc_id", "anchor", "first", "last")
    classes = scratch.write(runs.groupBy("bucket", "print").agg(F.count("*").alias("n"), F.min(first_run).alias("run")), "classes")
    buckets = classes.groupBy("bucket").agg(F.sum("n").alias("total"), F.count("*").alias("classes"), F.min("n").alias("least")).filter("total > 1")
    known = scratch.write(classes.join(buckets, "bucket").select("bucket", "print", "n", "run", (F.col("least") < 2).alias("sort")), "known")

    touched = runs.join(known.select("bucket", "print", "n", "sort"), ["bucket", "print"]).select("k", "doc_id", "anchor", "first", "last", "bucket", "print", "n")
    touched = scratch.write(touched, "touched")
    same = lambda a, b: (a["k"] == b["k"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    for done in ("runs", "classes"):
        scratch.drop(done)
    need = touched.select("k", "doc_id").distinct().withColumn("hit", F.lit(1))
    texts = scratch.write(rows.join(need, same(rows, need), "left").select(rows["k"], rows["doc_id"], "text", F.coalesce("hit", F.lit(0)).alias("hit")), "texts", "hit")
    plain, texts = texts.filter("hit = 0"), texts.filter("hit = 1").drop("hit")

    asked = known.filter("sort").select("bucket", "print", F.least(F.col("n"), F.lit(2)).alias("weight"), "run.*")
    fetched = asked.join(texts, same(asked, texts)).select(
        "bucket", "print", "weight", (F.col("anchor") - F.col("last")).alias("low"), F.substr("text", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + length).cast("int")).alias("bytes")
    )
    spans = repeated_spans(scratch.write(fetched, "fetched"), length, bucket_rows, scratch)
    covers = scratch.write(spans.distinct().groupBy("home_bucket", "home_print").agg(F.collect_list(cover_of(F.col("high"), F.col("low"), length)).alias("covers")), "covers")

    whole = touched.filter("n > 1").select("k", "doc_id", F.col("first").alias("from"), (F.col("last") + length).alias("to"))
    single = touched.filter("n = 1").join(covers.withColumnsRenamed({"home_bucket": "bucket", "home_print": "print"}), ["bucket", "print"])
    parts = single.select("k", "doc_id", "anchor", F.inline("covers")).select("k", "doc_id", (F.col("anchor") + F.col("from")).alias("from"), (F.col("anchor") + F.col("to")).alias("to"))
    marked = whole.unionByName(parts).groupBy("k", "doc_id").agg(F.collect_set(F.struct("from", "to")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, gone = [], []
            for raw, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for x, y in sorted((m["from"], m["to"]) for m in marks or ()):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                edges = [0, *(e for m in merged for e in m), len(raw)]
                left.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                gone.append([{"start": x, "end": y} for x, y in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.binary()), pa.array(gone, kind)], ["doc_id", "kept", "spans"])

    joined = texts.join(marked, same(texts, marked), "left").select(texts["doc_id"], "text", "marks")
    shape = "doc_id long, kept binary, spans array<struct<start:long,end:long>>"
    return joined.mapInArrow(cut, shape).unionByName(plain.select("doc_id", F.col("text").alias("kept"), F.from_json(F.lit("[]"), "array<struct<start:long,end:long>>").alias("spans")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left; a part of a character that
    lost its other bytes shows as U+FFFD, kept_sha256 is of the bytes)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut_repeats(docs, length, gram, bucket_rows).select(
        "doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text")
    )

"""Vector codes: every part of a vector becomes the number of its nearest codebook entry, found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import vectors
from inkledger.llm.common import Scratch

#: Integer components are held within these bounds, so that sums of squares stay exact.
LIMIT = 1 << 25
#: Vector parts that are searched side by side, and neighbours of a list that are looked at in one step.
SIDE, STEP = 2048, 8


@dataclass(frozen=True)
class Codes:
    parts: int = 4
    entries: int = 256
    scale: int = 1024
    rounds: int = 4


def integers(mat: np.ndarray, p: Codes) -> np.ndarray:
    """(vector, part, component): floor(scale * x); a length that the parts do not divide is filled up with zeros."""
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(mat * p.scale), -LIMIT, LIMIT).astype(np.int64)
    wide = max(1, -(-mat.shape[1] // p.parts))
    return np.pad(whole, ((0, 0), (0, wide * p.parts - whole.shape[1]))).reshape(len(whole), p.parts, wide)


class Orchard:
    """One codebook: for each entry all entries by squared distance, the lower index first on ties."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.first = np.argsort(entries[:, 0], kind="stable")
        self.heads = entries[self.first, 0]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of each point, ties to the lower index."""
        found = [self._side(points[i : i + SIDE]) for i in range(0, len(points), SIDE)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _side(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points walk side by side down the list of their entry. One that meets a nearer entry goes on in that entry's list,
        and past what it has visited; one whose list lies beyond twice its distance is done: whatever follows is farther from it
        than its entry. At exactly twice there may be a tie, so the walk goes on."""
        many, total = len(points), len(self.entries)
        best = self.first[np.minimum(np.searchsorted(self.heads, points[:, 0]), total - 1)]
        dist = ((points - self.entries[best]) ** 2).sum(axis=1)
        visited = np.zeros((many, total), dtype=bool)
        visited[np.arange(many), best] = True
        place, walking = np.zeros(many, np.int64), np.arange(many)
        while len(walking):
            at = place[walking, None] + np.arange(STEP)
            inside = at < total
            at = np.minimum(at, total - 1)
            own = best[walking, None]
            near = inside & (self.gaps[own, at] <= 4 * dist[walking, None])
            seen = self.order[own, at]
            row, col = np.nonzero(near & ~visited[walking[:, None], seen])
            who, entry = walking[row], seen[row, col]
            visited[who, entry] = True
            place[walking] += STEP
            going = near[:, -1] & (place[walking] < total)
            if len(who):
                away = ((points[who] - self.entries[entry]) ** 2).sum(axis=1)
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                least = np.minimum.reduceat(away, heads)
                tied = np.where(away == np.repeat(least, np.diff([*heads, len(row)])), entry, total)
                entry, who = np.minimum.reduceat(tied, heads), who[heads]
                better = (least < dist[who]) | ((least == dist[who]) & (entry < best[who]))
                jump = who[better]
                best[jump], dist[jump], place[jump] = entry[better], least[better], 0
                going[row[heads][better]] = True
            walking = walking[going]
        return best, dist


def _assigned(b: pa.RecordBatch, at: int, dim: int, books: list[Orchard], p: Codes) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    whole = integers(vectors.matrix(b.column(at), dim), p)
    return whole, [book.nearest(whole[:, i]) for i, book in enumerate(books)]


def next_entries(rows: DataFrame, entries: np.ndarray, dim: int, p: Codes) -> np.ndarray:
    """One round: every part goes to its nearest entry, entries become the floored means of their parts. Each task sums up what
    it reads; the sums (parts * entries * components, whatever the rows) are added by an aggregate."""
    parts, many, wide = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, sums = [Orchard(e) for e in entries], np.zeros((parts, many, wide + 1), np.int64)
        for b in batches:
            whole, found = _assigned(b, 0, dim, books, p)
            for i, (code, _) in enumerate(found):
                for j in range(wide):
                    sums[i, :, j] += np.bincount(code, weights=whole[:, i, j], minlength=many).astype(np.int64)
                sums[i, :, wide] += np.bincount(code, minlength=many)
        slots = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(sums.reshape(-1)[slots], pa.int64())], ["slot", "total"])

    sums = np.zeros(parts * many * (wide + 1), np.int64)
    for slot, total in rows.select("embedding").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total")).collect():
        sums[slot] = total
    sums = sums.reshape(parts, many, wide + 1)
    count = sums[:, :, wide:]
    return np.where(count > 0, sums[:, :, :wide] // np.maximum(count, 1), entries)


def fit(rows: DataFrame, dim: int, p: Codes) -> np.ndarray:
    """The codebooks (part, entry, component): the parts of the first ids, then ``rounds`` rounds over all rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(p.entries).select("embedding").collect()
    entries = np.ascontiguousarray(integers(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), dim), p).transpose(1, 0, 2))
    for _ in range(p.rounds):
        entries = next_entries(rows, entries, dim, p)
    return entries


def digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, entries: np.ndarray, dim: int, p: Codes = Codes()) -> DataFrame:
    """vec_id, label, code, error of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Orchard(e) for e in entries]
        for b in batches:
            found = _assigned(b, 2, dim, books, p)[1]
            code = ["".join(f"{c:02x}" for c in row) for row in zip(*(f[0].tolist() for f in found), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(df: DataFrame, p: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row with a usable vector. df: vec_id, embedding, label; other columns
    are not looked at.

    Rows whose vector is null or holds null or non-finite components are left out, and so are vectors of another length than most
    have (the longer on ties). Lengths that the parts do not divide are filled up with zeros; components beyond 2^25 / scale count as
    that. Rows that repeat an id are rows of their own, in the order of their vectors; null ids come last; a null label is a label of
    its own. Fewer rows than entries give fewer entries, equal entries leave all but the first unused, an empty table gives no rows.
    What travels to tasks is the codebooks (entries * length numbers); the driver gets sums of the same size."""
    rows = vectors.usable(df, "label")
    dim, _ = vectors.dimension(rows)
    if dim is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = vectors.of_dimension(rows, dim)
    entries = fit(rows, dim, p)
    coded = Scratch(df.sparkSession, "codes").write(encode(rows, entries, dim, p), "coded")
    # a label may hold a third of all rows: its sum meets them in shares
    salt, share = F.pmod(F.xxhash64("vec_id", "code"), F.lit(64)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(63)))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", share.alias("share"))
    with_salt = coded.withColumn("salt", salt)
    joined = with_salt.join(sums, with_salt["label"].eqNullSafe(sums["of"]) & (with_salt["salt"] == sums["share"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))


def _oracle(p: Codes = Codes()) -> str:
    """The same in SQL: distances by component, one block of tables for each round."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({p.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (SELECT vec_id, part, j, v[part * (len(v) // {p.parts}) + j + 1] AS x FROM (SELECT vec_id, v, unnest(range({p.parts})) AS part FROM k), LATERAL (SELECT unnest(range(len(v) // {p.parts})) AS j))""",
        f"f AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT {p.entries}))",
        "c0 AS MATERIALIZED (SELECT part, entry, j, x AS c FROM x JOIN f USING (vec_id))",
    ]
    for n in range(p.rounds + 1):
        steps.append(f"d{n} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (part, j) GROUP BY ALL)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS nth FROM d{n}) WHERE nth = 1)")
        if n < p.rounds:
            steps.append(f"m{n} AS (SELECT part, entry, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM x JOIN a{n} USING (vec_id, part) GROUP BY ALL)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT part, entry, j, coalesce(m, c) AS c FROM c{n} LEFT JOIN m{n} USING (part, entry, j))")
    last = p.rounds
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) FROM c{last}) AS codebooks_sha256
        FROM coded JOIN k USING (vec_id)"""


ORACLE = _oracle()

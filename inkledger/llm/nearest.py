"""Approximate nearest neighbours: an inverted index whose lists are scanned by adaptive dimension sampling.

Vectors are rotated at random, so that a few coordinates of a difference estimate its length. A probed list is scanned in blocks of
coordinates; after each block a hypothesis test compares the partial distance with the query's k-th distance so far and abandons
the candidates that are too far with high confidence. What survives all blocks is measured on the original vectors.

A product of matrices takes as many blocks at once as leave few pairs: those that can pass the last of these tests and are no farther
than the k-th row found since. They go through all tests all the same, against the k-th distance that the query set out with, so
what is found depends neither on how many blocks the product took nor on the order in which lists are scanned."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkledger.llm import vectors
from inkledger.llm.common import Scratch


@dataclass(frozen=True)
class Search:
    k: int = 10
    list_rows: int = 1024  # rows of a list that are aimed at
    max_lists: int = 1024
    block: int = 16  # coordinates of a block
    epsilon: float = 2.1  # a candidate goes when its estimate exceeds (1 + epsilon / sqrt(coordinates seen)) times the k-th distance
    tuned: int = 200  # queries whose exact neighbours set the number of probed lists
    found: float = 0.97  # of these neighbours are in the probed lists


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random rotation (up to a reflection)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T), 0.0)


def centres(rows: np.ndarray, many: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means over the sample."""
    rng = np.random.default_rng(seed)
    now = rows[rng.permutation(len(rows))[:many]]
    for _ in range(rounds if len(now) > 1 else 0):
        home = np.concatenate([squares(rows[i : i + 4096], now).argmin(axis=1) for i in range(0, len(rows), 4096)])
        count = np.bincount(home, minlength=len(now))
        sums = np.zeros_like(now)
        np.add.at(sums, home, rows)
        now = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], now)
    return now


class Index:
    """What tasks need of the index: a bounded number of centres, the rotation, the layout of a row's bytes."""

    def __init__(self, rows: np.ndarray, many: int, dim: int, exact: type, p: Search):
        self.dim, self.exact, self.p = dim, exact, p
        self.turn, self.centres = rotation(dim), centres(rows, many)
        self.seen = dim  # coordinates of a task's next product

    def placed(self, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and the vector."""
        with np.errstate(over="ignore", invalid="ignore"):
            cells = squares(mat, self.centres).argmin(axis=1) if len(mat) else np.zeros(0)
        return cells.astype(np.int32), np.ascontiguousarray(mat.astype(self.exact))

    def read(self, data: bytes) -> np.ndarray:
        return vectors.unpack(data, self.exact, self.dim).astype(np.float64)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """For each query all lists, nearest centre first."""
        return np.argsort(squares(queries, self.centres), axis=1, kind="stable")

    def limit(self, seen: int) -> float:
        """The share of the squared k-th distance that the partial distance over so many coordinates may reach."""
        return seen / self.dim * (1.0 + (self.p.epsilon / np.sqrt(seen) if seen < self.dim else 0.0)) ** 2

    def hold(self, cells: dict[int, vectors.Block]) -> dict[int, List]:
        return {cell: List(self, cell, rows) for cell, rows in cells.items()}

    def rotated(self, mat: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated differences to a point, in single precision where their squares stay within its range, and their squared lengths. The
        differences come first, so that all rounding is in proportion to them."""
        with np.errstate(over="ignore", invalid="ignore"):
            turned = (mat - origin) @ self.turn
            size = (turned * turned).sum(axis=1)
        return turned.astype(np.float32 if size.max() < 1e30 else np.float64), size

    def scan(self, held: dict[int, List], c: vectors.Block, asked: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """q, vec_id, score: the k nearest of the pairs that no test abandons, for each query. edge holds the squared distances that the
        tests are against, near the squared k-th distances so far."""
        q, ids, best = self.read(c["vec"]), c["vec_id"], vectors.Best(len(c["q"]), self.p.k)
        for cell, places in asked.items():
            own, step = held[cell], max(1, vectors.STEP_PAIRS // len(places))
            near = Near(self, own, q[places], c["edge"][places])
            for start in range(0, len(own.ids), step):
                i, j = near.pairs(slice(start, start + step), np.minimum(c["near"], best.edge * best.edge * WIDER)[places])
                i, fits = places[i], (ids[places[i]] != own.ids[j]) | (own.ids[j] == vectors.NO_ID)
                i, j = i[fits], j[fits]
                away = np.sqrt(((q[i] - own.data[j]) ** 2).sum(axis=1))
                good = away <= best.edge[i]
                best.add(i[good], own.ids[j[good]], away[good])
        key, found, away = best.settle()
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["q"][key], found, away)], ["q", "vec_id", "score"])


class List:
    """The rows of a list that a task holds: as they are, and as rotated differences to the list's centre."""

    def __init__(self, index: Index, cell: int, rows: vectors.Block):
        self.ids, self.data, self.origin = rows["vec_id"], vectors.unpack(rows["vec"], index.exact, index.dim), index.centres[cell]
        self.turned, self.size = index.rotated(self.data.astype(np.float64), self.origin)
        self.wide: tuple[int, type, np.ndarray] = (0, object, self.turned)

    def augmented(self, seen: int, kind: type, slack: float) -> np.ndarray:
        """The first coordinates, and one more that is half their squares less what rounding may take."""
        if self.wide[:2] != (seen, kind):
            head = self.turned[:, :seen]
            lift = ((head.astype(np.float64) ** 2).sum(axis=1) - 2 * slack * self.size) / 2
            self.wide = seen, kind, np.concatenate([head, lift[:, None]], axis=1, dtype=kind)
        return self.wide[2]


class Near:
    """Queries against the rows of a list."""

    def __init__(self, index: Index, own: List, q: np.ndarray, edge: np.ndarray):
        self.index, self.own, self.edge = index, own, edge
        self.turned, self.size = index.rotated(q, own.origin)
        self.kind = np.float32 if self.turned.dtype == own.turned.dtype == np.float32 else np.float64
        #: Rounding is within this share of the squared lengths.
        self.slack = (1e-5 if self.kind is np.float32 else 1e-9) * max(1.0, index.dim / 64)

    def product(self, part: slice, seen: int, near: np.ndarray) -> np.ndarray:
        """The places (query, row) of the pairs that can pass the test after so many coordinates and can be as near as ``near``."""
        head, edge = self.turned[:, :seen], np.minimum(self.edge * self.index.limit(seen), near)
        bound = ((head.astype(np.float64) ** 2).sum(axis=1) - edge - 2 * self.slack * self.size) / 2
        bound = np.where(np.isnan(bound), -np.inf, bound).astype(self.kind)
        reached = np.concatenate([head, np.full((len(head), 1), -1)], axis=1, dtype=self.kind) @ self.own.augmented(seen, self.kind, self.slack)[part].T
        return np.flatnonzero(~(reached < bound[:, None]))

    def pairs(self, part: slice, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the pairs that pass every test, without those that are farther than ``near`` (squared)."""
        index, own, block, last = self.index, self.own, self.index.p.block, self.index.dim
        rows = len(own.ids[part])
        with np.errstate(over="ignore", invalid="ignore"):
            hit = self.product(part, index.seen, near)
            while len(hit) * 256 > len(near) * rows and index.seen < last:
                index.seen = min((index.seen // block + 1) * block, last)
                hit = self.product(part, index.seen, near)
            if len(hit) * 4096 < len(near) * rows and index.seen > block:
                index.seen = (index.seen - 1) // block * block
            i, j = hit // rows, hit % rows + part.start
            partial, at = np.zeros(len(i)), 0
            while at < last and len(i):
                end = min(at + block, last)
                partial = partial + ((self.turned[i, at:end].astype(np.float64) - own.turned[j, at:end]) ** 2).sum(axis=1)
                stay = ~(partial > self.edge[i] * index.limit(end) + self.slack * (self.size[i] + own.size[j]))
                i, j, partial, at = i[stay], j[stay], partial[stay], end
        return i, j


def _best(i: np.ndarray, j: np.ndarray, away: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, *more: np.ndarray) -> pa.RecordBatch:
    """The k nearest of each query, as q, vec_id, score and more."""
    order = np.lexsort((ids[j], away, i))
    i, j, away = i[order], j[order], away[order]
    heads = np.flatnonzero(np.diff(i, prepend=-1))
    keep = np.arange(len(i)) - np.repeat(heads, np.diff([*heads, len(i)])) < k
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (q[i[keep]], ids[j[keep]], away[keep], *(np.full(keep.sum(), m, np.int32) for m in more))], ["q", "vec_id", "score", *("cell" for _ in more)])


FOUND = "q long, vec_id long, score double"
#: A squared distance times this is not below the square that it was taken from.
WIDER = 1 + 1e-12


def probes(queries: DataFrame, pieces: DataFrame, index: Index) -> int:
    """How many lists hold enough of the true neighbours of some queries: these few are compared with all rows."""
    p, dim = index.p, index.dim
    asked = queries.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(p.tuned).select("q", "vec_id", "vec").collect()
    own = index.read(b"".join(bytes(r["vec"]) for r in asked))
    q, own_ids = np.arange(len(asked)), np.array([r["vec_id"] for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                x, ids = index.read(b.column(1)[row].as_py()), b.column(2)[row].values.to_numpy(zero_copy_only=False)
                fits = (own_ids[:, None] != ids) | (ids == vectors.NO_ID)
                away = np.where(fits, squares(own, x), np.inf)
                edge = np.partition(away, min(p.k, len(ids)) - 1, axis=1)[:, min(p.k, len(ids)) - 1]
                i, j = np.nonzero(fits & (away <= edge[:, None]))
                yield _best(i, j, away[i, j], q, ids, p.k, b.column(0)[row].as_py())

    near = vectors.ranked(pieces.select("cell", "vec", "vec_id").mapInArrow(run, f"{FOUND}, cell int"), ["q"], F.col("score"), p.k).collect()
    place = np.argsort(index.order(own), axis=1)
    needed = np.sort([place[r["q"], r["cell"]] for r in near])
    return int(needed[min(len(needed) - 1, int(np.ceil(p.found * len(needed))))]) + 1 if len(needed) else 1


def nearest(df: DataFrame, queries: Column, p: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query the k nearest of the others, by Euclidean distance, nearest first,
    ties by id, null ids last. df: vec_id, embedding; ``queries`` may use any of its columns.

    Vectors that are null, zero or empty, hold null or non-finite components, or have another length than most, take no part. Rows
    that repeat an id are candidates of their own, but none of a query with that id; a repeated query is a query of its own. An empty
    table, or one without queries, gives no rows. The centres come from a bounded sample, every row is indexed, and the number of
    probed lists follows from the exact neighbours of ``tuned`` queries among all rows, at every size."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "nearest")
    rows = vectors.usable(df, F.coalesce(queries, F.lit(False)).cast("long").alias("label")).filter(F.exists("embedding", lambda x: x != 0))
    dim, total = vectors.dimension(rows)
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.of_dimension(rows, dim)
    kind = df.schema["embedding"].dataType
    exact = np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64
    index = Index(vectors.sample(rows, dim, total), min(p.max_lists, -(-total // p.list_rows)), dim, exact, p)
    placed = scratch.write(vectors.assign(rows, dim, index.placed), "placed")
    groups = vectors.groups(placed, dim * np.dtype(exact).itemsize)
    with vectors.batches_of(spark, 4096):
        pieces = scratch.write(vectors.pack(vectors.salted(placed.drop("label"), groups.salts), ["cell", "salt"], vectors.PIECE_ROWS), "pieces")
        asked = scratch.write(placed.filter("label = 1").drop("label").withColumns({"q": F.monotonically_increasing_id(), "edge": F.lit(float("inf")), "near": F.lit(float("inf"))}), "queries")

    def blocks(rows: DataFrame) -> DataFrame:
        return vectors.pack(rows.withColumn("salt", F.lit(0)), ["cell", "salt"], vectors.PIECE_QUERIES)

    def nearer(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
        kth = vectors.ranked(found, ["q"], F.col("score"), p.k).filter(F.col("rank") == p.k).select("q", (F.col("score") * F.col("score") * WIDER).alias("kth"))
        return rows.join(kth, "q", "left").withColumns({c: F.least("kth", c) for c in columns}).select(*rows.columns)

    with vectors.batches_of(spark, vectors.PIECES):
        lists = probes(asked, pieces, index)

        def probed(c: vectors.Block) -> Iterator[tuple[int, np.ndarray]]:
            order = index.order(index.read(c["vec"]))[:, :lists]
            at = np.argsort(order, axis=None, kind="stable")
            cells, starts = np.unique(order.reshape(-1)[at], return_index=True)
            for cell, places in zip(cells, np.split(at // order.shape[1], starts[1:]), strict=True):
                yield int(cell), places

        # one piece of a query's own list gives the k-th distance that tests are against, a share of the groups a nearer one
        heads = scratch.write(blocks(asked), "heads")
        now, more, found = asked, scratch.write(vectors.meet(heads, pieces.filter("salt = 0"), index.hold, index.scan, FOUND), "first"), []
        for n, wanted in enumerate(groups.rounds()):
            now = scratch.write(nearer(now, more, "near") if n else nearer(now, more, "edge", "near"), f"known-{n}")
            sent = vectors.spread_queries(scratch.write(blocks(now), f"blocks-{n}"), probed, groups, wanted)
            more = scratch.write(vectors.pass_by(pieces, sent, groups, wanted, index.hold, index.scan, FOUND), f"found-{n}")
            found.append(more)
    named = lambda c, to: F.nullif(F.col(c), F.lit(vectors.NO_ID)).alias(to)
    best = vectors.ranked(functools.reduce(DataFrame.unionByName, found), ["q"], F.col("score"), p.k)
    return best.join(asked.select("q", F.col("vec_id").alias("asked_id")), "q").select(named("asked_id", "query_id"), "rank", named("vec_id", "vec_id"), "score")

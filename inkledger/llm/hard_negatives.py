"""Hard negatives of anchors: exact searches in windows of inner products, over a GNAT of multiway hyperplane splits.

A split point of the tree keeps, for every sibling's subtree, the range of distances from the point to its rows. A window of
scores is an annulus of distances around the anchor, as a row's distance follows from its score and its length; a subtree is left
out where for some split point no distance in its range lets it reach the annulus. Leaves are compared exactly."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm import vectors
from inkledger.llm.common import Scratch

#: Integer components are held within these bounds, so that products stay exact in doubles.
LIMIT = 1 << 20
#: Split points of a node, rows of a leaf that are aimed at, and levels: at most DEGREE ** LEVELS leaves, whatever the rows.
DEGREE, LEAF_ROWS, LEVELS = 16, 4096, 3
MARGIN = 1e-6


def integers(mat: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(mat * scale), -LIMIT, LIMIT).astype(np.int32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances from rows of a to rows of b, whole numbers as doubles, so the squares are exact."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T), 0.0))


@dataclass
class Node:
    points: np.ndarray  # split points
    children: list[int]  # node number, or -1 - leaf


class Gnat:
    """The tree's split points, from a bounded sample; ``ranges`` are measured over all rows."""

    def __init__(self, rows: np.ndarray, leaves: int, seed: int = 5):
        self.nodes: list[Node] = []
        self.leaves, self.rng = 0, np.random.default_rng(seed)
        self.paths: list[list[tuple[int, int]]] = []  # of each leaf: (node, child) from the root
        self._grow(rows, leaves, [])
        #: (node, split point, child) -> least and greatest distance; (node, child) -> least and greatest squared length
        self.low = [np.full((len(n.points), len(n.points)), np.inf) for n in self.nodes]
        self.high = [np.full((len(n.points), len(n.points)), -np.inf) for n in self.nodes]
        self.short = [np.full(len(n.points), np.inf) for n in self.nodes]
        self.long = [np.full(len(n.points), -np.inf) for n in self.nodes]

    def _grow(self, rows: np.ndarray, leaves: int, path: list[tuple[int, int]]) -> int:
        spread = np.unique(rows, axis=0) if leaves > 1 and len(path) < LEVELS else rows[:0]
        if len(spread) < 2:
            self.paths.append(path)
            self.leaves += 1
            return -self.leaves
        node = Node(self._points(spread, min(DEGREE, leaves, len(spread))), [])
        at = len(self.nodes)
        self.nodes.append(node)
        home = distances(rows, node.points).argmin(axis=1)
        for i in range(len(node.points)):
            share = int(np.ceil(leaves * (home == i).sum() / len(rows)))
            node.children.append(self._grow(rows[home == i], share, [*path, (at, i)]))
        return at

    def _points(self, rows: np.ndarray, k: int) -> np.ndarray:
        """k points that lie apart: each the farthest of some drawn ones from those taken before."""
        drawn = rows[self.rng.permutation(len(rows))[: 3 * k]]
        taken, away = [0], distances(drawn, drawn[:1])[:, 0]
        while len(taken) < k:
            taken.append(int(away.argmax()))
            away = np.minimum(away, distances(drawn, drawn[taken[-1:]])[:, 0])
        return drawn[taken]

    def visits(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows that reach it, their distances to its points, the child each goes to), from the root on; a leaf as (-1 - leaf,
        rows, -, -)."""
        todo = [(0 if self.nodes else -1, np.arange(len(rows)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            if at < 0:
                yield at, own, own, own
                continue
            away = distances(rows[own], self.nodes[at].points)
            home = away.argmin(axis=1)
            yield at, own, away, home
            todo += [(child, own[home == i]) for i, child in enumerate(self.nodes[at].children)]

    def placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves of rows, and the rows."""
        out = np.zeros(len(rows), np.int32)
        for at, own, _, _ in self.visits(rows.astype(np.float64)):
            if at < 0:
                out[own] = -1 - at
        return out, rows

    def measure(self, rows: DataFrame, dim: int) -> None:
        """The ranges over all rows of (cell, vec): least and greatest by task, then of all tasks."""
        tree = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # of each node: points and, as the last line, squared lengths; by child
            low, high = ([np.full((len(n.points) + 1, len(n.points)), x) for n in tree.nodes] for x in (np.inf, -np.inf))
            for b in batches:
                mat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32).reshape(-1, dim).astype(np.float64)
                size = (mat * mat).sum(axis=1)
                for at, own, away, home in tree.visits(mat):
                    if at < 0:
                        continue
                    order = np.argsort(home, kind="stable")
                    values = np.concatenate([away[order], size[own[order], None]], axis=1)
                    kids, starts = np.unique(home[order], return_index=True)
                    low[at][:, kids] = np.minimum(low[at][:, kids], np.minimum.reduceat(values, starts, axis=0).T)
                    high[at][:, kids] = np.maximum(high[at][:, kids], np.maximum.reduceat(values, starts, axis=0).T)
            for at, (least, most) in enumerate(zip(low, high, strict=True)):
                point, child = np.nonzero(most > -np.inf)
                if len(point):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(point), at, np.int32)), *(pa.array(x.astype(np.int32)) for x in (point, child)), *(pa.array(x[point, child]) for x in (least, most))], ["node", "point", "child", "low", "high"])

        with vectors.batches_of(rows.sparkSession, max(256, min(8192, (1 << 20) // dim))):
            found = rows.select("vec").mapInArrow(run, "node int, point int, child int, low double, high double").groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        for node, point, child, low, high in zip(*(found.column(c).to_numpy() for c in ("node", "point", "child", "low", "high")), strict=True):
            if point == len(self.nodes[node].points):
                self.short[node][child], self.long[node][child] = low, high
            else:
                self.low[node][point, child], self.high[node][point, child] = low, high

    def reach(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places of the queries) where a row's score may lie in one of the query's windows [low, high] (query, window)."""
        size, todo = (queries * queries).sum(axis=1), [(0 if self.nodes else -1, np.arange(len(queries)))]
        while todo:
            at, own = todo.pop()
            if at < 0:
                if len(own):
                    yield -1 - at, own
                continue
            away = distances(queries[own], self.nodes[at].points)
            for j, child in enumerate(self.nodes[at].children):
                least, most = self.low[at][:, j], self.high[at][:, j]
                if most[0] < 0:
                    continue  # nobody is there
                near = np.maximum(0.0, np.maximum(away - most, least - away)).max(axis=1)
                far = (away + most).min(axis=1)
                with np.errstate(invalid="ignore"):
                    outer = np.sqrt(np.maximum(size[own, None] + self.long[at][j] - 2.0 * low[own], -1.0))  # NaN: no row reaches the score
                    inner = np.sqrt(np.maximum(size[own, None] + self.short[at][j] - 2.0 * high[own], 0.0))
                    open_ = (low[own] <= high[own]) & (near[:, None] <= outer * (1 + MARGIN) + MARGIN) & (far[:, None] >= inner * (1 - MARGIN) - MARGIN)
                todo.append((child, own[open_.any(axis=1)]))


def query_blocks(rows: DataFrame) -> DataFrame:
    """Rows (cell, q, vec_id, label, vec, low, high) of queries in blocks that share a cell; low and high are lists of doubles."""
    return vectors.pack(rows.withColumn("salt", F.lit(0)), ["cell", "salt"], vectors.PIECE_QUERIES)


#: Whole numbers below this are exact in single precision, sums of products too where the lengths' product is below it.
SINGLE = 1 << 24


@dataclass
class Leaf:
    """The rows of a leaf that a task holds, by label."""

    ids: np.ndarray
    labels: np.ndarray
    mat: np.ndarray  # single precision, which holds integers up to LIMIT exactly
    longest: float

    def of(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


def leaves(cells: dict[int, vectors.Block], dim: int) -> dict[int, Leaf]:
    out = {}
    for cell, rows in cells.items():
        order = np.argsort(rows["label"], kind="stable")
        mat = vectors.unpack(rows["vec"], np.int32, dim)[order].astype(np.float32)
        size = np.einsum("ij,ij->i", mat, mat, dtype=np.float64)
        out[cell] = Leaf(rows["vec_id"][order], rows["label"][order], mat, float(np.sqrt(size.max())))
    return out


def compare(held: dict[int, Leaf], c: vectors.Block, asked: dict[int, np.ndarray], dim: int, same_label: bool, k: int) -> Iterator[pa.RecordBatch]:
    """q, w, vec_id, score: the k best rows of the leaves in each window of each query. The k-th score so far lifts a window."""
    order = np.argsort(c["label"], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    q, own, labels, low, high = (c[n][order] for n in ("q", "vec_id", "label", "low", "high"))
    whole = vectors.unpack(c["vec"], np.int32, dim)[order].astype(np.float64)
    longest, many, best = float(np.sqrt((whole * whole).sum(axis=1).max())), low.shape[1], vectors.Best(low.size, k)

    def floors() -> np.ndarray:
        """Below these scores no window of a query is open."""
        floor = np.where(low <= high, np.maximum(low, -best.edge.reshape(low.shape)), np.inf).min(axis=1)
        return floor if exact is np.float64 else np.clip(np.ceil(floor), -SINGLE, SINGLE).astype(exact)

    for cell, places in asked.items():
        leaf = held[cell]
        exact = np.float32 if longest * leaf.longest < SINGLE else np.float64
        mine, floor = whole.astype(exact), floors()
        at = np.sort(place[places])
        runs = np.flatnonzero(np.diff(labels[at], prepend=labels[at[0]] - 1))
        runs = [(int(a), int(b), *leaf.of(labels[at[a]])) for a, b in zip(runs, [*runs[1:], len(at)], strict=True)]
        # of the query's label: for each label its queries and rows; of other labels: all of them without these
        for first, end, start, stop in runs if same_label else [(0, len(at), 0, len(leaf.ids))]:
            part = at[first:end]
            step = max(1, vectors.STEP_PAIRS // len(part))
            for j0 in range(start, stop, step):
                j1 = min(j0 + step, stop)
                score = mine[part] @ leaf.mat[j0:j1].astype(exact, copy=False).T
                if not same_label:
                    for a, b, x, y in runs:
                        score[a:b, max(x - j0, 0) : max(y - j0, 0)] = -np.inf
                hit = np.flatnonzero(score >= floor[part, None])
                if not len(hit):
                    continue
                i, j = part[hit // (j1 - j0)], hit % (j1 - j0) + j0
                points = score.reshape(-1)[hit].astype(np.float64)
                fits = (points > -np.inf) & ((own[i] != leaf.ids[j]) | (leaf.ids[j] == vectors.NO_ID))
                i, ids, points, moved = i[fits], leaf.ids[j[fits]], points[fits], False
                for w in range(many):
                    good = (points >= low[i, w]) & (points <= high[i, w]) & (points >= -best.edge[i * many + w])
                    moved |= best.add(i[good] * many + w, ids[good], -points[good])
                if moved:
                    floor = floors()
    key, ids, points = best.settle()
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[key // many], (key % many).astype(np.int32), ids, -points.astype(np.int64))], ["q", "w", "vec_id", "score"])


def search(queries: DataFrame, pieces: DataFrame, groups: vectors.Groups, tree: Gnat, dim: int, same_label: bool, k: int, scratch: Scratch, name: str) -> DataFrame:
    """q, w, vec_id, score, rank: for each query and each of its windows the k rows of highest score within it, of the query's label
    or of other labels; rows with the query's id are not its results. queries: cell, q, vec_id, label, vec, low, high.

    First one piece of the query's own leaf lifts the lower ends of its windows to the k-th score there, then a share of the groups
    does, then it goes to the other groups; of each it sees all leaves that the tree cannot exclude, where the k best are exact."""

    def hold(cells: dict[int, vectors.Block]) -> dict[int, Leaf]:
        return leaves(cells, dim)

    def ask(held: dict[int, Leaf], c: vectors.Block, asked: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield from compare(held, c, asked, dim, same_label, k)

    def reached(c: vectors.Block) -> Iterator[tuple[int, np.ndarray]]:
        yield from tree.reach(vectors.unpack(c["vec"], np.int32, dim).astype(np.float64), c["low"], c["high"])

    def lifted(queries: DataFrame, found: DataFrame) -> DataFrame:
        edge = vectors.ranked(found, ["q", "w"], F.desc("score"), k).filter(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("score").cast("double").alias("s")))).alias("edge"))
        return queries.join(edge, "q", "left").withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.try_element_at("edge", i.cast("int"))))).drop("edge")

    schema = "q long, w int, vec_id long, score long"
    with vectors.batches_of(queries.sparkSession, vectors.PIECES):
        heads = scratch.write(query_blocks(queries), f"{name}-heads")
        more, found = scratch.write(vectors.meet(heads, pieces.filter("salt = 0"), hold, ask, schema), f"{name}-first"), []
        for n, wanted in enumerate(groups.rounds()):
            queries = scratch.write(lifted(queries, more), f"{name}-lifted-{n}")
            blocks = scratch.write(query_blocks(queries), f"{name}-blocks-{n}")
            more = scratch.write(vectors.pass_by(pieces, vectors.spread_queries(blocks, reached, groups, wanted), groups, wanted, hold, ask, schema), f"{name}-found-{n}")
            found.append(more)
    return vectors.ranked(functools.reduce(DataFrame.unionByName, found), ["q", "w"], F.desc("score"), k)


def mine(df: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 10, scale: int = 256, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best rows of the same
    label the best rows of other labels whose score is between ``least`` and ``most`` percent of that row's. df: vec_id, embedding;
    label and anchors (whether a row is one) may use any of its columns.

    Rows with a null label or without a usable vector take no part, nor do vectors of another length than most have, or of none;
    components beyond 2^20 / scale count as that. Scores are inner products of floor(scale * x); equal scores go by id, null ids last.
    Rows that repeat an id are candidates of their own, but none of an anchor with that id; rows that repeat an anchor are anchors of
    their own. A negative score has no window, an empty table no rows."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "negatives")
    rows = vectors.usable(df, label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")).filter("label is not null and size(embedding) > 0")
    (dim, total), result = vectors.dimension(rows), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dim is None:
        return spark.createDataFrame([], result)
    rows = vectors.of_dimension(rows, dim)
    tree = Gnat(integers(vectors.sample(rows, dim, total), scale).astype(np.float64), -(-total // LEAF_ROWS))
    # the label travels with the anchor's mark in its last bit
    marked = rows.withColumn("label", F.shiftleft("label", 1) + F.col("is_anchor").cast("int"))
    placed = scratch.write(vectors.assign(marked, dim, lambda m: tree.placed(integers(m, scale))), "placed")
    tree.measure(placed, dim)
    plain = placed.withColumn("label", F.shiftright("label", 1))
    groups = vectors.groups(placed, 4 * dim)
    with vectors.batches_of(spark, 4096):
        pieces = scratch.write(vectors.pack(vectors.salted(plain, groups.salts), ["cell", "salt"], vectors.PIECE_ROWS), "pieces")
    ends = lambda x: F.array(F.lit(x).cast("double"))
    queries = scratch.write(placed.filter("label % 2 <> 0").withColumns({"label": F.shiftright("label", 1), "q": F.monotonically_increasing_id(), "low": ends("-Infinity"), "high": ends("Infinity")}), "anchors")
    same = scratch.write(search(queries, pieces, groups, tree, dim, True, positives, scratch, "same"), "positives")
    # least * p <= 100 * n <= most * p: a quotient of whole numbers below 2^53 falls on the right side of every whole score
    p = F.col("score")
    best = same.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    bound = lambda share: F.concat(F.transform("scores", lambda s: share * s / F.lit(100.0)), F.array_repeat(F.lit(float("nan")), F.lit(positives) - F.size("scores")))
    asked = scratch.write(queries.drop("low", "high").join(best, "q").withColumns({"low": bound(float(least)), "high": bound(float(most))}).drop("scores"), "windows")
    other = search(asked, pieces, groups, tree, dim, False, negatives, scratch, "other")
    pairs = same.select("q", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"))
    named = lambda c: F.nullif(F.col(c), F.lit(vectors.NO_ID)).alias(c)
    joined = other.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["q", "w"]).join(queries.select("q", F.col("vec_id").alias("anchor_id")), "q")
    return joined.select(named("anchor_id"), named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


ORACLE = """
WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM k a, k b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS nth
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE nth <= 10
"""

"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document is the set of its distinct five-word shingles; documents link when the Jaccard similarity of their full
sets is at least 3/4. Equal sets are one class and enter the search once, through their smallest id. Then:

* every class gets a min-hash signature; a *tree* starts by branching on one or two of its tokens (1 / similarity
  branches on average, which keeps a similar pair together in one node in expectation however deep the tree goes);
* a node of at most ``node_rows`` classes is settled within one task: while it is larger than ``leaf`` it branches again
  on tokens drawn from the node's own path, and leaves are compared exhaustively;
* larger nodes branch on by shuffles, level by level, so no node is ever gathered whole; those of a few tasks' size meet in
  all pairs of blocks instead;
* below the roots nodes branch more often, by as much as keeps the stated recall at the threshold down to the deepest level;
* in a large node all are first compared with a common centre, and those nearly equal to it leave the node: a crowd of
  near copies becomes a star instead of all its pairs. Estimates obey the triangle inequality, so whatever may be similar to
  one that leaves lies in a band around the centre; those of the band that are not in the centre's component are compared
  with all that leave, in blocks where the node is larger than a task;
* ``trees`` independent trees repeat the search to raise recall; a pair that several nodes compare whole is nominated by one.

Signatures only nominate pairs. A link counts once the full sets, computed from whole texts, confirm it. The nodes are
settled twice: first they nominate a spanning forest of the pairs that look similar, then all pairs that might be similar
and whose ends are still in different components; pairs within one component change no result and are not written.

Defined results: words are split at ASCII white space and A-Z lower-cased; fewer than five words are one shingle; null
and empty texts have no set and stay alone; a null id is never linked (component_id null, kept true); rows that repeat
an id are judged by their own text and carry the same id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Scratch, chunks, hash_words, mix, release
from inkledger.llm.components import components


@dataclass(frozen=True)
class Join:
    """width: words in a shingle; percent: least similarity; tokens: length of a signature; early: trees that nominate the
    forest (their nodes have odd numbers); slack: how far the estimate may lie below the threshold, 3 standard errors; near:
    estimated similarity at which a class leaves a large node; recall: of pairs at the threshold whose estimate is within the slack, at
    any depth; pairs: comparisons that a part of a node may take without branching; blocks: into how many a node is cut at
    most before it rather branches."""

    width: int = 5
    percent: int = 75
    trees: int = 8
    early: int = 8
    tokens: int = 512
    leaf: int = 24
    node_rows: int = 4096
    slack: float = 0.0574
    near: float = 0.9
    max_levels: int = 16
    seed: int = 11
    recall: float = 0.999
    pairs: int = 1 << 17
    blocks: int = 16

    @property
    def least(self) -> float:
        return self.percent / 100 - self.slack

    @property
    def band(self) -> float:
        """The estimate with a centre below which nothing can reach ``least`` with a class that leaves for the centre."""
        return self.least - (1 - self.near) - 1e-9

    def branches(self, node: int, many: float | None = None) -> np.ndarray:
        """The tokens a node branches on: ``many``, or 1 / similarity of them, on average, fixed by the node's path."""
        rng = np.random.default_rng([self.seed, int(node) & (1 << 64) - 1])
        many = many or 100 / self.percent
        return rng.choice(self.tokens, int(many) + int(rng.random() < many % 1), replace=False)


def missed(p: Join, many: float, levels: int) -> float:
    """The share of pairs at the threshold, with an estimate of ``least`` or more, that no tree brings together when nodes
    branch on ``many`` tokens below the roots. All trees share the signature, so the share is averaged over its agreement."""
    roots, least, total, lost = sum(len(p.branches(tree)) for tree in range(p.trees)), ceil(p.least * p.tokens - 1e-9), 0.0, 0.0
    for k in range(least, p.tokens + 1):
        share, gone = k / p.tokens, 0.0
        for _ in range(levels - 1):
            none = 1 - share * (1 - gone)
            gone = none ** int(many) * (1 - many % 1 + many % 1 * none)
        weight = comb(p.tokens, k) * (p.percent / 100) ** k * (1 - p.percent / 100) ** (p.tokens - k)
        total, lost = total + weight, lost + weight * (1 - share * (1 - gone)) ** roots
    return lost / total


@cache
def deep_branches(p: Join) -> float:
    """The fewest branches below the roots that keep the recall through all shuffled levels and all levels within a task."""
    many = 100 / p.percent
    while missed(p, many, 1 + 2 * p.max_levels) > 1 - p.recall:
        many += 0.02
    return many


def shingles(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes with repeats, bounds of each text)."""
    words, bounds = hash_words(data, starts)
    count = np.diff(bounds)
    short = (count > 0) & (count < width)
    many = np.where(count >= width, count - width + 1, short)
    out = np.zeros(len(many) + 1, dtype=np.int64)
    np.cumsum(many, out=out[1:])
    at = np.repeat(bounds[:-1] - out[:-1], many) + np.arange(out[-1])
    left = np.minimum(np.repeat(bounds[1:], many) - at, width)
    padded = np.append(words, np.zeros(width, dtype=np.uint64))
    value = left.astype(np.uint64)
    for i in range(width):
        value = mix(value + np.where(i < left, padded[at + i], np.uint64(0)))
    return value, out


def distinct_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    for _, _, data, starts in chunks(texts):
        value, bounds = shingles(data, starts, width)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(value[a:b])


def mark(node: np.ndarray, early: np.ndarray | bool) -> np.ndarray:
    return (node >> np.uint64(1) << np.uint64(1)) | np.asarray(early, dtype=np.uint64)


def print_of(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, whatever its order."""
    return int(mix(values).sum().view(np.int64)), int(mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def signatures(docs: DataFrame, p: Join) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, p1, p2 (the set's print), sig (8 bits a token), nodes (the first nodes of each tree)."""
    rng = np.random.default_rng(p.seed)
    flips, odds = rng.integers(0, 1 << 32, p.tokens, dtype=np.uint32), rng.integers(0, 1 << 31, p.tokens, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    roots = [(tree, token) for tree in range(p.trees) for token in p.branches(tree)]
    # signatures are estimates and take 32 bits of a shingle; the first nodes hold what shares 64 bits, however many documents there are
    root_flips, root_odds = rng.integers(0, 1 << 63, len(roots), dtype=np.uint64), rng.integers(0, 1 << 63, len(roots), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, starts in chunks(b.column(2)):
                value, bounds = shingles(data, starts, p.width)
                full = np.flatnonzero(np.diff(bounds))
                least, tops = np.zeros((p.tokens, end - first), dtype=np.uint32), np.zeros((len(roots), end - first), dtype=np.uint64)
                if len(full):
                    half = (value >> np.uint64(32)).astype(np.uint32)
                    for k in range(p.tokens):
                        least[k, full] = np.minimum.reduceat((half ^ flips[k]) * odds[k], bounds[full])
                    for k in range(len(roots)):
                        tops[k, full] = np.minimum.reduceat((value ^ root_flips[k]) * root_odds[k], bounds[full])
                nodes = np.stack([mark(mix(tops[k] + mix(np.array([(tree << 32) + k + 1], dtype=np.uint64))), tree < p.early) for k, (tree, _) in enumerate(roots)], 1)
                sets = [np.unique(value[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                prints = [print_of(s) for s in sets]
                sig = np.ascontiguousarray(least.T.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, end - first), b.column(1).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in prints], pa.int64()), pa.array([x for _, x in prints], pa.int64()),
                     pa.array([s.tobytes() for s in sig], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(nodes.view(np.int64).ravel()), len(roots)).cast(pa.list_(pa.int64()))],
                    ["doc_id", "t", "n_shingles", "p1", "p2", "sig", "nodes"],
                )
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "doc_id long, t long, n_shingles long, p1 long, p2 long, sig binary, nodes array<long>")


def matrix(column: pa.Array, tokens: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, tokens)


class Node:
    """Settles one node within a task. In the first pass it nominates a spanning forest of the pairs that look similar
    enough; in the second, every pair that might be and whose ends lie in different components."""

    def __init__(self, p: Join, ids: np.ndarray, sig: np.ndarray, root: np.ndarray | None, node: int = 0, whole: bool = False, done: np.ndarray | None = None):
        self.p, self.ids, self.sig, self.root = p, ids, sig, root
        self.node, self.whole, self.done = node, whole, done
        self.parent, self.found = list(range(len(ids))), []
        self.many = None if root is None else deep_branches(p)

    def flat(self) -> bool:
        """Branching would save few comparisons here."""
        a, b = np.random.default_rng(len(self.ids)).integers(0, len(self.ids), (2, 128))
        return deep_branches(self.p) * (self.sig[a] == self.sig[b]).mean() > 0.8

    def elsewhere(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs that also meet in another node which is compared whole: only the first such node nominates them."""
        least = np.full(len(a), np.iinfo(np.int64).max)
        for column in self.done.T:
            mine = column[a]
            shared = (mine != 0) & (self.done[b] == mine[:, None]).any(1)
            least = np.where(shared, np.minimum(least, mine), least)
        return (least != self.node) & (least != np.iinfo(np.int64).max)

    def top(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def nominate(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> None:
        if self.root is not None:
            keep = (same >= self.p.least) & (self.root[a] != self.root[b])
            a, b = a[keep], b[keep]
            if self.done is not None and self.done.any():
                own = ~self.elsewhere(a, b)
                a, b = a[own], b[own]
            self.found += zip(a.tolist(), b.tolist(), strict=True)
            return
        keep = np.flatnonzero(same >= self.p.percent / 100)
        for k in keep[np.argsort(-same[keep], kind="stable")]:
            x, y = self.top(int(a[k])), self.top(int(b[k]))
            if x != y:
                self.parent[x] = y
                self.found.append((int(a[k]), int(b[k])))

    def star(self, rows: np.ndarray, node: int = 0) -> np.ndarray:
        """Compares all with one centre of the node's own; returns those that stay in the node. In the second pass only
        members of the centre's component leave, and not before they met all that may be similar and are of another."""
        centre = rows[np.argmin(mix(self.ids[rows].view(np.uint64) ^ np.uint64(int(node) & (1 << 64) - 1)))]
        same = (self.sig[rows] == self.sig[centre]).mean(1)
        rest = np.flatnonzero(rows != centre)
        self.nominate(np.full(len(rest), centre), rows[rest], same[rest])
        leave = (same >= self.p.near) & (rows != centre)
        if self.root is not None:
            other = self.root[rows] != self.root[centre]
            leave &= ~other
            self.cross(rows[leave], rows[other & (same >= self.p.band)])
        return rows[~leave]

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Estimates of all pairs of two sides: small ones at once, others token by token, as counts of 255 tokens fit in a byte."""
        if len(x) * len(y) <= 2048:
            return np.count_nonzero(self.sig[x][:, None] == self.sig[y][None], axis=2) / self.p.tokens
        count, a, b = np.zeros((len(x), len(y)), np.uint16), np.ascontiguousarray(self.sig[x].T), np.ascontiguousarray(self.sig[y].T)
        for k in range(0, self.p.tokens, 255):
            few = np.zeros(count.shape, np.uint8)
            for u, v in zip(a[k : k + 255], b[k : k + 255], strict=True):
                few += (u[:, None] == v).view(np.uint8)
            count += few
        return count / self.p.tokens

    def cross(self, left: np.ndarray, right: np.ndarray, block: int = 256) -> None:
        """All pairs of the two sides, in blocks."""
        for i in range(0, len(left), block):
            for j in range(0, len(right), block):
                x, y = left[i : i + block], right[j : j + block]
                same = self.alike(x, y)
                m, n = np.nonzero(same >= self.p.least)
                self.nominate(x[m], y[n], same[m, n])

    def exhaust(self, rows: np.ndarray, block: int = 256) -> None:
        """All pairs, in blocks."""
        for i in range(0, len(rows), block):
            for j in range(i, len(rows), block):
                x, y = rows[i : i + block], rows[j : j + block]
                same = self.alike(x, y)
                m, n = np.nonzero(same >= self.p.least)
                keep = m + i < n + j
                self.nominate(x[m[keep]], y[n[keep]], same[m[keep], n[keep]])

    def settle(self, node: int, rows: np.ndarray, level: int = 0) -> None:
        if self.root is not None:  # only pairs of different components count
            _, which, sizes = np.unique(self.root[rows], return_inverse=True, return_counts=True)
            rest = rows[which != sizes.argmax()]
            if len(rest) * len(rows) <= self.p.pairs or (self.whole and level == 0):
                return self.exhaust(rows) if 2 * len(rest) > len(rows) else self.cross(rest, rows)
        if len(rows) > self.p.leaf:
            rows = self.star(rows, node)
        if len(rows) <= self.p.leaf or level >= self.p.max_levels:
            return self.exhaust(rows)
        for token in self.p.branches(node, self.many):
            order = rows[np.argsort(self.sig[rows, token], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(self.sig[order, token])) + 1):
                if len(part) > 1:
                    self.settle(hash((node, int(token), int(self.sig[part[0], token]))), part, level + 1)


def settle_nodes(rows: DataFrame, p: Join, second: bool) -> DataFrame:
    """Pairs (a, b) nominated by nodes, and in the first pass (node, NULL) for nodes that branching would not thin out, which the
    second compares whole. rows: node, id, sig, root, side, whole, done, with all rows of a node together. Where side is not 0,
    the rows of side 1 are compared with those of side 2; done are the nodes of a class that are compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pairs: list[np.ndarray] = []
        whole: list[int] = []

        def close() -> None:
            if held:
                node, ids, sig, root, side, own = int(held[0][0]), *(np.concatenate(x) for x in list(zip(*held, strict=True))[1:6])
                if not second or (root != root[0]).any():
                    done = [x for h in held for x in h[6]] if second else []
                    table = np.zeros((len(ids), max(map(len, done), default=0)), dtype=np.int64)
                    for k, x in enumerate(done):
                        table[k, : len(x)] = x
                    work = Node(p, ids, sig, root if second else None, node, bool(own[0]), table)
                    if side.any():
                        work.cross(np.flatnonzero(side == 1), np.flatnonzero(side == 2))
                    else:
                        if not second and p.leaf < len(ids) <= p.node_rows and work.flat():
                            whole.append(node)
                        work.settle(node, np.arange(len(ids)))
                    if work.found:
                        pairs.append(np.unique(np.sort(ids[np.array(work.found)], axis=1), axis=0) if len(work.found) > 1 else np.sort(ids[np.array(work.found)], axis=1))
                held.clear()

        def take() -> Iterator[pa.RecordBatch]:
            if pairs or whole:
                both = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(both[:, 0], np.array(whole, np.int64))), pa.concat_arrays([pa.array(both[:, 1]), pa.nulls(len(whole), pa.int64())])], ["a", "b"])
                pairs.clear()
                whole.clear()

        for b in batches:
            node, ids, sig, root, side, own = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), p.tokens), b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy(zero_copy_only=False)
            done = b.column(6).to_pylist() if second else []
            cuts = [0, *(np.flatnonzero(np.diff(node)) + 1), len(node)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and y > x and held[0][0] != node[x]:
                    close()
                if y > x:
                    held.append((node[x], ids[x:y], sig[x:y], root[x:y], side[x:y], own[x:y], done[x:y]))
            yield from take()
        close()
        yield from take()
        release()

    return rows.mapInArrow(run, "a long, b long")


def branch_nodes(rows: DataFrame, p: Join) -> DataFrame:
    """One level for nodes too large for a task. rows: node, id, sig, centre, centre_sig. Gives the classes a of the band
    around the centre b and the rows of child nodes (b null)."""
    many = deep_branches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, ids, sig, centre, centres = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), p.tokens), b.column(3).to_numpy(), matrix(b.column(4), p.tokens)
            same = (sig == centres).mean(1)
            near = np.flatnonzero((same >= p.band) & (ids != centre))
            yield pa.RecordBatch.from_arrays([pa.array(node[near]), pa.array(ids[near]), pa.array(centre[near]), pa.array(same[near])], ["node", "a", "b", "same"])
            for n in np.unique(node):
                stay = np.flatnonzero((node == n) & ((same < p.near) | (ids == centre)))
                for token in p.branches(int(n), many):
                    child = mark(mix(sig[stay, token].astype(np.uint64) + mix(np.array([n], dtype=np.int64).view(np.uint64) + np.uint64(token + 1))), n & 1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(ids[stay]), pa.nulls(len(stay), pa.int64()), pa.nulls(len(stay), pa.float64())], ["node", "a", "b", "same"])

    return rows.mapInArrow(run, "node long, a long, b long, same double")


def grow_trees(reps: DataFrame, p: Join, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, id, n) of the nodes that fit in a task with their size (0 for pairs of blocks), and (node, a, b, same) of the classes a in the band around the centre b of
    larger ones. reps: id, sig, nodes."""
    sigs = reps.select("id", "sig")
    now, small, stars = reps.select(F.explode("nodes").alias("node"), "id"), [], []
    for level in range(p.max_levels + 1):
        sizes = now.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "node"), "id")).alias("first")).filter("n > 1")
        now = scratch.write(now.join(sizes.select("node", "n", F.col("first.id").alias("centre")), "node"), f"level-{level}")
        small.append(now.filter(F.col("n") <= p.node_rows).select("node", "id", "n"))
        large = now.filter(F.col("n") > p.node_rows)
        if large.isEmpty():
            break
        # all pairs of blocks: exact, and bounded in memory; those with the first block nominate the forest
        blocks = F.ceil(F.col("n") * 2 / p.node_rows).cast("int")
        mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
        block = (large if level == p.max_levels else large.filter(blocks <= p.blocks)).select("node", "id", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        number, early = F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")), F.when(F.least("mine", "other") == 0, F.col("node").bitwiseAND(F.lit(1))).otherwise(F.lit(0))
        small.append(block.select(number.bitwiseAND(F.lit(-2)).bitwiseOR(early).alias("node"), "id", F.lit(0).cast("long").alias("n")))
        large = large.filter(blocks > p.blocks)
        if level == p.max_levels or large.isEmpty():
            break
        centres = large.select("node", "centre").distinct().join(sigs.withColumnsRenamed({"id": "centre", "sig": "centre_sig"}), "centre")
        stepped = scratch.write(branch_nodes(large.select("node", "id").join(sigs, "id").join(centres, "node").select("node", "id", "sig", "centre", "centre_sig"), p), f"branch-{level}")
        stars.append(stepped.filter("b is not null").select("node", "a", "b", "same"))
        now = stepped.filter("b is null").select("node", F.col("a").alias("id"))
    none = reps.select(F.col("id").alias("node"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("same")).filter(F.lit(False))
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, stars, none)


def band_blocks(stars: DataFrame, p: Join) -> DataFrame:
    """(node, id, side): blocks in which those that left a large node (side 1) meet those of the band that are not in the
    centre's component (side 2). stars: node, a, same, root_a, root_b."""
    gone, other, half = stars.filter(F.col("same") >= p.near), stars.filter("root_a <> root_b"), max(1, p.node_rows // 2)
    many = lambda side, name: side.groupBy("node").agg(F.ceil(F.count("*") / half).cast("int").alias(name))
    sizes = many(gone, "m").join(many(other, "n"), "node")
    sides = []
    for side, (rows, own, across) in enumerate(((gone, "m", "n"), (other, "n", "m")), 1):
        cut = rows.join(sizes, "node").select("node", F.col("a").alias("id"), F.pmod(F.xxhash64("a"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(across) - 1)).alias(across))
        sides.append(cut.select(F.xxhash64("node", "m", "n").alias("node"), "id", F.lit(side).alias("side")))
    return sides[0].union(sides[1])


def nominate(trees: tuple[DataFrame, DataFrame], reps: DataFrame, roots: DataFrame | None, p: Join, flat: DataFrame | None = None) -> DataFrame:
    """Distinct candidate pairs (a, b): without roots a forest and, as (node, NULL), the nodes to be compared whole; with roots
    (node, root) and these nodes (flat) all pairs between components."""
    nodes, stars = trees
    sigs, none = reps.select("id", "sig"), F.array().cast("array<long>")
    if roots is None:
        odd = F.col("node").bitwiseAND(F.lit(1)) == 1
        nodes, sigs, stars = nodes.filter(odd), sigs.withColumn("root", F.col("id")), stars.filter(odd & (F.col("same") >= p.percent / 100))
        nodes, sigs = nodes.select("node", "id", F.lit(0).alias("side"), F.lit(False).alias("whole")), sigs.withColumn("done", none)
    else:
        nodes = nodes.join(flat.withColumn("flat", F.lit(True)), "node", "left").select("node", "id", F.lit(0).alias("side"), F.coalesce("flat", F.lit(False)).alias("whole"), "n")
        # compared whole by their size or by choice; those of a leaf's size repeat too little to be worth the list
        done = nodes.filter(F.col("whole") | ((F.col("n") > p.leaf) & (F.col("n") * F.col("n") <= p.pairs))).groupBy("id").agg(F.collect_list("node").alias("done"))
        sigs = sigs.join(roots.withColumnRenamed("node", "id"), "id", "left").join(done, "id", "left").withColumns({"root": F.coalesce("root", "id"), "done": F.coalesce("done", none)})
        for end in ("a", "b"):
            stars = stars.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        stars = stars.withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")})
        nodes, stars = nodes.drop("n").unionByName(band_blocks(stars, p).withColumn("whole", F.lit(False))), stars.filter((F.col("root_a") != F.col("root_b")) & (F.col("same") >= p.least))
    rows = nodes.join(sigs, "id").select("node", "id", "sig", "root", "side", "whole", "done").repartition("node").sortWithinPartitions("node", "id")
    return settle_nodes(rows, p, roots is not None).union(stars.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, p: Join) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [distinct_sets(b.column(k), p.width) for k in (2, 3)]
            ok = []
            for x, y in zip(*both, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= p.percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.select("a", "b").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def candidate_texts(docs: DataFrame, pairs: DataFrame, reps: DataFrame, p: Join) -> DataFrame:
    """id, text of the classes in pairs: a class's text is that of its least document, and of rows that repeat that document's id one
    with the class's own set."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct().join(reps.select("id", "p1", "first"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [print_of(s)[0] for s in distinct_sets(b.column(2), p.width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["id", "text"]).filter(pa.array(np.array(own, dtype=np.int64) == b.column(1).to_numpy()))

    rows = docs.select(F.col("doc_id").cast("long").alias("first"), "text").join(ids, "first").select("id", "p1", "text")
    return rows.mapInArrow(run, "id long, text string").dropDuplicates(["id"])


def judged(docs: DataFrame, params: Join) -> DataFrame:
    """One row per document: doc_id, t (a hash of its text), n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.write(signatures(docs, params), "signed")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("p1", "p2").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("sig", "nodes"), "doc_id").alias("s"))
    # a class has a number of its own, as one document id may stand before texts of several classes
    reps = scratch.write(classes.select("p1", "p2", "first", F.monotonically_increasing_id().alias("id"), "s.sig", "s.nodes"), "reps")

    trees = grow_trees(reps, params, scratch)
    first, flat, rounds = None, None, []
    for name in ("forest", "rest"):
        found = scratch.write(nominate(trees, reps, first, params, flat), f"{name}-pairs")
        pairs, flat = found.filter("b is not null"), found.filter("b is null").select(F.col("a").alias("node"))
        texts = scratch.write(candidate_texts(docs, pairs, reps, params), f"{name}-texts")
        rounds.append(scratch.write(confirm(pairs, texts, params), f"{name}-links"))
        scratch.drop(f"{name}-texts")
        first = first or components(rounds[0], scratch, "first")
    more = rounds[1]
    roots = components(more.union(first.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch, "second")

    # components go by their least document
    members = roots.union(roots.select("root", "root").distinct()).join(reps.select(F.col("id").alias("node"), "first"), "node")
    named = members.groupBy("root").agg(F.min("first").alias("found"))
    linked = roots.union(roots.select("root", "root").distinct()).join(named, "root").select(F.col("node").alias("id"), "found")
    home = reps.select("p1", "p2", "id", "first").join(linked, "id", "left").select("p1", "p2", F.coalesce("found", "first").alias("found"))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    out = signed.select("doc_id", "t", "n_shingles", "p1", "p2").join(home, ["p1", "p2"], "left").withColumn("component_id", own)
    return out.select("doc_id", "t", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_groups(docs: DataFrame, params: Join = Join()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return judged(docs, params).drop("t")


def drop_near_copies(docs: DataFrame, params: Join = Join()) -> DataFrame:
    """The rows that stay, one document for each component, with all their columns; of rows that repeat an id each goes by its
    own text."""
    keep = judged(docs, params).filter("kept").select("doc_id", "t").distinct()
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["doc_id"]) & (F.xxhash64(docs["text"]) == keep["t"]), "left_semi")

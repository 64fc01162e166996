"""The vector operators: brute force, hot groups, edge rows, clashing columns."""

import hashlib
import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from oracle import check

from inkledger.llm import hard_negatives, nearest, queries, vector_codes, vectors

ROWS = "vec_id long, embedding array<float>, label int"
CLASHES = ["cell", "code", "edge", "error", "h", "high", "is_anchor", "low", "m", "n", "of", "q", "rank", "salt", "score", "share", "vec", "w", "x_vec", "asked_id"]


def vecs(n, dim, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.standard_normal(dim) / 3], int(rng.integers(labels))) for i in range(n)]


def edge_rows():
    """Unusable vectors, null labels and ids, other lengths, repeated rows and ids, ties, huge and zero components."""
    nan, inf = float("nan"), float("inf")
    bad = [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (1002, [nan] * 8, 1), (1003, [inf] + [0.0] * 7, 1), (1004, [], 1), (1005, [1.0, 2.0], 2)]
    odd = [(None, [0.5] * 8, 1), (1100, [0.25] * 8, None), (1200, [0.0] * 8, 2), (1300, [float(np.float32(1e30))] + [0.0] * 7, 1), (1400, [0.5] * 8, 1), (1400, [0.5] * 8, 1), (1500, [0.5] * 8, 2), (1500, [-0.5] * 8, 2)]
    return vecs(300, 8, 4) + bad + odd


def usable(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)) if clash else df


# ---------------------------------------------------------------- codes


def plain_codes(rows, dim, entries=256, rounds=4):
    rows = sorted(usable(rows, dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.clip(np.floor(1024.0 * np.array([r[1] for r in rows])), -(1 << 25), 1 << 25).astype(np.int64).reshape(len(rows), 4, dim // 4)
    books = x[:entries].copy()

    def assign():
        away = ((x[:, None] - books[None]) ** 2).sum(axis=3)  # row, entry, part
        return away.argmin(axis=1), away.min(axis=1).sum(axis=1)

    for _ in range(rounds):
        code = assign()[0]
        for part in range(4):
            for e in range(len(books)):
                own = x[code[:, part] == e, part]
                if len(own):
                    books[e, part] = own.sum(axis=0) // len(own)
    code, error = assign()
    sha = hashlib.sha256(",".join(str(v) for part in range(4) for b in books for v in b[part]).encode()).hexdigest()
    total = {}
    for r, e in zip(rows, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    return sorted(((r[0], "".join(f"{c:02x}" for c in k), int(e), total[r[2]], sha) for r, k, e in zip(rows, code, error, strict=True)), key=repr)


def test_codes_match_sql(spark, sf):
    check(spark, sf, queries.op11_vector_codes, vector_codes.ORACLE)


@pytest.mark.parametrize("clash", [False, True])
def test_codes_edges(spark, clash):
    got = sorted(map(tuple, vector_codes.compress(frame(spark, edge_rows(), clash)).collect()), key=repr)
    assert got == plain_codes(edge_rows(), 8)


def test_codes_hot_copies_and_few_rows(spark):
    """A third of all rows are one vector, so most entries are equal: only the first of them is used."""
    hot = [(i, [0.125] * 8, 0) for i in range(400)] + [(400 + i, v, lab) for i, v, lab in vecs(500, 8, 9)]
    assert sorted(map(tuple, vector_codes.compress(frame(spark, hot)).collect()), key=repr) == plain_codes(hot, 8)
    few = vecs(5, 8)
    assert sorted(map(tuple, vector_codes.compress(frame(spark, few)).collect()), key=repr) == plain_codes(few, 8)
    for rows in ([], [(1, None, 1)]):
        assert vector_codes.compress(frame(spark, rows)).collect() == []


def test_codes_of_odd_lengths(spark):
    """Lengths that four parts do not divide are filled up with zeros."""
    rows = [(i, v[:6], lab) for i, v, lab in vecs(300, 8)]
    full = [(i, v[:6] + [0.0, 0.0], lab) for i, v, lab in vecs(300, 8)]
    assert sorted(vector_codes.compress(frame(spark, rows)).collect()) == sorted(vector_codes.compress(frame(spark, full)).collect())


def test_orchard_search_is_exact():
    rng = np.random.default_rng(2)
    for spread in (3, 40, 10_000):  # many ties, some, none
        entries, points = rng.integers(-spread, spread, (256, 6)), rng.integers(-spread, spread, (5000, 6))
        away = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        code, dist = vector_codes.Orchard(entries).nearest(points)
        assert (code == away.argmin(axis=1)).all() and (dist == away.min(axis=1)).all()


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows, dim, every=10, scale=256):
    rows = [r for r in usable(rows, dim) if r[2] is not None]
    x = np.clip(np.floor(scale * np.array([r[1] for r in rows])), -(1 << 20), 1 << 20)
    out = []
    for a, (own, _, label) in enumerate(rows):
        if own is None or own % every:
            continue
        score = [int(s) for s in x @ x[a]]
        order = sorted((i for i, r in enumerate(rows) if r[0] is None or r[0] != own), key=lambda i: (-score[i], rows[i][0] is None, rows[i][0] or 0))
        for p in [i for i in order if rows[i][2] == label][:5]:
            fit = [i for i in order if rows[i][2] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(own, rows[p][0], n + 1, rows[i][0], score[p], score[i]) for n, i in enumerate(fit[:10])]
    return sorted(out, key=repr)


def mined(df, every=10):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("label"), F.col("vec_id") % every == 0).collect()), key=repr)


def test_negatives_match_sql(spark, sf):
    check(spark, sf, queries.op12_hard_negatives, hard_negatives.ORACLE)


@pytest.mark.parametrize("clash", [False, True])
def test_negatives_edges(spark, clash):
    """Ties go by id; a repeated anchor appears once for each of its rows, so rows are compared as multisets."""
    assert mined(frame(spark, edge_rows(), clash)) == plain_negatives(edge_rows(), 8)


def test_negatives_over_a_tree_with_hot_copies(spark, monkeypatch):
    """Small leaves and pieces, so that the tree has three levels and a hot leaf many pieces; a third of all rows are one vector."""
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "DEGREE", 4)
    monkeypatch.setattr(vectors, "PIECE_ROWS", 32)
    monkeypatch.setattr(vectors, "PIECE_QUERIES", 7)
    rng = np.random.default_rng(1)
    heart = rng.standard_normal((6, 8))
    rows = [(i, [float(np.float32(x)) for x in heart[i % 6] + rng.standard_normal(8) / 20], int(rng.integers(3))) for i in range(600)]
    rows += [(600 + i, [0.5] * 8, i % 3) for i in range(300)]
    assert mined(frame(spark, rows)) == plain_negatives(rows, 8)


def test_tree_leaves_out_what_no_window_reaches():
    """The ranges exclude leaves, and never one that holds a row of a window."""
    rng = np.random.default_rng(3)
    heart = rng.integers(-200, 200, (12, 6))
    rows = (heart[rng.integers(12, size=2000)] + rng.integers(-6, 7, (2000, 6))).astype(np.float64)
    tree = hard_negatives.Gnat(rows, 40)
    leaf, _ = tree.placed(rows)
    for at, own, away, home in tree.visits(rows):
        if at >= 0:
            for j in range(away.shape[1]):
                part = home == j
                if part.any():
                    tree.low[at][:, j], tree.high[at][:, j] = away[part].min(axis=0), away[part].max(axis=0)
                    size = (rows[own[part]] ** 2).sum(axis=1)
                    tree.short[at][j], tree.long[at][j] = size.min(), size.max()
    score = rows[:50] @ rows.T
    low, high = np.quantile(score, 0.95, axis=1)[:, None], np.quantile(score, 0.97, axis=1)[:, None]
    reached = np.zeros((50, tree.leaves), bool)
    for at, places in tree.reach(rows[:50], low, high):
        reached[places, at] = True
    for i in range(50):
        needed = np.unique(leaf[(score[i] >= low[i]) & (score[i] <= high[i])])
        assert reached[i, needed].all()
    assert reached.mean() < 0.6


def test_negatives_of_nothing(spark):
    for rows in ([], [(100, None, 1)], [(100, [1.0] * 8, 1)], [(100, [1.0] * 8, None), (200, [1.0] * 8, None)]):
        assert mined(frame(spark, rows)) == []


# ---------------------------------------------------------------- nearest


def plain_nearest(rows, dim, every=10, k=10):
    rows = [r for r in usable(rows, dim) if any(r[1])]
    x, out = np.array([r[1] for r in rows]), []
    for a, (own, _, _) in enumerate(rows):
        if own is None or own % every:
            continue
        away = np.sqrt(((x[a] - x) ** 2).sum(axis=1))
        order = sorted((i for i, r in enumerate(rows) if r[0] is None or r[0] != own), key=lambda i: (away[i], rows[i][0] is None, rows[i][0] or 0))
        out += [(own, n + 1, rows[i][0], away[i]) for n, i in enumerate(order[:k])]
    return out


def recall(got, want):
    pairs = lambda rows: {(r[0], r[2]) for r in rows}
    return len(pairs(got) & pairs(want)) / max(1, len(pairs(want)))


@pytest.mark.parametrize("clash", [False, True])
def test_nearest_edges(spark, clash):
    """One list, so only the tests on partial distances could lose a neighbour; scores are those of the vectors themselves."""
    got = sorted(map(tuple, nearest.nearest(frame(spark, edge_rows(), clash), F.col("vec_id") % 10 == 0).collect()), key=repr)
    want = sorted(plain_nearest(edge_rows(), 8), key=repr)
    assert len(got) == len(want) and recall(got, want) >= 0.97
    exact = {}  # a repeated query has a distance of each of its rows
    for r in want:
        exact.setdefault((r[0], r[2]), []).append(r[3])
    assert all(any(x == pytest.approx(r[3], rel=1e-12) for x in exact[r[0], r[2]]) for r in got if (r[0], r[2]) in exact)


@pytest.mark.parametrize("dim", [3, 16, 40])
def test_nearest_recall_over_lists(spark, monkeypatch, dim):
    """Many lists and small pieces; a third of all rows are one vector, whose neighbours tie and go by id."""
    monkeypatch.setattr(vectors, "PIECE_ROWS", 64)
    monkeypatch.setattr(vectors, "PIECE_QUERIES", 9)
    rows = vecs(2000, dim, 6) + [(2000 + i, [0.5] * dim, 0) for i in range(1000)]
    df, p = frame(spark, rows), nearest.Search(list_rows=100, tuned=50)
    got, want = nearest.nearest(df, F.col("vec_id") % 10 == 0, p).collect(), plain_nearest(rows, dim)
    assert len(got) == len(want) and recall(got, want) >= 0.93
    ties = sorted((r[1], r[2]) for r in got if r[0] == 2500)
    assert ties == [(n + 1, 2000 + n) for n in range(10)]
    assert [tuple(r) for r in sorted(nearest.nearest(df.repartition(2), F.col("vec_id") % 10 == 0, p).collect())] == [tuple(r) for r in sorted(got)]


def test_nearest_of_nothing(spark):
    for rows in ([], [(100, [0.0] * 8, 1)], [(100, [1.0] * 8, 1)], [(1, [1.0] * 8, 1), (2, [1.0] * 8, 1)]):
        assert nearest.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0).collect() == []


def test_nearest_query(spark, sf):
    got = queries.op13_nearest(spark, sf).collect()
    x = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = plain_nearest([(r["vec_id"], r["embedding"], r["label"]) for r in x], 64, 100)
    assert len(got) == len(want) and recall(got, want) >= 0.95


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with vectors.batches_of(spark, 3):
        assert spark.conf.get(key) == "3"
    assert spark.conf.get(key) == before

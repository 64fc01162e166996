"""What the vector operators send: the sample, groups of pieces, and the queries that pass by them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkledger.llm import hard_negatives, nearest, vectors


def sent_to_driver(spark, run):
    """The bytes of task results while ``run`` runs, and what it returns."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).resultSize() for i in range(stages.size()))

    before = total()
    out = run()
    return total() - before, out


def table(spark, n, dim, hot=0, parts=20):
    """n random rows and ``hot`` copies of one."""
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.standard_normal(dim)]) for i in range(n)] + [(n, [0.25] * dim)] * hot
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)


def test_sample_sends_little_more_than_itself(spark, monkeypatch):
    """Each task used to send a whole sample."""
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 100)
    rows = table(spark, 4000, 64)
    sent, got = sent_to_driver(spark, lambda: vectors.sample(rows, 64, 4000))
    assert got.shape == (100, 64)
    assert sent < 20 * 100 * 64 * 8 / 2


def test_sample_is_that_of_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 50)
    for n, hot in ((1000, 0), (300, 700), (20, 500), (30, 0), (0, 200)):
        rows = table(spark, n, 4, hot)
        keyed = sorted((r["h"], r["embedding"]) for r in rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).collect())
        assert vectors.sample(rows, 4, n + hot).tolist() == [v for _, v in keyed[:50]]


def test_groups_take_every_piece_once_in_even_shares(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE_ROWS", 10)
    monkeypatch.setattr(vectors, "GROUPS", 8)
    many = {3: 1, 5: 95, 6: 400, 9: 7, 12: 300}
    cells = spark.createDataFrame([(c,) for c, n in many.items() for _ in range(n)], "cell int")
    for wide, least in ((4, 8), (1 << 19, 8), (1 << 22, 51)):  # the last: vectors that fill more groups
        got = vectors.groups(cells, wide)
        assert got.many == least
        assert sorted(p[:2] for p in got.places) == [(c, s) for c, n in many.items() for s in range(-(-n // 10))]
        size = np.zeros(got.many)
        for cell, _, group in got.places:
            size[group] += many[cell] / got.salts[cell]
            assert cell in got.cells[group]
        assert size.max() <= 803 / got.many + 10
        assert sorted(g for r in got.rounds() for g in r) == list(range(got.many))


def test_a_query_travels_once_for_each_group(spark, monkeypatch):
    """It used to travel once for each piece: 40 here."""
    monkeypatch.setattr(vectors, "PIECE_ROWS", 16)
    monkeypatch.setattr(vectors, "GROUPS", 4)
    cells = spark.createDataFrame([(i % 10,) for i in range(640)], "cell int")
    groups = vectors.groups(cells, 8)
    assert len(groups.places) == 40
    queries = spark.createDataFrame([(i % 10, i, bytes([i] * 8)) for i in range(60)], "cell int, q long, vec binary")
    blocks = vectors.pack(queries.withColumn("salt", F.lit(0)), ["cell", "salt"], 7)

    def keep(c):
        for cell in range(10):
            yield cell, np.flatnonzero(c["q"] != cell)

    got = vectors.spread_queries(blocks, keep, groups, list(range(4))).collect()
    seen = {}
    for r in got:
        bits = np.unpackbits(np.frombuffer(bytes(r["asked"]), np.uint8).reshape(len(r["cells"]), -1), axis=1, count=len(r["q"]))
        assert bytes(r["vec"]) == b"".join(bytes([q] * 8) for q in r["q"])
        for i, q in enumerate(r["q"]):
            assert (r["grp"], q) not in seen
            seen[r["grp"], q] = {c for c, on in zip(r["cells"], bits[:, i], strict=True) if on}
    for g in range(4):
        for q in range(60):
            assert seen.get((g, q), set()) == {c for c in groups.cells[g] if c != q}


def test_windows_are_exact_in_single_and_double_precision():
    """Products beyond 2^24 are not exact in single precision; ranges of scores a few units wide tell."""
    rng = np.random.default_rng(5)
    for size in (200, 60_000):
        x, labels, ids = rng.integers(-size, size, (700, 8)).astype(np.int32), rng.integers(3, size=700), np.arange(700)
        held = hard_negatives.leaves({0: {"vec_id": ids[:400], "label": labels[:400], "vec": x[:400].tobytes()}, 4: {"vec_id": ids[400:], "label": labels[400:], "vec": x[400:].tobytes()}}, 8)
        score = x[:50].astype(np.int64) @ x.astype(np.int64).T
        mid = np.sort(score, axis=1)[:, [650, 680]].astype(np.float64)
        low, high = np.concatenate([mid - 1, np.full((50, 1), np.nan)], axis=1), np.concatenate([mid, np.full((50, 1), np.nan)], axis=1)
        block = {"q": 1000 + ids[:50], "vec_id": ids[:50], "label": labels[:50], "vec": x[:50].tobytes(), "low": low, "high": high}
        for same in (True, False):
            got = {}
            for b in hard_negatives.compare(held, block, {0: np.arange(50), 4: np.arange(50)}, 8, same, 3):
                for q, w, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got.setdefault((q - 1000, w), []).append((-s, i))
            for q in range(50):
                for w in range(3):
                    fit = [(-int(score[q, i]), int(i)) for i in ids if i != q and (labels[i] == labels[q]) == same and low[q, w] <= score[q, i] <= high[q, w]]
                    assert got.get((q, w), []) == sorted(fit)[:3]


def test_scan_finds_what_the_tests_leave_whatever_the_product_took():
    rng = np.random.default_rng(8)
    for dim, far in ((40, 1.0), (64, 1.0), (16, 1e20), (24, 1e-3)):
        rows, p = rng.standard_normal((900, dim)) * far, nearest.Search(epsilon=0.3)  # loses a part
        index = nearest.Index(rows[:300], 3, dim, np.float64, p)
        cells, _ = index.placed(rows)
        held = index.hold({int(c): {"vec_id": np.flatnonzero(cells == c), "vec": rows[cells == c].tobytes()} for c in np.unique(cells)})
        q = rows[:40]
        away = ((q[:, None] - rows[None]) ** 2).sum(axis=2)
        away[np.arange(40), np.arange(40)] = np.inf
        edge = np.sort(away, axis=1)[:, 60]
        turned, left = (q[:, None] - rows[None]) @ index.turn, away < np.inf
        for seen in [*range(p.block, dim, p.block), dim]:
            left &= (turned[:, :, :seen] ** 2).sum(axis=2) <= edge[:, None] * index.limit(seen)
        want = [sorted((away[i, j], int(j)) for j in np.flatnonzero(left[i]))[: p.k] for i in range(40)]
        block = {"q": np.arange(40), "vec_id": np.arange(40), "vec": q.tobytes(), "edge": edge, "near": np.full(40, np.inf)}
        assert 0 < left.sum() < (away <= edge[:, None]).sum()
        for seen in [*range(p.block, dim, p.block), dim]:
            index.seen = seen
            got = pa.Table.from_batches(list(index.scan(held, block, {c: np.arange(40) for c in held}))).to_pydict()
            for i in range(40):
                assert [v for k, v in zip(got["q"], got["vec_id"], strict=True) if k == i] == [j for _, j in want[i]]

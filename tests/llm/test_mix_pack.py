"""Mixing, packing and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

import corpus_pipeline
from inkledger.llm import mixing, packing, queries, toxicity
from inkledger.llm.common import documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rows_of(n):
    rng = random.Random(n)
    return [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))), "en", rng.choice(["a", "a", "b", None, "c"]), 0) for i in range(n)] + [(None, None, None, None, 0), (7, "again and again", "en", "a", 0), (7, "again and again", "en", "a", 0)]


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- mixing


def test_mix_matches_sql(spark, sf):
    check(spark, sf, queries.op7_mix_sources, mixing.ORACLE)


def test_mix_targets_and_reruns(spark):
    docs = spark.createDataFrame(rows_of(300), DOCS).withColumn("key", F.lit("clash"))
    weights = mixing.quality_weights(docs, labels_of(spark, [(1, 1, 0), (2, 0, 0), (None, 1, 0)]))
    one, two = (sorted(map(tuple, mixing.mix_sources(docs, weights, bucket_rows=n).collect()), key=repr) for n in (20, 100_000))
    assert one == two
    by_source = {}
    for _, size, source_size, target, taken in one:
        assert 0 <= taken <= 2 * size
        got = by_source.setdefault((source_size, target), [0, 0])
        got[0] += taken
        got[1] += size
    for (source_size, target), (taken, size) in by_source.items():
        assert size == source_size and abs(taken - target) <= 1 and target <= 2 * source_size + 1e-9
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * sum(s for s, _ in by_source))
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0


def test_mix_prefers_good_documents(spark):
    docs = spark.createDataFrame([(i, "one two", "en", "abc"[i // 1000], 0) for i in range(3000)], DOCS)
    weights = mixing.quality_weights(docs, labels_of(spark, [(i, i % 2, 0) for i in range(1000, 2000)]))
    rows = [r for r in mixing.mix_sources(docs, weights).collect() if 1000 <= r.doc_id < 2000]
    assert sum(r.taken for r in rows if r.doc_id % 2) > 1.3 * sum(r.taken for r in rows if not r.doc_id % 2)


def test_take_repeats_and_cuts(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", "en", "s", 6), (2, "d e", "en", "s", 3), (3, "f", "en", "s", 1)], DOCS)
    mixed = spark.createDataFrame([(1, 3, 5), (2, 2, 1), (3, 1, 0)], "doc_id long, size long, taken long")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in mixing.take_mix(docs, mixed).collect())
    assert got == [(1, "a  b\nc", 6), (1, "a b", 3), (2, "d", 1)]


def test_take_keeps_rows_without_an_id_of_their_own(spark):
    rows = [(None, " ".join(f"t{i}w{k}" for k in range(i % 4 + 1)), "en", "a", 0) for i in range(30)] + [(5, "one two three", "en", "a", 0), (5, "four", "en", "b", 0), (5, "four", "en", "b", 0), (5, "six seven", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix_sources(docs, mixing.quality_weights(docs, labels_of(spark)), keyed=True).collect()
    got = mixing.take_mix(docs, spark.createDataFrame(mixed)).collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in mixed)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    wanted = {}
    for r in mixed:
        source = next(s for _, t, _, s, _ in rows if len(t.split()) == r.size and sum(len(x.split()) for _, x, _, y, _ in rows if y == s) == r.source_size)
        wanted[source] = wanted.get(source, 0) + r.taken
    assert sizes == {k: v for k, v in wanted.items() if v}


# ---------------------------------------------------------------- packing


def layout(pieces, length):
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
        assert ends[p.sequence_id] <= length
    full = [n for s, n in sorted(ends.items())]
    assert sorted(ends) == list(range(len(ends))) and all(n == length for n in full[:-1])


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 3.0, None: 1.0}])
def test_pieces_round_trip(spark, weights):
    from tokenizers import Tokenizer

    rows = rows_of(200) + [(900, "It's <|endoftext|> A.b, c. ÉÀ", "en", "b", 0)]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), tokenizer_path(), 64, 4, weights=weights).collect()
    exact = Tokenizer.from_file(tokenizer_path())
    layout(pieces, 64)
    for doc_id, text, *_ in rows:
        if doc_id in (None, 7):
            continue
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [p.start for p in mine] == list(np.cumsum([0, *(p.length for p in mine)])[:-1])
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_windows_hold_the_proportions():
    rounds = packing.Rounds([6000, 3000, 1000], [6000.0, 3000.0, 1000.0], 500)
    for q, share in enumerate((0.6, 0.3, 0.1)):
        served = rounds.served(np.full(21, q), np.arange(21))
        assert (np.abs(served - share * 500 * np.arange(21)) < 1 + 1e-9).all() and served[-1] == (6000, 3000, 1000)[q]
    dry = packing.Rounds([100, 1000], [1.0, 1.0], 100)
    assert dry.served(np.array([1, 1]), np.array([2, 3])).tolist() == [100, 200]


def test_many_sources_keep_their_weights(spark):
    """1,100 sources with weights 1 and 3: while none is dry, every window holds a quarter and three quarters."""
    rows = [(i, " ".join(["and"] * 119), "en", f"s{i}", 0) for i in range(1100)]
    weights = {f"s{i}": 3.0 if i % 2 else 1.0 for i in range(1100)}
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer_path(), 550, 4, weights=weights).collect()
    layout(pieces, 550)
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    assert len(tokens) == 1100 and sum(p.length for p in pieces) == sum(tokens.values())
    for w in range(1, 30):
        heavy = sum(p.length for p in pieces if p.sequence_id < 4 * w and p.doc_id % 2)
        assert abs(heavy - 0.75 * 2200 * w) <= 1100
    assert all(abs(sum(p.length for p in pieces if p.doc_id == i and p.sequence_id < 80) - (60 if i % 2 else 20)) <= 2 for i in range(1100))


@pytest.mark.parametrize("queues", [50, 700, 10_000])
def test_many_sources_are_not_ground_to_tokens(queues):
    """However many sources there are, and however uneven, pieces stay long, every token has one place, and a source is never
    further from its share than the least piece it waits for."""
    rng = np.random.default_rng(queues)
    totals = np.maximum(1, (rng.pareto(1.2, queues) * 8000).astype(int))
    rounds = packing.Rounds(totals.tolist(), totals.astype(float).tolist(), max(16 * 2048, packing.SHARE * queues), packing.LEAST)
    some = np.arange(queues) if queues <= 700 else rng.permutation(queues)[:200]
    parts = [packing.cut(rounds, int(q), np.array([0]), np.array([totals[q]]), 2048) for q in some]
    spans = np.concatenate([np.stack([at, end - first]) for _, first, end, at in parts], axis=1)
    assert spans[1].sum() == totals[some].sum() and spans[1].min() > 0
    assert totals[some].sum() / spans.shape[1] > 256
    spans = spans[:, np.argsort(spans[0])]
    assert (spans[0, 1:] >= spans[0, :-1] + spans[1, :-1]).all()
    if queues <= 700:
        assert spans[0, 0] == 0 and (spans[0, 1:] == spans[0, :-1] + spans[1, :-1]).all()
    share, every = totals / totals.sum(), np.arange(queues)
    for w in range(1, rounds.windows, max(1, rounds.windows // 20)):
        served = rounds.served(every, np.full(queues, w))
        due = np.minimum(share * w * max(16 * 2048, packing.SHARE * queues), totals)
        assert (np.abs(served - due) <= packing.LEAST + 1).all()


def test_many_sources_of_the_table(spark):
    """The same through the operator: 400 sources of one long and many short documents."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["and", "river", "stone", "light"]) for _ in range(rng.choice([5, 300, 4000]))), "en", f"s{i % 400}", 0) for i in range(800)]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer_path()).collect()
    layout(pieces, 2048)
    assert sum(p.length for p in pieces) / len(pieces) > 256


def test_mix_of_one_id_does_not_depend_on_the_order_of_rows(spark):
    """600 documents that share an id, some of them equal, in three orders."""
    rng = random.Random(8)
    rows = [(5, " ".join("w" for _ in range(rng.randint(0, 40))) + f" {i % 550}", "en", rng.choice(["a", "b", "c"]), 0) for i in range(600)]
    seen = set()
    for turn in range(3):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, DOCS).repartition(turn + 1)
        mixed = mixing.mix_sources(docs, mixing.quality_weights(docs, labels_of(spark)), bucket_rows=50, keyed=True)
        seen.add(tuple(sorted(map(tuple, mixed.collect()))))
    assert len(seen) == 1
    taken = [r[4] / r[1] for r in seen.pop()]
    assert len(set(taken)) > 1  # the fractional rest is a prefix of an order that the texts give


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs, before = documents(spark, sf), None
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert not ids & bad and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "mixing":
            assert len(ids) == docs.count()
    layout(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), 2048)
    assert corpus_pipeline.run(spark, sf).count() > 0

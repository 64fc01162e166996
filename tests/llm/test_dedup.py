"""Exact, near and passage de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from inkledger.llm import exact_dedup, near_dup, queries, suffix_dedup
from inkledger.llm.common import documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "bcdfghjklm" for b in ("a", "en", "ist", "oru")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows():
    return [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (None, "a b"), (6, "x" * 5000), (6, "x" * 5000), (7, "one two three four five six")]


# ---------------------------------------------------------------- exact


def test_exact_matches_sql(spark, sf):
    check(spark, sf, queries.op2_exact_dedup, exact_dedup.ORACLE)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_edges_and_digest_collisions(spark, digest):
    rng = random.Random(1)
    rows = edge_rows() + [(10 + i, rng.choice(["p q", "pq", " p q ", "other", "r"])) for i in range(200)]
    got = exact_dedup.exact_groups(frame(spark, rows), digest=digest).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    for key, members in groups.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()]
        assert {(r.keep_id, r.group_size) for r in mine} == {(min(members)[2], len(members))}
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_keeps_one_row_of_repeats(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a  b"), (3, "c")]
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(frame(spark, rows).withColumn("salt", F.lit(1))).collect()) == [2, 3]


def test_exact_keeps_different_texts_of_one_id(spark):
    rows = [(None, f"text {i}") for i in range(30)] + [(None, "text3"), (9, "a b"), (9, "c d"), (9, "cd"), (9, "ab c"), (8, "abc")]
    got = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    want = [(None, f"text {i}") for i in range(30)] + [(9, "a b"), (9, "c d"), (9, "ab c")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


# ---------------------------------------------------------------- near


def near_brute(rows, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(sets[k]), least.get(top(k)) if i is not None else None) for k, (i, _) in enumerate(rows)]


def families(rng, n, copies):
    rows = []
    for _ in range(n):
        base = prose(rng, rng.choice([3, 30, 80, 200])).split()
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows) + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("params", [near_dup.Join(), near_dup.Join(node_rows=8, leaf=4, max_levels=3)])
def test_near_matches_brute_force(spark, params):
    """The second setting makes every larger node branch by shuffles and, at last, go through all pairs of blocks."""
    rng = random.Random(7)
    rows = edge_rows() + [(100 + i, t) for i, t in families(rng, 25, 12)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in near_dup.near_groups(frame(spark, rows), params).collect())
    want = sorted((-1 if i is None else i, n, -1 if c is None else c) for i, n, c in near_brute(rows))
    wrong = sum(a != b for a, b in zip(got, want, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert wrong <= len(rows) * 0.02


def test_near_links_of_documents_that_share_an_id(spark):
    """Each of an id's texts keeps its own links: classes do not get mixed up by the id they have in common."""
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    edited = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(5, a), (5, b), (7, edited(b)), (8, edited(a)), (9, c)]
    for given in (rows, rows[::-1], [(6 if i == 7 else 3 if i == 5 else i, t) for i, t in rows]):
        got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_groups(frame(spark, given)).collect()}
        first, second = (3, 6) if given[0][0] == 3 else (5, 7)
        assert got == {(first, first, True), (second, first, False), (8, first, False), (9, 9, True)}
        kept = near_dup.drop_near_copies(frame(spark, given)).select("doc_id", "text").collect()
        assert sorted(map(tuple, kept)) == sorted([(first, a), (first, b), (9, c)])


@pytest.mark.parametrize("ids", [5, 40])
def test_near_brute_force_with_repeated_ids(spark, ids):
    """Many texts for few ids: the links of every text, and of a component the least id of any of its texts."""
    rng = random.Random(ids)
    rows = [(rng.randrange(ids), t) for _, t in families(rng, 30, 6)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_groups(frame(spark, rows)).collect())
    want = sorted(near_brute(rows))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= len(rows) * 0.02


def test_near_crowd_is_one_component(spark):
    rng = random.Random(3)
    base = prose(rng, 100).split()
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(100)] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_groups(frame(spark, rows), near_dup.Join(node_rows=200)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def hanging(rng, copies, edited):
    """A crowd of near copies, and texts that are similar to one of its members only."""
    base = prose(rng, 400).split()
    rows = []
    for i in range(copies):
        w = list(base)
        for k in range(5):  # about 0.88 with the base
            w[i % 40 * 5 + k * 40 % 200] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    for i in range(edited):
        w = rows[i * 7][1].split()
        for k in range(10):  # about 0.78 with the member
            w[205 + 19 * k] = f"y{i}x{k}"
        rows.append((copies + i, " ".join(w)))
    return rows


def test_near_star_loses_no_pair():
    """What leaves for the centre has met all of other components that may be similar to it."""
    rng, p = np.random.default_rng(5), near_dup.Join()
    core = rng.integers(0, 1 << 16, p.tokens)

    def edit(sig, share):
        out = sig.copy()
        at = rng.choice(p.tokens, round(share * p.tokens), replace=False)
        out[at] = rng.integers(0, 1 << 16, len(at))
        return out

    crowd = [edit(core, 0.05) for _ in range(60)]
    sig = np.array([*crowd, *(edit(crowd[i], 0.24) for i in range(20))]).astype(np.uint16)
    root = np.array([0] * 60 + list(range(60, 80)))
    work = near_dup.Node(p, np.arange(80), sig, root)
    stay = set(work.star(np.arange(80)).tolist())
    assert len(stay) < 60
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if root[a] != root[b] and (sig[a] == sig[b]).mean() >= p.least and not {a, b} <= stay}
    assert want and want <= {tuple(sorted(x)) for x in work.found}


def test_near_large_node_keeps_what_hangs_on_a_member(spark):
    rows = hanging(random.Random(8), 80, 6)
    got = sorted((r.doc_id, r.component_id) for r in near_dup.near_groups(frame(spark, rows), near_dup.Join(node_rows=16, leaf=8, near=0.8, blocks=1)).collect())
    assert got == sorted((i, c) for i, _, c in near_brute(rows))


def test_near_recall_holds_at_depth():
    """A crowd of pairs at 0.6 in one node, and pairs at 0.75 within it: none but the stated share is lost."""
    rng, p = np.random.default_rng(6), near_dup.Join()
    core = rng.integers(0, 1 << 16, p.tokens)
    own = rng.integers(0, 1 << 16, (3000, p.tokens))
    sig = np.where(rng.random(own.shape) < 0.6**0.5, core, own).astype(np.uint16)
    other = np.where(rng.random((300, p.tokens)) < 0.75, sig[:300], rng.integers(0, 1 << 16, (300, p.tokens))).astype(np.uint16)
    sig = np.concatenate([sig, other])
    work = near_dup.Node(p, np.arange(len(sig)), sig, np.arange(len(sig)))
    for node in range(3):
        work.settle(node, np.arange(len(sig)))
    want = {(i, 3000 + i) for i in range(300) if (sig[i] == sig[3000 + i]).mean() >= p.least}
    assert len(want) >= 297
    assert len(want - {tuple(sorted(x)) for x in work.found}) <= 3
    error = (0.75 * 0.25 / p.tokens) ** 0.5
    assert p.slack >= 2.99 * error and near_dup.missed(p, near_dup.deep_branches(p), 1 + 2 * p.max_levels) <= 0.001


def test_near_empty(spark):
    assert near_dup.near_groups(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- passages


def passages_brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k : k + length] for _, x in raw for k in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((-1 if i is None else i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [4096, 1])
def test_passages_match_brute_force(spark, bucket_rows):
    rng = random.Random(5)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = edge_rows() + [(20 + i, " ".join(rng.choice([prose(rng, rng.randint(1, 40)), rng.choice(shared), "ñandú " * 9, "a" * 90]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(500, "".join(prose(rng, 300))), (501, "é" * 200)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), 80, 16, bucket_rows).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == passages_brute(rows, 80)


def test_passages_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]
    got = queries.op10_suffix_dedup(spark, sf).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == passages_brute(rows, 400)


def test_block_sort_ties(spark):
    rng = random.Random(9)
    for length in (80, 400):
        base = bytes(rng.choice(b"ab") for _ in range(length + 200))
        rows = [(base[a : a + length + rng.randint(0, 100)], rng.choice([1, 2])) for a in (rng.randrange(100) for _ in range(9))]
        seen = Counter()
        for x, w in rows:
            for k in range(len(x) - length + 1):
                seen[x[k : k + length]] += w
        for (x, _), again in zip(rows, suffix_dedup.repeated_starts(rows, length), strict=True):
            assert again.tolist() == [seen[x[k : k + length]] > 1 for k in range(len(x) - length + 1)]


def test_passages_leave_texts_and_spans(spark):
    """The texts that are left, byte for byte, and what was cut; copies of a row keep a row each, a halved character is shown as such."""
    rng = random.Random(8)
    shared = prose(rng, 30)
    rows = [(1, "head " + shared + " tail"), (2, shared), (3, "other"), (3, "other"), (4, shared + "x"), (4, shared + "x"), (None, None), (5, "é" + "b" * 90), (6, "ũ" + "b" * 90)]
    got = suffix_dedup.cut_repeats(frame(spark, rows), 80, 16).collect()
    raw = {i: (t or "").encode() for i, t in rows}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    digest = lambda r: hashlib.sha256(bytes(r.kept)).hexdigest()
    brute = passages_brute(rows, 80)
    assert sorted((-1 if r.doc_id is None else r.doc_id, len(raw[r.doc_id]), sum(s.end - s.start for s in r.spans), len(r.spans), digest(r)) for r in got) == brute
    for r in got:
        left = raw[r.doc_id]
        for s in reversed(r.spans):
            left = left[: s.start] + left[s.end :]
        assert left == bytes(r.kept)
    texts = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame(spark, rows), 80, 16).collect()}
    assert shared not in texts[1] and texts[3] == "other" and texts[4] == "" and texts[None] == "" and texts[5] == "�"


def test_passages_of_over_50_words(spark, tmp_path):
    """Planted in two documents each: all that reach 400 bytes go, shorter ones stay however many words they have, documents without one stay whole."""
    rng = random.Random(11)
    planted = {i: prose(rng, 400)[:size] for i, size in enumerate((250, 399, 400, 401, 900))}
    rows = [(10 * i + k, f"{prose(rng, 90)} {k}{p}{k} {prose(rng, 90)}") for i, p in planted.items() for k in (1, 2)] + [(100 + i, prose(rng, 300)) for i in range(20)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        p = planted.get(i // 10, "")
        assert i >= 100 or len(p.split()) > 50
        assert (got[i].n_removed, got[i].text) == ((len(p), t.replace(p, "")) if len(p) >= 400 else (0, t))


def test_passages_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0

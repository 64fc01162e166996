"""Quality rules, secret scan, language spans, toxicity and token counts."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkledger.llm import language_id, quality_rules, queries, secret_scan, token_counts, toxicity
from inkledger.llm.common import documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, 0), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 0), (None, "the end", "en", "s", 0), (4, "x" * 30000, "en", "s", 0), (5, "a b c " * 300, "en", "s", 0), (5, "a b c " * 300, "en", "s", 0)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- quality


def base(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [t for t in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", t)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_base_counts(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, sf).collect()}
    for r in rows:
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base(r.text)
        assert not (g.base_failed and g.kept)


def test_quality_edges(spark):
    docs = spark.createDataFrame(EDGE, DOCS).withColumn("stratum", F.lit("clash"))
    got = quality_rules.quality_rules(docs, labels_of(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0)])).collect()
    assert len(got) == len(EDGE) and not any(r.kept for r in got)
    assert quality_rules.quality_rules(docs.limit(0), labels_of(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "k", "p"), [(100, 0, 0.005), (1000, 3, 0.005), (3000, 2, 0.01), (10, 9, 0.005)])
def test_binomial_tail_is_exact(spark, n, k, p):
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    q = Fraction(str(p))
    want = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))) if k < n * p else 1.0
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_hold_the_risk(spark):
    """Good documents with few symbols, bad ones with many: the cutoff rejects the bad and at most the risk of the good."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["word%d" % j for j in rng.permutation(90)] + ["#"] * int(rng.integers(0, 4) if i % 4 else 60)), "en", "s", 0) for i in range(4000)]
    labels = labels_of(spark, [(i, int(i % 4 > 0), 0) for i in range(4000)])
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), labels).collect()}
    good = [got[i] for i in range(4000) if i % 4]
    assert 1 - sum(good) / len(good) <= 0.02
    assert not any(got[i] for i in range(4000) if i % 4 == 0)
    few = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), labels.limit(200)).collect()}
    assert all(few.values())


# ---------------------------------------------------------------- secrets


def brute_spans(text):
    spans = []
    for kind, rx, ok in (
        (0, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(rx, text or "") if ok(m)]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_base_spans(spark, sf):
    text = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    for r in queries.op4_secret_scan(spark, sf).collect():
        joined = brute_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))


def test_texts_of_many_spans():
    """The added kinds against all spans before them: the same as by comparing each with each, and fast on a key dump."""
    import time

    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 36))
    lines = [f"token = {word()} https://user:{word()[:9]}@host/{word()} {word()}" if i % 3 == 0 else word() for i in range(300)]
    text = "\n".join(lines)
    base, more = secret_scan.scan(text)
    taken = [(s, e) for _, s, e, _ in base]
    slow = []
    for kind, (_, pattern, group) in enumerate(secret_scan.ADDED, 3):
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e in taken):
                slow.append((kind, m.start(), m.end(), m[group]))
                taken.append((m.start(), m.end()))
    assert more == sorted(slow, key=lambda x: (x[1], x[0])) and len(more) > 200
    began = time.perf_counter()
    assert len(secret_scan.scan(" ".join(lines[1::3][:90] * 1200))[1]) > 100_000
    assert time.perf_counter() - began < 20


def test_ownership_separates_examples(spark):
    live, copied = "gh" + "p_" + "q9Wz7LmK3xVb5TtYc1RnHd8JsPg2FkUe4Aoi", "gh" + "p_" + "z8Xy6KnJ2wUa4SsXb0QmGc7HrOf1EjTd3Bpq"
    rows = [(1, f"key {live} end", "en", "a", 0), (2, "ſecret=abcdefgh token = short TOKEN: 'abcdef.gh' password=ab", "en", "a", 0)]
    rows += [(10 + i, f"é {copied}", "en", f"s{i % 4}", 0) for i in range(8)] + EDGE
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].spans == f"provider:4:{4 + len(live)}" and got[1].n_live == 1
    assert got[10].spans == "" and got[10].n_copied == 1
    assert got[2].n_assign == 1 and brute_spans(rows[1][1]) == got[2].spans
    assert secret_scan.scan_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_passwords_in_addresses_are_live(spark):
    rows = [(1, "at db://user:Passw0rd9@host now", "en", "a", 0), (2, "at db://user:changeme@host now", "en", "a", 0)]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].n_live == 1 and got[1].spans.startswith("url:")
    assert got[2].n_live == 0 and got[2].spans == ""


# ---------------------------------------------------------------- language


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_language_id(spark, sf).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in documents(spark, sf).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(a == b for a, b in held) / len(held) >= 0.97


def test_language_spans_and_edges(spark, sf):
    model = language_id.train(documents(spark, sf))
    rows = [(r.lang, r.text) for r in documents(spark, sf).filter("length(text) between 400 and 900 and lang in ('en', 'de')").collect()]
    english, german = (next(t for lang, t in rows if lang == x) for x in ("en", "de"))
    mixed = english + "\n" + german
    docs = spark.createDataFrame([*EDGE, (77, mixed, None, None, 0), (78, "12 34 !?", None, None, 0), (79, "привет мир", None, None, 0)], DOCS)
    got = {r.doc_id: r for r in language_id.predict(docs, model, spans=True).collect()}
    names = [s.lang for s in got[77].spans]
    assert names == ["en", "de"] and abs(got[77].spans[1].start - len(english)) < 40
    assert got[1].lang_pred == got[2].lang_pred == got[78].lang_pred == "und" and got[1].score == 0
    none = language_id.train(docs.filter("doc_id < 0"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_letters_of_the_last_planes_are_letters(spark):
    """A text of letters beyond U+30000 has a language; one of signs beyond has none."""
    rows = [(i, "der wind und die welle " * 5 if i % 2 else "the wind and the wave " * 5, "de" if i % 2 else "en", "s", 0) for i in range(40)] + [(100, chr(0x30000) * 20, None, "s", 0), (101, chr(0x3134A) + " " + chr(0x31350), None, "s", 0), (102, chr(0xE0001) * 9 + chr(0x10FFFF), None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert got[100][0] in ("de", "en") and got[101][0] in ("de", "en") and 0 <= got[100][1] <= 1 and got[102] == ("und", 0.0)
    assert not any(chr(c).isalpha() for c in range(language_id.LETTER_POINTS - 1, 0x110000))


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(1)
    vocabulary = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for _ in range(80)]
    rows = [(1000 * i + k, " ".join(rng.choice(vocabulary[i], 30)), f"l{i:02}", "s", 0) for i in range(80) for k in range(12 if i < 64 else 8)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert sum(got[i] == lang for i, _, lang, *_ in rows) == len(rows)


def test_viterbi_is_optimal():
    rng = np.random.default_rng(4)
    first = np.array([0, 0, 5, 6, 12])
    scores = rng.normal(size=(12, 3)).astype(np.float32)
    labels = language_id.viterbi(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:], strict=True):
        def value(path, a=a):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))
        best = max((value(p) for p in np.ndindex(*(3,) * (b - a))), default=0)
        assert value(labels[a:b]) == pytest.approx(best, abs=1e-5)


# ---------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op8_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in got)
    assert wrong / len(got) <= 0.05
    assert sum(r.predicted for r in got if not r.toxic) / len(got) <= 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([*EDGE, *((100 + i, "you are vile" if i % 4 == 1 else "a fine day", "en", "s", 0) for i in range(200))], DOCS)
    labels = labels_of(spark, [(100 + i, 1, int(i % 4 == 1)) for i in range(200)] + [(None, 1, 1), (100, 1, None), (4, 1, 0)])
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert got[101].predicted == 1 and got[100].predicted == 0 and got[1].score == got[2].score
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("text = 'you are vile'").count() == 0 and kept.count() == len(EDGE) + 150
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


# ---------------------------------------------------------------- tokens


def test_token_counts_match_the_tokenizer(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    exact = Tokenizer(models.Unigram([("<unk>", min(pieces.values())), *pieces.items()], 0, False))
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, sf).collect()}
    for r in documents(spark, sf).limit(60).collect():
        words = ["▁" + w for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        assert got[r.doc_id] == sum(len(e.ids) for e in exact.encode_batch(words, add_special_tokens=False))
    edge = token_counts.count_tokens(spark.createDataFrame(EDGE, DOCS), path).collect()
    assert len(edge) == len(EDGE) and [r.n_tokens for r in edge if r.doc_id in (1, 2, 3)] == [0, 0, 0]


def test_token_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    pieces = {"a": -1.0, "b": -1.0, "ab": -2.0, "aba": -3.0, "ba": -2.0}
    exact, count = Tokenizer(models.Unigram([("<unk>", -3.0), *pieces.items()], 0, False)), token_counts.Counter(pieces)
    for word in ("abab", "ababa", "zzab", "azzb", "baab", "z", "abazz"):
        assert count.pack(word) % token_counts.UNKNOWN == len(exact.encode(word, add_special_tokens=False).ids)

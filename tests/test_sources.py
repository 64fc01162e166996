"""Files and tables that change in place: what is not concerned stays as it is, and a second run changes nothing."""

import json
import os
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from inkledger.operators import audit, kpi
from inkledger.plans import files
from inkledger.plans.domain import view
from inkledger.plans import files
from inkledger.sources import fold, readers, relational, versions, writers

FIXES = "bank string, file string, field string, after string, reason string, reviewer_id string, at string"


def put(folder, *lines):
    folder.mkdir(parents=True)
    (folder / "part.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    os.utime(folder / "part.json", (1_700_000_000, 1_700_000_000))


def lines_of(folder):
    return [x for f in sorted(folder.glob("part*")) for x in f.read_text().splitlines() if x]


def test_a_fold_keeps_what_it_does_not_change(spark, tmp_path):
    """Members without a schema, nulls, other documents, unreadable lines and other partitions stay; repeats, unknown fields, banks
    and files, and corrections without a value do nothing."""
    one = {"bank": "A", "file": "f1", "extra": {"x": [1, None]}, "none": None, "fields": {"date": {"parse_norm": "old", "odd": 1.5}, "n": {}}}
    other = '{"bank": "A", "file":  "f2", "fields": {"date": {"parse_norm": null}}}'
    put(tmp_path / "bank_code=A", one, other, '{"bad')
    put(tmp_path / "bank_code=B", {"bank": "B", "file": "f1", "fields": None, "corrections": None})
    rows = [("A", "f1", "date", "v2", None, "r", "2"), ("A", "f1", "date", "v1", "why", "r", "1"), ("A", "f1", "date", "v1", "why", "r", "1"), ("A", "f1", "gone", "x", None, "r", "1"), ("A", "f1", "n", "z", None, None, "3"), ("A", "f1", "n", None, None, "r", "4"), ("C", "f1", "n", "z", None, "r", "3"), ("A", "f9", "n", "z", None, "r", "3"), (None, "f1", "n", "z", None, "r", "3")]
    fixes = spark.createDataFrame(rows, FIXES)
    for _ in range(2):
        assert fold.fold_audit(spark, str(tmp_path), fixes) == 1
        found = lines_of(tmp_path / "bank_code=A")
        assert other in found and '{"bad' in found and len(found) == 3
        doc = next(json.loads(x) for x in found if '"f1"' in x)
        history = doc.pop("corrections")
        assert [(c["field"], c["before"], c["after"], c["reason"], c["reviewer_id"]) for c in history] == [("date", "old", "v1", "why", "r"), ("date", "v1", "v2", None, "r"), ("n", None, "z", None, None)]
        assert doc == one | {"fields": {"date": {"parse_norm": "v2", "odd": 1.5}, "n": {"parse_norm": "z"}}}
    assert (tmp_path / "bank_code=B" / "part.json").stat().st_mtime == 1_700_000_000
    later = spark.createDataFrame([("A", "f1", "date", "v3", None, "r", "0")], FIXES)
    fold.fold_audit(spark, str(tmp_path), later)
    doc = next(json.loads(x) for x in lines_of(tmp_path / "bank_code=A") if '"f1"' in x)
    assert (doc["corrections"][-1]["before"], doc["fields"]["date"]["parse_norm"], len(doc["corrections"])) == ("v2", "v3", 4)
    assert fold.fold_audit(spark, str(tmp_path), later.limit(0)) == 0


def test_a_fold_opens_the_shards_it_needs(spark, tmp_path):
    docs = spark.range(40).select(F.lit("A").alias("bank"), F.format_string("f%d", "id").alias("file"), F.create_map(F.lit("date"), F.struct(F.lit("x").alias("parse_norm"))).alias("fields"))
    writers.write_audit(docs, f"{tmp_path}/a", shards=8)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "a").glob("bank_code=A/shard=*/part*")}
    assert fold.fold_audit(spark, f"{tmp_path}/a", spark.createDataFrame([("A", "f7", "date", "y", None, "r", "1")], FIXES), 8) == 1
    kept = [f for f, at in files.items() if f.exists() and f.stat().st_mtime_ns == at]
    shards = {f.parent for f in files}
    assert len(shards) > 4 and len({f.parent for f in kept}) == len(shards) - 1
    got = readers.scan_audit(spark, f"{tmp_path}/a").select("bank_dir", "file", "fields.date.parse_norm").collect()
    assert sorted(r.file for r in got) == sorted(f"f{i}" for i in range(40)) and {r.bank_dir for r in got} == {"A"}
    assert [r.file for r in got if r.parse_norm == "y"] == ["f7"]


def test_a_fold_writes_no_more_than_it_changes(spark, tmp_path):
    """Corrections that are known, or of unknown fields, write nothing; compressed files stay compressed; lines that no correction names
    need not meet them."""
    docs = spark.range(40).select(F.lit("A").alias("bank"), F.format_string("f%d", "id").alias("file"), F.create_map(F.lit("date"), F.struct(F.lit("x").alias("parse_norm"))).alias("fields"))
    writers.write_audit(docs, f"{tmp_path}/a", shards=2, compression="gzip")
    run = lambda *rows: fold.fold_audit(spark, f"{tmp_path}/a", spark.createDataFrame(list(rows), FIXES), 2, "gzip")
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "a").rglob("part*")}
    fixes = [("A", f"f{i}", "date", f"y{i}", None, "r", "1") for i in range(3)]
    assert run(*fixes) > 0 and all(f.name.endswith(".gz") for f in files())
    before = files()
    assert run(*fixes) > 0 and run(("A", "f9", "gone", "y", None, "r", "1")) == 1
    assert files() == before and not list((tmp_path / "a").glob("_f*"))
    got = {r.file: r.v for r in readers.scan_audit(spark, f"{tmp_path}/a").select("file", F.col("fields.date.parse_norm").alias("v")).collect()}
    assert got == {f"f{i}": f"y{i}" if i < 3 else "x" for i in range(40)}
    maybe = fold._may_be_named(docs.select("bank", "file"), spark.createDataFrame([r[:2] for r in fixes], "bank string, file string"))
    assert {r.file for r in maybe.filter("maybe").collect()} == {"f0", "f1", "f2"}


def test_derived_text_is_compressed(spark, sf, tmp_path, monkeypatch):
    """Pages that a query writes to read them back are compressed files, and no line is lost."""
    monkeypatch.setattr(files.work, "folder", lambda s, name: f"{tmp_path}/{name}")
    n = files.scan_ocr_lines(spark, sf).count()
    parts = list((tmp_path / "ocr").glob("part*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    assert n == files.view(spark, sf, "v_token").filter("doc_id % 11 <> 0").count()


def test_a_fold_that_was_cut_short_goes_on(spark, tmp_path):
    """Lost between writing and moving, when a partition may be gone: the next run moves it; a half-written one goes."""
    put(tmp_path / "bank_code=A", {"bank": "A", "file": "f1", "fields": {"date": {}}})
    put(tmp_path / "bank_code=B", {"bank": "B", "file": "f1", "fields": {"date": {}}})
    shutil.copytree(tmp_path / "bank_code=A", tmp_path / "_fold" / "bank_code=A")
    shutil.move(tmp_path / "bank_code=A", tmp_path / "_gone")
    none = spark.createDataFrame([], FIXES)
    (tmp_path / "_fold" / "_SUCCESS").touch()
    assert fold.fold_audit(spark, str(tmp_path), none) == 0
    assert len(lines_of(tmp_path / "bank_code=A")) == len(lines_of(tmp_path / "bank_code=B")) == 1 and not (tmp_path / "_fold").exists()
    put(tmp_path / "_fold" / "bank_code=B", "half")
    assert fold.fold_audit(spark, str(tmp_path), spark.createDataFrame([("B", "f1", "date", "v", None, "r", "1")], FIXES)) == 1
    assert json.loads(lines_of(tmp_path / "bank_code=B")[0])["fields"]["date"]["parse_norm"] == "v"


BATCH = "bank string, name string, seq long"


def together(*jobs):
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def test_writers_race_for_batches(spark, tmp_path):
    """Each writer gets the rows that are stored; a key exists once, whoever was first, and no row is lost."""
    root = f"{tmp_path}/t"
    wanted = [spark.createDataFrame([("A", f"b{i}", w) for i in range(w, w + 4)] + [(None, "b", w)], BATCH) for w in range(4)]
    got = together(*(lambda w=w: versions.get_or_create(spark, root, w, ["bank", "name"]).collect() for w in wanted))
    table = versions.current(spark, root, BATCH)[1].collect()
    assert sorted((r.bank or "", r.name) for r in table) == [("", "b"), *(("A", f"b{i}") for i in range(7))]
    for w, rows in enumerate(got):
        assert sorted((r.bank or "", r.name) for r in rows) == [("", "b"), *(("A", f"b{i}") for i in range(w, w + 4))]
        assert set(rows) <= set(table)
    assert versions.get_or_create(spark, root, wanted[0].limit(0), ["bank", "name"]).count() == 0
    twice = spark.createDataFrame([("B", "x", 2), ("B", "x", 1)], BATCH)
    assert [r.seq for r in versions.get_or_create(spark, root, twice, ["bank", "name"]).collect()] == [1]


def test_a_beaten_writer_works_its_change_out_again(spark, tmp_path, monkeypatch):
    """Another writer commits between reading and claiming: its row stays, ours is not added beside it."""
    root, real, beaten = f"{tmp_path}/t", versions._claim, []

    def claim(s, path, text):
        if not beaten:
            beaten.append(path)
            versions.get_or_create(spark, root, spark.createDataFrame([("A", "x", 7)], BATCH), ["bank", "name"])
        return real(s, path, text)

    monkeypatch.setattr(versions, "_claim", claim)
    ours = versions.get_or_create(spark, root, spark.createDataFrame([("A", "x", 1), ("A", "y", 1)], BATCH), ["bank", "name"]).collect()
    assert sorted(map(tuple, ours)) == [("A", "x", 7), ("A", "y", 1)] and versions.current(spark, root, BATCH)[1].count() == 2


def test_upserts_race_and_old_versions_go(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), BATCH)
    versions.upsert(spark, root, rows(("A", "x", 0), ("A", "y", 0)), ["bank", "name"])
    together(lambda: versions.upsert(spark, root, rows(("A", "x", 1), ("B", "n", 1)), ["bank", "name"]), lambda: versions.upsert(spark, root, rows(("A", "y", 2)), ["bank", "name"]))
    want = [("A", "x", 1), ("A", "y", 2), ("B", "n", 1)]
    assert sorted(map(tuple, versions.current(spark, root, BATCH)[1].collect())) == want
    with pytest.raises(ValueError):
        versions.upsert(spark, root, rows(("A", "x", 1), ("A", "x", 2)), ["bank", "name"])
    monkeypatch.setattr(versions, "MAX_FOLDERS", 2)
    for i in range(3):
        versions.get_or_create(spark, root, rows(("C", f"c{i}", i)), ["bank", "name"])
    assert len(versions._folders(spark, root, versions.current(spark, root, BATCH)[0])) <= 2
    assert versions.vacuum(spark, root, keep=1) > 0
    assert sorted(map(tuple, versions.current(spark, root, BATCH)[1].collect())) == [*want, *(("C", f"c{i}", i) for i in range(3))]


@pytest.fixture(scope="module")
def url(spark):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.method", "java.io.OutputStream.nullOutputStream")
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    return "jdbc:derby:memory:ink;create=true"


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_rates_from_a_database(spark, sf, url):
    """Tables of a database give the rates that files give; filters and columns reach the database, ranges split the reads."""
    frames = {n: view(spark, sf, n) for n in ("v_cheque", "v_field")}
    for n, frame in frames.items():
        types = ", ".join(f"{f.name} varchar(40)" for f in frame.schema if f.dataType.simpleString() == "string")
        relational.append_table(frame, url, n, types=types, **DERBY)
    cheques = relational.read_table(spark, url, "v_cheque", "cheque_id", 4, **DERBY)
    fields = relational.read_table(spark, url, "v_field", "cheque_id", 4, **DERBY)
    assert cheques.rdd.getNumPartitions() == 4 and cheques.count() == frames["v_cheque"].count()
    want = kpi.kpi_batch(frames["v_cheque"], frames["v_field"])
    assert sorted(map(tuple, kpi.kpi_batch(cheques, fields).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = cheques.filter("bank_code = 'CIB'").select("cheque_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(bank_code), *EqualTo(bank_code,CIB)]" in plan and "ReadSchema: struct<cheque_id:bigint>" in plan


def test_upserts_into_a_database(spark, url):
    schema = "id long, name string, n long"
    put = lambda *rows: relational.upsert_table(spark.createDataFrame(list(rows), schema), url, "ups", ["id"], **DERBY)
    relational.append_table(spark.createDataFrame([(1, "a", 1), (2, "b", None)], schema), url, "ups", **DERBY)
    for _ in range(2):
        put((2, "b2", 5), (3, None, 3))
    put()
    back = relational.read_table(spark, url, "ups", "id", 2, **DERBY)
    assert sorted(map(tuple, back.collect()), key=str) == [(1, "a", 1), (2, "b2", 5), (3, None, 3)]
    assert relational.read_table(spark, url, "ups", **DERBY).filter("id > 2").count() == 1
    empty = spark.createDataFrame([], schema)
    relational.append_table(empty, url, "vacant", **DERBY)
    assert relational.read_table(spark, url, "vacant", "id", 2, **DERBY).count() == 0


def test_stored_tables_join_without_exchange_and_prune(spark, sf):
    cheques, fields, corrections = files.stored(spark, sf)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = audit.values_between(cheques, fields, corrections, "1994-01-01", "1995-06-30")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert "(month#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    months = {r.month for r in cheques.select("month").distinct().collect()}
    asked = cheques.filter("month between 199401 and 199506")
    assert len(months) > 18 and asked.select(F.input_file_name()).distinct().count() < cheques.select(F.input_file_name()).distinct().count() / 2

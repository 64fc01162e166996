"""Streams over several micro-batches: numbering goes on, replays change nothing, sessions close once."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkledger.operators import kpi
from inkledger.sources import readers, writers
from inkledger.streaming import jobs

EVENTS = "bank string, key string, ts timestamp, event_id long, final boolean"


def at(minute, day=5):
    return datetime(2025, 1, day, 10 + minute // 60, minute % 60)


@pytest.fixture
def folder(spark, tmp_path):
    def put(*rows, schema=EVENTS):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return jobs.stream_of(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)

    return put


def test_first_upload_fixes_the_batch(spark, folder, tmp_path):
    source = folder(("A", "k1", at(0), 1, False), ("A", "k2", at(5), 2, False), ("B", "k1", at(1), 3, False))
    jobs.assign_batches(source, f"{tmp_path}/out")
    source = folder(("A", "k1", at(0, 6), 4, False), ("A", "k3", at(90), 5, False), ("A", "k1", at(7), 6, True), ("A", "k1", at(9), 7, True), ("A", "none", at(9), 8, True))
    got = {(r.bank, r.batch_name): r for r in jobs.assign_batches(source, f"{tmp_path}/out").collect()}
    assert {k: (r.seq, r.uploads, r.processing_ms) for k, r in got.items()} == {("A", "05_01_2025_A_01"): (1, 2, 7 * 60_000), ("A", "05_01_2025_A_02"): (2, 1, None), ("A", "05_01_2025_A_03"): (3, 1, None), ("B", "05_01_2025_B_01"): (1, 1, None)}
    again = jobs.assign_batches(folder(), f"{tmp_path}/out").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got.values()), key=repr)


def test_the_timer_ends_and_forgets_idle_keys(spark, folder, tmp_path):
    """A key is kept for so long after its last event; then its batch ends there, and a later upload opens another."""
    run = lambda *rows: {(r.seq, r.batch_date.day, r.bank): (r.uploads, r.ended_at) for r in jobs.assign_batches(folder(*rows), f"{tmp_path}/out", "1 day", 3).collect()}
    run(("A", "k1", at(0), 1, False), ("A", "k1", at(9), 2, False), ("A", "k2", at(1), 3, False), ("A", "k2", at(2), 4, True))
    assert run(("B", "k", at(0, 6), 5, False))[1, 5, "A"] == (2, None)
    assert run(("B", "k", at(1, 6), 6, False), ("C", "k", at(0, 20), 9, False))[1, 5, "A"] == (2, at(9))  # the watermark has moved to day 19
    got = run(("A", "k1", at(0, 21), 7, False), ("A", "k1", at(0, 5), 8, False))  # the last is too late
    assert got == {(1, 5, "A"): (2, at(9)), (2, 5, "A"): (1, at(2)), (1, 6, "B"): (2, at(1, 6)), (1, 20, "C"): (1, None), (1, 21, "A"): (1, None)}


def test_a_request_before_the_first_upload_counts_if_it_is_not_earlier(spark, folder, tmp_path):
    jobs.assign_batches(folder(("A", "k", at(5), 1, True), ("A", "k", at(1), 2, True)), f"{tmp_path}/out")
    got = jobs.assign_batches(folder(("A", "k", at(3), 3, False), ("A", "event:4", at(4), 4, False)), f"{tmp_path}/out").collect()
    assert sorted((r.seq, r.ended_at) for r in got) == [(1, at(5)), (2, None)]


def test_rates_by_differences(spark, folder, tmp_path):
    """Every micro-batch gives the rates that all corrections so far give, and rewrites the buckets it touches only; corrections
    that repeat, of unknown cheques, of other fields or without a field add nothing."""
    fields = ["date", "cheque_number", "amount_numeric", "name"]
    cheques = spark.createDataFrame([(i, "AB"[i // 4], datetime(2025, 1, 1).date()) for i in range(8)], "cheque_id long, bank_code string, batch_date date")
    rows = [(i, f, i == 1 and f == "date") for i in range(8) for f in fields if i != 3] + [(2, "date", False)]
    table = spark.createDataFrame(rows, "cheque_id long, name string, corrected boolean")
    seen = []
    steps = [[(0, "date"), (0, "date"), (99, "date"), (None, "date")], [(1, "date"), (0, "name"), (2, "date"), (3, "date"), (2, None)], [(0, "date"), (0, "amount_numeric"), (7, "name")], []]
    for n, step in enumerate(steps):
        seen += step
        source = folder(*step, schema="cheque_id long, field string")
        got = jobs.refresh_kpis(source, cheques, table, f"{tmp_path}/out", width=2)
        done = {(i, f) for i, f in seen}
        marked = spark.createDataFrame([(i, f, c or (i, f) in done) for i, f, c in rows], table.schema)
        banks = {"A", "B"} if n >= 2 else {"A"}
        want = [r for r in kpi.kpi_batch(cheques, marked).collect() if r.bank_code in banks]
        assert sorted(map(tuple, got.select(kpi.kpi_batch(cheques, marked).columns).collect())) == sorted(map(tuple, want))
    kept = lambda batch: sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out/state" / f"batch={batch}").glob("bucket=*"))
    assert [kept(b) for b in (-1, 0, 1, 2)] == [[0, 1, 2, 3], [0], [0, 1], [0, 3]]


def test_a_replayed_batch_of_rates_changes_nothing(spark, folder, tmp_path):
    """As after a failure between a micro-batch and its commit: the log of commits is cut by one, and the job runs again."""
    cheques = spark.createDataFrame([(1, "A", datetime(2025, 1, 1).date())], "cheque_id long, bank_code string, batch_date date")
    table = spark.createDataFrame([(1, "date", False), (1, "amount_numeric", False)], "cheque_id long, name string, corrected boolean")
    for f in ("date", "amount_numeric"):
        first = jobs.refresh_kpis(folder((1, f), schema="cheque_id long, field string"), cheques, table, f"{tmp_path}/out").collect()
    for log in (tmp_path / "out/checkpoint/commits").glob("*1*"):
        log.unlink()
    for log in (tmp_path / "out/checkpoint/commits").glob(".1*"):
        log.unlink()
    again = jobs.refresh_kpis(folder(schema="cheque_id long, field string"), cheques, table, f"{tmp_path}/out").collect()
    assert again == first and first[0].incorrect_fields == 2


def test_keys_of_one_upload_pass_by_the_state(spark, folder, tmp_path):
    """They open batches, also late ones, end by a request of their own that is not earlier, and leave nothing in the state."""
    jobs.assign_batches(folder(("A", "k", at(0, 9), 1, False), ("A", "event:2", at(1, 9), 2, False), ("A", "event:2", at(0, 9), 3, True), ("A", "event:2", at(4, 9), 4, True), ("A", "event:5", at(2, 9), 5, True)), f"{tmp_path}/out")
    got = jobs.assign_batches(folder(("A", "event:6", at(0, 9), 6, False), ("A", "event:7", at(0, 1), 7, False), ("A", "k", at(9, 9), 8, False)), f"{tmp_path}/out").collect()
    assert sorted((r.started_at, r.seq, r.uploads, r.ended_at) for r in got) == [(at(0, 1), 1, 1, None), (at(0, 9), 1, 2, None), (at(0, 9), 3, 1, None), (at(1, 9), 2, 1, at(4, 9))]
    assert spark.read.format("statestore").load(f"{tmp_path}/out/checkpoint").count() == 1


def audit(path, bank, name, file, text, indent=None, age=0):
    folder = path / f"bank_code={bank}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"schema_version": 1, "bank": bank, "file": file, "correlation_id": text, "decision": {"stp": True}}, indent=indent))
    os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))


@pytest.mark.parametrize("indent", [None, 2])
def test_an_audit_directory_is_followed(spark, tmp_path, indent):
    """Files that come later but are older lose; unreadable ones are passed over; folders are folded, and their number stays."""
    root, seen = tmp_path / "out", {}
    for n in range(9):
        audit(tmp_path / "in", "A", f"{n}.json", "same", f"a{n}", indent, age=10 * (n if n != 5 else 1))
        audit(tmp_path / "in", "B", f"{n}.json", f"b{n % 4}", f"b{n}", indent, age=10 * n)
        seen |= {"same": f"a{n}" if n != 5 else "a4", f"b{n % 4}": f"b{n}"}
        if n == 3:
            bad = tmp_path / "in" / "bank_code=A" / "bad.json"
            bad.write_text('{"bank": ')
            os.utime(bad, (1_700_000_035, 1_700_000_035))
        rows = jobs.latest_documents(readers.stream_audit(spark, str(tmp_path / "in"), multi_line=indent is not None), str(root), every=3)
        assert {r.file: (r.payload.correlation_id, r.payload.decision.stp) for r in rows.collect()} == {k: (v, True) for k, v in seen.items()}
    assert len(list((root / "latest").glob("batch=*"))) <= 6 and len(list((root / "folded").glob("upto=*"))) <= 2


def test_an_audit_directory_as_it_is_written(spark, tmp_path):
    docs = spark.createDataFrame([("A", "f1", "x"), ("B", "f2", "y")], "bank string, file string, correlation_id string")
    for n, rows in enumerate((docs, docs.filter("bank = 'B'").withColumn("correlation_id", F.lit("z")))):
        writers.write_audit(rows, f"{tmp_path}/in")
        got = jobs.latest_documents(readers.stream_audit(spark, f"{tmp_path}/in"), f"{tmp_path}/out").collect()
        assert {(r.bank, r.file): r.payload.correlation_id for r in got} == {("A", "f1"): "x", ("B", "f2"): "z" if n else "y"}


def test_sessions_close_once_and_stay_open_at_the_end(spark, folder, tmp_path):
    schema = "bank string, key string, ts timestamp"
    folder(("A", "k", at(0)), ("A", "k", at(20)), ("A", "k", at(80)), schema=schema)
    source = folder(("A", "k", at(0, 6)), ("A", "k", at(10, 6)), ("B", "k", at(5, 6)), schema=schema)
    now = spark.read.parquet(f"{tmp_path}/in")
    got = sorted((r.bank, r.started_at, r.uploads, r.processing_ms) for r in jobs.stream_sessions(source, now, f"{tmp_path}/out").collect())
    assert got == [("A", at(0), 2, 1_200_000), ("A", at(80), 1, 0), ("A", at(0, 6), 2, 600_000), ("B", at(5, 6), 1, 0)]


def test_ingest_forgets_keys_and_still_stores_each_once(spark, folder, tmp_path):
    """Repeats in a micro-batch, in the next one and after the state has forgotten the key; late rows and rows without a time go."""
    schema = "bank string, file string, ts timestamp, size long"
    run = lambda *rows: sorted(jobs.ingest_once(folder(*rows, schema=schema), f"{tmp_path}/out", ["bank", "file"], "1 day").collect(), key=repr)
    run(("A", "f1", at(0), 1), ("A", "f1", at(1), 1), ("A", None, at(2), 2), ("A", "f2", None, 3))
    run(("A", "f1", at(3), 9), ("B", "f1", at(4), 4), ("A", None, at(5), 9))
    run(("C", "f1", at(0, 9), 5))
    run(("A", "f1", at(0, 10), 9), ("D", "f1", at(0, 5), 6))
    got = run()
    assert [(r.bank, r.file, r.size) for r in got] == [("A", "f1", 1), ("A", None, 2), ("B", "f1", 4), ("C", "f1", 5)]
    assert spark.read.parquet(f"{tmp_path}/out/rows").filter("bank = 'A' and file = 'f1'").count() == 2
    state = spark.read.format("statestore").load(f"{tmp_path}/out/checkpoint")
    assert state.count() == 2  # C, and A's repeat

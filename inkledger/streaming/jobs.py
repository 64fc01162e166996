"""Structured Streaming jobs. Each has a batch twin with the same end state; ``drain`` runs a job over all that is there.

State is kept where it is bounded by keys that watermarks expire; everything else is written as one folder per micro-batch,
overwritten when a batch is replayed, so restarts do not double anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from inkledger.functions.validate import KPI_FIELDS
from inkledger.operators.kpi import BATCH, batch_name, business_date, with_rates
from inkledger.sources.store import exists, names, remove


def stream_of(spark: SparkSession, path: str, schema: object, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a foreachBatch job over all available data and waits for its end."""
    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers in the names (kind=number) of a folder's folders."""
    return sorted(int(n.split("=")[1]) for n in names(spark, path) if "=" in n)


#: Cheque ids of one bucket of the rates' state. Ids grow with time, so corrections of recent cheques touch few buckets.
BUCKET_IDS = 1 << 20
RATES = ["total_cheques", "cheques_with_errors", "total_fields", "incorrect_fields"]


def _cheque_state(cheques: DataFrame, fields: DataFrame, width: int) -> DataFrame:
    """One row for each cheque: its bucket and batch, and for each KPI field how many it has (n_) and how many are corrected (bad_)."""
    own = lambda f: F.col("name") == f
    counts = [c for f in KPI_FIELDS for c in (F.count_if(own(f)).alias(f"n_{f}"), F.count_if(own(f) & F.col("corrected")).alias(f"bad_{f}"))]
    rows = cheques.select("cheque_id", *BATCH).join(fields.filter(F.col("name").isin(KPI_FIELDS)).groupBy("cheque_id").agg(*counts), "cheque_id", "left")
    zero = {f"{k}_{f}": F.coalesce(f"{k}_{f}", F.lit(0)) for f in KPI_FIELDS for k in ("n", "bad")}
    return rows.withColumns(zero | {"bucket": F.floor(F.col("cheque_id") / width)})


def _total(prefix: str) -> Column:
    return sum((F.col(f"{prefix}_{f}") for f in KPI_FIELDS), F.lit(0))


def refresh_kpis(corrections: DataFrame, cheques: DataFrame, fields: DataFrame, root: str, width: int = BUCKET_IDS) -> DataFrame:
    """Rates of the batches that corrections touch, kept up by differences. corrections (a stream): cheque_id, field.

    The state is one row of counts for each cheque, in buckets of ids, and one row of sums for each batch; it comes from the tables
    once, when the job first starts. A micro-batch reads the buckets of the cheques it corrects and the sums, and writes both anew
    under its own number, with an index that tells which version of a bucket is the last. It reads neither earlier corrections nor
    the field table, so what it reads does not grow with history. A replayed micro-batch starts from the index before it and
    overwrites its own folders. Corrections of unknown cheques change nothing."""
    spark = corrections.sparkSession
    at = lambda kind, batch: f"{root}/{kind}/batch={batch}"

    def start() -> None:
        _cheque_state(cheques, fields, width).write.mode("overwrite").partitionBy("bucket").parquet(at("state", -1))
        state = spark.read.parquet(at("state", -1))
        sums = state.groupBy(*BATCH).agg(F.count("*").alias("total_cheques"), F.count_if(_total("bad") > 0).alias("cheques_with_errors"), F.sum(_total("n")).cast("long").alias("total_fields"), F.sum(_total("bad")).cast("long").alias("incorrect_fields"))
        sums.withColumn("touched", F.lit(False)).write.mode("overwrite").parquet(at("rates", -1))
        state.select("bucket", F.lit(-1).alias("version")).distinct().write.mode("overwrite").parquet(at("index", -1))

    def each(new: DataFrame, batch: int) -> None:
        hits = new.groupBy("cheque_id").agg(*(F.max(F.col("field") == f).alias(f"hit_{f}") for f in KPI_FIELDS)).withColumn("bucket", F.floor(F.col("cheque_id") / width))
        hits.write.mode("overwrite").parquet(at("hits", batch))
        hits, index = spark.read.parquet(at("hits", batch)), spark.read.parquet(at("index", batch - 1))
        # as many rows as there are buckets, at most
        versions = index.join(hits.select("bucket").distinct(), "bucket").collect()
        rates = spark.read.parquet(at("rates", batch - 1))
        if versions:
            state = spark.read.option("basePath", f"{root}/state").parquet(*(f"{at('state', r['version'])}/bucket={r['bucket']}" for r in versions)).drop("batch")
            joined = state.join(hits.drop("bucket"), "cheque_id", "left")
            now = {f"bad_{f}": F.when(F.col(f"hit_{f}"), F.col(f"n_{f}")).otherwise(F.col(f"bad_{f}")) for f in KPI_FIELDS}
            changed = joined.withColumns({"before": _total("bad").cast("long"), "touched": F.coalesce(*(F.col(f"hit_{f}").isNotNull() for f in KPI_FIELDS))}).withColumns(now)
            kept = ["cheque_id", *BATCH, "bucket", "before", "touched", *(f"{k}_{f}" for f in KPI_FIELDS for k in ("n", "bad"))]
            changed.select(kept).write.mode("overwrite").partitionBy("bucket").parquet(at("state", batch))
            after = _total("bad")
            more = spark.read.parquet(at("state", batch)).filter("touched").groupBy(*BATCH).agg(F.sum(after - F.col("before")).alias("d_fields"), F.sum((after > 0).cast("long") - (F.col("before") > 0).cast("long")).alias("d_cheques"))
            rates = rates.join(more, BATCH, "left").select(
                *BATCH, "total_cheques", (F.col("cheques_with_errors") + F.coalesce("d_cheques", F.lit(0))).alias("cheques_with_errors"), "total_fields",
                (F.col("incorrect_fields") + F.coalesce("d_fields", F.lit(0))).alias("incorrect_fields"), (F.col("touched") | F.col("d_fields").isNotNull()).alias("touched"),
            )
        rates.write.mode("overwrite").parquet(at("rates", batch))
        fresh = spark.createDataFrame([(r["bucket"], batch) for r in versions], "bucket long, version int")
        index.join(fresh.select("bucket"), "bucket", "left_anti").select(fresh.columns).union(fresh).write.mode("overwrite").parquet(at("index", batch))

    if not exists(spark, f"{root}/checkpoint"):
        start()
    drain(corrections, f"{root}/checkpoint", each)
    last = spark.read.parquet(f"{root}/rates").agg(F.max("batch")).first()[0]
    return with_rates(spark.read.parquet(at("rates", last)).filter("touched").drop("touched"))


def sessions(uploads: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Upload sessions of a (bank, key): first and last upload and their number. Works on tables and streams alike."""
    window = F.session_window("ts", gap)
    out = uploads.groupBy("bank", "key", window.alias("session")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("uploads"))
    return out.select("bank", "key", "started_at", "ended_at", "uploads", (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("processing_ms"))


def stream_sessions(uploads: DataFrame, now: DataFrame, root: str, gap_minutes: int = 30, late_minutes: int = 120) -> DataFrame:
    """Sessions as a stream. A session is written once, when the watermark passes its end, and then leaves the state. Those
    still open come from the table twin ``now``, which reads the uploads of keys that were active within the watermark only."""
    gap, closed = f"{gap_minutes} minutes", f"{root}/sessions"

    def each(new: DataFrame, batch: int) -> None:
        new.write.mode("overwrite").parquet(f"{closed}/batch={batch}")

    drain(sessions(uploads.withWatermark("ts", f"{late_minutes} minutes"), gap), f"{root}/checkpoint", each)
    done = uploads.sparkSession.read.parquet(closed).drop("batch")
    last = now.agg((F.max("ts") - F.expr(f"INTERVAL {late_minutes + 2 * gap_minutes} MINUTES")).alias("since"))
    active = now.join(last, F.col("ts") >= F.col("since"), "left_semi").select("bank", "key").distinct()
    still_open = sessions(now.join(active, ["bank", "key"], "left_semi"), gap)
    return done.unionByName(still_open.join(done, ["bank", "key", "started_at"], "left_anti").select(*done.columns))


#: The state of a (bank, key): its first upload, its last event, when it was finalized, requests that came before any upload.
SESSION_STATE = "first_ts timestamp, first_event long, last_ts timestamp, ended_at timestamp, early array<timestamp>"
SESSION_CHANGE = "bank string, key string, first_ts timestamp, first_event long, opened boolean, uploads long, ended_at timestamp"


def follow_session(keep_ms: int, key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a micro-batch changes for one (bank, key). The first upload opens its batch, later ones count; the first request to
    finalize that is not before the first upload ends it, once. When nothing has come for the time the state is kept, the timer
    ends a batch that nobody finalized, at its last event, and forgets the key."""
    if state.hasTimedOut:
        first_ts, first_event, last_ts, ended, _ = state.get
        state.remove()
        if first_ts is not None and ended is None:
            yield pd.DataFrame([(*key, first_ts, first_event, False, 0, last_ts)], columns=CHANGE_COLUMNS)
        return
    first_ts, first_event, last_ts, ended, early = state.get if state.exists else (None, None, None, None, [])
    ups, finals = [], list(early)
    for rows in pieces:
        for ts, event, final in zip((t.to_pydatetime() for t in rows["ts"]), rows["event_id"], rows["final"], strict=True):
            finals.append(ts) if final else ups.append((ts, int(event)))
            last_ts = ts if last_ts is None else max(last_ts, ts)
    opened = first_ts is None and bool(ups)
    if opened:
        first_ts, first_event = min(ups)
    was = ended
    if first_ts is not None:
        later = [t for t in finals if t >= first_ts]
        ended, finals = min([*later, *([ended] if ended else [])], default=None), []
    state.update((first_ts, first_event, last_ts, ended, finals))
    since = (last_ts - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
    state.setTimeoutTimestamp(max(since, state.getCurrentWatermarkMs()) + keep_ms)
    if first_ts is not None and (ups or ended != was):
        yield pd.DataFrame([(*key, first_ts, first_event, opened, len(ups), ended)], columns=CHANGE_COLUMNS)


CHANGE_COLUMNS = ["bank", "key", "first_ts", "first_event", "opened", "uploads", "ended_at"]


#: The keys of uploads that have none: one for each, so nothing that comes later can join them.
ALONE = "event:"


def alone_or_followed(rows: DataFrame) -> DataFrame:
    """What a micro-batch changes, one row for each key. rows: what follow_session found (``final`` is NULL), and the events of keys of
    one upload as they came (time and id as first_ts and first_event), which need no state."""
    final = F.col("final")
    own = F.first(F.when(final.isNull(), F.struct(*CHANGE_COLUMNS[2:])), ignorenulls=True)
    first = F.min(F.when(~final, F.struct("first_ts", "first_event")))
    per = rows.groupBy("bank", "key").agg(own.alias("own"), first.alias("first"), F.count_if(~final).alias("n"), F.collect_list(F.when(final, F.col("first_ts"))).alias("ends"))
    ended = F.array_min(F.filter("ends", lambda t: t >= F.col("first.first_ts")))
    made = F.when(F.col("first").isNotNull(), F.struct("first.first_ts", "first.first_event", F.lit(True).alias("opened"), F.col("n").alias("uploads"), ended.alias("ended_at")))
    return per.select("bank", "key", F.coalesce("own", made).alias("c")).filter("c is not null").select("bank", "key", "c.*")


def assign_batches(events: DataFrame, root: str, late: str = "2 days", keep_days: int = 31) -> DataFrame:
    """Upload sessions to batches. The first upload of a (bank, key) opens a batch, numbered after those its bank and business date
    have; every later one joins it. Finalizing sets the end once and may be repeated. events (a stream): bank, key, ts, event_id,
    final; rows later than ``late`` are dropped, but for keys of one upload (ALONE).

    Keys of one upload pass by the state. What another key's first upload was is keyed state (follow_session); a timer expires it when nothing has come for ``keep_days`` and the
    watermark has passed that. Numbers come from a table of the highest one
    of each bank and date, which every micro-batch writes anew under its own number. So a micro-batch reads no earlier key, event or
    folder but that table, and a replay gives the same numbers."""
    spark = events.sparkSession
    alone = F.coalesce(F.col("key").startswith(ALONE), F.lit(False))
    followed = events.filter(~alone).withWatermark("ts", late).groupBy("bank", "key").applyInPandasWithState(partial(follow_session, keep_days * 86_400_000), SESSION_CHANGE, SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    ones = events.filter(alone).select("bank", "key", F.col("ts").alias("first_ts"), F.col("event_id").alias("first_event"), "final")
    changes = followed.withColumn("final", F.lit(None).cast("boolean")).unionByName(ones, allowMissingColumns=True)

    def each(new: DataFrame, batch: int) -> None:
        alone_or_followed(new).write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")
        opened = spark.read.schema(SESSION_CHANGE).parquet(f"{root}/changes/batch={batch}").filter("opened").withColumn("batch_date", business_date(F.col("first_ts")))
        taken = spark.read.parquet(f"{root}/taken/batch={batch - 1}") if batch else spark.createDataFrame([], "bank string, batch_date date, taken long")
        nth = F.row_number().over(Window.partitionBy("bank", "batch_date").orderBy("first_ts", "first_event"))
        numbered = opened.join(taken, ["bank", "batch_date"], "left").withColumn("seq", (F.coalesce("taken", F.lit(0)) + nth).cast("long"))
        numbered.select("bank", "key", "first_ts", "first_event", "batch_date", "seq").write.mode("overwrite").parquet(f"{root}/opened/batch={batch}")
        highest = spark.read.parquet(f"{root}/opened/batch={batch}").groupBy("bank", "batch_date").agg(F.max("seq").alias("taken"))
        taken.unionByName(highest).groupBy("bank", "batch_date").agg(F.max("taken").alias("taken")).write.mode("overwrite").parquet(f"{root}/taken/batch={batch}")

    drain(changes, f"{root}/checkpoint", each)
    opened = spark.read.parquet(f"{root}/opened").select("bank", "key", "first_event", "first_ts", "batch_date", "seq")
    changed = spark.read.schema(SESSION_CHANGE).parquet(f"{root}/changes")
    # a key that was forgotten may open another batch, so its first upload is part of what names it
    sums = changed.groupBy("bank", "key", "first_event").agg(F.sum("uploads").alias("uploads"), F.min("ended_at").alias("ended_at"))
    done = opened.join(sums, ["bank", "key", "first_event"])
    return done.select("bank", "batch_date", "seq", batch_name(F.col("batch_date"), F.col("bank"), F.col("seq")).alias("batch_name"), "uploads", F.col("first_ts").alias("started_at"), "ended_at", (F.unix_millis("ended_at") - F.unix_millis("first_ts")).alias("processing_ms"))


def ingest_once(cheques: DataFrame, root: str, keys: list[str], late: str) -> DataFrame:
    """The cheques that came, each key once. cheques (a stream): ts, the time of arrival, and other columns.

    Repeats within ``late`` of the first arrival are dropped by keyed state, which forgets a key after that; so what the state
    holds does not grow with history. A repeat that comes later is stored once more and dropped when the rows are read, where the
    earliest of each key stays. Rows that arrive out of order by more than ``late`` are dropped, as are those without a time.
    Nulls in keys are equal."""
    once = cheques.filter("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    query = once.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    stored = cheques.sparkSession.read.schema(cheques.schema).parquet(f"{root}/rows")
    rest = ["ts", *(c for c in stored.columns if c not in ("ts", *keys))]
    return stored.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first")).select(*keys, "first.*").select(stored.columns)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bank", "file").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))


def latest_documents(snapshots: DataFrame, root: str, every: int = 16) -> DataFrame:
    """The last version of every audit document in a stream of snapshots. snapshots: bank, file, version, payload.

    A micro-batch adds a folder with its own last versions; every so many of them are folded into one table, and what was folded
    before the table's predecessor goes. So a reader opens one table and fewer than ``every`` folders, however long the job has run,
    and a replayed micro-batch still finds what it folds."""
    spark = snapshots.sparkSession
    part, table = (lambda n: f"{root}/latest/batch={n}"), (lambda n: f"{root}/folded/upto={n}")

    def up_to(last: int, before: int) -> DataFrame:
        """All documents after micro-batch ``last``, from the newest table made before micro-batch ``before``."""
        made = max((n for n in numbers(spark, f"{root}/folded") if n < before), default=-1)
        parts = [spark.read.parquet(part(n)) for n in numbers(spark, f"{root}/latest") if made < n <= last]
        return _newest(reduce(DataFrame.unionByName, parts + ([spark.read.parquet(table(made))] if made >= 0 else [])))

    def each(new: DataFrame, batch: int) -> None:
        _newest(new).write.mode("overwrite").parquet(part(batch))
        if batch % every == every - 1:
            up_to(batch, batch).write.mode("overwrite").parquet(table(batch))
            remove(spark, *(part(n) for n in numbers(spark, f"{root}/latest") if n <= batch - every), *(table(n) for n in numbers(spark, f"{root}/folded") if n < batch - every))

    drain(snapshots, f"{root}/checkpoint", each)
    last = max([*numbers(spark, f"{root}/latest"), *numbers(spark, f"{root}/folded")], default=-1)
    return up_to(last, last + 1) if last >= 0 else spark.createDataFrame([], snapshots.schema).select("bank", "file", "payload", "version")


def append_log(corrections: DataFrame, root: str) -> DataFrame:
    """The correction log as an exactly-once CSV sink."""
    query = corrections.writeStream.format("csv").option("header", True).option("path", f"{root}/log").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return corrections.sparkSession.read.schema(corrections.schema).option("header", True).csv(f"{root}/log")

"""Error rates of batches and banks, and the batch bookkeeping around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.functions.validate import FLAG_RATE, KPI_FIELDS

BATCH = ["bank_code", "batch_date"]


def safe_rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded; NULL on nothing."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def incorrect_per_cheque(fields: DataFrame) -> DataFrame:
    """cheque_id, n_fields, incorrect: KPI fields of a cheque and how many of them were corrected."""
    return fields.filter(F.col("name").isin(KPI_FIELDS)).groupBy("cheque_id").agg(F.count("*").alias("n_fields"), F.count_if("corrected").alias("incorrect"))


def kpi_batch(cheques: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per batch. Fields are reduced to their cheque first, so the join carries one row for each cheque and the
    batch totals are plain sums with map-side combining; cheques without fields count."""
    per = cheques.select("cheque_id", *BATCH).join(incorrect_per_cheque(fields), "cheque_id", "left")
    out = per.groupBy(*BATCH).agg(
        F.count("*").alias("total_cheques"), F.count_if(F.col("incorrect") > 0).alias("cheques_with_errors"),
        F.coalesce(F.sum("n_fields"), F.lit(0)).alias("total_fields"), F.coalesce(F.sum("incorrect"), F.lit(0)).alias("incorrect_fields"),
    )
    return with_rates(out)


def with_rates(sums: DataFrame) -> DataFrame:
    """The rates of batches from their sums."""
    out = sums.withColumns({"error_rate_cheques": safe_rate(F.col("cheques_with_errors"), F.col("total_cheques")), "error_rate_fields": safe_rate(F.col("incorrect_fields"), F.col("total_fields"))})
    return out.withColumn("flagged", F.coalesce(F.col("cheques_with_errors") / F.nullif("total_cheques", F.lit(0)) > FLAG_RATE, F.lit(False)))


def flagged_only(batches: DataFrame, flagged: bool | None) -> DataFrame:
    """Batches that are flagged, that are not, or (None) all."""
    return batches if flagged is None else batches.filter(F.col("flagged") == flagged)


def kpi_bank(cheques: DataFrame, fields: DataFrame, corrections: DataFrame, muted: str = "name") -> DataFrame:
    """Audit rates of a bank: all fields but the muted one; a cheque with a correction on such a field is in error; distinct
    corrected fields are incorrect. Rates are 0 on nothing and not rounded."""
    n_fields = fields.filter(F.col("name") != muted).groupBy("cheque_id", "name").agg(F.lit(1).alias("one")).groupBy("cheque_id").agg(F.count("*").alias("n_fields"))
    wrong = corrections.filter(F.col("field") != muted).groupBy("cheque_id", "field").agg(F.lit(1).alias("one")).groupBy("cheque_id").agg(F.count("*").alias("wrong"))
    per = cheques.select("cheque_id", "bank_code").join(n_fields, "cheque_id", "left").join(wrong, "cheque_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = per.groupBy("bank_code").agg(F.count("*").alias("total_cheques"), F.count("wrong").alias("cheques_with_errors"), zero("n_fields").alias("total_fields"), zero("wrong").alias("incorrect_fields"))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return out.withColumns({"error_rate_cheques": rate("cheques_with_errors", "total_cheques"), "error_rate_fields": rate("incorrect_fields", "total_fields")})


def accuracy(rate: Column) -> Column:
    """Field accuracy in percent."""
    return F.round((1 - rate) * 100, 2)


def batch_elapsed(batches: DataFrame, started: str = "started_at", ended: str = "ended_at") -> DataFrame:
    return batches.withColumn("processing_ms", F.unix_millis(F.col(ended).cast("timestamp")) - F.unix_millis(F.col(started).cast("timestamp")))


def batch_name(day: Column, bank: Column, seq: Column) -> Column:
    """DD_MM_YYYY_BANK_NN; longer sequence numbers are not cut."""
    number = seq.cast("string")
    return F.concat_ws("_", F.date_format(day, "dd_MM_yyyy"), bank, F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))


def seq_from_name(name: Column, bank: Column, day: Column) -> Column:
    """The sequence number, NULL unless bank and day are those of the name. Bank codes may hold underscores."""
    parts = [F.regexp_extract(name, r"^(\d{2}_\d{2}_\d{4})_(.+)_(\d{2,})$", i) for i in (1, 2, 3)]
    return F.when((parts[0] == F.date_format(day, "dd_MM_yyyy")) & (parts[1] == bank), parts[2].try_cast("int"))


def business_date(at: Column, zone: str = "Africa/Cairo") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def max_seq(batches: DataFrame) -> DataFrame:
    return batches.groupBy(*BATCH).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))


def session_batches(sessions: DataFrame, key: Column) -> DataFrame:
    """The batch of every upload. The first upload of a (bank, key) fixes the batch of all later ones; without a key an
    upload is a batch of its own. New batches of a bank and day are numbered by their first upload."""
    first = Window.partitionBy("bank", "key").orderBy("ts", "event_id")
    rows = sessions.withColumn("key", F.when(F.coalesce("correlation_id", F.lit("")) == "", F.concat(F.lit("event:"), F.col("event_id").cast("string"))).otherwise(key))
    rows = rows.withColumns({"first_ts": F.first("ts").over(first), "first_event": F.first("event_id").over(first)})
    opened = rows.filter(F.col("event_id") == F.col("first_event")).select("bank", "key", "first_ts", "first_event", business_date(F.col("first_ts")).alias("batch_date"))
    numbered = opened.withColumn("seq", F.row_number().over(Window.partitionBy("bank", "batch_date").orderBy("first_ts", "first_event")).cast("long"))
    names = numbered.select("bank", "key", "batch_date", "seq", batch_name(F.col("batch_date"), F.col("bank"), F.col("seq")).alias("batch_name"))
    return rows.select("event_id", "bank", "key").join(names, ["bank", "key"]).drop("key")


def missing_keys(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that are not there yet: what an insert-if-absent would add."""
    return wanted.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")

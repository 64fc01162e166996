"""Corrections folded into an audit directory in place: only the partitions that hold a corrected document are written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.sources.store import exists, names, remove, replace

#: What a correction is known by: one that a document's history holds already is not folded again.
KNOWN_BY = ["field", "after", "reviewer_id", "at"]
_ENTRY = "struct<reviewer_id:string,field:string,before:string,after:string,reason:string,at:string>"
_DOCUMENT = "struct<bank:string,file:string,fields:map<string,map<string,variant>>,corrections:array<struct<reviewer_id:string,field:string,after:string,at:string>>>"


def shard_of(file: Column, shards: int) -> Column:
    """The part of its bank's directory a document lies in."""
    return F.pmod(F.xxhash64(file), F.lit(shards)).cast("int")


def _put(record: Column, name: str, value: Column) -> Column:
    """A map of variants with one member set."""
    return F.map_concat(F.map_filter(record, lambda k, _: k != name), F.create_map(F.lit(name), value.cast("variant")))


def _fold(state: Column, fix: Column) -> Column:
    """One correction more: the field's value, and the entry of the history with the value before. Unknown fields change nothing."""
    before = F.try_variant_get(state["fields"][fix["field"]]["parse_norm"], "$", "string")
    entry = F.struct(fix["reviewer_id"].alias("reviewer_id"), fix["field"].alias("field"), before.alias("before"), fix["after"].alias("after"), fix["reason"].alias("reason"), fix["at"].alias("at"))
    fields = F.transform_values(state["fields"], lambda k, v: F.when(k == fix["field"], _put(v, "parse_norm", fix["after"])).otherwise(v))
    done = F.struct(fields.alias("fields"), F.array_append(state["added"], entry.cast(_ENTRY)).alias("added"))
    return F.when(F.coalesce(F.map_contains_key(state["fields"], fix["field"]), F.lit(False)), done).otherwise(state)


def _fresh(doc: Column, fixes: Column) -> Column:
    """The corrections that the document's history does not hold."""
    key = lambda x: F.struct(*(F.coalesce(x[c], F.lit("")).alias(c) for c in KNOWN_BY))
    known = F.transform(F.coalesce(doc["corrections"], F.array().cast("array<struct<reviewer_id:string,field:string,after:string,at:string>>")), key)
    return F.filter(fixes, lambda x: ~F.array_contains(known, key(x)))


def corrected(line: Column, doc: Column, fixes: Column) -> Column:
    """The text of a document with corrections folded in; every other member stays as it is, also those no schema names. A line
    whose corrections are all known, or of fields it lacks, stays the text it was."""
    fresh = _fresh(doc, fixes)
    none = F.struct(doc["fields"].alias("fields"), F.array().cast(f"array<{_ENTRY}>").alias("added"))
    state = F.aggregate(fresh, none, _fold)
    members = F.from_json(line, "map<string,variant>")
    history = F.from_json(F.get_json_object(line, "$.corrections"), "array<variant>")
    added = F.from_json(F.to_json(state["added"], {"ignoreNullFields": "false"}), "array<variant>")
    whole = F.concat(F.coalesce(history, F.array().cast("array<variant>")), added)
    rest = F.map_filter(members, lambda k, _: ~k.isin("fields", "corrections"))
    text = F.to_json(F.map_concat(rest, F.create_map(F.lit("fields"), F.parse_json(F.to_json(state["fields"])), F.lit("corrections"), F.parse_json(F.to_json(whole)))))
    return F.when(F.size(state["added"]) > 0, text).otherwise(line)


def _moves(doc: Column, fixes: Column) -> Column:
    """Whether some correction is neither known nor of a field that the document lacks."""
    return F.coalesce(F.exists(_fresh(doc, fixes), lambda x: F.coalesce(F.map_contains_key(doc["fields"], x["field"]), F.lit(False))), F.lit(False))


#: Words of the filter of named documents, of 64 bits each: its table is broadcast and has no more rows than this.
WORDS = 1 << 20


def _place(bank: Column, file: Column) -> tuple[Column, Column]:
    """The word and the bit of a document in the filter."""
    at = F.pmod(F.xxhash64(bank, file), F.lit(WORDS * 64))
    return F.shiftright(at, 6).cast("int").alias("word"), (at % 64).cast("int").alias("bit")


def _may_be_named(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """The rows (bank, file) with ``maybe``: false is certain, so only the others need to meet the corrections."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    words = fixes.select(*_place(F.col("bank"), F.col("file"))).groupBy("word").agg(F.bit_or(bit).alias("bits"))
    placed = rows.select("*", *_place(F.col("bank"), F.col("file"))).join(F.broadcast(words), "word", "left")
    return placed.withColumn("maybe", F.coalesce(F.getbit("bits", F.col("bit")) == 1, F.lit(False))).drop("word", "bit", "bits")


def fold_audit(spark: SparkSession, path: str, corrections: DataFrame, shards: int = 0, compression: str = "none") -> int:
    """Folds corrections into the audit directory that writers.write_audit wrote (one document a line), and returns how many of its
    partitions hold documents that they name. corrections: bank, file, field, after, reason, reviewer_id, at, in the order of ``at``
    within a document; those without a value, of unknown documents or fields, or known already (KNOWN_BY; so also repeats) change nothing.

    A first scan finds the partitions in which a line changes; with ``shards`` (as the directory was written) it opens
    only the shards that such documents can lie in. Then these partitions alone are read and written anew; other files
    are not touched, and lines in between, unreadable ones as well, stay what they are. A filter of bits tells most lines that no
    correction names, and these are written where they are read, without an exchange. The new partitions are first written to
    ``_fold`` in the directory and then renamed into place, where a run that finds some goes on. Folding the same corrections again
    writes nothing. One fold at a time: another that runs beside it is not guarded against."""
    by = ["bank_code", "shard"] if shards else ["bank_code"]
    pending, asked = f"{path}/_fold", f"{path}/_fixes"
    _finish(spark, path, pending, by)
    fix = F.struct("at", *(c for c in ("field", "after", "reviewer_id", "reason")))
    fixes = corrections.filter("after is not null and field is not null and bank is not null and file is not null").select("bank", "file", fix.alias("fix")).distinct()
    fixes.groupBy("bank", "file").agg(F.array_sort(F.collect_list("fix")).alias("fixes")).write.mode("overwrite").parquet(asked)
    per_doc = spark.read.parquet(asked)
    lines = spark.read.schema(f"value string, {', '.join(f'{c} {t}' for c, t in zip(by, ('string', 'int')))}").text(path)
    if shards:
        # as many rows as there are shards, at most
        lines = lines.filter(F.col("shard").isin([r[0] for r in per_doc.select(shard_of(F.col("file"), shards)).distinct().collect()]))

    def read(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("name", F.from_json("value", "struct<bank:string,file:string>"))
        return _may_be_named(named.select("value", *by, F.coalesce("name.bank", "bank_code").alias("bank"), F.col("name.file").alias("file")), per_doc)

    document = F.from_json("value", _DOCUMENT)
    # as many rows as there are partitions, at most
    docs = read(lines).filter("maybe").select(*by, "bank", "file", document.alias("doc")).join(per_doc, ["bank", "file"])
    named = docs.groupBy(*by).agg(F.max(_moves(F.col("doc"), F.col("fixes"))).alias("moves")).collect()
    touched = [r for r in named if r["moves"]]
    if touched:
        rows = read(lines.filter(F.struct(*by).isin([F.struct(*(F.lit(r[c]) for c in by)) for r in touched])))
        met = rows.filter("maybe").join(per_doc, ["bank", "file"], "left").select("value", *by, "fixes", document.alias("doc"))
        text = F.when(F.col("fixes").isNull(), F.col("value")).otherwise(corrected(F.col("value"), F.col("doc"), F.col("fixes")))
        out = met.select(text.alias("value"), *by).unionByName(rows.filter("not maybe").select("value", *by))
        out.write.mode("overwrite").option("compression", compression).partitionBy(*by).text(pending)
        _finish(spark, path, pending, by)
    remove(spark, asked)
    return len(named)


def _finish(spark: SparkSession, path: str, pending: str, by: list[str]) -> None:
    """Moves the partitions that a fold has written whole into their places, one after the other: what still lies in ``_fold`` is whole,
    and takes the place of what is there. What was not written whole goes."""
    if exists(spark, f"{pending}/_SUCCESS"):
        folders = [""]
        for _ in by:
            folders = [f"{f}/{n}" for f in folders for n in names(spark, f"{pending}{f}") if "=" in n]
        for f in folders:
            replace(spark, f"{pending}{f}", f"{path}{f}")
    remove(spark, pending)

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets the key -ln(u) / w: u is uniform in (0, 1) and fixed by the document's id and text, w is its quality weight.
In ascending key order every prefix is a weighted sample without replacement. A source's word budget takes
whole epochs first; what is left is a prefix of the key order, the last document being taken in part.

Prefix sums are two-level, so a source with a third of all rows is no single task: keys fall into ordered buckets
(a monotone function of the key), bucket totals give offsets, and only rows of one (source, bucket) are sorted together.

Defined results: a null text has size 0, and a document or source of size 0 is never taken from; a null source is
a source of its own, last in order; rows that repeat an id, or have none, are documents of their own with keys of their own, so one
id is no single task; other columns are ignored; an empty table gives an empty result. Reruns agree, whatever the order of rows: keys
depend on ids, texts and weights only, and rows that tie are equal in id and text.
``take_mix`` finds the rows by id, source and text where the takes are ``keyed``, and by id and size where they are not;
rows that are equal in these are dealt their takes one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.llm.common import Scratch, words_of

#: Quality weights: labelled good, not labelled, labelled bad.
GOOD, PLAIN, BAD = 1.0, 0.5, 0.125
#: Documents in a bucket of keys, about.
BUCKET_ROWS = 20_000


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, weight for the labelled documents; of repeated labels the best counts."""
    best = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(PLAIN).alias("weight"))


def uniform(doc_id: Column, text: Column) -> Column:
    """52 bits of the md5 of id and text, as a number strictly between 0 and 1."""
    known = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(known.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source.cast("string")))


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """A digest of id, source and text."""
    src = source_key(source)
    return F.sha2(F.concat_ws("|", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), F.length(src), src, F.coalesce(text, F.lit(""))), 256)


def source_targets(totals: DataFrame, share: float, limit: float) -> DataFrame:
    """src, source_size, target. Sources weigh 5, 2, 1, repeating; together they get ``share`` of all words; a target
    stops at ``limit`` times its source. Sources that reach their limit come first in order of limit / weight, so the
    level that the rest share follows from running sums over the table of sources."""
    by_name, by_need, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("need", "pos"), Window.partitionBy()
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("pos", F.row_number().over(by_name))
    t = t.withColumn("w", F.element_at(F.array(F.lit(1.0), F.lit(5.0), F.lit(2.0)), (F.col("pos") % 3 + 1).cast("int")))
    t = t.withColumn("need", F.lit(limit) * F.col("source_size") / F.col("w"))
    t = t.withColumns({"all_size": F.sum("source_size").over(all_rows), "all_w": F.sum("w").over(all_rows), "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "used_w": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "nth": F.row_number().over(by_need)})
    t = t.withColumn("level", (F.lit(share) * F.col("all_size") - F.lit(limit) * F.col("full")) / (F.col("all_w") - F.col("used_w")))
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("need"), F.col("level")), F.when(F.col("level") <= F.col("need"), F.col("nth"))).over(all_rows))
    return t.select("src", "source_size", F.least(F.lit(limit) * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), F.lit(limit) * F.col("source_size"))).alias("target"))


def mix_sources(docs: DataFrame, weights: DataFrame, share: float = 1.5, limit: float = 2.0, bucket_rows: int = BUCKET_ROWS, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the row's key if ``keyed``."""
    own = ["row_key"] if keyed else []
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("u"), *(row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias(k) for k in own))
    sized = sized.join(weights.select(F.col("doc_id").alias("_w_id"), "weight"), F.col("doc_id") == F.col("_w_id"), "left")
    weight = F.coalesce("weight", F.lit(PLAIN))
    sized = sized.select("doc_id", "size", "source", source_key(F.col("source")).alias("src"), (-F.log("u") / weight).alias("key"), *own)
    sized = scratch.write(sized, "sized")

    totals = scratch.write(sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-rows // bucket_rows))
    plan = source_targets(totals.select("src", "source", "source_size"), share, limit)

    keyed = sized.drop("source").withColumn("bucket", F.floor(F.lit(buckets) * (1 - F.exp(-F.col("key") * PLAIN))).cast("int"))
    sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(plan, "src").drop("words")
    offsets = scratch.write(offsets, "offsets")

    within = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(offsets, ["src", "bucket"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *own)


def take_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each document once for each whole time it was taken, and its first words for the rest."""
    id_and_size = lambda size: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), size.cast("long"))
    if "row_key" in mixed.columns:
        theirs, own = F.col("row_key"), row_key(F.col("doc_id"), F.col("source"), F.col("text"))
    else:
        theirs, own = id_and_size(F.col("size")), id_and_size(F.size(words_of(F.col("text"))))
    nth = lambda order: F.row_number().over(Window.partitionBy("key").orderBy(order))
    takes = mixed.filter("taken > 0").withColumn("key", theirs).withColumn("nth", nth(F.desc("taken")))
    takes = takes.select("key", "nth", F.expr("cast(taken div size as int)").alias("whole"), (F.col("taken") % F.col("size")).cast("int").alias("part"))
    # the row travels as one column, so its columns may have any names
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), own.alias("key")).withColumn("nth", nth(F.col("key"))).join(takes, ["key", "nth"])
    copies = F.flatten(F.array(F.array_repeat(F.lit(-1), F.col("whole")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<int>"))))
    cut = F.array_join(F.slice(words_of(F.col("row.text")), 1, F.greatest(F.col("words"), F.lit(0))), " ")
    rows = rows.select("row", F.explode(copies).alias("words")).withColumn("text", F.when(F.col("words") < 0, F.col("row.text")).otherwise(cut))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("words") < 0, F.col("row")["n_chars"]).otherwise(F.length("text")) if "n_chars" in docs.columns else None}
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE = rf"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source,
    len(list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> ''))::BIGINT AS size,
    -ln((('0x' || substr(md5(concat(coalesce(CAST(d.doc_id AS VARCHAR), 'null'), '|', coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN quality = 1 THEN {GOOD}::DOUBLE WHEN quality = 0 THEN {BAD}::DOUBLE ELSE {PLAIN}::DOUBLE END AS key
  FROM documents d LEFT JOIN best USING (doc_id)),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST)) % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM sized GROUP BY source),
need AS (SELECT *, 2.0::DOUBLE * source_size / w AS need FROM totals),
run AS (
  SELECT *, row_number() OVER o AS nth, 
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2.0::DOUBLE * (coalesce(sum(source_size) OVER (ORDER BY need, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
      / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY need, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM need WINDOW o AS (ORDER BY need, pos)),
stop AS (SELECT arg_min(level, nth) AS level FROM run WHERE level <= need),
plan AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(stop.level * w, 2.0::DOUBLE * source_size)) AS target
  FROM run, stop),
ranked AS (
  SELECT doc_id, size, s.source, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken
FROM ranked
"""

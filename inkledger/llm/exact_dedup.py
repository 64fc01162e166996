"""Exact de-duplication by skew-safe combining.

Texts are equal when they match after deleting white space. Copies are combined in three steps, each of which
groups on the digest *and* the whole normalised text, so a digest collision never merges different texts:

1. locally, by the map-side half of the first aggregation (a task sends one row per text and salt);
2. per (digest, salt), the salt being derived from the document id, which splits a hot text over many tasks;
3. over the salt winners of a digest, of which there are at most ``salts`` per text.

Members find their group again by (digest, salt), so a hot text is split on the way back as well.

Defined results: a null text counts as empty; empty texts form one group; a null id loses every tie; rows that
repeat an id with an equal text belong to one group and count one each in group_size; other columns of the input
are ignored; an empty table gives an empty result. ``drop_exact_copies`` keeps one row of every group, whatever its id:
rows are told apart by id and whole text, so repeated and null ids with different texts all stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkledger.llm.common import Scratch, without_spaces


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("points"), without_spaces(text).alias("content"))
    rows = rows.withColumns({"digest": digest(F.col("content")), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
    order = F.struct("points", F.bitwise_not("doc_id").alias("inv_id"))

    salted = rows.groupBy("digest", "salt", "content").agg(F.max(order).alias("best"), F.count("*").alias("n"))
    groups = salted.repartition("digest").groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    variants = F.count("*").over(Window.partitionBy("digest"))
    groups = groups.withColumn("variants", variants).select(
        "digest", F.when(F.col("variants") > 1, F.col("content")).alias("collided"), F.explode("salts").alias("salt"), F.bitwise_not("best.inv_id").alias("keep_id"), "group_size"
    )
    groups = scratch.write(groups, "groups")

    out = [*(F.col(c) for c in ("doc_id", "keep_id", "group_size")), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("text_sha256")]
    sha = F.col("digest") if digest is sha256 else sha256(F.col("content"))
    lean = rows.select("doc_id", "digest", "salt", sha.alias("text_sha256"))
    single = lean.join(groups.filter("collided is null"), ["digest", "salt"]).select(*out)
    collided = groups.filter("collided is not null")
    if collided.isEmpty():
        return single
    full = rows.withColumn("text_sha256", sha).join(collided.withColumnRenamed("collided", "content"), ["digest", "salt", "content"])
    return single.unionByName(full.select(*out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group, with all their columns."""
    winners = exact_groups(docs, id_col, text_col, salts).filter("kept").select("doc_id", "text_sha256").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the row travels as one column, so its columns may have any names
    keyed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), sha256(without_spaces(text)).alias("own"), F.length(text).alias("points"))
    kept = keyed.join(winners, keyed["doc_id"].eqNullSafe(winners["doc_id"]) & (keyed["own"] == winners["text_sha256"]), "left_semi")
    # rows that share an id and a content: one of the longest, as the winner is
    return kept.groupBy("doc_id", "own").agg(F.max_by("row", "points").alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(content) AS text_sha256
FROM d
"""

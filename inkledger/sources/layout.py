"""Tables stored for the joins and ranges that queries ask for."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def store(rows: DataFrame, name: str, key: str, buckets: int, by: str | None = None) -> DataFrame:
    """Stores rows as a table in buckets by the hash of ``key``, sorted by it, and reads it back; with ``by`` also in partitions by
    that column, which filters on it prune. Tables of as many buckets of the same key join and group by it without an exchange.
    Every bucket is one task's, in each partition one file, so ``by`` should have few values beside the rows (a month, not a
    day) and a bucket should fit a task: at 100 TB some 100,000 of them. A key that holds a large share of the rows belongs
    in no bucketed table. Rows whose ``by`` is null are kept, in a partition of their own."""
    writer = rows.repartition(buckets, F.col(key)).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def new_name(name: str) -> str:
    """A table name that is not taken, for tables a query derives and reads again; they lie in the warehouse the cluster shares."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def month(day: str = "batch_date") -> Column:
    """The partition of a date: its month as a number such as 199407, null for none."""
    return (F.year(day) * 100 + F.month(day)).alias("month")

"""Relational tables over JDBC: reads split by a column's range, appends in batches, upserts by one statement over a staged table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _on(spark: SparkSession, url: str, work: Callable[[JavaObject], list], options: dict[str, str]) -> list:
    """Runs statements of one transaction from the driver. They move no rows through it."""
    jvm = spark.sparkContext._jvm
    # Spark's registry loads drivers with the session's class loader, as its own reads and writes do
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options.get("driver") or jvm.java.sql.DriverManager.getDriver(url).getClass().getName())
    login = jvm.java.util.Properties()
    for k, v in options.items():
        if k != "driver":
            login.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        out = work(statement)
        connection.commit()
        return out
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def read_table(spark: SparkSession, url: str, name: str, split_by: str | None = None, parts: int = 8, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table. Filters, columns, limits and aggregates that the database can do are pushed down to it. With ``split_by`` (an indexed
    number) it is read by ``parts`` connections, each a range of that column between its least and greatest value; rows without
    a value are read with the first range. options: driver, user, password and the like."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=fetch, **options)
    if not split_by:
        return reader.load()
    low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({_quoted(split_by)}) AS LOW, max({_quoted(split_by)}) AS HIGH FROM {name}", **options).load().first()
    if low is None:
        return reader.load()
    return reader.options(partitionColumn=_quoted(split_by), lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts).load()


def append_table(rows: DataFrame, url: str, name: str, parts: int = 8, batch: int = 5_000, types: str = "", **options: str) -> None:
    """Appends in batches over at most ``parts`` connections; makes the table if it is not there, with column types of the
    database where ``types`` gives them (many make texts of unbounded length otherwise, which they cannot compare). A task that is repeated after a
    failure rolls its own rows back first, but a job that fails as a whole may leave some of its tasks' rows: use upsert_table where
    runs are repeated."""
    if types:
        options["createTableColumnTypes"] = types
    rows.coalesce(parts).write.format("jdbc").mode("append").options(url=url, dbtable=name, batchsize=batch, **options).save()


def upsert_table(rows: DataFrame, url: str, name: str, keys: list[str], parts: int = 8, **options: str) -> None:
    """Puts rows into a table that is there: rows with stored keys replace its other columns, others are added, in one transaction by
    a MERGE (of the SQL standard) from a staged table. Runs may be repeated. rows hold each key once, without nulls in it; where
    they do not, the statement fails or adds a row, by the database."""
    spark, stage = rows.sparkSession, f"STAGE_{uuid.uuid4().hex[:12].upper()}"
    columns = rows.columns
    rest = [c for c in columns if c not in keys]
    match = " AND ".join(f"t.{_quoted(k)} = s.{_quoted(k)}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{_quoted(c)} = s.{_quoted(c)}' for c in rest)}" if rest else ""
    names, values = ", ".join(map(_quoted, columns)), ", ".join(f"s.{_quoted(c)}" for c in columns)
    merge = f"MERGE INTO {name} AS t USING {stage} AS s ON {match}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    # the stage has the table's own columns and types, not those Spark would choose
    _on(spark, url, lambda st: [st.executeUpdate(f"CREATE TABLE {stage} AS SELECT {names} FROM {name} WITH NO DATA")], options)
    try:
        append_table(rows, url, stage, parts, **options)
        _on(spark, url, lambda st: [st.executeUpdate(merge)], options)
    finally:
        _on(spark, url, lambda st: [st.executeUpdate(f"DROP TABLE {stage}")], options)

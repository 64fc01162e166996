"""Tables that several writers change: folders of Parquet files, and numbered pointers to those that make up each version."""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.sources.store import names, opened

#: A version of more folders than this is written anew as one.
MAX_FOLDERS = 32


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this text unless one is there. Of several writers one wins: a local file by a hard link, others by a rename
    that does not overwrite, which is atomic on HDFS; on a store without atomic renames this does not hold."""
    fs, there = opened(spark, path)
    fs.mkdirs(there.getParent())
    if fs.getUri().getScheme() == "file":
        own = f"{there.getParent().toUri().getPath()}/.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, there.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            os.remove(own)
        return True
    jvm = spark.sparkContext._jvm
    _, own = opened(spark, f"{path}-{uuid.uuid4().hex}.tmp")
    out = fs.create(own, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(own, there, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        fs.delete(own, False)
        return False
    return True


def _pointers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{root}/versions") if n.isdigit())


def _folders(spark: SparkSession, root: str, version: int) -> list[str]:
    if version < 0:
        return []
    fs, there = opened(spark, f"{root}/versions/{version:012d}")
    stream = fs.open(there)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def current(spark: SparkSession, root: str, schema: str) -> tuple[int, DataFrame]:
    """(version, rows) of a table; -1 and no rows before anything was written. Folders of a version never change."""
    version = max(_pointers(spark, root), default=-1)
    paths = [f"{root}/data/{f}" for f in _folders(spark, root, version)]
    return version, spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, root: str, schema: str, change: Callable[[DataFrame], DataFrame], whole: bool, tries: int) -> None:
    for nth in range(tries):
        version, have = current(spark, root, schema)
        folders = [] if whole else _folders(spark, root, version)
        name = uuid.uuid4().hex
        change(have).write.parquet(f"{root}/data/{name}")
        if not whole and spark.read.schema(schema).parquet(f"{root}/data/{name}").isEmpty():
            return
        if len(folders) >= MAX_FOLDERS:
            merged = uuid.uuid4().hex
            spark.read.schema(schema).parquet(*(f"{root}/data/{f}" for f in [*folders, name])).write.parquet(f"{root}/data/{merged}")
            folders, name = [], merged
        if _claim(spark, f"{root}/versions/{version + 1:012d}", json.dumps([*folders, name])):
            return
        # another writer was first: what it wrote counts now, so the change is worked out again
        time.sleep(random.uniform(0, 0.1 * (nth + 1)))
    raise RuntimeError(f"{root}: other writers were first {tries} times")


def get_or_create(spark: SparkSession, root: str, wanted: DataFrame, keys: list[str], tries: int = 20) -> DataFrame:
    """The stored rows of the wanted keys; those not there are added first. Of rows with equal keys that are wanted at once, the
    least by their other columns is kept; one that is stored already, or that another writer adds meanwhile, stays as it is. Keys
    are compared by value, nulls as equal. Only rows to add are written. wanted: the table's columns, in any order; it is worked
    out again if another writer was first."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    rest = [c for c in wanted.columns if c not in keys]
    one = wanted.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, "row.*") if rest else wanted.distinct()
    _commit(spark, root, schema, lambda have: one.join(have, same(one, have), "left_anti").select(wanted.columns), False, tries)
    stored = current(spark, root, schema)[1]
    return stored.join(one, same(stored, one), "left_semi")


def upsert(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], tries: int = 20) -> DataFrame:
    """The table after rows are put in: of equal keys the given row replaces the stored one. rows hold each key once; others raise
    an error. The table is written whole, as a version of its own, so it suits small ones such as batches. A writer that was beaten
    puts its rows into what the other left."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"rows repeat keys {keys}")
    kept = lambda have: have.join(rows, [have[k].eqNullSafe(rows[k]) for k in keys], "left_anti").select(rows.columns)
    _commit(spark, root, schema, lambda have: kept(have).unionByName(rows), True, tries)
    return current(spark, root, schema)[1]


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Removes pointers but the last ``keep``, and the folders that none of those names, and returns how many folders went. Not
    to be run while others write: a folder that no pointer names yet may be one that is being added."""
    pointers = _pointers(spark, root)
    used = {f for v in pointers[-keep:] for f in _folders(spark, root, v)}
    gone = [n for n in names(spark, f"{root}/data") if n not in used]
    for path in [*(f"{root}/versions/{v:012d}" for v in pointers[:-keep]), *(f"{root}/data/{n}" for n in gone)]:
        fs, there = opened(spark, path)
        fs.delete(there, True)
    return len(gone)

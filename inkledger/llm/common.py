"""What the corpus operators share: the shared scratch folder, text rules and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " ", -1), "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset in one process (tests), a folder of our own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows that pass to Python at once: texts may be long, and a task holds a batch several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which hold whole texts here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def release() -> None:
    """Hands what a task no longer holds back to the system, as its worker lives on beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a re-read and not a re-run."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """by: last columns, of few values, by which readers filter."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- word hashing
# Words of many texts are hashed at once: a prefix polynomial over the bytes (mod 2^64) gives the hash of
# any byte range by one subtraction and one multiplication, so there is no Python loop over words.

_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, np.ndarray] = {}


#: Bytes of text that a task hashes at once, unless one text is longer.
PIECE = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call up to the size of a usual piece."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 64), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 2 * PIECE + 64:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def chunks(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts): rows in pieces of about ``limit`` bytes, each text followed by a
    space. starts has one entry more than rows. Nulls count as empty; a longer text is a piece of its own. Only one piece
    at a time is copied out of the batch."""
    texts = texts.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    held, first = np.concatenate([[0], np.cumsum(sizes)]), 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(held, held[first] + limit, side="right")) - 1)
        part = [x or b"" for x in texts.slice(first, end - first).to_pylist()]
        yield first, end, np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8), held[first : end + 1] - held[first]
        first = end


def hash_words(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, A-Z in lower case; first word of each text, with the total at the end)."""
    word = is_word[data]
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begins, ends = edges[::2], edges[1::2]
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * powers(_ROOT, len(data)), out=prefix[1:])
    hashes = (prefix[ends] - prefix[begins]) * powers(_INVERSE, len(data) + 1)[begins]
    hashes = mix(hashes + (ends - begins).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    return hashes, np.searchsorted(begins, starts)


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    """For each item of consecutive segments with the given bounds, its segment."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

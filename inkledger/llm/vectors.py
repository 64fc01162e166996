"""What the vector operators share: which rows count, bounded samples, and blocks of vectors that meet blocks of queries.

An index assigns every row a cell. Rows of a cell are packed into pieces of at most ``PIECE_ROWS`` vectors, and a cell with many
rows is spread over salts, so no task gathers a cell. Consecutive pieces form groups of about equal size. A task holds one group and
the queries that have to see it pass by in blocks, so a query travels once for each group and not for each piece."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; it comes last among ties and is null again in results.
NO_ID = (1 << 63) - 1
PIECE_ROWS, PIECE_QUERIES = 2048, 256
#: Values (rows times components) of the sample that an index is fitted on: at most 64 MB at the driver.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 1 << 23
#: Packed pieces that pass to Python at once.
PIECES = 16
#: Groups that rows are dealt into (fewer than that many pieces: one each), more where a group's vectors would exceed these bytes.
GROUPS, GROUP_BYTES = 64, 1 << 26
#: Of four times so many groups or more, the first round takes every ROUND-th: what it finds bounds the round over the others.
ROUND = 8
#: Pairs that are compared at once, and queries.
STEP_PAIRS, STEP_QUERIES = 1 << 18, 256


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the Arrow batches of what is executed inside, and only of that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def usable(df: DataFrame, *keep: str | Column) -> DataFrame:
    """vec_id, embedding (doubles) and ``keep`` of the rows whose vector is neither null nor holds null or non-finite components."""
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), *keep)
    return rows.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def dimension(rows: DataFrame) -> tuple[int | None, int]:
    """The length that most vectors have, the greater on ties, and their number; (None, 0) without vectors."""
    top = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return (top["n"], top["rows"]) if top else (None, 0)


def of_dimension(rows: DataFrame, dim: int) -> DataFrame:
    return rows.filter(F.size("embedding") == dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def sample(rows: DataFrame, dim: int, total: int) -> np.ndarray:
    """The vectors of at most SAMPLE_ROWS of ``total`` rows (fewer for long vectors), by the least hashes of their ids and components.

    Only rows below a bound on the hash are sent, copies as one with their number, so the driver gets little more than the sample
    from however many tasks; the bound is raised while too few rows lie below it."""
    n = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, dim)))
    keyed, share = rows.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")), 1.25 * n / max(1, total)
    while True:
        below = keyed.filter(F.col("h") < int((share - 0.5) * 2.0**64)) if share < 1 else keyed
        found = below.groupBy("h").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n")).toArrow().combine_chunks()
        h, many = (found.column(c).to_numpy() for c in ("h", "n"))
        if share >= 1 or many.sum() >= n:
            break
        share *= 2
    order = np.argsort(h)
    ahead = np.cumsum(many[order]) - many[order]
    return np.repeat(matrix(found.column("embedding").combine_chunks(), dim)[order], np.clip(n - ahead, 0, many[order]), axis=0)


def binary(mat: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    data, wide = np.ascontiguousarray(mat), mat.shape[1] * mat.itemsize
    return pa.Array.from_buffers(pa.binary(wide), len(mat), [None, pa.py_buffer(data)]).cast(pa.binary())


def assign(rows: DataFrame, dim: int, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """cell, vec_id, label, vec of rows with vec_id, embedding and label: ``place`` gives for vectors their cells and what is kept of
    them as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, kept = place(matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), b.column(0), b.column(2), binary(kept)], ["cell", "vec_id", "label", "vec"])

    ready = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    return ready.mapInArrow(run, "cell int, vec_id long, label long, vec binary")


@dataclass(frozen=True)
class Groups:
    """The pieces of the cells, and the groups of consecutive pieces."""

    many: int
    salts: dict[int, int]  # cell: its pieces
    places: list[tuple[int, int, int]]  # cell, salt, group
    cells: list[list[int]]  # of each group

    def rounds(self) -> list[list[int]]:
        every = list(range(self.many))
        return [every[::ROUND], [g for g in every if g % ROUND]] if self.many >= 4 * ROUND else [every]


def groups(rows: DataFrame, wide: int) -> Groups:
    """Pieces and groups of rows (cell) with vectors of ``wide`` bytes. An index has a bounded number of cells."""
    count = sorted((r["cell"], r["n"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())
    total, salts = sum(n for _, n in count), {cell: -(-n // PIECE_ROWS) for cell, n in count}
    many = max(min(GROUPS, sum(salts.values())), -(-total * wide // GROUP_BYTES), 1)
    places, cells, before = [], [set() for _ in range(many)], 0
    for cell, n in count:
        for salt in range(salts[cell]):
            places.append((cell, salt, (before * salts[cell] + n * salt) * many // (total * salts[cell])))
            cells[places[-1][2]].add(cell)
        before += n
    return Groups(many, salts, places, [sorted(c) for c in cells])


def salted(rows: DataFrame, many: dict[int, int]) -> DataFrame:
    """Rows with a salt below their cell's number of pieces."""
    table = rows.sparkSession.createDataFrame(pa.table({"cell": pa.array(list(many), pa.int32()), "m": pa.array(list(many.values()), pa.int32())}))
    return rows.join(F.broadcast(table), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id", "vec"), F.col("m")).cast("int")).drop("m")


def pack(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The rows of equal keys in pieces of at most ``size``: keys (ints), vec (the bytes of all vectors in one) and for every other
    column the list of its values. A task holds one piece and one batch, however many rows share a key."""
    columns = [c for c in rows.columns if c not in keys]
    spread = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *(c for c in columns if c == "vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, many = None, [], 0

        def piece() -> pa.RecordBatch:
            whole = pa.concat_batches(held)
            lists = [pa.array([b"".join(c.to_pylist())], pa.binary()) if n == "vec" else pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), c) for n, c in zip(columns, whole.columns, strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in now), *lists], [*keys, *columns])

        for b in batches:
            ids = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))])
            edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1), b.num_rows]
            values = pa.RecordBatch.from_arrays(b.columns[len(keys) :], columns)
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                key = tuple(int(x) for x in ids[:, start])
                if held and key != now:
                    yield piece()
                    held, many = [], 0
                now = key
                while start < end:
                    step = min(end - start, size - many)
                    held, many, start = [*held, values.slice(start, step)], many + step, start + step
                    if many == size:
                        yield piece()
                        held, many = [], 0
        if held:
            yield piece()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return spread.mapInArrow(run, ", ".join([*(f"{k} int" for k in keys), *(f"{c} binary" if c == "vec" else f"{c} array<{kinds[c]}>" for c in columns)]))


def unpack(data: bytes, dtype: type, wide: int) -> np.ndarray:
    """The matrix of vectors whose rows were packed as bytes."""
    return np.frombuffer(data, dtype=dtype).reshape(-1, wide)


def lists(values: pa.Array) -> np.ndarray:
    """The matrix of lists of equal lengths."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


Block = dict[str, np.ndarray | bytes]


def block(b: pa.RecordBatch, columns: list[str]) -> Block:
    """The values of several pieces, one after the other: vec as bytes, numbers as arrays, lists as matrices."""
    out: Block = {}
    for c in columns:
        column = b.column(b.schema.get_field_index(c))
        if c == "vec":
            out[c] = b"".join(column.to_pylist())
        else:
            values = column.flatten()
            out[c] = lists(values) if pa.types.is_list(values.type) else values.to_numpy(zero_copy_only=False)
    return out


def spread_queries(queries: DataFrame, keep: Callable[[Block], Iterator[tuple[int, np.ndarray]]], all_: Groups, wanted: list[int]) -> DataFrame:
    """Query blocks for each group that they have to see: grp, cells (those asked for), asked (for each of these cells the queries that
    ask for it, in bits) and the queries' columns. keep gives for a block the cells and the places of the queries in question."""
    columns = [c for c in queries.columns if c not in ("cell", "salt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [b.column(b.schema.get_field_index(c)) for c in columns]
            whole = block(b, columns)
            many = len(whole["q"])
            wide, asked = len(whole["vec"]) // max(1, many), {}
            for cell, places in keep(whole):
                asked[cell] = np.zeros(many, bool)
                asked[cell][places] = True
            data, flat = np.frombuffer(whole["vec"], np.uint8).reshape(many, wide), [None if c == "vec" else v.flatten() for c, v in zip(columns, values, strict=True)]
            for g in wanted:
                own = [c for c in all_.cells[g] if c in asked]
                if not own:
                    continue
                bits = np.stack([asked[c] for c in own])
                at = np.flatnonzero(bits.any(axis=0))
                if not len(at):
                    continue
                taken = [pa.array([data[at].tobytes()], pa.binary()) if v is None else pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), v.take(pa.array(at))) for v in flat]
                head = [pa.array([g], pa.int32()), pa.array([own], pa.list_(pa.int32())), pa.array([np.packbits(bits[:, at], axis=1).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*head, *taken], ["grp", "cells", "asked", *columns])

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.repartition(all_.many, "cell").mapInArrow(run, ", ".join(["grp int, cells array<int>, asked binary", *(f"{c} {kinds[c]}" for c in columns)]))


Hold = Callable[[dict[int, Block]], object]
Ask = Callable[[object, Block, dict[int, np.ndarray]], Iterator[pa.RecordBatch]]


def pass_by(pieces: DataFrame, sent: DataFrame, all_: Groups, wanted: list[int], hold: Hold, ask: Ask, schema: str) -> DataFrame:
    """What ``ask`` finds for the query blocks (of spread_queries) in the groups that are wanted. A task gets the pieces of one group first,
    which ``hold`` makes ready by cells, then the queries of the group; ask gets these with the places of those that ask for each cell."""
    mine, theirs = [c for c in pieces.columns if c not in ("cell", "salt")], [c for c in sent.columns if c not in ("grp", "cells", "asked")]
    chosen = set(wanted)
    placed = np.array([p for p in all_.places if p[2] in chosen], np.int32).reshape(-1, 3)
    place = pieces.sparkSession.createDataFrame(pa.table({n: pa.array(placed[:, i]) for i, n in enumerate(("cell", "salt", "grp"))}))
    rows = pieces.join(F.broadcast(place), ["cell", "salt"]).drop("salt").withColumn("kind", F.lit(0))
    both = rows.unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def asked(waiting: list[tuple[Block, list[int], np.ndarray]], ready: object) -> Iterator[pa.RecordBatch]:
        whole: Block = {c: b"".join(w[0][c] for w in waiting) if c == "vec" else np.concatenate([w[0][c] for w in waiting]) for c in theirs}
        many, at = len(whole["q"]), 0
        masks: dict[int, np.ndarray] = {}
        for values, cells, bits in waiting:
            end = at + len(values["q"])
            for cell, own in zip(cells, bits, strict=True):
                masks.setdefault(cell, np.zeros(many, bool))[at:end] = own
            at = end
        wide = len(whole["vec"]) // many
        for start in range(0, many, STEP_QUERIES):
            part = slice(start, start + STEP_QUERIES)
            own = {c: v[start * wide : (start + STEP_QUERIES) * wide] if c == "vec" else v[part] for c, v in whole.items()}
            yield from ask(ready, own, {c: places for c in sorted(masks) if len(places := np.flatnonzero(masks[c][part]))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready, waiting, many = None, {}, None, [], 0
        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for row in range(b.num_rows):
                one, grp = b.slice(row, 1), column["grp"][row].as_py()
                if grp != now:
                    if waiting:
                        yield from asked(waiting, ready)
                    now, held, ready, waiting, many = grp, {}, None, [], 0
                if column["kind"][row].as_py() == 0:
                    held.setdefault(column["cell"][row].as_py(), []).append(block(one, mine))
                    continue
                if ready is None:
                    ready = hold({cell: {c: b"".join(p[c] for p in held[cell]) if c == "vec" else np.concatenate([p[c] for p in held[cell]]) for c in mine} for cell in sorted(held)})
                    held = {}
                values, cells = block(one, theirs), column["cells"][row].as_py()
                bits = np.unpackbits(np.frombuffer(column["asked"][row].as_py(), np.uint8).reshape(len(cells), -1), axis=1, count=len(values["q"])).astype(bool)
                waiting.append((values, cells, bits))
                many += len(values["q"])
                if many >= STEP_QUERIES:
                    yield from asked(waiting, ready)
                    waiting, many = [], 0
        if waiting:
            yield from asked(waiting, ready)

    return both.repartitionById(all_.many, "grp").sortWithinPartitions("grp", "kind").mapInArrow(run, schema)


def meet(queries: DataFrame, pieces: DataFrame, hold: Hold, ask: Ask, schema: str) -> DataFrame:
    """The same for pairs of a query block and a piece with the same (cell, salt)."""
    mine, theirs = [c for c in pieces.columns if c not in ("cell", "salt")], [c for c in queries.columns if c not in ("cell", "salt")]
    named = pieces.withColumnsRenamed({c: f"x_{c}" for c in mine})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                one = b.slice(row, 1)
                own, rows = block(one, theirs), block(one, [f"x_{c}" for c in mine if c != "vec"])
                rows = {c.removeprefix("x_"): v for c, v in rows.items()} | {"vec": b.column(b.schema.get_field_index("x_vec"))[row].as_py()}
                cell = b.column(b.schema.get_field_index("cell"))[row].as_py()
                yield from ask(hold({cell: rows}), own, {cell: np.arange(len(own["q"]))})

    # a merge, as the blocks must not be gathered for a broadcast
    return queries.hint("merge").join(named, ["cell", "salt"]).mapInArrow(run, schema)


class Best:
    """The first k rows of each of ``many`` keys, by score and then id, as rows come."""

    def __init__(self, many: int, k: int):
        self.k, self.edge = k, np.full(many, np.inf)  # of each key the k-th score, once there are k
        self.rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> bool:
        """Whether the edges may have moved."""
        self.new.append((key, ids, score))
        self.waiting += len(key)
        if self.waiting > max(1 << 14, len(self.rows[0])):
            self.settle()
            return True
        return False

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, ids, score = (np.concatenate(c) for c in zip(self.rows, *self.new, strict=True))
        order = np.lexsort((ids, score, key))
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        nth = np.arange(len(key)) - np.repeat(heads, np.diff([*heads, len(key)]))
        last = nth == self.k - 1
        self.edge[key[last]] = score[order[last]]
        order = order[nth < self.k]
        self.rows, self.new, self.waiting = (key[nth < self.k], ids[order], score[order]), [], 0
        return self.rows


def ranked(found: DataFrame, keys: list[str], score: Column, k: int) -> DataFrame:
    """The first k rows of each key with their rank. Rows of a key come from few pieces and are thinned before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

"""What the corpus operators share: tables in the shared folder, running totals in a
distributed order, sums of count vectors and bounded samples of labelled rows."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_working: ContextVar[tuple[list[str], ...]] = ContextVar("working", default=())  # tables of each open working()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local
    session that names none gets a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="petroloom-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str = "step", hold: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, so a lost
    executor costs a read and not the work before it. A table to hold outlives the innermost
    working(), which deletes the others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    open_now = _working.get()
    if len(open_now) > hold:
        open_now[-1 - hold].append(path)
    made = spark.read.schema(df.schema).parquet(path)
    _paths[made] = path
    return made


def path_of(made: DataFrame) -> str:
    """Where materialize() has written a frame that it returned."""
    return _paths[made]


@contextlib.contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialize() wrote inside, but for those to hold. What is
    returned from inside must read held tables only."""
    tables: list[str] = []
    token = _working.set((*_working.get(), tables))
    try:
        yield
    finally:
        _working.reset(token)
        release(spark, tables)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables of the shared folder. Frames that read them end here."""
    for path in paths:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def set_aside(df: DataFrame, used: list[str], **more: Column) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with the columns of `used` under these names and all others as kept0, kept1 ..., so that no name of
    theirs can meet one that an operator makes; with further columns from expressions over df as it was. And the
    function that gives a frame the columns of df back, under their names and in their order, then others named."""
    own = {c: c.lower() if c.lower() in used else f"kept{k}" for k, c in enumerate(df.columns)}
    at = lambda c: F.col("`" + c.replace("`", "``") + "`")
    frame = df.select(*[at(c).alias(name) for c, name in own.items()], *[x.alias(name) for name, x in more.items()])
    return frame, lambda made, *others: made.select(*[F.col(name).alias(c) for c, name in own.items()], *others)


BATCH = 8 << 20  # bytes of a batch for Python, at most, but for a row that is longer by itself


def bound_batches(spark: SparkSession) -> None:
    """Texts may be long, so batches for Python are bounded by bytes. The bound is only ever lowered,
    and never changes a result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH:
        spark.conf.set(key, str(BATCH))


def batches(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of a string column each, one row at least."""
    texts = batch.column(column).cast(pa.large_string())
    lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Mapper) -> Mapper:
    """run, after which the worker gives back to the system what it no longer uses. Spark keeps a worker
    for the tasks of all later stages, and the allocators would keep the most that any of them took."""
    def then_trim(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(rows)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
                trim(0)

    return then_trim


def part_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_totals(df: DataFrame, order: list[str], value: str, label: str = "ranked") -> tuple[DataFrame, int]:
    """df with `_before`: the sum of `value` over all rows that come before a row in `order`
    (nulls first), and the sum over all rows.

    A range shuffle sorts the rows, each partition adds up its own, and only the partitions'
    sums meet on the driver. Rows that are alike in all of `order` are told apart by their place in df, so
    they too are dealt over many partitions. `value` must be long. df is read twice (the range bounds
    come from a sample): pass a table, not a computation."""
    from pyspark.sql import types as T

    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def add_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in rows:
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(values) + total
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(ends - values)], names=[*batch.schema.names, "_part", "_local"])

    placed = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(part_count(spark), *order, "_place").sortWithinPartitions(*order, "_place")
    dealt = materialize(placed.drop("_place").mapInArrow(lean(add_up), schema), label)
    sums = sorted((r["_part"], r["s"]) for r in dealt.groupBy("_part").agg(F.sum(value).alias("s")).collect())
    starts, total = [], 0
    for part, s in sums:
        starts.append((part, total))
        total += s
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _start long")  # a row for each partition
    return dealt.join(F.broadcast(offsets), "_part").withColumn("_before", F.col("_local") + F.col("_start")).drop("_part", "_local", "_start"), total


def _along(values: np.ndarray, starts: np.ndarray, carry: int, fold: np.ufunc) -> tuple[np.ndarray, int]:
    """Running sums (np.add) or exclusive ors (np.bitwise_xor) that begin anew where a key starts. starts: for
    each value the place of its key's first one, -1 if that came in a batch before."""
    undo = np.subtract if fold is np.add else np.bitwise_xor
    ran = fold(fold.accumulate(values), carry)
    before = np.where(starts >= 0, undo(ran, values)[np.maximum(starts, 0)], 0)
    made = undo(ran, before)
    return made, int(made[-1])


def running_by_key(df: DataFrame, key: str, order: list[Column], sums: list[str], xors: list[str] = (), label: str = "along") -> DataFrame:
    """df with `<name>_run` for each of sums and xors (long, no nulls): the sum or exclusive or over the rows
    of the same key (long, no nulls) up to and with this one, in `order`.

    A range shuffle sorts the rows by key and order, so a key that holds a third of all rows lies in many
    partitions. Each adds up its own rows; only the first and the last key's state of each partition meet
    on the driver and go back as what a partition's first key has gathered before it. Rows alike in all
    of `order` are told apart by their place in df. df is read twice: pass a table."""
    from pyspark.sql import types as T

    kinds = [(c, np.add) for c in sums] + [(c, np.bitwise_xor) for c in xors]
    added = [f"{c}_run" for c, _ in kinds]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in added], T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType()), T.StructField("_open", T.BooleanType())])

    def add_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, first, last, carry = TaskContext.get().partitionId(), 0, None, None, [0] * len(kinds)
        for batch in rows:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            first, last = int(keys[0]) if first is None else first, int(keys[-1])
            made = []
            for k, (c, fold) in enumerate(kinds):
                run, carry[k] = _along(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), starts, carry[k], fold)
                made.append(pa.array(run))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(np.full(len(keys), part, np.int32)), pa.array(np.arange(n, n + len(keys))), pa.array(keys == first)], names=schema.names)
            n += len(keys)

    placed = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(part_count(df.sparkSession), key, *order, "_place").sortWithinPartitions(key, *order, "_place")
    dealt = materialize(placed.drop("_place").mapInArrow(lean(add_up), schema), label)
    ends = dealt.groupBy("_part").agg(F.min_by(key, "_nth").alias("first"), F.max_by(key, "_nth").alias("last"), *[F.max_by(c, "_nth").alias(c) for c in added]).collect()
    held, carries = (None, [0] * len(kinds)), []
    for r in sorted(ends, key=lambda r: r["_part"]):
        before = held[1] if held[0] == r["first"] else [0] * len(kinds)
        carries.append((r["_part"], *before))
        after = [r[c] for c in added]
        if r["last"] == r["first"]:
            after = [a + b if fold is np.add else a ^ b for a, b, (_, fold) in zip(after, before, kinds, strict=True)]
        held = (r["last"], after)
    carried = df.sparkSession.createDataFrame(carries or [(0, *[0] * len(kinds))], ", ".join(["_part int", *[f"_c{k} long" for k in range(len(kinds))]]))  # a row for each partition
    out = dealt.join(F.broadcast(carried), "_part")
    for k, (c, fold) in enumerate(kinds):
        more = F.when(F.col("_open"), F.col(f"_c{k}")).otherwise(F.lit(0))
        out = out.withColumn(f"{c}_run", F.col(f"{c}_run") + more if fold is np.add else F.col(f"{c}_run").bitwiseXOR(more))
    return out.select(*df.columns, *added)


SLICE = 1 << 16
FAN = 16
VECTORS = "name string, slice int, fan int, counts binary"
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Whole numbers of 0 and above in the narrowest type that holds them, compressed."""
    kind = next(k for k, t in enumerate(_WIDTHS) if int(counts.max()) <= np.iinfo(t).max)
    return bytes([kind]) + zlib.compress(counts.astype(_WIDTHS[kind]).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), _WIDTHS[data[0]])


def _vector_batch(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["name", "slice", "fan", "counts"])


def vector_rows(vectors: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (name, slice, fan, counts) for sum_vectors(): what one task has counted, none below 0."""
    fan = TaskContext.get().partitionId() // 64 % FAN
    for name, v in vectors.items():
        for k in range(0, len(v), SLICE):
            if (part := v[k : k + SLICE]).any():
                yield _vector_batch([(name, k // SLICE, fan, _packed(part))])


def sum_vectors(df: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Adds up the rows of vector_rows() in two levels. A task holds one running sum for each slice it
    gets. The sums, of fixed size, come to the driver."""
    def add_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in rows:
            for name, part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                v = _unpacked(counts.as_py())
                held[name, part] = held[name, part] + v if (name, part) in held else v.astype(np.int64)
        for (name, part), v in held.items():
            yield _vector_batch([(name, part, 0, _packed(v))])

    out = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    first = df.repartition("name", "slice", "fan").mapInArrow(lean(add_up), VECTORS)
    for r in first.repartition("name", "slice").mapInArrow(lean(add_up), VECTORS).collect():
        v = _unpacked(bytes(r["counts"]))
        out[r["name"]][r["slice"] * SLICE : r["slice"] * SLICE + len(v)] = v
    return out


def bounded_rows(df: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """At most `limit` rows of df, drawn by a seeded hash of `key`: a documented bound on what
    a model is fitted on. The same rows come out whatever the partitioning."""
    n = df.count()
    mixed = F.xxhash64(F.lit(seed), F.col(key))
    if n > limit:
        edge = -(2**63) + int(2**64 * min(1.0, 1.2 * limit / n + 0.001))
        df = df.filter(mixed < F.lit(min(edge, 2**63 - 1)))
    return df.orderBy(mixed, F.col(key)).limit(limit)


def fold(column: str, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo `parts`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def empty_if_null(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hot_keys(counts: DataFrame, key: str, of: int, share: int = 1000) -> list:
    """The keys with more than 1 / `share` of all `of` rows, `share` at most. counts: (key, n)."""
    return [r[0] for r in counts.filter(F.col("n") > max(64, of // share)).select(key).collect()]


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """left join right on `key` (inner), where right has one row for each key, and left may hold
    a third of its rows in one. The rows of `right` with one of the keys of hot_keys() are broadcast;
    the others shuffle evenly."""
    if not hot:
        return left.join(right, key)
    few = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], f"{key} {left.schema[key].dataType.simpleString()}"))
    cold = left.join(few, key, "left_anti").join(right, key)  # no row of a hot key reaches the shuffle
    return cold.unionByName(left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key))

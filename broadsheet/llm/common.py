"""What the operators share: tables, durable intermediate results, Arrow and numpy helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the contracts: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one under the warehouse, or a local one if Spark itself is local (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    master = spark.sparkContext.master
    own = tempfile.mkdtemp(prefix="broadsheet-") if master == "local" or master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to be a column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def inside(df: DataFrame, *own: str) -> DataFrame:
    """df with the columns named in own under these names, the others under numbers: so no name of a caller can clash or need quotes. toDF(*df.columns) undoes it."""
    named = {}
    for name in own:
        same = [i for i, c in enumerate(df.columns) if c.lower() == name]
        if same:
            named[next((i for i in same if df.columns[i] == name), same[0])] = name
    return df.toDF(*[named.get(i, f"c{i}") for i in range(len(df.columns))])


#: Tables written in the scopes that are open, innermost last.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """A scope that lists the durable tables which are written inside."""
    made: list[DataFrame] = []
    token = _open.set((*_open.get(), made))
    try:
        yield made
    finally:
        _open.reset(token)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """A scope at whose end the durable tables that were written inside go, but for those put on the list that it gives; these pass to the scope around it."""
    kept: list[DataFrame] = []
    with collected() as made:
        yield kept
    names = {df._durable_path for df in kept}
    forget(*[df for df in made if df._durable_path not in names])
    if around := _open.get():
        around[-1].extend(kept)


def _written(df: DataFrame, path: str) -> DataFrame:
    df._durable_path = path
    if around := _open.get():
        around[-1].append(df)
    return df


def durable(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a written table: it is computed once, cuts the lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return _written(spark.read.schema(df.schema).parquet(path), path)


def durable_parts(df: DataFrame, mark, name: str, compression: str | None = None) -> tuple[DataFrame, DataFrame]:
    """df written once as two tables: the rows without and with the mark; each can be forgotten for itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.withColumn("part", mark.cast("int")).write.partitionBy("part").parquet(path, compression=compression)
    out = []
    for part in (0, 1):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # a part without rows has no folder yet
        out.append(_written(spark.read.schema(df.schema).parquet(f"{path}/part={part}"), f"{path}/part={part}"))
    return out[0], out[1]


def forget(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession, rounds: int = 2) -> None:
    """Between steps: let Spark drop the shuffle files of finished ones, and the driver give back memory.

    What one collection frees holds what the next one can; Spark's cleaner works beside them.
    """
    for _ in range(rounds):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    _give_back()


@contextmanager
def narrow(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> Iterator[None]:
    """Inside, Spark hands smaller Arrow batches to workers: for steps, run at once, whose rows unfold to many times their size."""
    want = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(task):
    """A mapInArrow function whose worker gives freed memory back at its end: idle workers stay beside the executor's heap."""

    def run(batches):
        yield from task(batches)
        _end_task()

    return run


def lean_group(task):
    """The same for an applyInArrow function of one table: memory goes back after each group of some size."""

    def run(t):
        size = t.nbytes
        out = task(t)
        if size > 1 << 20:
            del t
            _end_task()
        return out

    return run


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _end_task() -> None:
    """A worker's modules outlive its tasks: frozen, they aren't walked through again at the end of each, which took a third of a small task's time."""
    _give_back()
    gc.freeze()


def width(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt over; the cluster sets it in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows whose bytes come to about `most`; a longer row has a run of its own."""
    out, a, n = [], 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) for uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)

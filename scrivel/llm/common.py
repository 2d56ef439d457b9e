"""What the operators share: the shared work folder, written intermediate tables and Arrow text slices."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that an Arrow function works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes that Spark hands over at once.
BATCH_BYTES = 2 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and everything runs on one machine, a temporary one; elsewhere that is an error, as executors would write to their own disks."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='scrivel-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{work_dir(spark)}/scrivel/{spark.sparkContext.applicationId}"


#: Of each open scratch(), the paths of its tables.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there, and lost executors lose none of it. Within a scratch() it is removed with it; `outer` leaves it to what is around that."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _scopes.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that written() makes inside, at the end. What is needed longer is written with `outer`."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            removed(spark, path)


def release(spark: SparkSession) -> None:
    """Removes every table that this application left in the shared folder, once no DataFrame that reads them is needed."""
    removed(spark, run_dir(spark))


#: What this Python worker keeps between tasks, by operator: how to forget it.
_kept: dict[str, Callable[[], None]] = {}


def only(operator: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called by a task before it begins: what other operators keep in this worker is forgotten, so that a worker holds one operator's caches at a time."""
    others = [k for k in _kept if k != operator]
    for k in others:
        _kept.pop(k)()
    if others:
        released()
    _kept[operator] = forget


def released() -> None:
    """What this worker no longer needs goes back to the system, where the C library can: a worker that waits counts with its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, each, schema) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes, as texts may be long. A bound that the session sets itself is kept. At a task's end its worker gives back what it no longer needs."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, BATCH_BYTES)

    def task(batches):
        yield from each(batches)
        released()

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch in slices of at most `limit` bytes of text, one row at least."""
    off, _ = utf8(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; null is the empty text."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def texts(array: pa.Array) -> list[str]:
    """The strings; null is the empty text."""
    return [x or "" for x in array.to_pylist()]


#: Bits of a filter in one row of it, and of a whole one: from two MiB to 64, however many names there are.
ROW_BITS, LEAST_BITS, MOST_BITS = 1 << 15, 1 << 24, 1 << 29


def filtered(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """rows with `may`: whether their key may be among names (one column of a written table), by a bit filter of bounded size, which is broadcast. False is certain, so what it rules out needs no shuffle; names beyond its size let more through, and an exact join decides."""
    bits = min(max(LEAST_BITS, 1 << (16 * names.count()).bit_length()), MOST_BITS)
    bit = F.pmod(F.xxhash64(names.columns[0]), F.lit(bits))
    held = names.select(F.shiftright(bit, 15).alias("filter_row"), bit.bitwiseAND(F.lit(ROW_BITS - 1)).alias("bit")).groupBy("filter_row").agg(F.bitmap_construct_agg("bit").alias("filter_bits"))
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    byte = F.conv(F.hex(F.substring("filter_bits", (F.shiftright(bit.bitwiseAND(F.lit(ROW_BITS - 1)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.call_function("getbit", byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return rows.withColumn("filter_row", F.shiftright(bit, 15)).join(F.broadcast(held), "filter_row", "left").withColumn("may", may).drop("filter_row", "filter_bits")


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with `mark` for each span; spans that overlap are one. spans: an array of structs with start and end, in code points, ends exclusive, each of one character at least.

    Linear in the text and in what spans cover: a start or an end that lies within no span is one of the merged spans, and those
    lying within are told by a hash of places; the text is taken apart into its characters once, and pieces between spans are slices.
    """
    place = lambda x, end: x[end].cast("int")
    inner = F.flatten(F.transform(spans, lambda x: F.when(x["end"] - x["start"] > 1, F.sequence(place(x, "start") + 1, place(x, "end") - 1)).otherwise(F.array().cast("array<int>"))))

    def pieces(held):
        chars, starts, ends = held["chars"], held["starts"], held["ends"]
        upto = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        piece = F.transform(starts, lambda x, i: F.concat(F.array_join(F.slice(chars, upto(i) + 1, x - upto(i)), ""), F.lit(mark)))
        return F.concat(F.array_join(piece, ""), F.array_join(F.slice(chars, F.element_at(ends, -1) + 1, F.size(chars)), ""))

    outer = lambda end: F.array_sort(F.array_except(F.transform(spans, lambda x: place(x, end)), inner))
    # bound by a lambda, so that none is computed again for each span
    held = F.array(F.struct(F.split(text, "").alias("chars"), outer("start").alias("starts"), outer("end").alias("ends")))
    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(F.transform(held, pieces), 1))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Bounded(dict):
    """A cache that computes what is missing. At twice `most` entries it keeps them aside as the older half and begins anew, so its memory is bounded; who fills it in bulk may do so at `most`."""

    def __init__(self, compute, most: int = 200_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= 2 * self.most:
                self.turn()
            self[key] = value
        return value

    def turn(self) -> None:
        """What is held becomes the older half."""
        self.old = dict(self)
        self.clear()

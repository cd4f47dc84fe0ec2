"""What the corpus operators share: tables, held-out folds, checkpoints and text batches.

A text is null or any string; null counts as empty. A document with a null id is folded as if its id
were the empty text. Only the named columns of a table are read, so further columns cannot clash.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Texts are of any length: Arrow batches are bounded by their bytes, here.
BATCH_BYTES = 8 << 20


def steady(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES, if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held_to = (spark.conf.get(name, None) or "0").lower().rstrip("b")
    size = float(held_to.rstrip("kmgt")) * {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(held_to[-1], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    steady(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(modulus: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`: the same fold on every run and cluster."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def _folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names; a temporary one only on a single machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spindrift-"))
    return context._jsc.sc().getCheckpointDir().get()


def pinned(df: DataFrame) -> DataFrame:
    """`df`, computed once and written as Parquet where every executor can reread it, so that a lost
    executor loses nothing."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.pinned_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what `pinned` wrote for `frames`, once nothing reads it any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.pinned_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: it does so once the
    driver's garbage is collected, which may else come late. Executors give back the heap that earlier
    operators grew, so that a stage has it beside its own workers' memory only once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if executors > 0:
        # A heap once grown is given back only by a collection of its own: one task for each executor.
        spark.range(0, executors, 1, executors).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


_held: dict = {}


def forget() -> None:
    """Drops what `held` keeps, and gives its memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU system
        pass


def held(key: object, make: Callable[[], object]) -> object:
    """The one large object that a worker keeps between tasks, whatever operator made it."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


Batches = Iterator[pa.RecordBatch]


def frugal(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`work` of a `mapInArrow`, in a worker that keeps nothing of other operators before, and no freed
    memory after."""

    @functools.wraps(work)
    def run(batches: Batches) -> Batches:
        forget()
        yield from work(batches)
        forget()

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20):
    """Runs of rows with about `most` bytes of text each, so that work arrays stay small.

    A row is never split: one longer text makes a slice of its own.
    """
    lengths = np.diff(utf8(batch.column(column))[1])
    total = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


#: Bits of an id bitmap: 8 MB, however many ids there are.
BITMAP_BITS = 1 << 26


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the low bits of long ids: a superset of them in a fixed number of bytes.

    Rows outside it are surely not among the ids, so work on them can be skipped; rows inside still
    need an exact join. At most BITMAP_BITS / 64 rows reach the driver.
    """
    place = F.col(column).bitwiseAND(BITMAP_BITS - 1)
    word, bit = F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast((`{column}` & 63) as int))").alias("bit")
    found = ids.where(F.col(column).isNotNull()).select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place = ids.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_filter(shared, column: str) -> Column:
    """Whether a long column is in a broadcast bitmap. Only that column goes through Python."""

    def inside(ids: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(shared.value, ids.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(inside, "boolean")(F.col(column))


#: Stands for a null document id where ids are joined.
NO_ID = -(2**63)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def own_rows(documents: DataFrame) -> DataFrame:
    """`documents` with __key (see `id_key`), __seq and __fresh: __key and __seq name one row.

    __seq is 0 but for rows whose key (an id or a null one) occurs again: those are numbered by their
    text's hash, and __fresh is a number of its own for each. Only these rows are shuffled and kept.
    """
    rows = documents.withColumn("__key", id_key())
    clear = rows.withColumn("__seq", F.lit(0).cast("long")).withColumn("__fresh", F.lit(0).cast("long"))
    again = pinned(rows.groupBy("__key").count().where("count > 1").select("__key"))
    if again.isEmpty():
        return clear
    touched = documents.sparkSession.sparkContext.broadcast(id_bitmap(again, "__key"))
    no_id = F.col("__key") == NO_ID
    inside = rows.where(bitmap_filter(touched, "__key") | no_id).withColumn("__hash", F.xxhash64("text"))
    twice = again.where(~no_id).withColumn("__twice", F.lit(True))
    unsure = inside.where(~no_id).join(twice, "__key", "left").unionByName(inside.where(no_id).withColumn("__twice", F.lit(True)))
    unsure = unsure.withColumn("__part", F.when(F.col("__twice"), F.shiftrightunsigned("__hash", 52)).otherwise(0))
    unsure = unsure.withColumn("__fresh", F.monotonically_increasing_id())
    # Numbers run on over parts of a key's rows, so that the rows of a frequent key are many tasks.
    part = Window.partitionBy("__key", "__part")
    unsure = pinned(unsure.withColumn("__at", F.row_number().over(part.orderBy("__hash", "__fresh")) - 1).drop("__hash", "__twice"))
    sizes = unsure.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__part")) - F.col("__n")
    numbered = unsure.join(sizes.select("__key", "__part", before.alias("__before")), ["__key", "__part"])
    numbered = pinned(numbered.withColumn("__seq", F.col("__before") + F.col("__at")).select(*clear.columns))
    return clear.where(~(bitmap_filter(touched, "__key") | no_id)).union(numbered)


def numbered_rows(documents: DataFrame) -> DataFrame:
    """`documents` with __node, a long id of every row: its doc_id, but for rows without one, and all but
    the first of those that repeat one, an id above all of the table's."""
    rows = own_rows(documents)
    highest = rows.agg(F.max("doc_id").cast("long").alias("id"), F.max("__fresh").alias("fresh")).first()
    above = max(-1, highest.id if highest.id is not None else -1) + 1
    if above + (highest.fresh or 0) >= 2**63:
        raise ValueError("no ids are left above the table's for rows that repeat an id or have none")
    own = (F.col("__seq") == 0) & F.col("doc_id").isNotNull()
    return rows.withColumn("__node", F.when(own, F.col("doc_id").cast("long")).otherwise(F.lit(above).cast("long") + F.col("__fresh"))).drop("__key", "__seq", "__fresh")

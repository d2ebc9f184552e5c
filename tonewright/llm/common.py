"""Helpers that several of these operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: For bytes.translate: ASCII letters lower-cased, other ASCII characters but digits made blank, the rest as it is.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; set one only where none is set and Spark runs in one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        configured = tempfile.mkdtemp(prefix="tonewright-checkpoint-")
    sc.setCheckpointDir(configured)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; what earlier steps have left goes first."""
    ensure_checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_folder(spark: SparkSession) -> str:
    """A folder of its own for written tables, inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


def free(columns: Iterable[str], name: str) -> str:
    """The name, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def thinned(df: DataFrame, keys: list[Column], gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """df without the rows whose keys are rows of `gone`, and with one row for each row of keys in `repeated`; null keys agree.

    Of rows with a repeated key, the one whose columns have the smallest hash stays, however the rows are dealt.
    """
    names = [free(df.columns, f"_thinned_{i}") for i in range(len(keys))]
    marks = [free([*df.columns, *names], f"{n}_x") for n in names]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    same = [F.col(n).eqNullSafe(F.col(m)) for n, m in zip(names, marks, strict=True)]
    left = keyed.join(gone.toDF(*marks), same, "left_anti")
    if repeated.limit(1).count():
        more = repeated.toDF(*marks)
        row = F.struct(*df.columns)
        first = left.join(more, same, "left_semi").groupBy(*names).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_thinned_row"))
        left = left.join(more, same, "left_anti").select(*df.columns).unionByName(first.select("_thinned_row.*"))
    return left.select(*df.columns)


#: A key with more than this share of a table's rows is hot: there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
HOT_LEAST = 1_000
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: Column) -> DataFrame:
    """Inner join on `key`, which `right` has once: the left rows of a hot key are dealt over SALTS parts by `salt`.

    Both are read twice, so they should be cheap to read; the hashes of hot keys, under 1 / HOT_SHARE of them, come to the driver.
    """
    mark = F.xxhash64(key)
    counts = left.groupBy(key).agg(F.count("*").alias("_rows"))
    least = max(HOT_LEAST, int((left.count() or 0) * HOT_SHARE))
    hot = [r[0] for r in counts.where(F.col("_rows") > least).select(mark).collect()]
    if not hot:
        return left.join(right, key)
    parts = F.when(mark.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.withColumn("_salt", F.when(mark.isin(hot), F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(parts)), [key, "_salt"]).drop("_salt")


def give_back() -> None:
    """Give memory that is free, but still held for this process, back to the machine: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of the text column, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths, dtype=np.int64) // limit
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
        del batch, column, lengths, block, starts
    give_back()


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """The text column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def byte_texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The text column as UTF-8; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


#: Bits of the map that tells a pass over the texts which rows are wanted; where it is full, more rows pass than needed.
MARK_BITS = 23


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for b in batches:
        mark = np.asarray(b.column(0)) & ((1 << MARK_BITS) - 1)
        np.bitwise_or.at(seen, mark >> 3, (1 << (mark & 7)).astype(np.uint8))
    at = np.flatnonzero(seen)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at].astype(np.int32))], names=["cell", "bits"])


def marks(hashes: DataFrame) -> np.ndarray:
    """A map of fixed size of the values in a one-column frame of 64-bit hashes; marked() asks it."""
    cells = hashes.mapInArrow(_marks, "cell int, bits int").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    got = cells.toArrow()  # at most 2 ** (MARK_BITS - 3) short rows, whatever the input
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    out[np.asarray(got["cell"])] = np.asarray(got["bits"])
    return out


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the map: all that are, and some others."""
    mark = hashes & ((1 << MARK_BITS) - 1)
    return (table[mark >> 3] >> (mark & 7) & 1).astype(bool)


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Pause Python's cycle collector while many small objects are made."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()

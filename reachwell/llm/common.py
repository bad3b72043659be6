"""What several text operators share: Arrow text as bytes, bounded blocks, checkpoints."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel handles at once; bounds a Python worker's memory.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``; where it names none, a temporary one if all runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Rows of a few numbers each that one task reads of a checkpointed table.
TASK_ROWS = 50_000


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, its lineage cut; for rows of a few numbers. Small tables get few partitions.

    The count that this takes is kept for :func:`rows_of`.
    """
    shared_folder(df.sparkSession)
    df = df.checkpoint()
    rows = df.count()
    df = df.coalesce(rows // TASK_ROWS + 1)  # never more than there are
    df.counted = rows
    return df


def numbered(rows: DataFrame, *order: Column, task_rows: int = 1_000_000) -> DataFrame:
    """Rows of a few numbers each with ``place``, their number from 1 in an order without ties; no task orders more than its range.

    ``rows`` is checkpointed. The ranges' counts, a row for some ``task_rows`` rows, are summed and sent to all.
    """
    dealt = rows.repartitionByRange(rows_of(rows) // task_rows + 1, *order).withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)  # ranges are drawn from a sample, so their borders are kept
    counts = dealt.groupBy("part").agg(F.count("*").alias("before"))
    counts = counts.withColumn("before", F.sum("before").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", own.cast("long")).join(F.broadcast(counts), "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def rows_of(df: DataFrame) -> int:
    """The number of rows, counted once for a checkpointed table."""
    return df.counted if hasattr(df, "counted") else df.count()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again; for what is too large to be kept uncompressed."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.path = path
    return read


def removed(df: DataFrame) -> None:
    """Overwrites a ``written`` table by an empty one; whatever came of it must be written or checkpointed by now."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.path)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of tables that nothing refers to any more; it would do so only when the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    if data is None or not n or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, in slices of at most ``most`` bytes of text or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at, n = 0, len(sizes)
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unused(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that none of ``taken`` equals, whatever the case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def digest(column: str) -> list[Column]:
    """Two 64-bit hashes, h and g, that tell contents apart; null has the hashes of nothing."""
    return [F.xxhash64(column).alias("h"), F.xxhash64(F.lit(0x5851F42D4C957F2D), column).alias("g")]

"""What the operators of this subpackage share: scratch tables, Arrow batches and word rules."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word rule of every operator here: bytes.split() cuts at exactly 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one serves a local master; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='attestor-scratch-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder. Rows in them keep their place and value when executors are lost."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tables = spark, set()
        self.path = f"{scratch_root(spark)}/attestor/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.path}/{table}"
        self.tables.add(table)
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        return self.read(table, df.schema)

    def read(self, table: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def drop(self, table: str = "") -> None:
        """Delete one table or all; silent once the session has ended."""
        try:
            sc = self.spark.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}".rstrip("/"))
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM is gone: nothing can be deleted any more
            return


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def bitmap(values: DataFrame, column: str, bits: int) -> bytes:
    """One bit for each value by its low bits; at most bits / 64 rows reach the driver."""
    at = F.shiftright(F.col(column).bitwiseAND(F.lit(bits - 1)), 6).alias("at")
    words = values.groupBy(at).agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63 as int)))").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.tobytes()


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values have their bit in a bitmap's bytes."""
    low = values & np.uint64(8 * len(bits) - 1)
    return bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1 == 1


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def lean(run: Callable) -> Callable:
    """A task's function that hands memory back when it ends: Python workers stay for the next stages, idle ones too."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return whole

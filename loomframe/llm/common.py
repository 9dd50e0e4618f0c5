"""Shared helpers: the shared folder, written intermediate tables and byte-level words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.errors import LoomError

#: Words are maximal runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch while a table is written.
BATCH = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all runs
    on this machine (tests); on a cluster, whose executors would write to their own disks, an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise LoomError("spark.checkpoint.dir is unset", "Name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession):
    """This application's own part of the shared folder, which goes when the application ends."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back. One pass, and the lineage ends there, so a lost
    executor costs no more than the reading tasks. The shuffles it took are deleted when it is written. Python workers get
    small Arrow batches, as both sides hold a batch."""
    spark, settings = df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": BATCH}
    folder = _folder(spark)
    path, before = f"{folder.toString()}/{name}-{uuid.uuid4().hex}", {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def numbered_columns(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1 and so on, so that none clashes with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() made and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files and "/" + spark.sparkContext.applicationId + "/" in files[0]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % modulus


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words_of(text: str | None) -> list[bytes]:
    """As words_of(), with A-Z (and no other letter) lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def chunks(batch: pa.RecordBatch, text_at: int, most_bytes: int = 2_000_000):
    """Slices of an Arrow batch with about most_bytes of text each, one row at least."""
    column = batch.column(text_at)
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, total + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        total, start = int(ends[stop - 1]), stop


def release() -> None:
    """Give freed memory back to the system: allocators of Arrow and C keep it, and Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, with a worker that waits for its next task in as little memory as it can."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64: a counter-based source of pseudorandom bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def mixed_one(x: int) -> int:
    """mixed() of a single number, without the cost of an array."""
    x &= 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


def uniforms(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) of mixed bits."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / 9007199254740992.0)

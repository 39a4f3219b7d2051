"""Helpers of the operators: shared tables, sizes, and text columns as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows of a batch that a task works on at once.
SLICE = 1024


#: Bytes of an Arrow batch that Spark sends to a Python worker.
BATCH_BYTES = 1 << 22


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, and let workers import this package where it is not installed."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in known if p] + [ROOT])


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may go without that setting; it gets a temporary
    folder, which is then its checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: its lineage ends, its rows stay the same."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.pinned_at = path
    return out


def unpin(df: DataFrame) -> None:
    """Delete the table behind a pinned frame; nothing that reads it may run afterwards."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.pinned_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(nbytes: int, each: int, least: int = 8) -> int:
    """Number of parts so that one gets ``each`` bytes."""
    return max(least, math.ceil(nbytes / each))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = SLICE, limit: int = 1 << 20):
    """Batches of at most ``rows`` rows and about ``limit`` bytes each (one row at least)."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).get_total_buffer_size() and _nbytes(batch, start, n) > limit:
                n = (n + 1) // 2
            yield batch.slice(start, n)
            start += n
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _nbytes(batch: pa.RecordBatch, start: int, n: int) -> int:
    return batch.slice(start, n).nbytes


def remainders(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``modulus``; -1 for null."""
    import zlib

    return np.array(
        [-1 if i is None else zlib.crc32(b"%d" % i) % modulus for i in ids.to_pylist()], dtype=np.int64
    )


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()

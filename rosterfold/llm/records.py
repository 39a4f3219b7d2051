"""Token sequences as length-delimited binary records, with an index of offsets beside them.

Format (all numbers little-endian). A data file is ``MAGIC``, one byte with the
bytes of an id (2 or 4), then one frame for each document::

    length    unsigned 64-bit, bytes of the payload
    check     unsigned 32-bit, masked crc32 of the eight length bytes
    payload   1 byte (0: the id is null), doc_id as signed 64-bit, the token ids
    check     unsigned 32-bit, masked crc32 of the payload

A checksum is masked (rotated right by 15 bits, plus a constant) so that a
checksum of data that hold checksums stays useful. The index file of the same
name holds ``INDEX`` entries: offset of the frame, doc_id, 1 if it is not null,
tokens, ids before it in the file. A shuffled reader seeks to an offset and
reads one frame.

Files are written by the tasks, in the order of ``doc_id`` (null first, ties by
text), under a name of the attempt, and then moved to their place; the list of
files that ``write`` returns comes from the attempts that counted, so what a lost
executor left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterfold.llm.common import parts, pin, prepare, shared_dir, slices, text_bytes, texts
from rosterfold.llm.encoding import encoder

MAGIC = b"RSEQ1\n"

#: Added to a rotated checksum.
MASK = 0xA282EAD8

INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("known", "u1"), ("tokens", "<u4"), ("start", "<u8")])

#: Bytes of text that go to one file.
FILE_BYTES = 1 << 23

_LIST = "shard int, file string, n_records bigint, n_ids bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17 & 0xFFFFFFFF)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload_at(data, offset: int) -> bytes:
    """The payload of the frame at ``offset``; raises if a checksum is wrong."""
    size = bytes(data[offset : offset + 8])
    if len(size) < 8 or masked(size) != struct.unpack_from("<I", data, offset + 8)[0]:
        raise ValueError(f"damaged length at byte {offset}")
    (n,) = struct.unpack("<Q", size)
    payload = bytes(data[offset + 12 : offset + 12 + n])
    if len(payload) < n or masked(payload) != struct.unpack_from("<I", data, offset + 12 + n)[0]:
        raise ValueError(f"damaged record at byte {offset}")
    return payload


def record(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    known, doc_id = struct.unpack_from("<Bq", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=9)


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, width: int = 2) -> DataFrame:
    """Encode, append ``end_id``, write; returns the list of files: shard, file, n_records, n_ids.

    ``folder`` is a URI that all executors reach; by default a new one in the
    shared folder. ``width`` 2 is for vocabularies of up to 65,536 ids.
    """
    prepare(docs.sparkSession)
    folder = folder or shared_dir(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = parts(text_bytes(rows), FILE_BYTES)

    def save(batches):
        from pyarrow import fs

        task = TaskContext.get()
        shard, name = task.partitionId(), f"{task.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        own = encoder(vocabulary)
        end = np.array([end_id], f"<u{width}").tobytes()
        index, offset, start = [], len(MAGIC) + 1, 0
        with store.open_output_stream(f"{base}/_{name}.seq") as out:
            out.write(MAGIC + bytes([width]))
            for batch in slices(batches, limit=1 << 21):
                ids = own.batch(texts(batch.column("text")))
                done = []
                for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    found = np.frombuffer(x, "<u4")
                    if width == 2 and len(found) and found.max() > 0xFFFF:
                        raise ValueError("an id has no place in two bytes")
                    head = struct.pack("<Bq", doc_id is not None, doc_id or 0)
                    done.append(frame(head + found.astype(f"<u{width}").tobytes() + end))
                    index.append((offset, doc_id or 0, doc_id is not None, len(found) + 1, start))
                    offset += len(done[-1])
                    start += len(found) + 1
                out.write(b"".join(done))
        if not index:
            store.delete_file(f"{base}/_{name}.seq")
            return
        with store.open_output_stream(f"{base}/_{name}.idx") as out:
            out.write(np.array(index, INDEX).tobytes())
        for kind in ("idx", "seq"):
            store.move(f"{base}/_{name}.{kind}", f"{base}/{name}.{kind}")
        yield pa.record_batch(
            {
                "shard": pa.array([shard], pa.int32()),
                "file": pa.array([f"{folder}/{name}"]),
                "n_records": pa.array([len(index)], pa.int64()),
                "n_ids": pa.array([start], pa.int64()),
            }
        )

    ordered = rows.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "text"
    )
    return pin(ordered.mapInArrow(save, _LIST))


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Every record of the listed files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    names = [r.file for r in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select(
        F.element_at(F.split("file", "/"), -1).alias("name"), F.coalesce(before, F.lit(0)).alias("before")
    )
    data = spark.read.format("binaryFile").load([f"{n}.seq" for n in names]).select(
        F.regexp_extract("path", r"([^/]+)\.seq$", 1).alias("name"), "content"
    )

    def parse(batches):
        for batch in batches:
            for content, name in zip(batch.column("content"), batch.column("name").to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                if bytes(data[: len(MAGIC)]) != MAGIC:
                    raise ValueError("not a file of records")
                width, at, rows = data[len(MAGIC)], len(MAGIC) + 1, []
                before = 0
                while at < len(data):
                    payload = payload_at(data, at)
                    at += len(payload) + 16
                    doc_id, ids = record(payload, width)
                    rows.append((doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                for k in range(0, len(rows), 4096):
                    some = rows[k : k + 4096]
                    yield pa.record_batch(
                        [pa.array([name] * len(some)), *(pa.array(c, pa.int64()) for c in zip(*some, strict=True))],
                        names=["name", "doc_id", "inside", "n_tokens", "ids_crc32"],
                    )

    found = data.mapInArrow(parse, "name string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, "name").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_at(file: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records number ``places`` of one file, through its index."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(f"{path}.idx") as handle:
        index = np.frombuffer(handle.read(), INDEX)
    out = []
    with store.open_input_file(f"{path}.seq") as handle:
        width = handle.read(len(MAGIC) + 1)[-1]
        for k in places:
            row = index[k]
            handle.seek(int(row["offset"]))
            size = int(row["tokens"]) * width + 9 + 16
            out.append(record(payload_at(handle.read(size), 0), width))
    return out

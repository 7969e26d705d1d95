"""Length-delimited binary records of token ids, with an offset index for reads in any order.

A file is a row of frames: payload length (unsigned 64 bits), masked checksum of those eight bytes
(32), payload, masked checksum of the payload (32), all little-endian. A payload is a document id
(signed 64 bits), a byte that is 1 if the id is null, the width of a token id in bytes (2 or 4), and
the ids. The checksum is CRC-32 (as in zlib), turned right by 15 bits, plus a constant modulo 2**32,
so that checksums of data that hold checksums stay useful.

The index is a Parquet table beside the files with a row for each record: the file, its place in the
order of files, the record's place in it, the byte where its frame starts, the frame's length, the
document id, the number of ids, and the ids of the file before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.common import arrow, shared_dir

MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<qBB")
_SUM = struct.Struct("<I")
#: Ids are two bytes wide if the vocabulary allows it.
NARROW = 1 << 16
#: Bytes of a file that a reading task takes at a time.
SPAN = 8 << 20

INDEX = "file string, part int, record long, at long, frame long, doc_id long, n_tokens long, before long"


def masked(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _PAYLOAD.pack(doc_id or 0, doc_id is None, width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, _SUM.pack(masked(size)), payload, _SUM.pack(masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document ids and token ids of the frames in data; ValueError where one is damaged."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise ValueError("a frame is cut short")
        size, check = _HEAD.unpack_from(data, at)
        if masked(view[at : at + 8]) != check:
            raise ValueError("a frame's length is damaged")
        end = at + _HEAD.size + size
        if end + _SUM.size > len(data):
            raise ValueError("a frame is cut short")
        payload = view[at + _HEAD.size : end]
        if masked(payload) != _SUM.unpack_from(data, end)[0]:
            raise ValueError("a frame's payload is damaged")
        doc_id, null, width = _PAYLOAD.unpack_from(payload)
        yield None if null else doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=_PAYLOAD.size).astype("<u4")
        at = end + _SUM.size


def _store(uri: str):
    """The file system of a folder that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the store it is in, as Hadoop sees it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 0) -> str:
    """Encode the texts of docs (doc_id, text) and write them to files in ascending doc_id order, null first, equal ids by text. Returns the folder.

    A task writes one file, under a name of its own attempt, and hands on the index rows of that
    file; Spark commits the rows of one attempt only, so files of lost or doubled attempts are never
    read. Null texts count as empty; an empty table gives an index without rows.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or shared_dir(spark, "records"))
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = bpe.encoder(tokenizer, end_id)
        width = 2 if len(encoder.id_bytes) <= NARROW else 4
        part = TaskContext.get().partitionId()
        store = out = name = None
        at = record = before = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, base = _store(files)
                store.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
                out = store.open_output_stream(f"{base}/{name}")
            rows = []
            for keys, ids, counts in bpe.encoded(encoder, batch):
                ends = np.cumsum(counts).tolist()
                for key, end, n in zip(keys.to_pylist(), ends, counts.tolist(), strict=True):
                    data = frame(key, ids[end - n : end], width)
                    out.write(data)
                    rows.append((name, part, record, at, len(data), key, n, before))
                    at, record, before = at + len(data), record + 1, before + n
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    arrow(ordered, run, INDEX).write.parquet(f"{folder}/index")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the files: doc_id, ids (binary, little-endian unsigned 32 bits), and start, the ids of all records before it."""
    folder = qualified(spark, folder)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    # A file holds consecutive records; the sums below have one row a file.
    sums = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    spans = index.groupBy("file", F.floor(F.col("at") / SPAN).alias("span")).agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("frame")).alias("end"), F.min("before").alias("before"))
    spans = spans.join(bases, "file").select("file", "at", "end", (F.col("base") + F.col("before")).alias("start"))
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            store, base = _store(files)
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    f.seek(row["at"])
                    data = f.read(row["end"] - row["at"])
                start, keys, ids, starts = row["start"], [], [], []
                for key, found in frames(data):
                    keys.append(key)
                    ids.append(found.tobytes())
                    starts.append(start)
                    start += len(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(starts, pa.int64())], names=["doc_id", "ids", "start"])

    # The rows are few and small but stand for much work: a given number of partitions isn't coalesced.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return arrow(spans.repartition(parts, "file", "at"), run, "doc_id long, ids binary, start long")


def pick(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of wanted.doc_id, each read alone by its place in the index, as shuffled reads do: doc_id, ids."""
    folder = qualified(spark, folder)
    rows = spark.read.schema(INDEX).parquet(f"{folder}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("file", "at", "frame")
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = _store(files)
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    f.seek(row["at"])
                    key, ids = next(frames(f.read(row["frame"])))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["doc_id", "ids"])

    return arrow(rows, run, "doc_id long, ids binary")

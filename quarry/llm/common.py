"""What the operators of this subpackage share: folders, text columns and bound expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer() -> str:
    """The tokenizer file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share.

    That is spark.checkpoint.dir. Only where it is unset, as in tests, a temporary folder of this
    machine takes its place for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + (folder := tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write df as a table in the shared folder, in buckets by key, and read it back: what is grouped by
    key or meets other rows by it is not dealt out again."""
    spark = df.sparkSession
    table = f"quarry_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", shared_dir(spark, name)).saveAsTable(table)
    return spark.table(table)


#: Bytes of an Arrow batch at most: whole texts are large, and a batch exists on both sides.
BATCH = 6 << 20
_held: dict[object, object] = {}
_asked: list[object] = []


def held(key: object, make: Callable[[], object]):
    """What a worker keeps from task to task: one thing at a time, the last asked for, till a task asks for nothing."""
    _asked.append(key)
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def tidy() -> None:
    """Give memory that a task has freed back to the system; the worker lives on, beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def send(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, and keep Arrow batches small."""
    sc = spark.sparkContext
    if not getattr(sc, "_quarry_sent", False):
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # executors fetch the archive from the driver as long as the session lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}-src", "zip", package.parent, package.name))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        sc._quarry_sent = True


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with this package sent to the executors once a session and batches kept small."""
    send(df.sparkSession)

    def tidied(batches: Iterator) -> Iterator:
        _asked.clear()
        try:
            for batch in run(batches):
                if not _asked:
                    _held.clear()
                yield batch
        finally:
            tidy()

    return df.mapInArrow(tidied, schema)


#: Bytes of text in a block, but for a longer text, which is one by itself.
BLOCK = 8 << 20
BLOCKS = "block long, size long, ids array<long>, rows binary"


def blocks(docs: DataFrame, name: str) -> DataFrame:
    """A written table of docs (doc_id, text and more) in blocks: a row has the bytes of text, the ids and, as compressed Arrow data, the rows of a block.

    A block goes by the number of its first row. Numbers are given once, as the table is written, and
    read from it ever after. The table is in buckets by block, so what belongs to a block meets it
    without any text being dealt out.
    """
    text = docs.columns.index("text") + 2
    rows = docs.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long").alias("id_"), *[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            own = table.select(range(2, table.num_columns))
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(own)
            block = [table.column(0)[0].as_py()], [size], [table.column(1).to_pylist()], [sink.getvalue().to_pybytes()]
            kinds = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(block, kinds, strict=True)], names=["block", "size", "ids", "rows"])

        for batch in batches:
            sizes = [0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()]
            first = 0
            for i, n in enumerate(sizes):
                if size and size + n > BLOCK:
                    held.append(batch.slice(first, i - first))
                    yield out()
                    held, size, first = [], 0, i
                size += n
            if first < len(sizes):
                held.append(batch.slice(first))
        if held:
            yield out()

    return bucketed(arrow(rows, run, BLOCKS), name, "block")


def block_rows(row) -> object:
    """The rows, an Arrow table, of the one row of blocks that an Arrow table holds."""
    import pyarrow as pa

    return pa.ipc.open_stream(row.column("rows")[0].as_buffer()).read_all()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

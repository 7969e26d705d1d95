"""Vector best-fit packing of token pieces into sequences.

An item asks for (tokens, one document, attention cost: its length squared); a bin has a capacity of
each. What an item asks for depends on its length alone, so packing needs only the number of items of
each length: at most as many numbers as a sequence has tokens, whatever the size of the corpus. The
driver packs these classes, longest first, into groups of bins with equal residuals; each class goes
to the group whose residual fits it best, under every constraint. Items then take places by their
rank in their class. Ranks are counted in lanes of a class, so a length that a third of the items
share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.common import arrow, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A task's share of the items, at least, is split into so many lanes of a class.
LANES = 4


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. weights: of tokens, documents and cost, in choosing a bin.

    choose: "norm" takes the bin whose weighted residual after the item is least, "dot" the one with the
    largest weighted product of item and residual. The default documents and cost are what tokens
    allow anyway.
    """

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.2, 0.2)
    choose: str = "norm"

    def asks(self, length: int) -> tuple[int, int, int]:
        return length, 1, length * length


def encode_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int | None = 0, with_ids: bool = False, chunk: int = bpe.CHUNK) -> DataFrame:
    """Token pieces of the whole texts (null: empty), each at most limit long: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32 bits).

    Only longer documents are cut; then the first piece has what is left over whole pieces. chunk:
    characters encoded at a time; fewer take a worker less memory and more time, with the same result.
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tokenizer, end_id, chunk)
        for batch in batches:
            for keys, ids, counts in bpe.encoded(encoder, batch):
                data = memoryview(ids.tobytes())
                heads = np.where(counts % limit, counts % limit, np.minimum(counts, limit))
                each = np.maximum(-(-counts // limit), 1)
                doc = np.repeat(np.arange(len(counts)), each)
                piece = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                length = np.where(piece == 0, heads[doc], limit)
                start = np.where(piece == 0, 0, heads[doc] + (piece - 1) * limit)
                at = (np.cumsum(counts) - counts)[doc] + start
                cuts = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [keys.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([bytes(x) for x in cuts], pa.binary())] if with_ids else [])], names=names)

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


@dataclass
class _Bins:
    """Bins of equal content: how many, the first one's number, tokens used, and what is left."""

    count: int
    first: int
    used: int
    left: tuple[int, int, int]


def plan(counts: dict[int, int], capacity: Capacity) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, items in each, offset) that place every item, and the number of sequences."""
    if unfit := [n for n in counts if any(a > c for a, c in zip(capacity.asks(n), (capacity.tokens, capacity.documents, capacity.cost), strict=True))]:
        raise ValueError(f"items of lengths {sorted(unfit)[:5]} exceed a sequence")
    whole = (capacity.tokens, capacity.documents, capacity.cost)
    shortest = min(counts, default=0)
    runs: list[tuple[int, int, int, int, int]] = []
    groups: list[_Bins] = []
    opened = 0

    def score(left: tuple[int, int, int], ask: tuple[int, int, int]) -> float:
        w = capacity.weights
        if capacity.choose == "dot":
            return -sum(wi * a / c * r / c for wi, a, r, c in zip(w, ask, left, whole, strict=True))
        return sum(wi * ((r - a) / c) ** 2 for wi, a, r, c in zip(w, ask, left, whole, strict=True))

    def fits(left: tuple[int, int, int], ask: tuple[int, int, int]) -> int:
        return min(r // a for r, a in zip(left, ask, strict=True))

    for length in sorted(counts, reverse=True):
        remaining, rank, ask = counts[length], 0, capacity.asks(length)
        usable = [g for g in groups if fits(g.left, ask)]
        usable.sort(key=lambda g: (-score(g.left, ask), -g.first))  # the best is last
        while remaining:
            if not usable:
                m = fits(whole, ask)
                n = -(-remaining // m)
                usable.append(_Bins(n, opened, 0, whole))
                groups.append(usable[-1])
                opened += n
            g = usable.pop()
            m = fits(g.left, ask) if capacity.choose == "norm" else 1
            # Full bins take m items each; a last one takes what is left; others stay as they are.
            for each in (m, remaining % m):
                n = min(g.count, remaining // each) if each else 0
                if not n:
                    continue
                runs.append((length, rank, g.first, each, g.used))
                rank, remaining = rank + n * each, remaining - n * each
                filled = _Bins(n, g.first, g.used + each * length, tuple(r - each * a for r, a in zip(g.left, ask, strict=True)))
                groups.append(filled)
                if capacity.choose == "dot" and fits(filled.left, ask):
                    usable.append(filled)
                    usable.sort(key=lambda x: (-score(x.left, ask), -x.first))
                g.first, g.count = g.first + n, g.count - n
        groups = [g for g in groups if g.count and fits(g.left, capacity.asks(shortest))]
    return runs, opened


def pack(pieces: DataFrame, capacity: Capacity | None = None, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces, a table with a column length, with sequence_id and offset: the place of each row.

    Rows are ranked by the given columns in lanes of their length; rows that agree in all of them are
    alike to the plan. pieces is read twice and should be a written table. Lengths must be from 1 to
    what a sequence holds.
    """
    capacity = capacity or Capacity()
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length
    runs, _ = plan(counts, capacity)
    share = sum(counts.values()) // (LANES * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    lanes = -(-max(counts.values(), default=1) // share)
    lane = F.pmod(F.xxhash64(*keys), F.lit(lanes)).cast("int")
    rows = pieces.withColumn("lane_", lane)
    upto = Window.partitionBy("length").orderBy("lane_")
    before = rows.groupBy("length", "lane_").agg(F.count("*").alias("n_")).select(F.col("length").alias("b_length"), F.col("lane_").alias("b_lane"), (F.sum("n_").over(upto) - F.col("n_")).alias("before_"))
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy("length", "lane_").orderBy(*keys)) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("b_length")) & (F.col("lane_") == F.col("b_lane"))).withColumn("rank_", F.col("rank_") + F.col("before_"))
    order = sorted(runs)
    table = spark.sparkContext.broadcast(np.array(order, np.int64).reshape(-1, 5))  # bounded by the number of lengths
    big = 1 << 40
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    out = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        firsts = t[:, 0] * big + t[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank_").to_numpy()
            r = t[np.searchsorted(firsts, length * big + rank, side="right") - 1]
            k = rank - r[:, 1]
            places = [pa.array(r[:, 2] + k // r[:, 3], out), pa.array(r[:, 4] + k % r[:, 3] * length, out)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *places], names=[*own, "sequence_id", "offset"])

    schema = ranked.select(*own, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    ranked = ranked.select(*own, "rank_").withColumns({c: F.col(c).cast("long") for c in ("length", "rank_")})
    return arrow(ranked, run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity | None = None, with_ids: bool = False, chunk: int = bpe.CHUNK) -> DataFrame:
    """The pieces of docs (see encode_pieces) with their places. Rows repeated in docs are packed as often; null ids are kept; an empty table gives an empty one."""
    capacity = capacity or Capacity()
    pieces = materialise(encode_pieces(docs, tokenizer, capacity.tokens, with_ids=with_ids, chunk=chunk), "pieces")
    return pack(pieces, capacity, ("doc_id", "piece", "length", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), and the (doc_id, piece, offset, length) of what each holds. packed needs ids. A sequence's rows are bounded by its tokens."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    empty = F.lit(b"").cast("binary")
    return rows.select("sequence_id", F.aggregate("parts", empty, lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("parts"))

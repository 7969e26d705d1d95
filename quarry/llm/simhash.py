"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a fingerprint in the middle, so balls of half the radius
around both meet there. For r = 3 half is one and a half. Balls of radius 2 have 2081 variants; two
steps with balls of radius 1 do the same with about 130:

* Links of up to 2 bits: every distinct fingerprint emits its ball of radius 1. Fingerprints that
  meet at a variant are within 2 bits of each other, so a chain through them is made of links. At most
  65 distinct fingerprints can meet. The components of these links get labels.
* Links of 3 bits: the bits are dealt into blocks. One of the three bits is in some block; without this
  block two bits at most differ, and balls of radius 1 over the other bits meet. Every fingerprint emits
  these, block by block, and what meets is verified on all bits, between labels only: the members of a
  large group of copies share a label and are not compared.

So no link is lost, none is false, and no pairs within a group are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow, materialise
from quarry.llm.components import components

BITS, RADIUS = 64, 3
#: Bytes of a text that are cut into words at a time.
CHUNK = 4 << 20
_BLANK = b" \t\n\x0b\x0c\r"


def _words(text: str) -> Iterator[list[bytes]]:
    data = text.encode().lower()  # of bytes: A-Z only
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in _BLANK:
            end += 1
        yield data[at:end].split()
        at = end


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, repeats included; zero of none."""
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of the shingles of size words, repeats included; zero without words."""
    import xxhash

    digest = xxhash.xxh64_digest
    count, n, rest = np.zeros((8, 256), np.int64), 0, []
    lane = np.arange(8) * 256

    def add(parts: list[bytes]) -> None:
        nonlocal count, n
        if parts:
            hashes = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8)
            count += np.bincount((hashes + lane).ravel(), minlength=2048).reshape(8, 256)
            n += len(hashes)

    for words in _words(text or ""):
        words = rest + words
        if len(words) >= size:
            row = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(sizes) - 1
            firsts = ends + 1 - sizes
            add([digest(row[a:b], 42) for a, b in zip(firsts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)])
            rest = words[len(words) - size + 1 :] if size > 1 else []
        else:
            rest = words
    if not n and rest:
        add([digest(b" ".join(rest), 42)])
    if not n:
        return 0
    bits = 2 * np.einsum("ij,jk->ik", count, _ONES).ravel() > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, key, fp) of the whole texts of docs, key a hash of the text, fp as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    return arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text"), run, "doc_id long, key long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(numbers: list[int]) -> Column:
    """A literal array of the signed forms of numbers."""
    return F.expr("array(" + ",".join("-9223372036854775807L - 1L" if n >> 63 and n == 1 << 63 else f"{_signed(n)}L" for n in numbers) + ")")


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that chain all fingerprints, a column fp of distinct ones, at most 2 bits apart."""
    ball = F.explode(F.transform(_longs([0, *(1 << i for i in range(BITS))]), lambda m: F.col("fp").bitwiseXOR(m))).alias("at")
    w = Window.partitionBy("at").orderBy("fp")
    return fps.select(ball, "fp").select(F.col("fp").alias("a"), F.lag("fp").over(w).alias("b")).filter("b is not null").distinct()


def blocks(n: int) -> list[int]:
    """Masks of the blocks that bits are dealt into, for n fingerprints: as few as keep chance meetings below the emitted rows. Results don't depend on it."""
    parts = 2 if n < 1 << 24 else 3 if n < 1 << 33 else 4
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between labels of rows (at, fp, label), sorted by at, that meet at one place and are at most RADIUS bits apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def meet(fp: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
        """Joins the members of a place; those with the most frequent label are compared with others only."""
        known = np.array([root(x) for x in label.tolist()])
        names, which, sizes = np.unique(known, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        others = np.flatnonzero(which != sizes.argmax())
        step = max(1, (1 << 20) // len(fp))
        for k in range(0, len(others), step):
            part = others[k : k + step]
            near = (np.bitwise_count(fp[part][:, None] ^ fp) <= RADIUS) & (which[part][:, None] != which)
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = root(int(known[part[i]])), root(int(known[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield int(known[part[i]]), int(known[j])

    def found(at: np.ndarray, fp: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(at)) + 1
        firsts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
        several = np.flatnonzero(ends - firsts > 1)
        mixed = [k for k in several.tolist() if (label[firsts[k] : ends[k]] != label[firsts[k]]).any()]
        return [x for k in mixed for x in meet(fp[firsts[k] : ends[k]], label[firsts[k] : ends[k]])]

    def out(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    held: list[list[np.ndarray]] = []  # rows of the last place so far
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(3)]
        columns[1] = columns[1].view(np.uint64)  # bits of signed numbers count by absolute value
        at = columns[0]
        last = int(np.searchsorted(at, at[-1]))  # sorted: the last place's rows start here
        if held and held[0][0][0] == at[-1] and last == 0:
            held.append(columns)
            continue
        rows = [np.concatenate(c) for c in zip(*held, [c[:last] for c in columns], strict=True)] if held else [c[:last] for c in columns]
        if len(rows[0]):
            yield from out(found(*rows))
        held = [[c[last:] for c in columns]]
    if held:
        yield from out(found(*[np.concatenate(c) for c in zip(*held, strict=True)]))


def far_links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between the labels of fingerprints (fp, label) of different labels that chain all of those at most RADIUS bits apart."""

    def ball(base: Column, flips: Column) -> Column:
        return F.transform(flips, lambda m: base.bitwiseXOR(m))

    keys = []
    for i, mask in enumerate(blocks(n)):
        kept = [1 << b for b in range(BITS) if not mask >> b & 1]
        name = (0x9E3779B97F4A7C15 * (i + 1)) & mask  # tells the blocks' places apart; a chance meeting is verified like any
        base = F.col("fp").bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ mask))).bitwiseOR(F.lit(_signed(name)))
        keys.append(ball(base, _longs([0, *kept])))
    emitted = fps.select(F.explode(F.concat(*keys)).alias("at"), "fp", "label")
    return arrow(emitted.repartition("at").sortWithinPartitions("at"), _verify, "a long, b long").distinct()


def _label(fps: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """fps with column replaced by the label that found (node, label) has for it, if any."""
    named = found.select(F.col("node").alias(column), F.col("label").alias("to_"))
    return fps.join(named, column, "left").withColumn(column, F.coalesce("to_", column)).drop("to_")


def classes(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp and more, a written table) with label, which names the class, and component_id: the smallest doc_id that links lead to, itself included; null only if all are null.

    Rows of equal fingerprints are one node, so copies cost one row however many they are.
    """
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    n = distinct.count()
    near = components(near_links(distinct.select("fp")))
    labelled = materialise(_label(distinct.withColumn("label", F.col("fp")), near, "label"), "labelled")
    far = components(far_links(labelled.select("fp", "label"), n))
    whole = _label(labelled, far, "label")
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = materialise(whole.join(least, "label").select("fp", "label", "component_id"), "classes")
    return rows.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, key, fp, label, component_id) for every row of docs; key is a hash of the text. Texts without words have fingerprint zero and are linked like any; an empty table gives an empty one."""
    return classes(materialise(fingerprints(docs, size), "simhash"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row of each class of docs: that with the smallest doc_id, null last, then the smallest hash of the text; of rows that agree in both, the least by all columns."""
    return one_of_each(docs, near_duplicates(docs, size))


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of docs, one row for each label that rows (doc_id, key, label), one for each of docs, have."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = materialise(rows.groupBy("label").agg(F.min(own).alias("own")).select(F.col("own.doc_id").alias("id_"), F.col("own.key").alias("key_")), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("key_"))
    # Written, the ids have a size the planner knows: texts are dealt out only where these are many.
    out = docs.join(kept, same, "left_semi")
    repeated = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left_semi").count() > kept.count()
    if not repeated:
        return out
    # Tasks aggregate their own rows first, so a row repeated very often is one row of each.
    least = out.groupBy(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("key_")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row_"))
    return least.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])

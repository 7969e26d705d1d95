"""One-permutation MinHash fingerprints with optimal densification and b-bit storage.

Every 5-word shingle is hashed once. The top bits of the hash name a bin, and a bin keeps the least
hash in it. An empty bin copies a filled one, found by a sequence of hashes of its own number, so two
sets with the same filled bins copy alike (Shrivastava, 2017). A fingerprint stores the low bits of
every bin (Li and König, 2010); the likeness of two corrects the share of equal bins for those that
agree by chance. Column expressions only.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import let, words_of

#: Bins, a power of two, and bits stored of each.
BINS, BITS = 256, 8
SHINGLE = 5
#: Probes of an empty bin in its first and second round; then the filled bins are gone through.
ROUNDS = (8, 56)


@lru_cache
def _probes(bins: int) -> tuple[str, ...]:
    """By round, the bins that each empty bin tries, as a SQL literal."""
    rng = random.Random(2017)
    return tuple(f"array({','.join('array(' + ','.join(str(rng.randrange(bins)) for _ in range(n)) + ')' for _ in range(bins))})" for n in ROUNDS)


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of size words; of all words where there are fewer; none of none."""
    return let(
        words,
        lambda w: F.transform(
            F.slice(w, 1, F.when(F.size(w) >= size, F.size(w) - (size - 1)).otherwise(F.least(F.size(w), F.lit(1)))),
            lambda _, i: F.xxhash64(F.slice(w, i + 1, size)),
        ),
    )


def _least(hashes: Column, bins: int, bits: int) -> Column:
    """The low bits of the least hash of every bin, null where it is empty."""
    shift = 64 - (bins.bit_length() - 1)
    bin_ = lambda h: (F.shiftright(h, shift) + bins // 2).cast("int")
    low = lambda h: h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    empty = lambda n: F.array_repeat(F.lit(None).cast("int"), n)

    def spread(first: Column) -> Column:
        filled = F.transform(first, lambda h, i: F.concat(empty(bin_(h) - F.coalesce(bin_(F.get(first, i - 1)), F.lit(-1)) - 1), F.array(low(h))))
        return F.concat(F.flatten(filled), empty(F.lit(bins - 1) - F.coalesce(bin_(F.get(first, F.size(first) - 1)), F.lit(-1))))

    firsts = let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_(F.get(s, i - 1)) != bin_(h))))
    return let(firsts, spread)


def _densified(least: Column, bins: int) -> Column:
    def fill(d: Column) -> Column:
        def tried(i: Column, table: str) -> Column:
            return F.get(F.filter(F.transform(F.get(F.expr(table), i), lambda p: F.get(d, p)), lambda v: v.isNotNull()), F.lit(0))

        def gone_through(i: Column) -> Column:
            found = F.filter(F.transform(d, lambda v, j: F.struct(F.xxhash64(i, j).alias("h"), v.alias("v"))), lambda x: x["v"].isNotNull())
            return F.array_min(found)["v"]

        return F.transform(d, lambda v, i: F.coalesce(v, *[tried(i, t) for t in _probes(bins)], gone_through(i)))

    return let(least, lambda d: F.when(F.exists(d, lambda v: v.isNull()), fill(d)).otherwise(d))


def signature(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The fingerprint of a text as an array of bins numbers of as many bits; empty for a text without words, null counting as one."""
    none = F.array().cast("array<int>")
    return let(shingle_hashes(words_of(text)), lambda h: F.when(F.size(h) == 0, none).otherwise(_densified(_least(h, bins, bits), bins)))


def packed(sign: Column, bits: int = BITS) -> Column:
    """The fingerprint as hexadecimal digits, bits / 4 for each bin."""
    digits = bits // 4
    table = F.expr("array(" + ",".join(f"'{v:0{digits}x}'" for v in range(1 << bits)) + ")")
    return F.array_join(F.transform(sign, lambda v: F.get(table, v)), "")


def unpacked(fingerprint: Column, bits: int = BITS) -> Column:
    """The array that packed() had; null counts as the fingerprint of an empty text."""
    digits = bits // 4
    found = F.regexp_extract_all(F.coalesce(fingerprint, F.lit("")), F.lit(f"[0-9a-f]{{{digits}}}"), F.lit(0))
    return F.transform(found, lambda x: F.conv(x, 16, 10).cast("int"))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard index of the shingles behind two signatures, from 0 to 1: 1 for two empty ones, 0 for one."""
    chance = 2.0**-bits
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(bins))
    estimate = F.greatest((equal - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """docs with signature and fingerprint; columns of these names are replaced."""
    return docs.withColumn("signature", signature(F.col("text"), bins, bits)).withColumn("fingerprint", packed(F.col("signature"), bits))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (doc_id, text and more) with next_<c> of the next row in descending doc_id order (null last; equal ids by text), the first following the last.

    Ids are cut into ranges of about equal numbers of rows, one for each shuffle partition; the first
    row of a range goes also to the range before it, so each range knows its successor, and one
    shuffle does. The driver gets two numbers a range. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(cuts))
    literal = lambda xs: F.expr(f"cast(array({','.join('null' if x is None else str(x) for x in xs)}) as array<bigint>)")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))] or [1]
    table, id_ = literal(bounds), F.col("doc_id").cast("long")
    # Binary search: how many bounds are at most the id; none for null.
    range_ = F.aggregate(literal(steps), F.lit(0).cast("long"), lambda at, s: at + F.when(F.get(table, (at + s - 1).cast("int")) <= id_, s).otherwise(F.lit(0)))
    firsts = {r["r"]: r["m"] for r in ids.select(range_.alias("r"), "doc_id").groupBy("r").agg(F.max("doc_id").alias("m")).collect()}
    down = sorted(firsts, reverse=True)
    before = {r: down[i - 1] for i, r in enumerate(down)}  # the last one comes before the first
    first_id = literal([firsts.get(r) for r in range(len(bounds) + 1)])
    goes_to = literal([before.get(r) for r in range(len(bounds) + 1)])
    spot = F.col("r_").cast("int")
    own = F.struct(F.col("r_").alias("r"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(goes_to, spot).alias("r"), F.lit(1).alias("guest"))
    placed = rows.withColumn("r_", range_).withColumn("at_", F.explode(F.when(F.get(first_id, spot).eqNullSafe(id_), F.array(own, guest)).otherwise(F.array(own))))
    placed = placed.withColumns({"r_": F.col("at_.r"), "guest_": F.col("at_.guest")}).drop("at_")
    placed = placed.repartitionById(len(bounds) + 1, F.col("r_").cast("int")) if hasattr(placed, "repartitionById") else placed
    w = Window.partitionBy(F.col("r_").cast("int")).orderBy("guest_", F.col("doc_id").desc_nulls_last(), "text")
    return placed.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("guest_ = 0").drop("r_", "guest_")


def edited(text: Column, following: Column) -> Column:
    """text with its last third of code points replaced by the first as many of the following text."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - third), F.left(following, third))

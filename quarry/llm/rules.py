"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

A sketch is a log-linear histogram (16 steps to each power of two, so a quantile is off by at most
1/16 of its value). Two sketches merge by adding counts, in any order and with the same result, so
the partial sketches of every task add up before the shuffle, and the sketches of a language or of
the whole corpus are sums of those of its sources. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import let, materialise, words_of

#: Rates are whole numbers of 1/10000.
UNIT = 10_000


@dataclass(frozen=True)
class Policy:
    """A group's cutoff of a rate is q + reach * (q' - median): q its given quantile, q' the end of q's bucket.

    A group's cutoff is at most twice that of its language, and a language's twice that of all documents,
    so a source that is junk for the most part does not set its own measure, as long as less than a
    tenth of the corpus, what the quantile leaves, is such junk. min_rows: groups with fewer documents
    use the cutoff of their language, and languages with fewer that of all documents.

    A document fails if a rate is above the cutoff also without its last event. events: by rate, what
    an event adds to the count: one sign, letter or line, and for words of repeated windows two windows.
    A rate that is not named is not used.
    """

    quantile_num: int = 9
    quantile_den: int = 10
    reach: int = 10
    min_rows: int = 200
    events: dict[str, int] = field(default_factory=lambda: {"symbol": 1, "bang": 1, "upper": 1, "dup_line": 1, "repeat": 6})


def repeat_positions(words: Column) -> Column:
    """Zero-based starts, ascending, of the 3-word windows found twice or more.

    Windows are compared by 64-bit hash. Only texts with an equal pair of hashes are sorted.
    """
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda _, i: F.xxhash64(F.slice(words, i + 1, 3)))

    def starts(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda e, k: (F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"]))),
                    lambda e: e["i"],
                )
            ),
        )

    none = F.array().cast("array<int>")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(starts(h)))


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more, the first included."""
    return let(
        repeat_positions(words),
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )


def _count(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """docs with the counts of each text; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumns({"words_": words_of(text), "lines_": lines})
        .withColumns(
            {
                "n_words": F.size("words_").cast("long"),
                "word_chars": _count(text, r"[\x20\x09-\x0D]+"),
                "n_symbols": _count(text, r"[^#*$%&|<>]+"),
                "n_bangs": _count(text, r"[^!?]+"),
                "n_upper": _count(text, r"\P{Lu}+"),
                "n_lines": F.size("lines_").cast("long"),
                "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
                "n_repeat_words": repeat_words(F.col("words_")),
            }
        )
        .drop("words_", "lines_")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates(less: dict[str, int] | None = None) -> dict[str, Column]:
    """The rates by name, in 1/10000, zero where there is nothing to divide by; less: what is taken off the counts."""
    less = less or {}
    of = lambda name, a, b: F.coalesce(F.try_divide(UNIT * F.greatest(F.col(a) - less.get(name, 0), F.lit(0)), F.col(b)), F.lit(0.0)).cast("long")
    return {
        "symbol": of("symbol", "n_symbols", "word_chars"),
        "bang": of("bang", "n_bangs", "word_chars"),
        "upper": of("upper", "n_upper", "word_chars"),
        "dup_line": of("dup_line", "n_dup_lines", "n_lines"),
        "repeat": of("repeat", "n_repeat_words", "n_words"),
    }


def bucket(x: Column) -> Column:
    """The sketch bucket of a whole number from 0."""
    shift = F.length(F.bin(x)) - 5
    return F.when(x < 32, x).otherwise((shift + 1) * 16 + F.call_function("shiftright", x, F.greatest(shift, F.lit(0))) - 16).cast("long")


def lowest(b: Column) -> Column:
    """The least number of a bucket, which stands for it in quantiles."""
    shift = F.greatest((b / 16).cast("int") - 1, F.lit(0))
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", b - shift * 16, shift)).cast("long")


def sketches(rows: DataFrame, names: list[str]) -> DataFrame:
    """Counts by language, source, rate and bucket. Tasks add up their own rows before the shuffle,
    so a source with a third of the rows sends as many rows as any other."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), bucket(F.col(f"r_{n}")).alias("bucket")) for n in names])).alias("s")
    return rows.select("lang", "source", named).select("lang", "source", "s.*").groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """A row for each group of keys: its size, and the cutoff of each rate."""
    by = [*keys, "rate"]
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    # A group has at most a few hundred buckets, whatever its number of documents.
    w = Window.partitionBy(*by).orderBy("bucket")
    at = merged.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*by))})
    q = at.groupBy(*by).agg(
        F.max("total").alias("rows"),
        F.min(F.when(F.col("upto") * policy.quantile_den >= F.col("total") * policy.quantile_num, F.col("bucket"))).alias("b"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), lowest(F.col("bucket")))).alias("median"),
    )
    cut = lowest(F.col("b")) + policy.reach * (lowest(F.col("b") + 1) - F.col("median"))
    names = list(policy.events)
    wide = q.groupBy(*keys) if keys else q.groupBy()
    return wide.agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("rate") == n, cut)).alias(f"c_{n}") for n in names])


def bounded(own: Column, rows: Column, parent: Column, policy: Policy) -> Column:
    """The cutoff of a group of so many rows, by that of the group it is part of."""
    return F.when(rows >= policy.min_rows, F.least(own, 2 * parent)).otherwise(parent).cast("long")


def judge(docs: DataFrame, policy: Policy | None = None, carry_text: bool = True) -> DataFrame:
    """docs with the counts of features(), base_failed and kept.

    Sketches are made of documents that pass the base rules. The features are written to the shared
    folder once, with all columns of docs (without text if not carry_text), and read for the sketches and for the verdicts. Columns of
    docs with the names of added ones are replaced. Null texts count as empty, and so fail; null
    languages and sources form groups of their own; an empty table gives an empty one.
    """
    policy = policy or Policy()
    names = list(policy.events)
    counted = features(docs).withColumn("base_failed", base_failed()).withColumns({f"r_{n}": c for n, c in rates().items() if n in names})
    rows = materialise(counted if carry_text else counted.drop("text"), "rules")
    sketch = materialise(sketches(rows.filter(~F.col("base_failed")), names), "sketch")
    fine = cutoffs(sketch, policy, ["lang", "source"])
    coarse = cutoffs(sketch, policy, ["lang"]).select(F.col("lang").alias("l_"), F.col("rows").alias("lang_rows"), *[F.col(f"c_{n}").alias(f"l_{n}") for n in names])
    whole = cutoffs(sketch, policy, []).first()  # one row
    table = fine.join(coarse, F.col("lang").eqNullSafe(F.col("l_")), "left")
    by_lang = {n: bounded(F.col(f"l_{n}"), F.col("lang_rows"), F.lit(whole[f"c_{n}"]).cast("long"), policy) for n in names}
    table = table.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[bounded(F.col(f"c_{n}"), F.col("rows"), by_lang[n], policy).alias(f"t_{n}") for n in names])
    # Written, the table has a size the planner knows: a small one is broadcast and no text is shuffled, a large one is not.
    table = materialise(table, "cutoffs")
    joined = rows.join(table, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    over, lessened = F.lit(False), rates(policy.events)
    for n in names:
        over = over | F.coalesce(lessened[n] > F.col(f"t_{n}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("g_lang", "g_source", *[f"{p}_{n}" for p in "rt" for n in names])


def filter_documents(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The documents that judge() keeps, with their own columns in their order."""
    used = ("text", "lang", "source")
    rest = [c for c in docs.columns if c not in used]
    judged = judge(docs.select(*used, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("own_")), policy)
    return judged.filter("kept").select(*[F.col(c) if c in used else F.col("own_").getField(c).alias(c) for c in docs.columns])

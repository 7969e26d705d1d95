"""Connected components of a link table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round. links: (a, b) with a > b, distinct.

    large: every node sends its larger neighbours to the least of it and its neighbours. small: every
    node sends itself and its smaller neighbours there. The least is found by an aggregate and joined
    back, so the links of a node with very many need not meet in one task.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        sent = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        sent = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return sent.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b, whole numbers in any order): label is the least node that links lead to.

    Each pair of rounds is written to the shared folder; rounds end when a pair changes nothing.
    Null ends are left out.
    """
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "links")
    state = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == state or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        state = mark
        now = materialise(_stars(_stars(now, True), False), "links")

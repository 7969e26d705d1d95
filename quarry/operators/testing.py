"""Which tests cover which files, and what the tests are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import basename
from quarry.operators.graph import reach

#: From worst to best.
QUALITY = ("no_tests", "assertion_free", "placeholder_smoke", "over_mocked", "snapshot_heavy", "smoke", "adequate", "thorough")


def by_import(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(test, path) of files that tests import."""
    rows = edges.join(tests.select(F.col("path").alias("src")), "src", "left_semi").join(tests.select(F.col("path").alias("dst")), "dst", "left_anti")
    return rows.select(F.col("src").alias("test"), F.col("dst").alias("path")).distinct()


def by_name(files: DataFrame, tests: DataFrame) -> DataFrame:
    """(test, path): test_x.py, x_test.py, x.test.ts and x.spec.ts stand for any x with that ending."""
    base = basename("path")
    bare = F.regexp_replace(F.regexp_replace(base, r"^test_", ""), r"(_test|\.test|\.spec|Tests?)(\.[^.]+)$", "$2")
    named = tests.select(F.col("path").alias("test"), bare.alias("base")).filter(bare != base)
    return named.join(files.select("path", base.alias("base")), "base").select("test", "path").distinct()


def coverage(files: DataFrame, edges: DataFrame, tests: DataFrame, quality: DataFrame) -> DataFrame:
    """(path, kind, quality, test): how each file (path) is covered.

    kind is direct, by import or name; transitive, through files that are; or untested. quality is that of
    the best test if it is adequate or better, or else of the worst, by first path. quality: (path, quality) of tests.
    """
    direct = by_import(edges, tests).unionByName(by_name(files, tests)).distinct()
    rank = F.array_position(F.array(*map(F.lit, QUALITY)), F.col("quality"))
    rows = direct.join(quality.select(F.col("path").alias("test"), "quality"), "test", "left").withColumn("rank", rank)
    agg = rows.groupBy("path").agg(F.max_by("quality", "rank").alias("best"), F.max("rank").alias("top"), F.min_by(F.struct("quality", "test"), F.struct("rank", "test")).alias("worst"))
    good = QUALITY.index("adequate") + 1
    agg = agg.select("path", F.lit("direct").alias("kind"), F.when(F.col("top") >= good, F.col("best")).otherwise(F.col("worst.quality")).alias("quality"), F.when(F.col("top") < good, F.col("worst.test")).alias("test"))
    plain = edges.join(tests.select(F.col("path").alias("dst")), "dst", "left_anti")
    far = reach(plain, agg.select(F.col("path").alias("node"))).select(F.col("node").alias("path"), F.lit(True).alias("far"))
    rows = files.select("path").join(tests.select("path"), "path", "left_anti").join(agg, "path", "left").join(far, "path", "left")
    return rows.select("path", F.coalesce("kind", F.when(F.col("far"), "transitive").otherwise("untested")).alias("kind"), "quality", "test")


def untested_findings(covered: DataFrame, files: DataFrame, importers: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    """(path, kind, tier, weight): findings on files (path, loc, complexity) without direct tests, the largest first; many importers or much complexity make them urgent; the weight is the root of the size, 50 at most."""
    rows = covered.filter("kind <> 'direct'").join(files.filter(F.col("loc") >= least), "path").join(importers, "path", "left")
    urgent = (F.coalesce("importers", F.lit(0)) >= 10) | (F.col("complexity") >= 20)
    return rows.select("path", "kind", F.when(urgent, 2).otherwise(3).alias("tier"), F.least(F.sqrt("loc"), F.lit(50.0)).alias("weight"), "loc").orderBy(F.desc("loc"), "path").limit(most).drop("loc")

"""Findings from what detectors report: ids, tiers, confidence and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "detector", "file", "tier", "confidence", "summary")


def make(rows: DataFrame, detector: str, file: Column, name: Column | None, tier: Column | int, confidence: Column | str, summary: Column) -> DataFrame:
    """Findings of a detector. An id is the detector, the file and, if there is one, a name; a file is without ./ at its start."""
    path = F.regexp_replace(file, r"^(\./)+", "")
    parts = [F.lit(detector), path] + ([F.when(name != "", name)] if name is not None else [])
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.concat_ws("::", *parts).alias("id"), F.lit(detector).alias("detector"), path.alias("file"), lit(tier).alias("tier"), lit(confidence).alias("confidence"), summary.alias("summary"))


def from_smells(rows: DataFrame) -> DataFrame:
    """rows: (smell_id, path, severity, n). Severe ones can be fixed quickly, light ones are less sure."""
    tier = F.when(F.col("severity") == "high", 2).otherwise(3)
    confidence = F.when(F.col("severity") == "low", "low").otherwise("medium")
    return make(rows, "smells", F.col("path"), F.col("smell_id"), tier, confidence, F.concat(F.col("n").cast("string"), F.lit("x "), "smell_id"))


def from_cycles(rows: DataFrame) -> DataFrame:
    """rows: (node, cycle, size), nodes as paths. A finding for each cycle, on its first file; more than three files make it a large one."""
    agg = rows.groupBy("cycle").agg(F.min("node").alias("file"), F.max("size").alias("size"))
    tier = F.when(F.col("size") <= 3, 3).otherwise(4)
    return make(agg, "cycles", F.col("file"), F.col("size").cast("string"), tier, "high", F.concat(F.lit("Import cycle of "), F.col("size").cast("string"), F.lit(" files")))


def from_duplicates(rows: DataFrame) -> DataFrame:
    """rows: (file_a, name_a, loc_a, file_b, name_b, loc_b, similarity). Copies go quickly, near ones are less sure; two bodies under ten lines are none."""
    same = F.col("similarity") >= 1
    kept = rows.filter((F.col("loc_a") >= 10) | (F.col("loc_b") >= 10))
    pair = F.array_sort(F.array(F.concat_ws(":", "file_a", "name_a"), F.concat_ws(":", "file_b", "name_b")))
    return make(kept, "dupes", F.col("file_a"), F.array_join(pair, "|"), F.when(same, 2).otherwise(3), F.when(same, "high").otherwise("low"), F.concat(F.when(same, "Same body: ").otherwise("Near body: "), "name_a", F.lit(", "), "name_b"))


def from_orphans(rows: DataFrame) -> DataFrame:
    """rows: (path, loc)."""
    return make(rows, "orphaned", F.col("path"), None, 3, "medium", F.concat(F.lit("Nothing imports these "), F.col("loc").cast("string"), F.lit(" lines")))


def from_facades(rows: DataFrame) -> DataFrame:
    """rows: (path, importers). Without importers one can surely go."""
    none = F.col("importers") == 0
    return make(rows, "facade", F.col("path"), None, 2, F.when(none, "high").otherwise("medium"), F.concat(F.lit("Only passes on imports, to "), F.col("importers").cast("string"), F.lit(" files")))


def from_unused(rows: DataFrame) -> DataFrame:
    """rows: (path, name, kind): imports can be removed by machine, variables quickly."""
    return make(rows, "unused", F.col("path"), F.col("name"), F.when(F.col("kind") == "import", 1).otherwise(2), "high", F.concat(F.lit("Unused "), "kind", F.lit(": "), "name"))


def from_large(rows: DataFrame) -> DataFrame:
    """rows: (path, loc)."""
    return make(rows, "structural", F.col("path"), None, 3, "medium", F.concat(F.lit("large: "), F.col("loc").cast("string"), F.lit(" lines")))

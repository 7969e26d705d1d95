"""Work queues, clusters and design concerns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import schema


def judging() -> tuple[str, ...]:
    """Detectors whose findings ask for judgment."""
    return tuple(d.name for d in schema.DETECTORS if d.judgment)


def _confidence():
    return F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).otherwise(9)


def queue(findings: DataFrame, limit: int | None = None, scope: str | None = None) -> DataFrame:
    """Open findings to work on, best first, with position: by tier, confidence, larger count, id. With a limit, a top-k; without, positions need all rows in order."""
    rows = findings.filter("status = 'open' and not suppressed")
    if scope:
        rows = rows.filter((F.col("file") == scope) | F.col("file").startswith(scope.rstrip("/") + "/"))
    key = [F.col("tier"), _confidence(), F.desc("detail_count"), F.col("id")]
    top = rows.orderBy(*key).limit(limit) if limit else rows
    return top.withColumn("position", F.row_number().over(Window.orderBy(*key)))


def fallback_tier(findings: DataFrame, wanted: int) -> DataFrame:
    """The tier nearest to the wanted one that has open findings, the lower of two: one row (tier, n), or none."""
    counts = findings.filter("status = 'open' and not suppressed").groupBy("tier").agg(F.count("*").alias("n"))
    return counts.orderBy(F.abs(F.col("tier") - wanted), "tier").limit(1)


def planned(findings: DataFrame, order: DataFrame, skipped: DataFrame) -> DataFrame:
    """Open findings with part: those that order (id, pos) names come first, by pos, then the rest, then the skipped (id)."""
    rows = findings.filter("status = 'open' and not suppressed").join(order, "id", "left").join(skipped.select("id", F.lit(True).alias("skip_")), "id", "left")
    part = F.when(F.col("skip_"), 2).when(F.col("pos").isNotNull(), 0).otherwise(1)
    return rows.withColumn("part", part).withColumn("pos", F.when(part == 0, F.col("pos"))).drop("skip_")


def clusters(findings: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, n, files, tier): groups of open findings of a detector: by smell where they have one, by file for size findings, else by the detector's action."""
    action = F.create_map(*[F.lit(x) for d in schema.DETECTORS for x in (d.name, d.action)])[F.col("detector")]
    base = F.element_at(F.split("file", "/"), -1)
    key = (
        F.when(F.col("detector") == "smells", F.concat_ws("::", F.lit("typed"), "detector", "smell_id"))
        .when(F.col("detector") == "structural", F.concat_ws("::", F.lit("file"), "detector", base))
        .when(action == "auto_fix", F.concat_ws("::", F.lit("auto"), "detector"))
        .otherwise(F.concat_ws("::", F.lit("detector"), "detector"))
    )
    rows = findings.filter("status = 'open' and not suppressed").groupBy(key.alias("cluster"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min("tier").alias("tier")).filter(F.col("n") >= least)


def concerns_by_file(findings: DataFrame) -> DataFrame:
    """(file, n, detectors, kind, fingerprint) of files that need a look: two detectors that ask for judgment, or one among three findings. Detector sets of a file are bounded by the registry."""
    rows = findings.filter("status = 'open' and not suppressed and file <> '.'")
    judged = F.col("detector").isin(*judging())
    agg = rows.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(judged, F.col("detector")))).alias("detectors"), F.max(F.when(F.col("detector") == "structural", F.col("detail_count"))).alias("size"))
    agg = agg.filter((F.size("detectors") >= 2) | ((F.size("detectors") >= 1) & (F.col("n") >= 3)))
    has = lambda x: F.array_contains("detectors", x)
    kind = F.when(F.size("detectors") >= 3, "mixed_responsibilities").when(has("dupes"), "duplication_design").when(has("structural"), "structural_complexity").when(has("coupling"), "coupling_design").otherwise("design_concern")
    names = F.array_join("detectors", ",")
    return agg.select("file", "n", names.alias("detectors"), kind.alias("kind"), F.substring(F.sha2(F.concat_ws("::", kind, "file", names), 256), 1, 16).alias("fingerprint"))


def concerns_across_files(findings: DataFrame, least: int = 3) -> DataFrame:
    """(detectors, files): sets of two or more judging detectors that open findings of three or more files share."""
    rows = findings.filter("status = 'open' and not suppressed and file <> '.'").filter(F.col("detector").isin(*judging()))
    sets = rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"), F.countDistinct("detector").alias("k"))
    return sets.filter("k >= 2").groupBy("detectors").agg(F.count("*").alias("files")).filter(F.col("files") >= least)


def systemic_smells(findings: DataFrame, least: int = 5) -> DataFrame:
    """(smell_id, files, n): smells that are open in five or more files."""
    rows = findings.filter("detector = 'smells' and status = 'open' and not suppressed and file <> '.'")
    return rows.groupBy("smell_id").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n")).filter(F.col("files") >= least)


def false_positive_rates(findings: DataFrame, least: int = 5) -> DataFrame:
    """(detector, zone, total, fp, rate) where five or more findings include a false positive."""
    agg = findings.groupBy("detector", "zone").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "false_positive").alias("fp"))
    return agg.filter((F.col("total") >= least) & (F.col("fp") > 0)).withColumn("rate", F.col("fp") / F.col("total"))


def scope_breakdown(findings: DataFrame, scope: str) -> DataFrame:
    """Open findings in a scope (a folder, or a file; those of the whole project are in every scope) and outside it: one row."""
    inside = F.col("file").startswith(scope.rstrip("/") + "/") | (F.col("file") == scope) | (F.col("file") == ".")
    rows = findings.filter("status = 'open' and not suppressed")
    return rows.agg(F.count_if(inside).alias("in_scope"), F.count_if(~inside).alias("out_of_scope"), F.count("*").alias("total"))

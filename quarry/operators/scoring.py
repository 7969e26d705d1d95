"""Scores of findings: weighted failures by detector, dimensions, health, and what-if changes.

Weights are decimals, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.session import small


def policies(spark: SparkSession) -> DataFrame:
    rows = [(d.name, d.dimension, d.file_based, d.loc_weight, list(d.no_zones)) for d in schema.DETECTORS if d.dimension or d.name in schema.NEVER_SCORED]
    return small(spark, rows, "detector string, dimension string, file_based boolean, use_loc boolean, no_zones array<string>")


def modes(spark: SparkSession) -> DataFrame:
    return small(spark, [(m, s) for m, ss in schema.FAILS.items() for s in ss], "mode string, status string")


def merge_potentials(potentials: DataFrame) -> DataFrame:
    return potentials.groupBy("detector").agg(F.sum("potential").alias("potential"))


def weight(use_loc: Column | bool) -> Column:
    """A finding's weight: its size weight (1 if it has none), or by confidence."""
    by_confidence = F.lit(schema.DEFAULT_CONFIDENCE_WEIGHT)
    for name, w in schema.CONFIDENCE_WEIGHT.items():
        by_confidence = F.when(F.col("confidence") == name, w).otherwise(by_confidence)
    use = F.lit(use_loc) if isinstance(use_loc, bool) else use_loc
    return F.when(use, F.coalesce("loc_weight", F.lit("1.0").cast("decimal(10,1)"))).otherwise(by_confidence.cast("decimal(10,1)")).cast("decimal(10,1)")


def failures(findings: DataFrame) -> DataFrame:
    """Failures that count, by mode: findings in a failing status that are neither suppressed nor in a zone their detector leaves out."""
    spark = findings.sparkSession
    rows = findings.join(F.broadcast(policies(spark)), "detector").filter(~F.coalesce("suppressed", F.lit(False)) & ~F.array_contains("no_zones", F.coalesce("zone", F.lit("production"))))
    return rows.join(F.broadcast(modes(spark)), "status").withColumn("weight", weight(F.col("use_loc")))


def file_cap(n: Column) -> Column:
    cap = F.lit(None).cast("decimal(10,1)")
    for least, value in reversed(schema.FILE_CAPS):
        cap = F.when(n >= least, F.lit(value).cast("decimal(10,1)")).otherwise(cap)
    return cap


def weighted_failures(findings: DataFrame) -> DataFrame:
    """(mode, detector, weighted, issues). Detectors by file count each file up to a cap: by its number of findings, or the first finding's size weight; findings on the whole project weigh ten times and are not capped."""
    rows = failures(findings)
    whole = F.coalesce(F.col("holistic") & (F.col("file") == "."), F.lit(False))
    by_file = F.col("file_based") & ~whole
    # One pass: files of detectors that count by file are units of their own, all else is one unit of its detector.
    rows = rows.withColumns({"whole": F.col("file_based") & whole, "unit": F.when(by_file, F.col("file"))})
    units = rows.groupBy("mode", "detector", "file_based", "use_loc", "whole", "unit").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min_by("weight", "id").alias("first"))
    d = "decimal(20,1)"
    capped = F.least("w", F.when(F.col("use_loc"), F.col("first")).otherwise(file_cap(F.col("n"))))
    counted = F.when(F.col("whole"), F.col("w") * schema.HOLISTIC_MULTIPLIER).when(F.col("file_based"), capped).otherwise(F.col("w")).cast(d)
    return units.groupBy("mode", "detector").agg(F.sum(counted).cast(d).alias("weighted"), F.sum("n").alias("issues"))


def detector_stats(findings: DataFrame, potentials: DataFrame) -> DataFrame:
    """(mode, detector, potential, weighted, issues, pass_rate) of every detector and mode; a detector without potential, or that is never scored, passes."""
    spark = findings.sparkSession
    every = merge_potentials(potentials).crossJoin(F.broadcast(modes(spark).select("mode").distinct()))  # three modes
    rows = every.join(weighted_failures(findings), ["mode", "detector"], "left")
    skip = (F.col("potential") <= 0) | F.col("detector").isin(*schema.NEVER_SCORED)
    weighted = F.when(skip, F.lit(0)).otherwise(F.coalesce("weighted", F.lit(0))).cast("decimal(20,1)")
    issues = F.when(skip, F.lit(0)).otherwise(F.coalesce("issues", F.lit(0)))
    rows = rows.withColumns({"weighted": weighted, "issues": issues})
    return rows.withColumn("pass_rate", F.when(skip, 1.0).otherwise(F.greatest((F.col("potential") - F.col("weighted")).cast("double") / F.col("potential"), F.lit(0.0))))


def dimension_scores(stats: DataFrame) -> DataFrame:
    """(mode, dimension, checks, weighted, issues, score): of detectors with potential, 100 times the share that passes, in decimals with one digit."""
    rows = stats.filter("potential > 0").join(F.broadcast(policies(stats.sparkSession)), "detector").filter("dimension is not null")
    agg = rows.groupBy("mode", "dimension").agg(F.sum("potential").alias("checks"), F.sum("weighted").alias("weighted"), F.sum("issues").alias("issues"))
    passed = F.greatest(F.col("checks") - F.col("weighted"), F.lit(0).cast("decimal(20,1)")).cast("double") / F.col("checks")
    return agg.withColumn("score", F.round(100 * passed, 1))


def health(dimensions: DataFrame, assessments: DataFrame | None = None) -> DataFrame:
    """(mode, mechanical, subjective, overall). Mechanical dimensions count by weight, less below a number of checks; assessments (mode, dimension, score, weight) are the other pool. One digit."""
    w = F.lit(1.0)
    for name, value in schema.DIMENSION_WEIGHT.items():
        w = F.when(F.col("dimension") == name, float(value)).otherwise(w)
    effective = w * F.least(F.col("checks") / schema.MIN_SAMPLE, F.lit(1.0))
    rows = dimensions.withColumn("w", effective)
    mechanical = rows.groupBy("mode").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("mechanical"))
    if assessments is None:
        return mechanical.select("mode", F.round("mechanical", 1).alias("mechanical"), F.lit(None).cast("double").alias("subjective"), F.round("mechanical", 1).alias("overall"))
    subjective = assessments.groupBy("mode").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("subjective"))
    both = mechanical.join(subjective, "mode", "full")
    overall = F.col("mechanical") * float(schema.MECHANICAL_SHARE) + F.col("subjective") * float(schema.SUBJECTIVE_SHARE)
    return both.select("mode", F.round("mechanical", 1).alias("mechanical"), F.round("subjective", 1).alias("subjective"), F.round(F.coalesce(overall, "mechanical", "subjective"), 1).alias("overall"))


def impact(stats: DataFrame) -> DataFrame:
    """(detector, issues, gain): how much the lenient score of a detector's dimension rises when its issues go."""
    rows = stats.filter("mode = 'lenient' and potential > 0").join(F.broadcast(policies(stats.sparkSession)), "detector").filter("dimension is not null")
    total = rows.groupBy("dimension").agg(F.sum("potential").alias("checks"), F.sum("weighted").alias("all_weighted"))
    score = lambda w: F.greatest((F.col("checks") - w).cast("double") / F.col("checks"), F.lit(0.0))
    gain = score(F.col("all_weighted") - F.col("weighted")) - score(F.col("all_weighted"))
    return rows.join(total, "dimension").select("detector", "dimension", "issues", F.round(100 * gain, 2).alias("gain"))


def integrity(assessments: DataFrame, target: float, tolerance: float = 0.05) -> DataFrame:
    """Assessments (dimension, score) with matched and status: two or more within the tolerance of a target are reset to 0 and penalised, one is a warning."""
    near = F.abs(F.col("score") - target) <= tolerance
    n = assessments.filter(near).count()
    status = F.when(~near, "ok").when(F.lit(n >= 2), "penalized").otherwise("warn")
    return assessments.withColumn("status", status).withColumn("score", F.when(F.col("status") == "penalized", 0.0).otherwise(F.col("score")))


def batch_scores(batches: DataFrame) -> DataFrame:
    """(dimension, n, score): merged assessments of review batches.

    batches: (dimension, score, weight, pressure, findings). The weighted mean counts 0.7 and the least
    0.3, less 2.2 a unit of pressure and 0.8 a further finding up to 24; with findings, the score is at
    most 90 less 3.5 and 0.8, and that cap not below 60.
    """
    agg = batches.groupBy("dimension").agg(
        F.count("*").alias("n"), F.sum(F.col("score") * F.col("weight")).alias("sw"), F.sum("weight").alias("w"), F.min("score").alias("low"), F.sum("pressure").alias("pressure"), F.sum("findings").alias("findings")
    )
    extra = F.greatest(F.col("findings") - 1, F.lit(0))
    base = F.col("sw") / F.col("w") * 0.7 + F.col("low") * 0.3 - F.least(F.lit(24.0), 2.2 * F.col("pressure") + 0.8 * extra)
    cap = F.greatest(F.lit(60.0), 90.0 - (3.5 * F.col("pressure") + 0.8 * extra))
    score = F.when(F.col("findings") > 0, F.least(base, cap)).otherwise(base)
    return agg.select("dimension", "n", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("score"))


def status_tiers(findings: DataFrame) -> DataFrame:
    """Counts by tier and status, of each tier, and of all, in one pass; null stands for all."""
    return findings.filter("not suppressed").rollup("tier", "status").agg(F.count("*").alias("n"))


def debt(stats: DataFrame) -> DataFrame:
    """(detector, gap): how far the strict pass rate stays behind the lenient one, in percent, where it does."""
    rates = stats.groupBy("detector").pivot("mode", ["lenient", "strict"]).agg(F.max("pass_rate"))
    return rates.select("detector", F.round(100 * (F.col("lenient") - F.col("strict")), 2).alias("gap")).filter("gap > 0")

"""Dimensions of judgment, how far scores can be trusted, and when to review a whole project again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import age_days, area
from quarry.session import small

# Weights of dimensions of judgment.
WEIGHTS = {
    "high elegance": 22,
    "mid elegance": 22,
    "low elegance": 12,
    "contracts": 12,
    "type safety": 12,
    "abstraction fit": 8,
    "logic clarity": 6,
    "structure nav": 5,
    "error consistency": 3,
    "naming quality": 2,
    "ai generated debt": 1,
    "design coherence": 10,
}
CHECKS = 10


def key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[\s_-]+", "_"), F.lit("_"))


def subjective(assessments: DataFrame, findings: DataFrame, defaults: tuple[str, ...] = ()) -> DataFrame:
    """(dimension, score, checks, issues, placeholder) of assessments (dimension, score, placeholder, penalised), with defaults that nobody assessed at 0.

    Scores are kept between 0 and 100; placeholders and penalised ones count 0. issues are the open
    review findings (dimension) of each.
    """
    given = assessments.select(key(F.col("dimension")).alias("dimension"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("score", F.lit(0.0)))).alias("score"), F.coalesce("placeholder", F.lit(False)).alias("placeholder"), F.coalesce("penalised", F.lit(False)).alias("penalised"))
    spark = assessments.sparkSession
    every = small(spark, [(d,) for d in defaults], "dimension string").select(key(F.col("dimension")).alias("dimension"))
    rows = given.join(every, "dimension", "full")
    open_ = findings.filter("detector = 'review' and status = 'open'").groupBy(key(F.col("dimension")).alias("dimension")).agg(F.count("*").alias("issues"))
    rows = rows.join(open_, "dimension", "left")
    nothing = F.col("score").isNull() | F.col("placeholder") | F.col("penalised")
    return rows.select("dimension", F.when(nothing, 0.0).otherwise(F.col("score")).alias("score"), F.lit(CHECKS).alias("checks"), F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("placeholder", F.lit(True)).alias("placeholder"))


def confidence(coverage: DataFrame, policies: DataFrame) -> DataFrame:
    """(dimension, confidence, detectors): dimensions with detectors that ran with less than full coverage (detector, status, confidence), at the least of theirs."""
    reduced = coverage.filter("status = 'reduced' or confidence < 1")
    rows = reduced.join(F.broadcast(policies.select("detector", "dimension")), "detector").filter("dimension is not null")
    return rows.groupBy("dimension").agg(F.round(F.min("confidence"), 2).alias("confidence"), F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"))


def carried(now: DataFrame, before: DataFrame) -> DataFrame:
    """Dimension scores of a scan with those of the scan before that it did not look at, marked carried."""
    old = before.join(now.select("mode", "dimension"), ["mode", "dimension"], "left_anti").withColumn("carried", F.lit(True))
    return now.withColumn("carried", F.lit(False)).unionByName(old, allowMissingColumns=True)


def review_due(reviews: DataFrame, files: int, now: Column, days: int = 30, drift: float = 0.2) -> DataFrame:
    """(reason), one row or none, from the reviews (reviewed_at, files) of a whole project: no review yet, too long ago, or the number of files changed by a fifth. Without files nothing is due; 0 days: once is enough."""
    if files <= 0:
        return reviews.select(F.lit("").alias("reason")).limit(0)
    last = reviews.agg(F.max(F.struct("reviewed_at", "files")).alias("r")).select("r.*")
    reason = F.when(F.col("reviewed_at").isNull(), "unreviewed")
    if days:
        reason = reason.when(age_days(F.col("reviewed_at"), now) > days, "stale").when(F.abs(F.lit(files) - F.col("files")) > drift * F.col("files"), "drifted")
    return last.select(reason.alias("reason")).filter("reason is not null")


def issue_history(reviews: DataFrame, most: int = 30) -> DataFrame:
    """(dimension, status, n, recent): review findings (id, dimension, status, last_seen) by dimension and status, and how many of them are among the latest."""
    latest = reviews.orderBy(F.desc("last_seen"), "id").limit(most).select("id", F.lit(1).alias("recent"))
    return reviews.join(latest, "id", "left").groupBy("dimension", "status").agg(F.count("*").alias("n"), F.sum(F.coalesce("recent", F.lit(0))).alias("recent"))


def hubs(files: DataFrame, edges: DataFrame, least: int = 5, most: int = 10) -> DataFrame:
    """(path, importers, loc): the files that most others import."""
    count = edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("importers")).filter(F.col("importers") >= least)
    return count.join(files.select("path", "loc"), "path").orderBy(F.desc("importers"), "path").limit(most)


def coupling_matrix(edges: DataFrame, each: int = 10, most: int = 20) -> DataFrame:
    """(src_area, dst_area, links): links between areas; of each source the strongest ten count, and of these the strongest twenty are shown."""
    rows = edges.select(area("src").alias("src_area"), area("dst").alias("dst_area")).filter("src_area <> dst_area").groupBy("src_area", "dst_area").agg(F.count("*").alias("links"))
    own = rows.withColumn("r", F.row_number().over(Window.partitionBy("src_area").orderBy(F.desc("links"), "dst_area"))).filter(F.col("r") <= each).drop("r")
    return own.orderBy(F.desc("links"), "src_area", "dst_area").limit(most)


def auth_coverage(files: DataFrame, route: str = r"(?m)^\s*(?:@\w*\.?(?:route|get|post|put|patch|delete)\b|(?:app|router)\.(?:get|post|put|patch|delete)\()", guard: str = r"(?i)\b(?:login_required|requires_auth|authenticate|authorize|current_user|verifyToken|getUser)\b") -> DataFrame:
    """(path, routes, guarded): files with routes; a route is guarded if the text up to the next one has a guard."""
    parts = F.split("content", route)
    rows = files.select("path", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("s")).filter(F.size("s") > 0)
    return rows.select("path", F.size("s").alias("routes"), F.size(F.filter("s", lambda x: x.rlike(guard))).alias("guarded"))

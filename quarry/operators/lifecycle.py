"""What people decide about findings, and what plans and reviews make of it: resolutions, skips, reconciliation, staleness and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import age_days, glob_regex
from quarry.session import small


def selects(pattern: str) -> Column:
    """Whether a pattern names a finding: its id, a glob of it, the beginning of it (if it has ::), its end (eight hexadecimal digits or more), its detector, file or folder."""
    if "*" in pattern:
        return F.col("id").rlike(glob_regex(pattern)) | F.col("file").rlike(glob_regex(pattern))
    out = (F.col("id") == pattern) | (F.col("detector") == pattern) | (F.col("file") == pattern) | F.col("file").startswith(pattern.rstrip("/") + "/")
    if "::" in pattern:
        out = out | F.col("id").startswith(pattern)
    if len(pattern) >= 8 and all(c in "0123456789abcdef" for c in pattern):
        out = out | F.col("id").endswith("::" + pattern)
    return out


def resolve(findings: DataFrame, pattern: str, status: str, note: str | None = None) -> DataFrame:
    """Findings after open ones that the pattern names got a status; opening goes for any other status, and counts as a reopening."""
    hit = selects(pattern) & (F.col("status") != "open" if status == "open" else F.col("status") == "open")
    return findings.withColumns({"reopen_count": F.col("reopen_count") + (hit & F.lit(status == "open")).cast("int"), "note": F.when(hit, F.lit(note)), "status": F.when(hit, status).otherwise(F.col("status"))})


def unsuppress(findings: DataFrame, pattern: str) -> DataFrame:
    """Findings with the suppression of those that a pattern names taken back."""
    return findings.withColumn("suppressed", F.col("suppressed") & ~selects(pattern))


def stale_wontfix(state: DataFrame, current: DataFrame, scans: int = 20, complexity: int = 10, loc: int = 50) -> DataFrame:
    """(id, drift, tier, confidence) of accepted findings to look at again: kept for many scans, or grown since. state: (id, status, age, complexity, loc), current: (id, complexity, loc)."""
    now = current.select("id", F.col("complexity").alias("c"), F.col("loc").alias("l"))
    rows = state.filter("status = 'wontfix'").join(now, "id")
    drift = (F.col("c") - F.col("complexity") >= complexity) | (F.col("l") - F.col("loc") >= loc)
    rows = rows.withColumn("drift", F.coalesce(drift, F.lit(False))).filter(F.col("drift") | (F.col("age") >= scans))
    return rows.select("id", "drift", F.when(F.col("drift"), 4).otherwise(3).alias("tier"), F.when(F.col("drift"), "high").otherwise("medium").alias("confidence"))


def unmentioned(excluded: DataFrame, files: DataFrame) -> DataFrame:
    """Excluded folders (folder) that no file's text mentions as a word."""
    words = files.select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\w.-]+"), F.lit(0)))).alias("folder"))
    return excluded.join(words.distinct(), "folder", "left_anti")


def resurfaced(skips: DataFrame, scan_count: int) -> DataFrame:
    """Skips (id, kind, skipped_at_scan, review_after) of the temporary kind whose time is over."""
    return skips.filter((F.col("kind") == "temporary") & (F.col("review_after") > 0) & (F.col("skipped_at_scan") + F.col("review_after") <= scan_count))


def reconcile(planned: DataFrame, findings: DataFrame, most: int = 5) -> DataFrame:
    """(id, candidates): planned ids that are no longer open, with up to five open findings of the same detector and file, by id."""
    alive = findings.filter("status = 'open'").select("id")
    dead = planned.select("id").distinct().join(alive, "id", "left_anti").join(findings.select("id", "detector", "file"), "id", "left")
    other = findings.filter("status = 'open'").select(F.col("id").alias("other"), F.col("detector").alias("d"), F.col("file").alias("f"))
    near = dead.join(other, (F.col("detector") == F.col("d")) & (F.col("file") == F.col("f")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("other"))).filter(F.col("r") <= most)
    found = near.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("candidates"))
    return dead.select("id").join(found, "id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def expire(findings: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Findings with open holistic reviews older than so many days resolved."""
    old = (F.col("detector") == "review") & F.col("holistic") & (F.col("status") == "open") & (age_days(F.col("last_seen"), now) > days)
    return findings.withColumn("status", F.when(old, "auto_resolved").otherwise(F.col("status")))


def review_order(files: DataFrame, importers: DataFrame, findings: DataFrame, low_value: str = r"(?:^|/)(?:types|constants|enums|index)\.[a-z]+$|\.d\.ts$", least: int = 20) -> DataFrame:
    """(path, priority) of files (path, loc): by files that import them, open findings, accepted smells and size findings, complexity and size; files of little to review count a third, small ones not at all."""
    agg = findings.groupBy(F.col("file").alias("path")).agg(
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if((F.col("status") == "wontfix") & F.col("detector").isin("structural", "smells")).alias("accepted"),
        F.max(F.when(F.col("detector") == "structural", F.col("detail_count"))).alias("complexity"),
    )
    rows = files.filter(F.col("loc") >= least).join(importers.select("path", "importers"), "path", "left").join(agg, "path", "left").na.fill(0, ["importers", "open", "accepted", "complexity"])
    low = F.col("path").rlike(low_value)
    score = F.col("importers") * F.when(low, 2).otherwise(10) + F.col("open") * 5 + F.col("accepted") * 15 + F.when(F.col("complexity") > 100, 20).otherwise(0) + F.floor(F.col("loc") / 50)
    return rows.select("path", F.when(low, F.floor(score / 3)).otherwise(score).cast("long").alias("priority"))


def store_assessments(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(dimension, score, source): assessments after an import; holistic ones replace any, others never a holistic one; scores from 0 to 100."""
    i = incoming.select("dimension", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score"))).alias("n_score"), F.col("source").alias("n_source"))
    rows = stored.join(i, "dimension", "full")
    new = F.col("n_source").isNotNull() & (F.col("source").isNull() | (F.col("n_source") == "holistic") | (F.col("source") != "holistic"))
    return rows.select("dimension", F.when(new, F.col("n_score")).otherwise(F.col("score")).alias("score"), F.when(new, F.col("n_source")).otherwise(F.col("source")).alias("source"))


# Dimensions of judgment that open findings of a detector make stale.
STALE = {
    "structural": ("design_coherence", "abstraction_fitness"),
    "smells": ("design_coherence", "error_consistency"),
    "global_mutable_config": ("initialization_coupling",),
    "coupling": ("cross_module_architecture",),
    "layer_violation": ("cross_module_architecture",),
    "private_imports": ("cross_module_architecture",),
    "dupes": ("convention_outlier",),
    "boilerplate_duplication": ("convention_outlier",),
    "naming": ("convention_outlier",),
    "flat_dirs": ("package_organization",),
    "orphaned": ("design_coherence",),
    "uncalled_functions": ("design_coherence",),
    "responsibility_cohesion": ("design_coherence", "abstraction_fitness"),
    "cycles": ("cross_module_architecture", "dependency_health"),
}


def stale_dimensions(changed: DataFrame) -> DataFrame:
    """(dimension, detectors): dimensions to judge again, by the detectors whose findings (detector) changed."""
    table = small(changed.sparkSession, [(d, x) for d, xs in STALE.items() for x in xs], "detector string, dimension string")
    rows = changed.select("detector").distinct().join(F.broadcast(table), "detector")
    return rows.groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"))


def single_use_actionable(rows: DataFrame) -> DataFrame:
    """Files (path, loc, importer) imported once that are worth a finding: neither of middling size nor in the importer's area."""
    part = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, 2), "/")
    return rows.filter(~F.col("loc").between(50, 200) & (part("path") != part("importer")))


def structural_findings(signals: DataFrame, least: int = 3, low: int = 35) -> DataFrame:
    """(path, tier, confidence, summary) of files by their signals (path, signal, score): three make a larger finding; complexity alone, below a score, none."""
    agg = signals.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("signal")), " / ").alias("summary"), F.count("*").alias("n"), F.max(F.when(F.col("signal") == "complexity", F.col("score"))).alias("c"))
    agg = agg.filter(~((F.col("n") == 1) & (F.coalesce("c", F.lit(low)) < low)))
    big = F.col("n") >= least
    return agg.select("path", F.when(big, 4).otherwise(3).alias("tier"), F.when(big, "high").otherwise("medium").alias("confidence"), "summary")


def boilerplate(pairs: DataFrame) -> DataFrame:
    """(cluster, files, first_file): fragments of pairs (fragment, file_a, start_a, file_b, start_b) in several files, by hash of their beginning; of a file, the first start counts."""
    key = F.substring(F.sha1(F.substring(F.trim("fragment"), 1, 200)), 1, 16)
    rows = pairs.filter("file_a <> file_b").select(key.alias("cluster"), F.explode(F.array(F.struct(F.col("file_a").alias("file"), F.col("start_a").alias("start")), F.struct(F.col("file_b").alias("file"), F.col("start_b").alias("start")))).alias("x"))
    agg = rows.groupBy("cluster", "x.file").agg(F.min("x.start").alias("start")).groupBy("cluster").agg(F.count("*").alias("files"), F.min("file").alias("first_file"))
    return agg.filter("files >= 2")


def batch_identity(issues: DataFrame) -> DataFrame:
    """Review issues (dimension, identifier, summary, file) put together: by dimension and identifier, or the first eight words of three letters; the longest summary, then the first by spelling, stands for them."""
    words = F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter(F.split(F.lower("summary"), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3))), 1, 8), " ")
    key = F.concat_ws("::", "dimension", F.coalesce(F.when(F.col("identifier") != "", F.col("identifier")), words))
    best = F.max_by("summary", F.struct(F.length("summary"), F.col("summary")))
    return issues.groupBy(key.alias("key")).agg(F.count("*").alias("n"), best.alias("summary"), F.countDistinct("file").alias("files"))

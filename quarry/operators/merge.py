"""The life of findings from scan to scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import glob_regex

SUSPECT_LEAST = 3
GONE = ("open", "wontfix", "fixed", "false_positive")


def ignored(patterns: list[str]) -> Column:
    """The first of the patterns that a finding matches, or null: a glob of the id if it has ::, of the file otherwise; the beginning of an id; a file."""
    found = F.lit(None).cast("string")
    for p in reversed(patterns):
        if "*" in p:
            hit = F.col("id" if "::" in p else "file").rlike(glob_regex(p))
        elif "::" in p:
            hit = F.col("id").startswith(p)
        else:
            hit = F.col("file") == p
        found = F.when(hit, p).otherwise(found)
    return found


def suspect_detectors(state: DataFrame, current: DataFrame, ran: list[str] | None = None, force: bool = False) -> DataFrame:
    """(detector, previous): detectors with open findings before and none now whose silence is not to be believed. If it is known which ran, the others; else those with three or more before; review always; none with force."""
    before = state.filter("status = 'open'").groupBy("detector").agg(F.count("*").alias("previous"))
    silent = before.join(current.select("detector").distinct(), "detector", "left_anti")
    if force:
        return silent.limit(0)
    doubt = ~F.col("detector").isin(*ran) if ran is not None else F.col("previous") >= SUSPECT_LEAST
    return silent.filter(doubt | (F.col("detector") == "review"))


def merge(state: DataFrame, current: DataFrame, *, lang: str | None = None, scope: str | None = None, patterns: list[str] | None = None, ran: list[str] | None = None, force: bool = False) -> DataFrame:
    """The findings after a scan, with change: new, reopened, refreshed, suppressed, auto_resolved, kept, or why a missing one was left alone (other_language, out_of_scope, suspect).

    A finding seen again takes tier, confidence and zone of the scan; if it was fixed or resolved it opens
    again, while wontfix and false positives stay. One that matches an ignore pattern is suppressed and
    otherwise left. One that is missing resolves itself, unless its language was not scanned, it is
    outside the scope, or its detector is suspect. One full join by id; suspects are few and broadcast
    by size.
    """
    names = ["detector", "file", "tier", "confidence", "zone", "lang", "first_seen"]
    s = state.select(F.col("id"), *[F.col(c).alias(f"s_{c}") for c in (*names, "status", "suppressed", "reopen_count")], F.lit(True).alias("was"))
    c = current.select(F.col("id"), *[F.col(x).alias(f"c_{x}") for x in names], F.lit(True).alias("now"))
    rows = s.join(c, "id", "full")
    suspects = suspect_detectors(state, current, ran, force).select(F.col("detector").alias("s_detector"), F.lit(True).alias("suspect"))
    rows = rows.join(suspects, "s_detector", "left")
    both = {x: F.coalesce(f"c_{x}", f"s_{x}") for x in names}
    rows = rows.withColumns({x: both[x] for x in ("detector", "file")})
    match = ignored(patterns or []).isNotNull()
    was, now = F.col("was").isNotNull(), F.col("now").isNotNull()
    in_scope = F.lit(True) if scope is None else F.col("file").startswith(scope)
    same_lang = F.lit(True) if lang is None else F.coalesce(F.col("s_lang") == lang, F.lit(True))
    change = (
        F.when(now & match, "suppressed")
        .when(now & ~was, "new")
        .when(now & F.col("s_status").isin("fixed", "auto_resolved"), "reopened")
        .when(now, "refreshed")
        .when(~F.col("s_status").isin(*GONE), "kept")
        .when(~same_lang, "other_language")
        .when(~in_scope, "out_of_scope")
        .when(F.coalesce("suspect", F.lit(False)), "suspect")
        .otherwise("auto_resolved")
    )
    rows = rows.withColumn("change", change)
    changed = F.col("change")
    return rows.select(
        "id",
        "detector",
        "file",
        *[both[x].alias(x) for x in ("tier", "confidence", "zone", "lang")],
        F.coalesce("s_first_seen", "c_first_seen").alias("first_seen"),
        F.when(changed.isin("new", "reopened"), "open").when(changed == "auto_resolved", "auto_resolved").otherwise(F.coalesce("s_status", F.lit("open"))).alias("status"),
        (F.coalesce("s_reopen_count", F.lit(0)) + (changed == "reopened").cast("int")).alias("reopen_count"),
        F.when(now, changed == "suppressed").otherwise(F.coalesce("s_suppressed", F.lit(False))).alias("suppressed"),
        "change",
    )


def chronic(findings: DataFrame) -> DataFrame:
    """Open findings that were reopened twice or more."""
    return findings.filter("reopen_count >= 2 and status = 'open'")


def noise_budget(findings: DataFrame, each: int, total: int = 0) -> DataFrame:
    """Findings with rank in their detector, and surfaced: the first of each detector by tier, confidence and id, then one of each detector in turn up to the total (0: no limit), detectors in the order of their best."""
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).otherwise(9)
    key = [F.col("tier"), order, F.col("id")]
    ranked = findings.withColumn("rank", F.row_number().over(Window.partitionBy("detector").orderBy(*key)))
    capped = ranked.filter(F.col("rank") <= each) if each > 0 else ranked
    if not total:
        return capped.withColumn("surfaced", F.lit(True))
    best = capped.filter("rank = 1").select("detector", F.struct("tier", order.alias("o"), "id", "detector").alias("b"))
    turns = best.select("detector", F.row_number().over(Window.orderBy("b")).alias("turn"))  # a row for each detector
    queue = capped.filter(F.col("rank") <= total).join(F.broadcast(turns), "detector").select("id", "rank", "turn").orderBy("rank", "turn").limit(total)
    return capped.join(queue.select("id", F.lit(True).alias("surfaced")), "id", "left").withColumn("surfaced", F.coalesce("surfaced", F.lit(False)))


def suppression(history: DataFrame, last: int = 5) -> DataFrame:
    """Scans (day, raw_findings, ignored) with the share ignored, in percent, and that of the last scans up to each."""
    w = Window.orderBy("day").rowsBetween(1 - last, 0)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 1)
    return history.select("day", share(F.col("ignored"), F.col("raw_findings")).alias("pct"), share(F.sum("ignored").over(w), F.sum("raw_findings").over(w)).alias("recent_pct"))


def phases(history: DataFrame) -> DataFrame:
    """The phase that a project is in after each scan (day, score_tenths). A history has a row for each scan, so one window holds it."""
    w = Window.orderBy("day")
    last3 = w.rowsBetween(-2, 0)
    rows = history.withColumns({"n": F.row_number().over(w), "before": F.lag("score_tenths").over(w), "high": F.max("score_tenths").over(last3), "low": F.min("score_tenths").over(last3), "first": F.first("score_tenths").over(w)})
    s = F.col("score_tenths")
    phase = (
        F.when(F.col("n") == 1, "first_scan")
        .when(F.col("before") - s > 5, "regression")
        .when((F.col("n") >= 3) & (F.col("high") - F.col("low") <= 5), "stagnation")
        .when((F.col("n") <= 5) & (s > F.col("first")), "early_momentum")
        .when(s > 930, "maintenance")
        .when(s > 800, "refinement")
        .otherwise("middle_grind")
    )
    return rows.select("day", "score_tenths", phase.alias("phase"))


def stagnant(history: DataFrame, group: str, last: int = 5, least: int = 3, spread: int = 5) -> DataFrame:
    """Groups whose score hardly moved over the last scans: (group, samples, spread)."""
    recent = history.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("day")))).filter(F.col("r") <= last)
    agg = recent.groupBy(group).agg(F.count("*").alias("samples"), (F.max("score_tenths") - F.min("score_tenths")).alias("spread"))
    return agg.filter((F.col("samples") >= least) & (F.col("spread") <= spread))

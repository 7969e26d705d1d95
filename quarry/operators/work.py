"""The work queue with clusters and subjective dimensions, scan policies, and what a status report counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import slug

# The order of actions of clusters, detectors counted as one, limits of flags, weights of confidence, scores that need a finding or feedback.
ACTIONS = ("auto_fix", "reorganize", "refactor", "manual_fix")
STRUCTURAL = ("large", "complexity", "gods", "concerns")
HIDDEN_PCT, HIDDEN, GAP = 30.0, 100, 1.0
WEIGHTS = {"high": 1.0, "medium": 0.7, "low": 0.3}
HOLISTIC = 10.0
NEEDS_FINDING, NEEDS_FEEDBACK, NEEDS_NOTE = 85.0, 100.0, 85.0
SLOW_PROFILES, SUBJECTIVE_PROFILES = ("ci",), ("objective", "ci")

_OPEN = "status = 'open' and not suppressed"


def subjective_items(dimensions: DataFrame, open_review: DataFrame, threshold: float = 100.0) -> DataFrame:
    """(id, tier, dimension, strict, open_review, command, stale) for dimensions (name, strict, issues, placeholder, stale, keys) below a threshold, between 0 and 100. open_review: (dimension, n).

    A dimension without assessment, and a stale one, is to be prepared for review (by its keys, if it has any and is assessed); one with open review findings is to be looked at.
    """
    least = max(0.0, min(100.0, threshold))
    key = slug("name")
    n = open_review.groupBy(F.lower(F.trim("dimension")).alias("d_")).agg(F.sum("n").alias("n_"))
    rows = dimensions.filter((F.trim("name") != "") & (F.col("strict") < least)).withColumn("dimension", key)
    names = rows.select("dimension", F.explode(F.array_distinct(F.concat(F.array("dimension"), F.transform("keys", lambda k: F.lower(F.trim(k)))))).alias("d_"))
    found = names.join(n, "d_").groupBy("dimension").agg(F.sum("n_").alias("open_review"))
    rows = rows.join(found, "dimension", "left").withColumn("open_review", F.coalesce("open_review", F.lit(0)))
    unassessed = F.col("placeholder") | ((F.col("strict") <= 0) & (F.col("issues") == 0))
    keyed = F.when(F.size("keys") > 0, F.concat(F.lit("prepare "), F.array_join("keys", ","))).otherwise("prepare")
    command = F.when(unassessed, "prepare").when(F.col("stale"), keyed).when(F.col("open_review") > 0, "show").otherwise(keyed)
    return rows.select(F.concat(F.lit("subjective::"), "dimension").alias("id"), F.lit(4).alias("tier"), "dimension", "strict", "open_review", command.alias("command"), "stale")


def collapsed(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """items (id, detector, tier, confidence, weight, count) with those of one of clusters (cluster, id, action), two at least, as one row: kind, members and action are added. An item is in one cluster."""
    rows = items.join(clusters.select("id", "cluster", "action"), "id", "left")
    sizes = rows.filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("members"), F.first("action").alias("action"), F.min(F.struct("id", "detector"))["detector"].alias("detector")).filter("members >= 2")
    single = rows.join(sizes.select("cluster"), "cluster", "left_anti")
    plain = single.select("id", "detector", "tier", "confidence", "weight", "count", F.lit("finding").alias("kind"), F.lit(1).cast("long").alias("members"), F.lit(None).cast("string").alias("action"))
    whole = sizes.select(F.col("cluster").alias("id"), "detector", F.lit(0).alias("tier"), F.lit("high").alias("confidence"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("count"), F.lit("cluster").alias("kind"), "members", "action")
    return plain.unionByName(whole)


def order() -> list[Column]:
    """The order of collapsed() items: clusters first, by action, larger ones, name; then by tier, confidence, weight, count, id."""
    cluster = F.col("kind") == "cluster"
    action = F.coalesce(F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")), F.lit(0))
    rank = F.when(action == 0, len(ACTIONS)).otherwise(action)
    sure = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).otherwise(9)
    return [F.when(cluster, 0).otherwise(1), F.when(cluster, rank).otherwise(F.col("tier")), F.when(cluster, -F.col("members")).otherwise(sure), F.desc("weight"), F.desc("count"), F.col("id")]


def next_items(items: DataFrame, count: int = 1, tier: int | None = None) -> DataFrame:
    """The first items of the queue, a top-k; of one tier if one is named."""
    rows = items if tier is None else items.filter(F.col("tier") == tier)
    return rows.orderBy(*order()).limit(count)


def review_weight() -> Column:
    """What an open review finding weighs, by its confidence, ten times for one of the whole."""
    known = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, F.col("confidence")), F.lit(0.3)) * F.when(F.col("holistic"), HOLISTIC).otherwise(1.0)


def remediation(findings: DataFrame, potential: int) -> DataFrame:
    """(id, weight, impact) of open findings of the whole: impact is the share of the potential, in percent."""
    rows = findings.filter("status = 'open' and holistic").withColumn("weight", review_weight())
    return rows.select("id", "weight", (F.col("weight") / F.lit(float(potential)) * 100 if potential > 0 else F.lit(0.0)).alias("impact"))


def review_tier() -> Column:
    """The tier of a review finding by its confidence and whether it is of the whole."""
    return F.when((F.col("confidence") == "high") & F.col("holistic"), 1).when((F.col("confidence") == "medium") & F.col("holistic"), 2).otherwise(3)


def open_counts(findings: DataFrame) -> DataFrame:
    """(detector, n) of open findings: structural detectors count as one; review findings of the whole, and those without investigation (no false or missing `investigated`), count again under names of their own."""
    merged = F.when(F.col("detector").isin(*STRUCTURAL), "structural").otherwise(F.col("detector"))
    review = F.col("detector") == "review"
    names = F.array_compact(F.array(merged, F.when(review & F.col("holistic"), "review_holistic"), F.when(review & ~F.coalesce("investigated", F.lit(False)), "review_uninvestigated")))
    return findings.filter(_OPEN).select(F.explode(names).alias("detector")).groupBy("detector").agg(F.count("*").alias("n"))


def risk_flags(state: DataFrame) -> DataFrame:
    """state (suppressed_pct, ignored, wontfix, gap, and keys) with flags, an array of (type, severity), high ones first."""
    hidden = (F.col("suppressed_pct") >= HIDDEN_PCT) | (F.col("ignored") >= HIDDEN)
    loud = (F.col("suppressed_pct") >= HIDDEN_PCT + 10) | (F.col("ignored") >= 2 * HIDDEN)
    debt = (F.col("gap") >= GAP) | (F.col("wontfix") > 0)
    deep = (F.col("gap") >= 5.0) | (F.col("wontfix") >= 50)
    flag = lambda when, name, high: F.when(when, F.struct(F.lit(name).alias("type"), F.when(high, "high").otherwise("medium").alias("severity")))
    both = F.array_compact(F.array(flag(hidden, "high_ignore_suppression", loud), flag(debt, "wontfix_gap", deep)))
    return state.withColumn("flags", F.concat(F.filter(both, lambda f: f["severity"] == "high"), F.filter(both, lambda f: f["severity"] != "high")))


def strict_target(scores: DataFrame, target: float = 95.0) -> DataFrame:
    """scores (strict and keys) with the gap to a target, in tenths, and whether it is below, at or above it, or not known."""
    gap = F.round(F.lit(target) - F.round("strict", 1), 1)
    return scores.withColumns({"gap": gap, "state": F.when(F.col("strict").isNull(), "unavailable").when(gap > 0, "below").when(gap < 0, "above").otherwise("at")})


def review_breakdown(findings: DataFrame) -> DataFrame:
    """(reason, n, holistic) of open subjective findings (status, reason, id, summary, holistic): those of the whole say so in their detail, id or summary."""
    whole = F.col("holistic") | F.col("id").contains("::holistic_unreviewed") | F.col("id").contains("::holistic_stale") | (F.lower("summary").contains("holistic") & F.lower("summary").contains("review"))
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "other").otherwise(F.col("reason"))
    return findings.filter("status = 'open'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(whole, F.lit(False))).alias("holistic"))


def stamped(findings: DataFrame, zones: DataFrame, lang: str, downgraded: dict[str, tuple[str, ...]]) -> DataFrame:
    """findings with the language and the zone of their file by zones (path, zone), production where there is none; confidence is low where the zone's policy has it so."""
    rows = findings.drop("lang", "zone").join(zones.select(F.col("path").alias("file"), "zone"), "file", "left").withColumns({"lang": F.lit(lang), "zone": F.coalesce("zone", F.lit("production"))})
    low = F.lit(False)
    for zone, detectors in downgraded.items():
        low = low | ((F.col("zone") == zone) & F.col("detector").isin(*detectors))
    return rows.withColumn("confidence", F.when(low, "low").otherwise(F.col("confidence")))


def adjusted_potential(potentials: DataFrame, zones: DataFrame) -> DataFrame:
    """potentials (lang, potential) less the files of zones (lang, zone) that are not production, zero at least."""
    other = zones.filter("zone <> 'production'").groupBy("lang").agg(F.count("*").alias("other_"))
    return potentials.join(other, "lang", "left").withColumn("potential", F.greatest(F.col("potential") - F.coalesce("other_", F.lit(0)), F.lit(0))).drop("other_")


def phases_of(phases: DataFrame, profile: str = "full", slow: bool = True) -> DataFrame:
    """The phases (label, slow, subjective) that a scan runs: a profile that is not known counts as full."""
    rows = phases if slow and profile not in SLOW_PROFILES else phases.filter("not slow")
    return rows.filter("not subjective") if profile in SUBJECTIVE_PROFILES else rows


def feedback(assessments: DataFrame) -> DataFrame:
    """assessments (dimension, score, findings, note, issues_note) with what is missing: a finding, feedback of any kind, or a note on what keeps a high score from being higher."""
    score = F.col("score")
    noted = F.coalesce("note", F.lit("")) != ""
    missing = F.array_compact(
        F.array(
            F.when((score < NEEDS_FINDING) & (F.col("findings") == 0), "finding"),
            F.when((score < NEEDS_FEEDBACK) & (F.col("findings") == 0) & ~noted, "feedback"),
            F.when((score > NEEDS_NOTE) & noted & (F.coalesce("issues_note", F.lit("")) == ""), "issues_note"),
        )
    )
    return assessments.withColumn("missing", missing)


def reviewed(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """One row: files of a review cache (reviewed_at, as text) reviewed in the last days, and the others; a date that can't be read is none."""
    at = F.col("reviewed_at").try_cast("timestamp_ntz")
    fresh = F.coalesce(F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 86400) <= days, F.lit(False))
    return cache.agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"))


def axis_means(scores: DataFrame) -> DataFrame:
    """(axis, score): means of scores (axis, score, weight) by weight, between 0 and 100, in tenths; axes without weight go."""
    rows = scores.groupBy("axis").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w")).filter("w > 0")
    return rows.select("axis", F.round(F.least(F.greatest(F.col("s") / F.col("w"), F.lit(0.0)), F.lit(100.0)), 1).alias("score"))


def corroborated(findings: DataFrame, entries: DataFrame, large: int = 500, complex_: int = 20, fanout: int = 5, least: int = 2) -> DataFrame:
    """findings with signals, how many of size, complexity and imports of their file in entries (file, loc, complexity, imports) are large; confidence is medium from two on and low below. Findings of other files stay as they are."""
    n = sum((F.coalesce(c, F.lit(0)) >= limit).cast("int") for c, limit in ((F.col("loc"), large), (F.col("complexity"), complex_), (F.col("imports"), fanout)))
    rows = findings.join(entries.select("file", n.alias("signals")), "file", "left")
    return rows.withColumn("confidence", F.when(F.col("signals").isNull(), F.col("confidence")).when(F.col("signals") >= least, "medium").otherwise("low"))


def detector_coverage(reports: DataFrame) -> DataFrame:
    """(detector, status, confidence, reasons) of reports (detector, status, confidence, reason): reduced if any is, the least confidence, and the distinct reasons, joined in order of spelling."""
    rows = reports.filter(F.trim("detector") != "").groupBy("detector")
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    reasons = F.array_join(F.array_sort(F.collect_set(F.when(F.trim("reason") != "", F.trim("reason")))), " | ")
    return rows.agg(F.when(F.count_if(F.col("status") == "reduced") > 0, "reduced").otherwise("full").alias("status"), F.round(F.min(sure), 2).alias("confidence"), reasons.alias("reasons"))


def finalised(nodes: DataFrame, edges: DataFrame, excluded: Column) -> DataFrame:
    """(path, imports, importers) of nodes (path) that are not excluded, and their links (src, dst) among each other; links to what is no node count as imports."""
    kept = nodes.filter(~excluded).select("path")
    gone = nodes.filter(excluded).select("path")
    links = edges.select("src", "dst").distinct().join(gone.select(F.col("path").alias("dst")), "dst", "left_anti").join(gone.select(F.col("path").alias("src")), "src", "left_anti")
    out, in_ = links.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imports")), links.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))
    return kept.join(out, "path", "left").join(in_, "path", "left").select("path", F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("importers", F.lit(0)).alias("importers"))


def under(path: Column, prefix: str, root: str) -> Column:
    """Whether a path is under a prefix, either of them below root or written from it."""
    root, prefix = root.replace("\\", "/").rstrip("/") + "/", prefix.strip().replace("\\", "/").rstrip("/") + "/"
    short = prefix[len(root) :] if prefix.startswith(root) else prefix.lstrip("/")
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    from_root = F.when(p.startswith(root), F.substring(p, len(root) + 1, 1 << 20)).otherwise(F.regexp_replace(p, "^/+", ""))
    return p.startswith(prefix) | from_root.startswith(short)

"""Queries on findings: scores, merges, queues and concerns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import merge, ranking, scoring
from quarry.plans import bindings as b
from quarry.plans.registry import query

_F = f"WITH {b.FINDINGS}"
_FP = f"{_F}, {b.POTENTIALS}"
_POLICY = """policy(detector, dimension, file_based, use_loc) AS (VALUES ('structural', 'File health', false, false), ('smells', 'Code quality', true, false), ('dupes', 'Duplication', false, false),
    ('security', 'Security', true, false), ('test_coverage', 'Test health', true, true)),
modes(mode, status) AS (VALUES ('lenient', 'open'), ('strict', 'open'), ('strict', 'wontfix'), ('verified_strict', 'open'), ('verified_strict', 'wontfix'), ('verified_strict', 'fixed'), ('verified_strict', 'false_positive')),
failing AS (SELECT f.*, m.mode, p.file_based, p.use_loc, CASE WHEN p.use_loc THEN loc_weight ELSE CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.3 END END::DECIMAL(10, 1) AS weight
    FROM findings f JOIN policy p ON f.detector = p.detector JOIN modes m ON f.status = m.status WHERE NOT suppressed AND NOT (f.detector = 'security' AND zone IN ('test', 'config', 'generated', 'vendor'))),
by_file AS (SELECT mode, detector, file, sum(weight) AS w, count(*) AS n, arg_min(weight, id) AS first_w, any_value(use_loc) AS use_loc FROM failing WHERE file_based AND NOT (holistic AND file = '.') GROUP BY ALL),
weighted AS (SELECT mode, detector, sum(w)::DECIMAL(20, 1) AS weighted, sum(n)::BIGINT AS issues FROM (
    SELECT mode, detector, sum(weight) AS w, count(*) AS n FROM failing WHERE NOT file_based GROUP BY ALL
    UNION ALL SELECT mode, detector, sum(least(w, CASE WHEN use_loc THEN first_w WHEN n >= 6 THEN 2.0 WHEN n >= 3 THEN 1.5 ELSE 1.0 END)), sum(n) FROM by_file GROUP BY ALL
    UNION ALL SELECT mode, detector, sum(weight * 10), count(*) FROM failing WHERE file_based AND holistic AND file = '.' GROUP BY ALL) GROUP BY ALL),
pots AS (SELECT detector, sum(potential)::BIGINT AS potential FROM potentials GROUP BY ALL),
stats AS (SELECT m.mode, p.detector, p.potential, coalesce(w.weighted, 0)::DECIMAL(20, 1) AS weighted, coalesce(w.issues, 0)::BIGINT AS issues, greatest((p.potential - coalesce(w.weighted, 0))::DOUBLE / p.potential, 0.0) AS pass_rate
    FROM pots p CROSS JOIN (SELECT DISTINCT mode FROM modes) m LEFT JOIN weighted w ON w.mode = m.mode AND w.detector = p.detector),
dims AS (SELECT mode, dimension, sum(potential)::BIGINT AS checks, sum(weighted) AS weighted, sum(issues)::BIGINT AS issues, round(100 * (greatest(sum(potential) - sum(weighted), 0)::DOUBLE / sum(potential)::BIGINT), 1) AS score FROM stats JOIN policy USING (detector) GROUP BY ALL)"""
_S = f"{_FP}, {_POLICY}"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.detector_stats(b.findings(spark, sf_dir), b.potentials(spark, sf_dir))


@query(f"{_S} SELECT mode, detector, potential, weighted::DOUBLE AS weighted, issues, pass_rate FROM stats")
def score_detector_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("mode", "detector", "potential", F.col("weighted").cast("double").alias("weighted"), "issues", "pass_rate")


@query(f"{_S} SELECT mode, dimension, checks, weighted::DOUBLE AS weighted, issues, score FROM dims")
def score_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dimension_scores(_stats(spark, sf_dir)).select("mode", "dimension", "checks", F.col("weighted").cast("double").alias("weighted"), "issues", "score")


@query(f"""{_S}, w AS (SELECT *, CASE dimension WHEN 'File health' THEN 2.0 ELSE 1.0 END::DOUBLE * least(checks / 200, 1.0) AS wt FROM dims)
SELECT mode, round(sum(score * wt) / sum(wt), 1) AS mechanical, round(sum(score * wt) / sum(wt), 1) AS overall FROM w GROUP BY mode""")
def score_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.health(scoring.dimension_scores(_stats(spark, sf_dir))).select("mode", "mechanical", "overall")


@query(f"{_S} SELECT mode, detector, file, n, w::DOUBLE AS w FROM by_file")
def score_file_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.failures(b.findings(spark, sf_dir)).filter("file_based and not (holistic and file = '.')")
    return rows.groupBy("mode", "detector", "file").agg(F.count("*").alias("n"), F.sum("weight").cast("double").alias("w"))


@query(f"""{_S}, t AS (SELECT dimension, sum(potential)::BIGINT AS checks, sum(weighted) AS aw FROM stats JOIN policy USING (detector) WHERE mode = 'lenient' GROUP BY ALL)
SELECT s.detector, p.dimension, s.issues, round(100 * (greatest((checks - (aw - s.weighted))::DOUBLE / checks, 0.0) - greatest((checks - aw)::DOUBLE / checks, 0.0)), 2) AS gain FROM stats s JOIN policy p USING (detector) JOIN t ON p.dimension = t.dimension WHERE mode = 'lenient'""")
def score_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.impact(_stats(spark, sf_dir))


@query(f"{_FP} SELECT detector, sum(potential)::BIGINT AS potential FROM potentials GROUP BY ALL")
def potentials_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.merge_potentials(b.potentials(spark, sf_dir))


@query(f"{_F} SELECT tier, status, count(*) AS n FROM findings WHERE NOT suppressed GROUP BY ROLLUP (tier, status)")
def stats_status_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.status_tiers(b.findings(spark, sf_dir))


@query(f"{_S} SELECT detector, gap FROM (SELECT detector, round(100 * (max(CASE WHEN mode = 'lenient' THEN pass_rate END) - max(CASE WHEN mode = 'strict' THEN pass_rate END)), 2) AS gap FROM stats GROUP BY ALL) WHERE gap > 0")
def debt_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.debt(_stats(spark, sf_dir))


@query("""WITH x AS (SELECT source AS dimension, count(*) AS n, sum(quality * 40 + 55 - toxic * 20)::BIGINT AS sw, min(quality * 40 + 55 - toxic * 20) AS low, sum(toxic)::BIGINT AS f FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT dimension, n, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN f > 0 THEN least(base, cap) ELSE base END)), 1) AS score FROM (SELECT *, sw::DOUBLE / n * 0.7::DOUBLE + low * 0.3::DOUBLE - least(24.0::DOUBLE, 2.2::DOUBLE * f + 0.8::DOUBLE * greatest(f - 1, 0)) AS base,
    greatest(60.0::DOUBLE, 90.0::DOUBLE - (3.5::DOUBLE * f + 0.8::DOUBLE * greatest(f - 1, 0))) AS cap FROM x)""")
def score_subjective_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    score = (F.col("quality") * 40 + 55 - F.col("toxic") * 20).cast("double")
    return scoring.batch_scores(rows.select(F.col("source").alias("dimension"), score.alias("score"), F.lit(1).alias("weight"), F.col("toxic").alias("pressure"), F.col("toxic").alias("findings")))


@query("""WITH a AS (SELECT source AS dimension, round(100.0 * sum(quality) / count(*), 0)::DOUBLE AS score FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT dimension, CASE WHEN abs(score - 85) <= 1.5 AND (SELECT count(*) FROM a WHERE abs(score - 85) <= 1.5) >= 2 THEN 0.0 ELSE score END AS score,
    CASE WHEN abs(score - 85) > 1.5 THEN 'ok' WHEN (SELECT count(*) FROM a WHERE abs(score - 85) <= 1.5) >= 2 THEN 'penalized' ELSE 'warn' END AS status FROM a""")
def score_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    a = rows.groupBy(F.col("source").alias("dimension")).agg(F.round(100.0 * F.sum("quality") / F.count("*"), 0).alias("score"))
    return scoring.integrity(a, 85.0, 1.5)


_M = f"{_F}, {b.SCANS}"
_IGNORE = ["src/area3/*", "smells::src/area1", "src/area2/user_16.py"]
_MERGED = """suspects AS (SELECT detector FROM state WHERE status = 'open' AND detector NOT IN (SELECT detector FROM current) GROUP BY detector HAVING count(*) >= 3),
joined AS (SELECT coalesce(c.id, s.id) AS id, coalesce(c.detector, s.detector) AS detector, coalesce(c.file, s.file) AS file, s.status AS s_status, s.id IS NOT NULL AS was, c.id IS NOT NULL AS now, coalesce(c.tier, s.tier) AS tier, coalesce(c.confidence, s.confidence) AS confidence,
    coalesce(s.reopen_count, 0) AS reopen_count, s.suppressed AS s_suppressed, s.lang AS s_lang, coalesce(s.first_seen, c.first_seen) AS first_seen FROM state s FULL JOIN current c ON s.id = c.id),
merged AS (SELECT *, CASE WHEN now AND (file LIKE 'src/area3/%' OR starts_with(id, 'smells::src/area1') OR file = 'src/area2/user_16.py') THEN 'suppressed' WHEN now AND NOT was THEN 'new' WHEN now AND s_status IN ('fixed', 'auto_resolved') THEN 'reopened' WHEN now THEN 'refreshed'
    WHEN s_status = 'auto_resolved' THEN 'kept' WHEN s_lang <> 'python' THEN 'other_language' WHEN NOT starts_with(file, 'src/') THEN 'out_of_scope' WHEN detector IN (SELECT detector FROM suspects) THEN 'suspect' ELSE 'auto_resolved' END AS change FROM joined),
after AS (SELECT id, detector, tier, confidence, first_seen, change, CASE WHEN change IN ('new', 'reopened') THEN 'open' WHEN change = 'auto_resolved' THEN 'auto_resolved' ELSE coalesce(s_status, 'open') END AS status,
    (reopen_count + (change = 'reopened')::INTEGER)::INTEGER AS reopen_count, CASE WHEN now THEN change = 'suppressed' ELSE coalesce(s_suppressed, false) END AS suppressed FROM merged)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, current = b.two_scans(spark, sf_dir)
    return merge.merge(state, current, lang="python", scope="src/", patterns=_IGNORE)


@query(f"{_M}, {_MERGED} SELECT id, detector, tier, confidence, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, change, status, reopen_count, suppressed FROM after")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("id", "detector", "tier", "confidence", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "change", "status", "reopen_count", "suppressed")


@query(f"{_M}, {_MERGED} SELECT id, detector FROM after WHERE change = 'auto_resolved'")
def merge_auto_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).filter("change = 'auto_resolved'").select("id", "detector")


@query(f"{_M} SELECT detector, count(*) AS previous FROM state WHERE status = 'open' AND detector NOT IN (SELECT detector FROM current WHERE user_id < 20 AND detector <> 'dupes') GROUP BY detector HAVING count(*) >= 3")
def merge_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, current = b.two_scans(spark, sf_dir)
    return merge.suspect_detectors(state, current.filter("user_id < 20 and detector <> 'dupes'"))


@query(f"{_M}, {_MERGED} SELECT change, count(*) AS n FROM after GROUP BY change")
def merge_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@query(f"{_F} SELECT id, reopen_count FROM findings WHERE reopen_count >= 2 AND status = 'open'")
def reopen_chronic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.chronic(b.findings(spark, sf_dir)).select("id", "reopen_count")


@query(f"{_F} SELECT id, CASE WHEN file LIKE 'src/area3/%' THEN 'src/area3/*' WHEN starts_with(id, 'smells::src/area1') THEN 'smells::src/area1' WHEN file = 'src/area2/user_16.py' THEN 'src/area2/user_16.py' END AS pattern FROM findings WHERE file LIKE 'src/area3/%' OR starts_with(id, 'smells::src/area1') OR file = 'src/area2/user_16.py'")
def ignore_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).withColumn("pattern", merge.ignored(_IGNORE)).filter("pattern is not null").select("id", "pattern")


@query(f"{_F}, {b.HISTORY} SELECT day::VARCHAR AS day, round(100.0::DOUBLE * ignored / raw_findings, 1) AS pct, round(100.0::DOUBLE * sum(ignored) OVER w / sum(raw_findings) OVER w, 1) AS recent_pct FROM history WINDOW w AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def history_suppression_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.suppression(b.history(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"""{_F}, {b.HISTORY}, h AS (SELECT *, row_number() OVER o AS n, lag(score_tenths) OVER o AS prev, max(score_tenths) OVER l AS hi, min(score_tenths) OVER l AS lo, first(score_tenths) OVER o AS f FROM history WINDOW o AS (ORDER BY day), l AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT day::VARCHAR AS day, score_tenths, CASE WHEN n = 1 THEN 'first_scan' WHEN prev - score_tenths > 5 THEN 'regression' WHEN n >= 3 AND hi - lo <= 5 THEN 'stagnation' WHEN n <= 5 AND score_tenths > f THEN 'early_momentum' WHEN score_tenths > 930 THEN 'maintenance' WHEN score_tenths > 800 THEN 'refinement' ELSE 'middle_grind' END AS phase FROM h""")
def history_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.phases(b.history(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


_BY_DETECTOR = "SELECT detector, first_seen::DATE AS day, (sum(CASE WHEN status = 'open' THEN 0 ELSE 1 END) * 1000 // count(*))::BIGINT AS score_tenths FROM findings GROUP BY ALL"


@query(f"{_F}, h AS ({_BY_DETECTOR}), r AS (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY day DESC) AS r FROM h) SELECT detector, count(*) AS samples, max(score_tenths) - min(score_tenths) AS spread FROM r WHERE r <= 5 GROUP BY detector HAVING count(*) >= 3 AND max(score_tenths) - min(score_tenths) <= 150")
def history_stagnation(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = b.findings(spark, sf_dir).groupBy("detector", F.to_date("first_seen").alias("day")).agg((F.sum(F.when(F.col("status") == "open", 0).otherwise(1)) * 1000 / F.count("*")).cast("long").alias("score_tenths"))
    return merge.stagnant(h, "detector", spread=150)


_RANK = "row_number() OVER (PARTITION BY detector ORDER BY tier, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id)"


@query(f"{_F} SELECT id, detector, rank FROM (SELECT *, {_RANK}::INTEGER AS rank FROM findings WHERE status = 'open') WHERE rank <= 25")
def noise_per_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.noise_budget(b.findings(spark, sf_dir).filter("status = 'open'"), 25).select("id", "detector", "rank")


@query(f"""{_F}, r AS (SELECT *, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS co, {_RANK} AS rank FROM findings WHERE status = 'open'), t AS (SELECT detector, row_number() OVER (ORDER BY tier, co, id, detector) AS turn FROM r WHERE rank = 1)
SELECT id, detector, rank::INTEGER AS rank FROM (SELECT r.*, row_number() OVER (ORDER BY rank, turn) AS g FROM r JOIN t USING (detector) WHERE rank <= 25) WHERE g <= 40""")
def noise_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.noise_budget(b.findings(spark, sf_dir).filter("status = 'open'"), 25, 40).filter("surfaced").select("id", "detector", "rank")


_KEY = "tier, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END, detail_count DESC, id"


@query(f"{_F} SELECT id, tier, row_number() OVER (ORDER BY {_KEY})::INTEGER AS position FROM findings WHERE status = 'open' AND NOT suppressed ORDER BY position LIMIT 100")
def queue_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.queue(b.findings(spark, sf_dir), 100).select("id", "tier", "position")


@query(f"{_F} SELECT tier, n FROM (SELECT tier, count(*) AS n FROM findings WHERE status = 'open' AND NOT suppressed AND tier <> 2 GROUP BY tier) ORDER BY abs(tier - 2), tier LIMIT 1")
def queue_tier_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fallback_tier(b.findings(spark, sf_dir).filter("tier <> 2"), 2)


@query(f"{_F} SELECT id, CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS part, CASE WHEN event_id % 17 <> 0 AND event_id % 11 = 0 THEN event_id END AS pos FROM findings WHERE status = 'open' AND NOT suppressed")
def queue_plan_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.findings(spark, sf_dir)
    order = f.filter("event_id % 11 = 0").select("id", F.col("event_id").alias("pos"))
    return ranking.planned(f, order, f.filter("event_id % 17 = 0").select("id")).select("id", "part", "pos")


@query(f"""{_F} SELECT cluster, count(*) AS n, count(DISTINCT file) AS files, min(tier) AS tier FROM (SELECT *, CASE WHEN detector = 'smells' THEN 'typed::smells::' || smell_id WHEN detector = 'structural' THEN 'file::structural::' || string_split(file, '/')[-1] ELSE 'detector::' || detector END AS cluster
FROM findings WHERE status = 'open' AND NOT suppressed) GROUP BY cluster HAVING count(*) >= 2""")
def cluster_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.clusters(b.findings(spark, sf_dir))


_OPEN = "findings WHERE status = 'open' AND NOT suppressed AND file <> '.'"


@query(f"""{_F}, a AS (SELECT file, count(*) AS n, list_sort(list_distinct(list(detector) FILTER (detector IN ('smells', 'structural', 'dupes')))) AS d FROM {_OPEN} GROUP BY file),
c AS (SELECT *, CASE WHEN len(d) >= 3 THEN 'mixed_responsibilities' WHEN list_contains(d, 'dupes') THEN 'duplication_design' WHEN list_contains(d, 'structural') THEN 'structural_complexity' ELSE 'design_concern' END AS kind FROM a WHERE len(d) >= 2 OR (len(d) >= 1 AND n >= 3))
SELECT file, n, array_to_string(d, ',') AS detectors, kind, substr(sha256(kind || '::' || file || '::' || array_to_string(d, ',')), 1, 16) AS fingerprint FROM c""")
def concerns_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.concerns_by_file(b.findings(spark, sf_dir))


@query(f"""{_F} SELECT detectors, count(*) AS files FROM (SELECT file, array_to_string(list_sort(list_distinct(list(detector))), ',') AS detectors FROM {_OPEN} AND detector IN ('smells', 'structural', 'dupes') GROUP BY file HAVING count(DISTINCT detector) >= 2) GROUP BY detectors HAVING count(*) >= 3""")
def concerns_cross_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.concerns_across_files(b.findings(spark, sf_dir))


@query(f"{_F} SELECT smell_id, count(DISTINCT file) AS files, count(*) AS n FROM {_OPEN} AND detector = 'smells' GROUP BY smell_id HAVING count(DISTINCT file) >= 5")
def concerns_systemic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.systemic_smells(b.findings(spark, sf_dir))


@query(f"{_F} SELECT detector, zone, count(*) AS total, count(*) FILTER (status = 'false_positive') AS fp, count(*) FILTER (status = 'false_positive') / count(*) AS rate FROM findings GROUP BY ALL HAVING total >= 5 AND fp > 0")
def fp_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.false_positive_rates(b.findings(spark, sf_dir))


@query(f"{_F} SELECT count(*) FILTER (i) AS in_scope, count(*) FILTER (NOT i) AS out_of_scope, count(*) AS total FROM (SELECT starts_with(file, 'src/area4/') OR file = '.' AS i FROM findings WHERE status = 'open' AND NOT suppressed)")
def scope_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scope_breakdown(b.findings(spark, sf_dir), "src/area4")

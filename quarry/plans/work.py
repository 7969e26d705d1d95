"""Queries on the work queue, reports of further analysers, and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import values
from quarry.functions.text import lines
from quarry.operators import work
from quarry.plans import bindings as b
from quarry.plans.registry import query
from quarry.session import spread
from quarry.sources import reports

_F = f"WITH {b.FINDINGS}"


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their last digits as dimensions: how many of their findings are not open."""
    user = F.col("user_id") % 25
    rows = b.findings(spark, sf_dir).groupBy(user.alias("u")).agg(F.count_if(F.col("status") == "open").alias("issues"), F.count("*").alias("n"))
    keys = F.when(F.col("u") % 3 == 0, F.array()).otherwise(F.array(F.concat(F.lit("key"), F.col("u")))).cast("array<string>")
    return rows.select(F.concat(F.lit("Dimension "), "u").alias("name"), F.floor((F.col("n") - F.col("issues")) * 100 / F.col("n")).cast("double").alias("strict"), "issues", (F.col("u") % 7 == 0).alias("placeholder"), (F.col("u") % 5 == 0).alias("stale"), keys.alias("keys"))


@query(f"""{_F}, d AS (SELECT user_id % 25 AS u, count(*) FILTER (status = 'open') AS issues, count(*) AS n FROM findings GROUP BY 1), r AS (SELECT user_id % 25 AS u, count(*) AS n FROM findings WHERE status = 'open' AND detector = 'smells' GROUP BY 1),
x AS (SELECT d.u, issues, floor((d.n - issues) * 100 / d.n)::DOUBLE AS strict, CASE WHEN d.u % 3 = 0 OR d.u % 2 = 1 THEN 0 ELSE coalesce(r.n, 0) END + CASE WHEN d.u % 2 = 1 THEN coalesce(r.n, 0) ELSE 0 END AS open_review FROM d LEFT JOIN r ON d.u = r.u)
SELECT 'subjective::dimension_' || u AS id, 4 AS tier, 'dimension_' || u AS dimension, strict, open_review::BIGINT AS open_review, u % 5 = 0 AS stale,
    CASE WHEN u % 7 = 0 OR strict <= 0 AND issues = 0 THEN 'prepare' WHEN u % 5 = 0 OR open_review = 0 THEN CASE WHEN u % 3 = 0 THEN 'prepare' ELSE 'prepare key' || u END ELSE 'show' END AS command FROM x WHERE strict < 82""")
def queue_subjective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions below 82, with review findings under their names or keys."""
    u = F.col("user_id") % 25
    found = b.findings(spark, sf_dir).filter("status = 'open' and detector = 'smells'")
    n = found.groupBy(F.when(u % 2 == 1, F.concat(F.lit(" Dimension_"), u)).otherwise(F.concat(F.lit("KEY"), u)).alias("dimension")).agg(F.count("*").alias("n"))
    return work.subjective_items(_dimensions(spark, sf_dir), n, 82.0)


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = b.findings(spark, sf_dir).filter("status = 'open' and not suppressed")
    items = f.select("id", "detector", "tier", "confidence", (F.col("user_id") % 4 / 2).alias("weight"), F.col("detail_count").cast("long").alias("count"))
    action = F.when(F.col("user_id") % 3 == 0, "auto_fix").when(F.col("user_id") % 3 == 1, "refactor").otherwise("elsewhere")
    return items, f.filter("user_id % 5 < 4").select(F.concat_ws("/", F.lit("auto"), "detector", "user_id").alias("cluster"), "id", action.alias("action"))


_COLLAPSED = f"""{_F}, open_ AS (SELECT *, CASE WHEN user_id % 5 < 4 THEN 'auto/' || detector || '/' || user_id END AS cluster FROM findings WHERE status = 'open' AND NOT suppressed),
sizes AS (SELECT cluster, any_value(detector) AS detector, any_value(CASE user_id % 3 WHEN 0 THEN 'auto_fix' WHEN 1 THEN 'refactor' ELSE 'elsewhere' END) AS action, count(*) AS members FROM open_ WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(*) >= 2),
items AS (SELECT id, detector, tier::INTEGER AS tier, confidence, user_id % 4 / 2 AS weight, detail_count::BIGINT AS count, 'finding' AS kind, 1::BIGINT AS members, NULL AS action FROM open_ WHERE cluster IS NULL OR cluster NOT IN (SELECT cluster FROM sizes)
    UNION ALL SELECT cluster, detector, 0, 'high', 0.0, 0, 'cluster', members, action FROM sizes)"""


@query(f"{_COLLAPSED} SELECT * FROM items")
def queue_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings, with clusters by detector and user as one item each."""
    return work.collapsed(*_items(spark, sf_dir))


@query(f"""{_COLLAPSED} SELECT * FROM items ORDER BY kind <> 'cluster', CASE WHEN kind = 'cluster' THEN CASE action WHEN 'auto_fix' THEN 1 WHEN 'refactor' THEN 3 ELSE 4 END ELSE tier END,
CASE WHEN kind = 'cluster' THEN -members ELSE CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END END, weight DESC, count DESC, id LIMIT 40""")
def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty items of the queue with clusters."""
    return work.next_items(work.collapsed(*_items(spark, sf_dir)), 40)


@query(f"{_F} SELECT id, round(w * 10, 6) AS weight, round(w * 10 / 400 * 100, 6) AS impact FROM (SELECT id, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.3 END::DOUBLE AS w FROM findings WHERE status = 'open' AND holistic)")
def review_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.remediation(b.findings(spark, sf_dir), 400).withColumns({"weight": F.round("weight", 6), "impact": F.round("impact", 6)})


@query(f"{_F} SELECT id, CASE WHEN holistic AND confidence = 'high' THEN 1 WHEN holistic AND confidence = 'medium' THEN 2 ELSE 3 END AS tier FROM findings")
def review_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).select("id", work.review_tier().alias("tier"))


@query(f"""{_F}, o AS (SELECT CASE detector WHEN 'security' THEN 'large' WHEN 'dupes' THEN 'gods' WHEN 'smells' THEN 'review' ELSE detector END AS detector, holistic, user_id FROM findings WHERE status = 'open' AND NOT suppressed)
SELECT CASE WHEN detector IN ('large', 'gods') THEN 'structural' ELSE detector END AS detector, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT 'review_holistic', count(*) FROM o WHERE detector = 'review' AND holistic HAVING count(*) > 0 UNION ALL SELECT 'review_uninvestigated', count(*) FROM o WHERE detector = 'review' AND user_id % 3 > 0 HAVING count(*) > 0""")
def status_open_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings by detector, security and duplicates as size findings, smells as review findings."""
    d = F.col("detector")
    f = b.findings(spark, sf_dir).withColumn("detector", F.when(d == "security", "large").when(d == "dupes", "gods").when(d == "smells", "review").otherwise(d))
    return work.open_counts(f.withColumn("investigated", F.when(F.col("user_id") % 3 == 0, True)))


@query(f"""{_F}, s AS (SELECT user_id, 100.0 * count(*) FILTER (k3) / count(*) AS pct, 30 * count(*) FILTER (k3) AS ignored, count(*) FILTER (status = 'wontfix') AS wontfix, count(*) FILTER (status = 'fixed') * 0.25 AS gap FROM (SELECT *, detail_count % 4 = 0 AS k3 FROM findings) GROUP BY user_id),
f AS (SELECT user_id, CASE WHEN pct >= 30 OR ignored >= 100 THEN CASE WHEN pct >= 40 OR ignored >= 200 THEN 'high' ELSE 'medium' END END AS a, CASE WHEN gap >= 1 OR wontfix > 0 THEN CASE WHEN gap >= 5 OR wontfix >= 50 THEN 'high' ELSE 'medium' END END AS b FROM s)
SELECT user_id, CASE WHEN b = 'high' AND a = 'medium' THEN 'wontfix_gap:high,high_ignore_suppression:medium' ELSE concat_ws(',', 'high_ignore_suppression:' || a, 'wontfix_gap:' || b) END AS flags FROM f""")
def status_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.count_if(F.col("detail_count") % 4 == 0)
    state = b.findings(spark, sf_dir).groupBy("user_id").agg((100.0 * hidden / F.count("*")).alias("suppressed_pct"), (30 * hidden).alias("ignored"), F.count_if(F.col("status") == "wontfix").alias("wontfix"), (F.count_if(F.col("status") == "fixed") * 0.25).alias("gap"))
    return work.risk_flags(state).select("user_id", F.array_join(F.transform("flags", lambda f: F.concat_ws(":", f["type"], f["severity"])), ",").alias("flags"))


@query(f"""{_F}, s AS (SELECT user_id, CASE WHEN user_id % 9 > 0 THEN round(90 + avg(detail_count % 11), 1) END AS strict FROM findings GROUP BY user_id)
SELECT user_id, strict, round(95.0 - strict, 1) AS gap, CASE WHEN strict IS NULL THEN 'unavailable' WHEN round(95.0 - strict, 1) > 0 THEN 'below' WHEN round(95.0 - strict, 1) < 0 THEN 'above' ELSE 'at' END AS state FROM s""")
def status_strict_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = b.findings(spark, sf_dir).groupBy("user_id").agg(F.round(90 + F.avg(F.col("detail_count") % 11), 1).alias("strict"))
    return work.strict_target(scores.withColumn("strict", F.when(F.col("user_id") % 9 > 0, F.col("strict"))))


@query(f"""{_F} SELECT CASE WHEN user_id % 8 = 0 THEN 'other' ELSE smell_id END AS reason, count(*) AS n, count(*) FILTER (holistic OR user_id % 7 = 0 OR user_id % 11 = 0) AS holistic FROM findings WHERE status = 'open' GROUP BY 1""")
def status_review_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    f = b.findings(spark, sf_dir).withColumns({"reason": F.when(user % 16 == 0, "").when(user % 8 != 0, F.col("smell_id")), "summary": F.when(user % 7 == 0, "Holistic REVIEW needed").otherwise("a review"), "id": F.concat("id", F.when(user % 11 == 0, "::holistic_stale").otherwise(""))})
    return work.review_breakdown(f)


_DOWN = {"test": ("smells", "dupes"), "vendor": ("security",)}


@query(f"""{_F} SELECT id, detector, file, 'python' AS lang, CASE WHEN area % 3 = 0 THEN 'test' WHEN area % 3 = 1 THEN 'vendor' ELSE 'production' END AS zone, CASE WHEN area % 3 = 0 AND detector IN ('smells', 'dupes') OR area % 3 = 1 AND detector = 'security' THEN 'low' ELSE confidence END AS confidence
FROM (SELECT *, CASE WHEN file = '.' THEN 2 ELSE user_id END AS area FROM findings)""")
def scan_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.findings(spark, sf_dir)
    user = F.regexp_extract("path", r"user_(\d+)", 1).cast("long")
    zones = f.filter("file <> '.'").select(F.col("file").alias("path")).distinct().withColumn("zone", F.when(user % 3 == 0, "test").when(user % 3 == 1, "vendor")).filter("zone is not null")
    return work.stamped(f, zones, "python", _DOWN).select("id", "detector", "file", "lang", "zone", "confidence")


@query(f"""{_F}, {b.POTENTIALS}, z AS (SELECT lang, count(*) AS other FROM findings WHERE zone <> 'production' GROUP BY lang) SELECT p.lang, detector, greatest(potential - coalesce(other, 0), 0) AS potential FROM potentials p LEFT JOIN z ON p.lang = z.lang""")
def scan_adjusted_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.adjusted_potential(b.potentials(spark, sf_dir), b.findings(spark, sf_dir).select("lang", "zone"))


@query("""WITH p AS (SELECT 'phase ' || n_nationkey AS label, n_nationkey % 2 = 0 AS slow, n_nationkey % 3 = 0 AS subjective FROM nation)
SELECT 'full' AS profile, label FROM p UNION ALL SELECT 'objective', label FROM p WHERE NOT subjective UNION ALL SELECT 'ci', label FROM p WHERE NOT slow AND NOT subjective UNION ALL SELECT 'fast', label FROM p WHERE NOT slow""")
def scan_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    p = b.table(spark, sf_dir, "nation").select(F.concat(F.lit("phase "), key).alias("label"), (key % 2 == 0).alias("slow"), (key % 3 == 0).alias("subjective"))
    runs = [("full", work.phases_of(p)), ("objective", work.phases_of(p, "objective")), ("ci", work.phases_of(p, "ci")), ("fast", work.phases_of(p, "unknown", slow=False))]
    out = [rows.select(F.lit(name).alias("profile"), "label") for name, rows in runs]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""WITH a AS (SELECT doc_id, (50 + doc_id % 60)::DOUBLE AS score, quality AS findings, toxic = 1 AS noted FROM labels)
SELECT doc_id, score, array_to_string(list_filter([CASE WHEN score < 85 AND findings = 0 THEN 'finding' END, CASE WHEN score < 100 AND findings = 0 AND NOT noted THEN 'feedback' END, CASE WHEN score > 85 AND noted AND doc_id % 2 = 0 THEN 'issues_note' END], lambda x: x IS NOT NULL), ',') AS missing FROM a""")
def review_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    a = b.table(spark, sf_dir, "labels").select("doc_id", (50 + key % 60).cast("double").alias("score"), F.col("quality").alias("findings"), F.when(F.col("toxic") == 1, "note").alias("note"), F.when(key % 2 == 1, "issues").alias("issues_note"))
    return work.feedback(a).select("doc_id", "score", F.array_join("missing", ",").alias("missing"))


@query("SELECT count(*) FILTER (fresh) AS fresh, count(*) FILTER (NOT fresh) AS stale FROM (SELECT event_id % 10 > 0 AND date_diff('second', ts, TIMESTAMP '2024-02-15 00:00:00') // 86400 <= 30 AS fresh FROM events)")
def review_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("event_id") % 20 == 0, "no date").when(F.col("event_id") % 10 != 0, F.col("ts").cast("string"))
    return work.reviewed(b.table(spark, sf_dir, "events").select(at.alias("reviewed_at")), F.lit("2024-02-15 00:00:00").cast("timestamp_ntz"), 30)


@query("SELECT p_brand AS axis, round(sum(p_size * (p_partkey % 4)) / sum(p_partkey % 4), 1) AS score FROM part GROUP BY p_brand HAVING sum(p_partkey % 4) > 0")
def review_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.axis_means(b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("axis"), F.col("p_size").cast("double").alias("score"), (F.col("p_partkey") % 4).cast("double").alias("weight")))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN toxic = 0 THEN s END AS signals FROM
(SELECT doc_id, toxic, ((doc_id % 1000 >= 500)::INTEGER + (doc_id % 30 >= 20)::INTEGER + (doc_id % 7 >= 5)::INTEGER) AS s FROM labels)""")
def findings_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, rows = F.col("doc_id"), b.table(spark, sf_dir, "labels")
    entries = rows.filter("toxic = 0").select(F.concat(F.lit("f"), key).alias("file"), (key % 1000).alias("loc"), (key % 30).alias("complexity"), (key % 7).alias("imports"))
    return work.corroborated(rows.select("doc_id", F.concat(F.lit("f"), key).alias("file"), F.lit("high").alias("confidence")), entries).select("doc_id", "confidence", "signals")


@query("""SELECT 'd' || p_size AS detector, CASE WHEN max((p_partkey % 9 = 0)::INTEGER) = 1 THEN 'reduced' ELSE 'full' END AS status, round(min(least(greatest(p_partkey % 13 / 10.0 - 0.1, 0), 1)), 2)::DOUBLE AS confidence, coalesce(array_to_string(list_sort(list(DISTINCT 'no ' || p_brand) FILTER (p_partkey % 3 > 0)), ' | '), '') AS reasons FROM part GROUP BY p_size""")
def scan_detector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = b.table(spark, sf_dir, "part").select(F.concat(F.lit("d"), "p_size").alias("detector"), F.when(key % 9 == 0, "reduced").otherwise("full").alias("status"), (key % 13 / 10.0 - 0.1).alias("confidence"), F.when(key % 3 > 0, F.concat(F.lit(" no "), "p_brand")).otherwise(" ").alias("reason"))
    return work.detector_coverage(rows).withColumn("reasons", F.coalesce("reasons", F.lit("")))


@query(f"""WITH {b.FILE_EDGES}, k AS (SELECT path FROM modules WHERE NOT contains(path, '/t2/')), l AS (SELECT DISTINCT src, dst FROM file_edges WHERE NOT contains(src, '/t2/') AND NOT contains(dst, '/t2/'))
SELECT path, coalesce(o.n, 0) AS imports, coalesce(i.n, 0) AS importers FROM k LEFT JOIN (SELECT src AS path, count(*) AS n FROM l GROUP BY 1) o USING (path) LEFT JOIN (SELECT dst AS path, count(*) AS n FROM l GROUP BY 1) i USING (path)""")
def graph_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.finalised(b.modules(spark, sf_dir), b.file_edges(spark, sf_dir), F.col("path").contains("/t2/"))


@query(f"WITH {b.MODULES} SELECT path, starts_with(path, 'src/tools/t1/') AS inside FROM modules")
def graph_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they come, some absolute, some with back slashes."""
    m, node = b.modules(spark, sf_dir), F.col("node")
    shape = F.when(node % 3 == 0, F.concat(F.lit("/repo/"), "path")).when(node % 3 == 1, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    return m.select("path", work.under(shape, "/repo/src/tools/t1", "/repo").alias("inside"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN nullif(k, 0) WHEN event_id % 4 = 2 THEN nullif(k, 0) ELSE event_id % 50 + 1 END::BIGINT AS line, CASE WHEN event_id % 4 = 0 THEN 4 ELSE least(greatest(k - 3, 1), 4) END::INTEGER AS tier,
CASE WHEN event_id % 4 = 1 AND k >= 5 THEN k ELSE 20 END::BIGINT AS budget, CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE least(greatest(k / 10.0 - 0.2, 0.0), 1.0) END::DOUBLE AS share FROM (SELECT event_id, (json_extract_string(props, '$.k'))::INTEGER AS k FROM events)""")
def values_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, tiers, budgets and shares of loosely typed details."""
    e = b.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, k = F.col("event_id") % 4, F.col("k").cast("string")
    none = F.lit(None).cast("string")
    detail = F.create_map(F.lit("line"), F.when(kind == 1, k).otherwise("0"), F.lit("lineno"), F.when(kind == 2, F.concat(F.lit(" "), k, F.lit(" "))).otherwise("-3"), F.lit("row"), F.when(kind == 3, (F.col("event_id") % 50 + 1).cast("string")))
    tier = F.when(kind == 0, F.when(F.col("event_id") % 8 == 0, "high").otherwise(none)).otherwise((F.col("k") - 3).cast("string"))
    return e.select("event_id", values.line_hint(detail).alias("line"), values.safe_tier(tier).alias("tier"), values.whole_or(F.when(kind == 1, k).otherwise("many"), 20, 5).alias("budget"), values.share_or(F.when(kind != 0, (F.col("k") / 10.0 - 0.2).cast("string")).otherwise("?")).alias("share"))


@query("SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 280), ' ') || '...' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS t FROM documents)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", values.snippet("text").alias("snippet"))


_CODE = """'x = "' || p_name || ' // not /* one";' || chr(10) || '// ' || p_brand || chr(10) || 'y = /* ' || p_type || chr(10) || ' */ ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' // end' ELSE ' /* open' END"""


@query("SELECT p_partkey, 'x = \"' || p_name || ' // not /* one\";' || chr(10) || chr(10) || 'y =  ' || p_size || ' ' AS code FROM part")
def comments_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "part").select("p_partkey", values.without_comments(F.expr(_CODE.replace("chr(10)", "char(10)"))).alias("code"))


_PYTHON = """'class A:' || chr(10) || '    def f(self, a, b=(1, (2)), *c, d' || p_size || '=0):' || chr(10) || repeat('        x = 1' || chr(10), 2 * p_size) || chr(10) || '    def g(cls):' || chr(10) || '        def h(p, q, r, s, t):' || chr(10) || '            pass' || chr(10) || 'y = 2'"""


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 5 END AS params, CASE WHEN p_partkey % 4 > 0 THEN CASE WHEN 2 * p_size + 2 >= 3 THEN 'f' ELSE 'g' END END AS name, CASE WHEN p_partkey % 4 > 0 THEN greatest(2 * p_size + 2, 3) END AS loc FROM part")
def function_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most parameters and the longest function of made-up modules."""
    code = F.when(F.col("p_partkey") % 4 == 0, "x = 1\n").otherwise(F.expr(_PYTHON.replace("chr(10)", "char(10)")))
    rows = spread(b.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", code.alias("code"))
    return rows.select("p_partkey", values.most_parameters("code").alias("params"), values.longest_function(lines("code")).alias("f")).select("p_partkey", "params", "f.name", "f.loc")


@query("""SELECT 'src/' || p_brand || CASE WHEN p_partkey % 5 = 0 THEN '/mod.py' ELSE '/m' || p_size || '.py' END AS file, p_size::INTEGER AS line, 'n' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'imports' ELSE 'vars' END AS category FROM part WHERE p_partkey % 3 < 2 AND NOT (p_partkey % 2 = 0 AND p_partkey % 7 = 0)""")
def tool_parse_pyflakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    file = F.concat(F.lit("src/"), "p_brand", F.when((key % 2 == 0) & (key % 7 == 0), "/__init__.py").when(key % 5 == 0, "/mod.py").otherwise(F.concat(F.lit("/m"), "p_size", F.lit(".py"))))
    text = F.when(key % 2 == 0, F.concat(F.lit("'n"), key, F.lit("' imported but unused"))).otherwise(F.concat(F.lit("local variable 'n"), key, F.lit("' is assigned to but never used")))
    return reports.pyflakes(b.table(spark, sf_dir, "part").select(F.when(key % 3 == 2, "a.py:1:1: other").otherwise(F.concat(file, F.lit(":"), "p_size", F.lit(":1 "), text)).alias("value")))


@query("SELECT 'src/' || c_mktsegment || '.ts' AS file, (c_custkey % 90 + 1)::INTEGER AS line, 7 AS col, CASE WHEN c_custkey % 3 = 0 THEN '(entire import)' ELSE 'v' || c_custkey END AS name FROM customer WHERE c_custkey % 4 > 0")
def tool_parse_tsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, "error TS6192: All imports in import declaration are unused.").otherwise(F.concat(F.lit("error TS6133: 'v"), key, F.lit("' is declared but its value is never read.")))
    text = F.when(key % 4 > 0, text).when(key % 8 == 0, "error TS6133: '_v' is declared but its value is never read.").otherwise("error TS1: no")
    return reports.tsc_unused(b.table(spark, sf_dir, "customer").select(F.concat(F.lit("src/"), "c_mktsegment", F.lit(".ts("), key % 90 + 1, F.lit(",7): "), text).alias("value")))


@query("""SELECT o_orderkey AS id, 'app/m' || o_custkey || '.py' AS file, 'm' || o_custkey AS source_pkg, 'core.x' AS target_pkg, 'layers ' || (o_orderkey % 3) AS contract FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'main.py', 'main', 'y', 'second' FROM orders WHERE o_orderkey % 4 = 0""")
def tool_parse_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    first = F.when(key % 2 == 0, F.concat(F.lit("Broken contract 'layers "), key % 3, F.lit("'"))).otherwise("all kept")
    text = F.array(F.lit("  a.b imports c.d"), first, F.concat(F.lit("  app.m"), "o_custkey", F.lit(" imports core.x")), F.lit("noise"), F.when(key % 4 == 0, "Broken contract 'second'").otherwise("-"), F.when(key % 4 == 0, "   main -> y ").otherwise("end"))
    return reports.layers(b.table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("lines")))


@query("""SELECT 'f' || p_size || '.ts' AS file, 'e' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN 0 ELSE p_size + 1 END::INTEGER AS line, 'export' AS kind FROM part UNION ALL SELECT 'f' || p_size || '.ts', 't' || p_partkey, 3, 'type' FROM part WHERE p_partkey % 2 = 0""")
def tool_parse_knip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pos = F.when(key % 3 == 0, size).when(key % 3 == 1, '"?"').otherwise(F.concat(F.lit('{"start":{"line":'), (F.col("p_size") + 1).cast("string"), F.lit("}}")))
    types = F.when(key % 2 == 0, F.concat(F.lit('[{"name":"t'), key, F.lit('","pos":{"start":3}}]'))).otherwise('[{"name":""}]')
    text = F.concat(F.lit('{"issues":[{"file":"f'), size, F.lit('.ts","exports":[{"name":"e'), key, F.lit('","pos":'), pos, F.lit('}],"types":'), types, F.lit('},{"file":"","exports":[{"name":"x"}]}]}'))
    return reports.knip(b.table(spark, sf_dir, "part").select(text.alias("value")))


@query("""WITH p AS (SELECT substr(sha1('frag' || p_size), 1, 16) AS id, p_size % 20 + 1 AS lines, unnest([{'f': 'a' || (p_partkey % 5), 'l': p_partkey}, {'f': 'a' || (p_partkey % 3), 'l': p_partkey + 1}]) AS x FROM part WHERE p_partkey % 5 <> p_partkey % 3),
g AS (SELECT id, x.f AS file, min(x.l) AS line, max(lines) AS lines FROM p GROUP BY ALL) SELECT id, count(*) AS files, max(lines)::INTEGER AS lines, min(file) AS first_file, arg_min(line, file)::INTEGER AS first_line FROM g GROUP BY id HAVING count(*) >= 2""")
def tool_parse_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    place = lambda n, more: F.struct(F.concat(F.lit("a"), key % n).alias("name"), (key + more).cast("int").alias("start"))
    dup = F.struct((F.col("p_size") % 20 + 1).alias("lines"), F.concat(F.lit("  frag"), "p_size", F.lit("\n")).alias("fragment"), place(5, 0).alias("firstFile"), place(3, 1).alias("secondFile"))
    return reports.copied_fragments(b.table(spark, sf_dir, "part").select(F.to_json(F.struct(F.array(dup).alias("duplicates"))).alias("value")))


@query("""SELECT DISTINCT 's' || l_suppkey AS src, CASE WHEN l_partkey % 6 > 0 THEN 'p' || l_partkey END AS dst FROM lineitem WHERE l_linenumber % 2 = 0 UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber % 2 = 1 AND l_partkey % 6 > 0""")
def tool_parse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, dst = F.concat(F.lit("s"), "l_suppkey"), F.when(F.col("l_partkey") % 6 > 0, F.concat(F.lit("p"), "l_partkey")).otherwise(" ")
    files = F.to_json(F.struct(F.array(F.struct(src.alias("file"), F.array(dst).alias("imports"))).alias("files")))
    odd = F.col("l_suppkey") % 2 == 0
    edges = F.to_json(F.struct(F.array(F.struct(F.when(odd, src).alias("source"), F.when(~odd, src).alias("from"), F.when(odd, dst).alias("to"), F.when(~odd, dst).alias("target"))).alias("edges")))
    return reports.graph_report(b.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, files).otherwise(edges).alias("value")))

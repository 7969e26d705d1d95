"""Queries on decisions, narrative, tests, and code of several languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import assessment, duplicates, factories, graph, languages, lifecycle, narrative, scan, scoring, testing
from quarry.plans import bindings as b
from quarry.plans.registry import query
from quarry.plans.state import _S as _SCORES
from quarry.session import settled, spread
from quarry.sources import python_code

_F, _C, _E = f"WITH {b.FINDINGS}", f"WITH {b.CORPUS}", f"WITH {b.FILE_EDGES}"


@query(f"{_F} SELECT id, CASE WHEN status = 'open' AND (detector = 'dupes') THEN 'wontfix' ELSE status END AS status, reopen_count FROM findings")
def resolve_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.resolve(b.findings(spark, sf_dir), "dupes", "wontfix").select("id", "status", "reopen_count")


@query(f"{_F} SELECT id, CASE WHEN starts_with(file, 'src/area2/') THEN 'open' ELSE status END AS status, reopen_count + (starts_with(file, 'src/area2/') AND status <> 'open')::INTEGER AS reopen_count FROM findings")
def reopen_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.resolve(b.findings(spark, sf_dir), "src/area2", "open").select("id", "status", "reopen_count")


@query(f"""{_F}, {b.SCANS}, d AS (SELECT id, detector, file FROM state WHERE id NOT IN (SELECT id FROM current WHERE status = 'open')), c AS (SELECT d.id, o.id AS other, row_number() OVER (PARTITION BY d.id ORDER BY o.id) AS r FROM d JOIN (SELECT * FROM findings WHERE status = 'open') o ON d.detector = o.detector AND d.file = o.file)
SELECT d.id, coalesce(max(n), 0) AS n, max(f) AS first_candidate FROM d LEFT JOIN (SELECT id, count(*) AS n, min(other) AS f FROM c WHERE r <= 5 GROUP BY id) x USING (id) GROUP BY d.id""")
def plan_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, current = b.two_scans(spark, sf_dir)
    alive = current.filter("status = 'open'")
    dead = state.join(alive, "id", "left_anti")
    known = dead.select("id", "detector", "file", F.lit("fixed").alias("status")).unionByName(b.findings(spark, sf_dir).filter("status = 'open'").select("id", "detector", "file", "status"))
    return lifecycle.reconcile(dead, known).select("id", F.size("candidates").cast("long").alias("n"), F.get("candidates", 0).alias("first_candidate"))


@query(f"{_F} SELECT dimension, string_agg(detector, ',' ORDER BY detector) AS detectors FROM (SELECT DISTINCT detector FROM findings WHERE status = 'open') JOIN (VALUES ('structural', 'design_coherence'), ('structural', 'abstraction_fitness'), ('smells', 'design_coherence'), ('smells', 'error_consistency'), ('dupes', 'convention_outlier')) AS m(detector, dimension) USING (detector) GROUP BY dimension")
def stale_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stale_dimensions(b.findings(spark, sf_dir).filter("status = 'open'"))


@query(f"""{_E}, imp AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM file_edges GROUP BY dst) SELECT path, coalesce(importers, 0) * 10 + loc // 50 AS priority FROM modules LEFT JOIN imp USING (path) WHERE loc >= 20""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.file_edges(spark, sf_dir).groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("importers"))
    return lifecycle.review_order(b.modules(spark, sf_dir).select("path", "loc"), e, b.findings(spark, sf_dir))


@query("""WITH s AS (SELECT source AS dimension, 50.0 + sum(quality) % 50 AS score, CASE WHEN sum(toxic) % 2 = 0 THEN 'holistic' ELSE 'per_file' END AS source FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 0 GROUP BY 1), i AS (SELECT source AS dimension, 90.0 + sum(quality) % 30 AS score, CASE WHEN sum(quality) % 2 = 0 THEN 'holistic' ELSE 'per_file' END AS source FROM labels JOIN documents USING (doc_id) WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT coalesce(s.dimension, i.dimension) AS dimension, CASE WHEN i.source IS NOT NULL AND (s.source IS NULL OR i.source = 'holistic' OR s.source <> 'holistic') THEN least(100.0, i.score) ELSE s.score END::DOUBLE AS score, CASE WHEN i.source IS NOT NULL AND (s.source IS NULL OR i.source = 'holistic' OR s.source <> 'holistic') THEN i.source ELSE s.source END AS source FROM s FULL JOIN i ON s.dimension = i.dimension""")
def assessments_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")

    def part(odd: int, base: int, span: int, by: str) -> DataFrame:
        agg = rows.filter(F.col("doc_id") % 2 == odd).groupBy(F.col("source").alias("dimension"))
        return agg.agg((base + F.sum("quality") % span).cast("double").alias("score"), F.when(F.sum(by) % 2 == 0, "holistic").otherwise("per_file").alias("source"))

    return lifecycle.store_assessments(part(0, 50, 50, "toxic"), part(1, 90, 30, "quality"))


@query("""WITH x AS (SELECT substr(sha1(substr(trim(p_name), 1, 200)), 1, 16) AS cluster, unnest([{'file': p_brand, 'start': p_size}, {'file': p_type, 'start': p_size + 1}]) AS f FROM part WHERE p_brand <> p_type), y AS (SELECT cluster, f.file AS file FROM x GROUP BY ALL) SELECT cluster, count(*) AS files, min(file) AS first_file FROM y GROUP BY cluster HAVING count(*) >= 2""")
def boilerplate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    return lifecycle.boilerplate(p.select(F.col("p_name").alias("fragment"), F.col("p_brand").alias("file_a"), F.col("p_size").alias("start_a"), F.col("p_type").alias("file_b"), (F.col("p_size") + 1).alias("start_b")))


@query(f"{_F}, {b.HISTORY}, h AS (SELECT *, lag(score_tenths) OVER (ORDER BY day) AS prev FROM history) SELECT day::VARCHAR AS day, mark::INTEGER AS mark FROM h, (VALUES (820), (800)) AS m(mark) WHERE score_tenths >= mark AND prev < mark")
def history_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.milestones(b.history(spark, sf_dir), (820, 800)).withColumn("day", F.col("day").cast("string"))


@query(f"{_SCORES} SELECT dimension, score FROM dims WHERE mode = 'strict' AND score < 100 ORDER BY score, dimension LIMIT 3")
def weakest_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.weakest(scoring.dimension_scores(scoring.detector_stats(b.findings(spark, sf_dir), b.potentials(spark, sf_dir))))


@query(f"""{_SCORES}, t AS (SELECT dimension, sum(potential)::BIGINT AS checks, sum(weighted) AS aw FROM stats JOIN policy USING (detector) WHERE mode = 'lenient' GROUP BY ALL),
g AS (SELECT s.detector, round(100 * (greatest((checks - (aw - s.weighted))::DOUBLE / checks, 0.0) - greatest((checks - aw)::DOUBLE / checks, 0.0)), 2) AS gain FROM stats s JOIN policy p USING (detector) JOIN t ON p.dimension = t.dimension WHERE mode = 'lenient'),
o AS (SELECT detector, count(*) AS n, CASE detector WHEN 'smells' THEN 'auto_fix' WHEN 'security' THEN 'manual_fix' ELSE 'refactor' END AS action FROM findings WHERE status = 'open' GROUP BY detector)
SELECT row_number() OVER (ORDER BY CASE action WHEN 'auto_fix' THEN 1 WHEN 'refactor' THEN 3 ELSE 4 END, gain DESC, detector)::INTEGER AS priority, detector, action, n, gain FROM o JOIN g USING (detector)""")
def narrative_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.findings(spark, sf_dir)
    counts = f.filter("status = 'open'").groupBy("detector").agg(F.count("*").alias("n"))
    return narrative.actions(counts, scoring.impact(scoring.detector_stats(f, b.potentials(spark, sf_dir))))


@query(f"{_F} SELECT string_agg(DISTINCT detector, ',' ORDER BY detector) AS lane, count(DISTINCT detector)::INTEGER AS detectors, count(DISTINCT file) AS files FROM findings WHERE status = 'open' AND NOT suppressed AND file <> '.'")
def narrative_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On these tables all detectors share files, so there is one lane."""
    return narrative.lanes(b.findings(spark, sf_dir))


@query(f"""{_F}, p AS (SELECT file, count(*) FILTER (smell_id = 'smell_1') AS smell_1, count(*) FILTER (smell_id = 'smell_4') AS smell_4 FROM findings WHERE detector = 'smells' AND status = 'open' AND smell_id IN ('smell_1', 'smell_4') GROUP BY file)
SELECT file, smell_1, smell_4, smell_1 + smell_4 AS total FROM p WHERE smell_1 + smell_4 >= 2 ORDER BY total DESC, file LIMIT 20""")
def evidence_error_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.smell_hotspots(b.findings(spark, sf_dir).filter("detector = 'smells' and status = 'open'"), ("smell_1", "smell_4"), least=2)


@query(f"""{_C}, l AS (SELECT path, content, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END AS ls FROM corpus), s AS (SELECT path, len(list_filter(ls, lambda x: regexp_matches(x, '^[A-Z][a-z]+[.]'))) / len(ls) AS comments, len(regexp_extract_all(content, '(?m)tion')) / greatest(len(regexp_extract_all(content, '(?m)the ')), 1) AS logs,
len(regexp_extract_all(content, '(?m)ing[.]')) / greatest(len(regexp_extract_all(content, '(?m)the ')), 1) AS guards FROM l WHERE len(ls) > 0) SELECT *, ((comments > 0.3)::INT + (logs > 3)::INT + (guards > 2)::INT)::INTEGER AS signals FROM s""")
def style_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.style_signals(b.corpus(spark, sf_dir), r"^[A-Z][a-z]+[.]", "tion", "the ", "ing[.]")


@query(f"""{_C}, c AS (SELECT count(*) FILTER (contains(content, 'token = ')) AS a, count(*) FILTER (contains(content, 'icensed under')) AS z, count(*) FILTER (contains(content, 'xyzzy')) AS q FROM corpus) SELECT 'secrets' AS pair, a AS old, z AS new FROM c WHERE a > 0 AND z > 0 UNION ALL SELECT 'none', q, z FROM c WHERE q > 0 AND z > 0""")
def migration_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.mixed_patterns(b.corpus(spark, sf_dir), {"secrets": ("token = ", "icensed under"), "none": ("xyzzy", "icensed under")})


@query(f"""WITH RECURSIVE {b.FILE_EDGES}, tests AS (SELECT path FROM modules WHERE contains(path, '/t5/')), direct AS (SELECT DISTINCT e.dst AS path FROM file_edges e WHERE e.src IN (SELECT path FROM tests) AND e.dst NOT IN (SELECT path FROM tests)), plain AS (SELECT src, dst FROM file_edges WHERE dst NOT IN (SELECT path FROM tests)),
w(path) AS (SELECT path FROM direct UNION SELECT p.dst FROM w JOIN plain p ON w.path = p.src) SELECT path, CASE WHEN path IN (SELECT path FROM direct) THEN 'direct' WHEN path IN (SELECT path FROM w) THEN 'transitive' ELSE 'untested' END AS kind FROM modules WHERE path NOT IN (SELECT path FROM tests)""")
def coverage_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.modules(spark, sf_dir)
    tests = m.filter(F.contains("path", F.lit("/t5/"))).select("path")
    quality = tests.withColumn("quality", F.lit("adequate"))
    return testing.coverage(m, b.file_edges(spark, sf_dir), tests, quality).select("path", "kind")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt out before modules are made of them."""
    return spread(b.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each part, of code that its numbers decide."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.lit("import os\nfrom pkg.m"),
        (k * 7 % 50 + 1).cast("string"),
        F.lit(" import value\nLIMIT = "),
        (size % 4).cast("string"),
        F.lit("\n\ndef work_"),
        size.cast("string"),
        F.lit("(a, b=1"),
        F.when(k % 3 == 0, ", *rest").otherwise(""),
        F.lit("):\n    total = {'x': a, 'y': b, 'z': value}\n"),
        F.when(size % 5 == 0, "    try:\n        total['x'] += 1\n    except ValueError:\n        pass\n").otherwise(""),
        F.when(size % 7 == 0, "    import sys\n").otherwise(""),
        F.lit("    return total\n\nclass Part:\n"),
        F.when(size % 2 == 0, "    items = []\n").otherwise("    items = ()\n"),
        F.lit("    def run(self):\n        pass\n"),
    )
    return _parts(spark, sf_dir).select(F.concat(F.lit("pkg/m"), k, F.lit(".py")).alias("path"), text.alias("content"))


@query("""SELECT smell, count(*) AS files FROM (SELECT unnest(list_filter(['dead_function', CASE WHEN p_size % 2 = 0 THEN 'mutable_class_var' END, CASE WHEN p_size % 5 = 0 THEN 'silent_except' END, CASE WHEN p_size % 5 = 0 THEN 'empty_except' END, CASE WHEN p_size % 7 = 0 THEN 'deferred_import' END], lambda x: x IS NOT NULL)) AS smell FROM part) GROUP BY smell""")
def python_tree_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = python_code.smells(python_code.facts(_python_files(spark, sf_dir), ("smell",)))
    return found.groupBy(F.col("smell_id").alias("smell")).agg(F.count("*").alias("files"))


@query("""WITH f AS (SELECT 'work_' || p_size AS name, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a,b,rest' ELSE 'a,b' END AS sig FROM part UNION ALL SELECT 'run', p_partkey, '' FROM part) SELECT name, count(DISTINCT p_partkey) AS files, count(*) AS occurrences, count(DISTINCT sig) AS signatures, 1::BIGINT AS returns FROM f GROUP BY name HAVING count(DISTINCT p_partkey) >= 3 AND count(DISTINCT sig) >= 2""")
def python_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.signature_variance(python_code.functions(python_code.facts(_python_files(spark, sf_dir), ("function",))))


@query("SELECT 'pkg/m' || p_partkey || '.py' AS src, 'pkg/m' || (p_partkey * 7 % 50 + 1) || '.py' AS dst, false AS deferred FROM part WHERE p_partkey <> p_partkey * 7 % 50 + 1 AND p_partkey * 7 % 50 + 1 IN (SELECT p_partkey FROM part)")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _python_files(spark, sf_dir)
    return python_code.import_edges(python_code.facts(files, ("import",)), files)


@query("SELECT 'LIMIT' AS name, (p_size % 4)::VARCHAR AS value, count(*) AS files FROM part GROUP BY 2 HAVING count(*) > 1")
def python_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.duplicate_constants(python_code.facts(_python_files(spark, sf_dir), ("constant",)))


def _stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up module for each part: one in two rebinds a name that the next part's module imports, one in three has a mixin, and dicts have keys that are not read, misspelt or written twice."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.lit("from pkg.s"),
        (k + 1).cast("string"),
        F.lit(" import now\nnow = None\nseen = []\ndef put(x):\n"),
        F.when(k % 2 == 0, "    global now\n    now = x\n").otherwise("    now = x\n"),
        F.when(size % 3 == 0, "    seen.append(x)\n    seen.extend(x)\n").otherwise(""),
        F.lit("    d = {}\n    d['colour'] = 1\n    d['n'] = 2\n"),
        F.when(size % 4 == 0, "    d['n'] = 3\n").otherwise("    d['m'] = d['n']\n"),
        F.when(size % 5 == 0, "    return d['color'], d['n'], d['m']\n").otherwise("    return d['colour'], d['n'], d['m']\n"),
        F.when(k % 3 == 0, "class AMixin:\n    def f(self):\n        return self.a, self.b, self.c").otherwise("class A:\n    def f(self):\n        return self.a, self.b, self.c"),
        F.when(size % 2 == 0, ", self.d, self.e, self.g\n").otherwise("\n"),
    )
    return _parts(spark, sf_dir).select(F.concat(F.lit("pkg/s"), k, F.lit(".py")).alias("path"), text.alias("content"))


@query("""SELECT 'pkg/s' || p_partkey || '.py' AS path, 'now' AS name, 1::BIGINT AS changes, true AS rebound FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'pkg/s' || p_partkey || '.py', 'seen', 2, false FROM part WHERE p_size % 3 = 0""")
def python_mutable_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.mutable_globals(python_code.facts(_stateful(spark, sf_dir), ("global", "change"))).select("path", "name", "changes", "rebound")


@query("SELECT 'pkg/s' || p.p_partkey || '.py' AS path, 'now' AS name, 1 AS line, 'pkg.s' || q.p_partkey AS source FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1 WHERE q.p_partkey % 2 = 0")
def python_stale_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.stale_imports(settled(python_code.facts(_stateful(spark, sf_dir), ("global", "change", "import"))))


@query("SELECT 'pkg/s' || p_partkey || '.py' AS path, 'AMixin' AS name, CASE WHEN p_size % 2 = 0 THEN 'a,b,c,d,e,g' ELSE 'a,b,c' END AS wanted, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END AS tier, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM part WHERE p_partkey % 3 = 0")
def python_mixin_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.mixin_contracts(python_code.facts(_stateful(spark, sf_dir), ("mixin",))).select("path", "name", F.array_join("wanted", ",").alias("wanted"), "tier", "confidence")


@query("""WITH f AS (SELECT 'pkg/s' || p_partkey || '.py' AS path, p_size FROM part) SELECT path, 'overwritten_key' AS kind, 'n' AS key FROM f WHERE p_size % 4 = 0 UNION ALL SELECT path, 'phantom_read', 'm' FROM f WHERE p_size % 4 = 0
UNION ALL SELECT path, 'phantom_read', 'color' FROM f WHERE p_size % 5 = 0 UNION ALL SELECT path, 'dead_write', 'colour' FROM f WHERE p_size % 5 = 0 UNION ALL SELECT path, 'near_miss', 'colour~color' FROM f WHERE p_size % 5 = 0""")
def python_key_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.key_flow(python_code.facts(_stateful(spark, sf_dir), ("key",))).select("path", "kind", "key")


@query("""SELECT 'pkg/c' || p_partkey || '.py' AS path, 9::BIGINT AS functions, (CASE WHEN p_size % 2 = 0 THEN 9 ELSE 1 END)::BIGINT AS components, (CASE WHEN p_size % 3 = 0 THEN 9 ELSE 1 END)::BIGINT AS families, 0::BIGINT AS imports FROM part WHERE p_size % 2 = 0""")
def python_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up module of nine functions for each part, in a chain of calls or not."""
    size, i = F.col("p_size"), F.col("i")
    name = lambda n: F.concat(F.when(size % 3 == 0, F.concat(F.lit("w"), n)).otherwise("same"), F.lit("_f"), n)
    one = F.concat(F.lit("def "), name(i), F.lit("():\n    return "), F.when((size % 2 == 1) & (i < 8), F.concat(name(i + 1), F.lit("()"))).otherwise("1"), F.lit("\n\n"))
    rows = _parts(spark, sf_dir).select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select("p_partkey", F.struct("i", one.alias("t")).alias("x"))
    texts = rows.groupBy("p_partkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    files = texts.select(F.concat(F.lit("pkg/c"), "p_partkey", F.lit(".py")).alias("path"), F.concat(F.array_join(F.transform("xs", lambda x: x["t"]), ""), F.repeat(F.lit("# end\n"), 200)).alias("content"))
    return python_code.cohesion(python_code.facts(files, ("module", "calls")))


@query()
def script_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TypeScript catalogue over web pages; look-aheads have no counterpart in SQL."""
    pages = b.table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id", F.lit(".ts")).alias("path"), F.col("html").alias("content"))
    return scan.smells(pages, languages.TYPESCRIPT_SMELLS)


@query("""WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '\\n$', ''), chr(10))) AS line FROM pages) SELECT 'page' || page_id || '.ts' AS path, count(*) AS n FROM l WHERE regexp_matches(line, '\\b(?:eval|new\\s+Function)\\s*\\(|dangerouslySetInnerHTML|[.]innerHTML\\s*=') AND NOT regexp_matches(line, '^\\s*(?://|#|[*]|/[*])') GROUP BY 1""")
def script_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = b.table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id", F.lit(".ts")).alias("path"), F.col("html").alias("content"))
    return languages.line_rules(pages, languages.TYPESCRIPT_SECURITY).groupBy("path").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT source AS d, (sum(quality) * 7 % 130)::DOUBLE AS score, sum(toxic) % 5 = 0 AS ph, sum(toxic) % 7 = 0 AS pen FROM labels JOIN documents USING (doc_id) GROUP BY source), r AS (SELECT source AS d, count(*) AS issues FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY source)
SELECT d AS dimension, CASE WHEN ph OR pen THEN 0.0 ELSE least(100.0, score) END::DOUBLE AS score, 10 AS checks, coalesce(issues, 0) AS issues, ph AS placeholder FROM a LEFT JOIN r USING (d) UNION ALL SELECT 'never_seen', 0.0, 10, 0, true""")
def subjective_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    marks = rows.groupBy(F.col("source").alias("dimension")).agg((F.sum("quality") * 7 % 130).cast("double").alias("score"), (F.sum("toxic") % 5 == 0).alias("placeholder"), (F.sum("toxic") % 7 == 0).alias("penalised"))
    issues = rows.filter("toxic = 1").select(F.lit("review").alias("detector"), F.lit("open").alias("status"), F.col("source").alias("dimension"))
    return assessment.subjective(marks, issues, ("Never Seen",))


@query(f"{_F} SELECT CASE detector WHEN 'security' THEN 'Security' WHEN 'smells' THEN 'Code quality' END AS dimension, 0.5::DOUBLE AS confidence, detector AS detectors FROM (SELECT DISTINCT detector FROM findings WHERE detector IN ('security', 'smells'))")
def score_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("detector").isin("security", "smells")
    c = b.findings(spark, sf_dir).select("detector").distinct().select("detector", F.when(low, "reduced").otherwise("full").alias("status"), F.when(low, 0.5).otherwise(1.0).alias("confidence"))
    return assessment.confidence(c, scoring.policies(spark))


@query(f"{_E} SELECT path, importers, loc FROM modules JOIN (SELECT dst AS path, count(DISTINCT src) AS importers FROM file_edges GROUP BY dst) USING (path) WHERE importers >= 3 ORDER BY importers DESC, path LIMIT 10")
def context_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.hubs(b.modules(spark, sf_dir), b.file_edges(spark, sf_dir), least=3)


@query("WITH m AS (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1), x AS (SELECT 'r' || n_regionkey || '/n' || (c_custkey % 25) AS sa, 'r' || (c_nationkey % 5) || '/n' || c_nationkey AS da FROM customer JOIN nation ON n_nationkey = c_custkey % 25), g AS (SELECT sa AS src_area, da AS dst_area, count(*) AS links FROM x WHERE sa <> da GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src_area ORDER BY links DESC, dst_area) AS r FROM g) SELECT src_area, dst_area, links FROM r WHERE r <= 10 ORDER BY links DESC, src_area, dst_area LIMIT 20")
def context_coupling_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "customer").join(b.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_custkey") % 25)
    src = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), F.col("c_custkey") % 25, F.lit("/x"))
    dst = F.concat(F.lit("r"), F.col("c_nationkey") % 5, F.lit("/n"), "c_nationkey", F.lit("/y"))
    return assessment.coupling_matrix(c.select(src.alias("src"), dst.alias("dst")))


@query("SELECT source AS dimension, CASE WHEN toxic = 1 THEN 'open' ELSE 'fixed' END AS status, count(*) AS n, sum((r <= 30)::INT)::BIGINT AS recent FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM labels JOIN documents USING (doc_id)) GROUP BY ALL")
def review_issue_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return assessment.issue_history(rows.select(F.col("doc_id").alias("id"), F.col("source").alias("dimension"), F.when(F.col("toxic") == 1, "open").otherwise("fixed").alias("status"), F.col("n_chars").alias("last_seen")))


@query(f"""{_E}, n AS (SELECT dst AS path, count(DISTINCT src) AS n FROM file_edges GROUP BY dst) SELECT 'orphaned::' || path AS id, 'orphaned' AS detector, path AS file, 3 AS tier, 'medium' AS confidence, 'Nothing imports these ' || loc || ' lines' AS summary FROM modules WHERE loc >= 10 AND path NOT IN (SELECT path FROM n)
UNION ALL SELECT 'facade::' || path, 'facade', path, 2, CASE WHEN n IS NULL THEN 'high' ELSE 'medium' END, 'Only passes on imports, to ' || coalesce(n, 0) || ' files' FROM modules LEFT JOIN n USING (path) WHERE loc % 3 = 0 AND coalesce(n, 0) <= 2""")
def findings_of_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = b.modules(spark, sf_dir), b.file_edges(spark, sf_dir)
    alone = factories.from_orphans(graph.orphans(m, e))
    return alone.unionByName(factories.from_facades(graph.facades(m.withColumn("is_facade", F.col("loc") % 3 == 0), e)))


@query(f"""{_C}, l AS (SELECT path, unnest(CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END) AS line FROM corpus), m AS (SELECT path, count(*) AS n FROM l WHERE regexp_matches(line, '[*]{{3}}') GROUP BY path)
SELECT 'smells::' || path || '::marks' AS id, 'smells' AS detector, path AS file, 2 AS tier, 'medium' AS confidence, n || 'x marks' AS summary FROM m""")
def findings_of_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    rows = scan.numbered(b.corpus(spark, sf_dir).select("path", "content")).filter(line.rlike("[*]{3}")).groupBy("path").agg(F.count("*").alias("n"))
    return factories.from_smells(rows.select(F.lit("marks").alias("smell_id"), "path", F.lit("high").alias("severity"), "n"))

"""Queries on lines, duplicates, history of changes, retrieval, review and tool output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import word_set
from quarry.operators import duplicates, insight, scan
from quarry.operators.files import with_size
from quarry.plans import bindings as b
from quarry.plans.registry import query
from quarry.sources import tools

_C, _F, _E = f"WITH {b.CORPUS}", f"WITH {b.FINDINGS}", f"WITH {b.FILE_EDGES}"
_SPLIT = "CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END"
_LINES = f"lines AS (SELECT path, u.i AS line_no, ls[u.i] AS line FROM (SELECT path, {_SPLIT} AS ls FROM corpus), LATERAL unnest(range(1, len(ls) + 1)) AS u(i))"


@query(f"{_C}, {_LINES} SELECT path, line_no::INTEGER AS line_no, line FROM lines WHERE regexp_matches(line, '[Ll]icensed under|AKIA|token')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.grep(b.corpus(spark, sf_dir), "[Ll]icensed under|AKIA|token")


@query(f"{_C}, names AS (SELECT DISTINCT regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')[2] AS name FROM benchmark), w AS (SELECT path, unnest(list_distinct(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'))) AS name FROM corpus) SELECT name, path FROM w WHERE name IN (SELECT name FROM names)")
def grep_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = b.table(spark, sf_dir, "benchmark").select(F.get(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), 1).alias("name"))
    return scan.grep_names(b.corpus(spark, sf_dir), names)


@query(f"{_C} SELECT count(*) AS files FROM corpus WHERE regexp_matches(content, '\\btoken\\b')")
def grep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.count_files(b.corpus(spark, sf_dir), "token")


_SECRET = "password|passwd|secret|api_key|apikey|token|credentials|private_key|access_key|client_secret"


@query(f"""{_C}, {_LINES}, n AS (SELECT path, line_no, unnest(regexp_extract_all(line, '(?:^|[\\s,;(])(?:const|let|var|export)?\\s*([A-Za-z_]\\w*)\\s*[:=]\\s*"(.{{5,}}?)"', 1)) AS name FROM lines)
SELECT path, line_no::INTEGER AS line_no, 'secret_name' AS kind, name, 'high' AS severity FROM n WHERE regexp_matches(name, '(?i)({_SECRET})')
UNION ALL SELECT path, line_no::INTEGER, 'secret', 'AWS access key', 'critical' FROM lines WHERE regexp_matches(line, 'AKIA[0-9A-Z]{{16}}')""")
def security_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.security(b.corpus(spark, sf_dir).select("path", "content", F.lit("production").alias("zone")))


_SMELLS = (scan.Rule("smell", "shouting", "[A-Z]{3,}!!", "medium"), scan.Rule("smell", "long_number", "[0-9]{7,}", "low"), scan.Rule("smell", "marks", r"[*]{3}", "high"))


@query(f"""{_C}, {_LINES}, m AS (SELECT 'shouting' AS smell_id, 'medium' AS severity, path, line_no FROM lines WHERE regexp_matches(line, '[A-Z]{{3,}}!!') UNION ALL SELECT 'long_number', 'low', path, line_no FROM lines WHERE regexp_matches(line, '[0-9]{{7,}}')
    UNION ALL SELECT 'marks', 'high', path, line_no FROM lines WHERE regexp_matches(line, '[*]{{3}}')), r AS (SELECT *, row_number() OVER (PARTITION BY smell_id ORDER BY path, line_no) AS r FROM m)
SELECT smell_id, path, severity, count(*) AS n, array_to_string(list_sort(list(line_no))[1:10], ',') AS lines FROM r WHERE r <= 50 GROUP BY smell_id, path, severity""")
def smells_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.smells(b.corpus(spark, sf_dir).select("path", "content"), _SMELLS).withColumn("lines", F.array_join("lines", ","))


@query()
def python_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of Python smells over documents; look-behinds have no counterpart in SQL."""
    return scan.smells(b.corpus(spark, sf_dir).select("path", "content"))


_FAMILIES = {"shouting": "[A-Z]{4}!!", "tables": r"[|] [a-z]+ [|]", "secrets": "token = ", "licences": "[Ll]icensed under"}


@query(f"""{_C}, u AS (SELECT source AS area, path, unnest(list_filter(['shouting', 'tables', 'secrets', 'licences'], lambda n: CASE n WHEN 'shouting' THEN regexp_matches(content, '[A-Z]{{4}}!!') WHEN 'tables' THEN regexp_matches(content, '[|] [a-z]+ [|]') WHEN 'secrets' THEN contains(content, 'token = ') ELSE regexp_matches(content, '[Ll]icensed under') END)) AS family FROM corpus),
g AS (SELECT area, family, count(DISTINCT path) AS files FROM u GROUP BY ALL), f AS (SELECT family, count(*) AS areas FROM g GROUP BY family)
SELECT area, family, files, areas, (SELECT count(DISTINCT source) FROM corpus) >= 5 AND areas < 0.5 * (SELECT count(DISTINCT source) FROM corpus) AS outlier FROM g JOIN f USING (family)""")
def pattern_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.census(b.corpus(spark, sf_dir).select("path", "content", F.col("source").alias("area")), _FAMILIES, rare=0.5)


def _count(p: str) -> str:
    return f"len(list_filter(ls, lambda x: regexp_matches(x, '{p}')))"


_TESTS = """CASE WHEN doc_id % 5 = 0 THEN 'it placeholder' || chr(10) || 'expect(true).toBe(true);' || chr(10) || '# expect(y)' WHEN doc_id % 5 = 1 THEN content || chr(10) || 'it a' || chr(10) || 'expect( ''a'' ).toEqual("a")' || chr(10) || 'expect(b).toBe(b)' || chr(10) || '# expect(c)' ELSE content END"""


@query(f"""{_C}, k AS (SELECT path, regexp_replace({_TESTS}, '(?m)#.*$', '', 'g') AS content FROM corpus), l AS (SELECT path, content, {_SPLIT} AS ls FROM k),
c AS (SELECT path, content, {_count("[aeiou]the[a-z]|expect[(]")}::INTEGER AS asserts, {_count("tion[a-z]")}::INTEGER AS mocks, {_count("[0-9]{4}")}::INTEGER AS snapshots, len(regexp_extract_all(content, '(?m)^(?:[A-Z][a-z]+|it) '))::INTEGER AS functions,
    {_count("expect[(]true[)].toBe[(]true[)]|expect[(] .a. [)].toEqual[(].a.[)]")} AS same, regexp_matches(content, '(?i)\\b(coverage smoke|direct test coverage entry|placeholder)\\b') AS label FROM l)
SELECT path, asserts, mocks, snapshots, functions, CASE WHEN functions = 0 THEN 'no_tests' WHEN asserts = 0 THEN 'assertion_free' WHEN same > 0 AND (same >= asserts AND (label OR asserts <= functions) OR label AND same >= 0.5 * asserts) THEN 'placeholder_smoke'
    WHEN mocks > asserts THEN 'over_mocked' WHEN snapshots > 0 AND snapshots > asserts * 0.5 THEN 'snapshot_heavy' WHEN asserts / functions < 1 THEN 'smoke' WHEN asserts / functions >= 3 THEN 'thorough' ELSE 'adequate' END AS quality FROM c""")
def coverage_quality_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tests, two fifths of them with tests that compare a thing with itself."""
    tests = b.corpus(spark, sf_dir).select("path", F.expr(_TESTS.replace("chr(10)", "char(10)").replace("''", "\\'")).alias("content"))
    return scan.test_quality(tests, "[aeiou]the[a-z]|expect[(]", "tion[a-z]", "[0-9]{4}", "^(?:[A-Z][a-z]+|it) ", comments="(?m)#.*$")


@query(f"WITH {b.MODULES} SELECT count(*) AS files, round(sum(least(sqrt(loc), 50.0)))::BIGINT AS potential FROM modules WHERE node % 4 <> 0 AND loc >= 10")
def coverage_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.coverage_potential(b.modules(spark, sf_dir).withColumn("zone", F.when(F.col("node") % 4 == 0, "test").otherwise("production")))


@query(f"{_C}, h AS (SELECT md5(content) AS body_hash, doc_id, CASE WHEN content = '' THEN 0 ELSE len({_SPLIT}) END::INTEGER AS loc FROM corpus) SELECT body_hash, count(*) AS n, min(doc_id) AS first_id, min(loc) AS loc FROM h GROUP BY body_hash HAVING count(*) > 1")
def dupes_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact(b.corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("content").alias("body")))


@query()
def dupes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with nearly the same lines, copies too, and their classes; matching in order has no counterpart in SQL."""
    return duplicates.near_members(b.corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("content").alias("body")), threshold=0.8, min_loc=5)


@query("""WITH f AS (SELECT 'fn_' || p_size AS name, p_brand AS file, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('self', 'cls')), ',') AS sig, p_type AS returns FROM part)
SELECT name, count(DISTINCT file) AS files, count(*) AS occurrences, count(DISTINCT sig) AS signatures, count(DISTINCT returns) AS returns FROM f GROUP BY name HAVING count(DISTINCT file) >= 3 AND (count(DISTINCT sig) >= 2 OR count(DISTINCT returns) >= 2)""")
def signature_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    return duplicates.signature_variance(p.select(F.concat(F.lit("fn_"), "p_size").alias("name"), F.col("p_brand").alias("file"), F.split("p_name", " ").alias("params"), F.col("p_type").alias("returns")))


@query()
def dict_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as keys of literals."""
    rows = b.corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), word_set("content").alias("keys"))
    return duplicates.schema_drift(rows)


@query("""WITH w AS (SELECT doc_id AS id, lang AS dimension, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 3)) AS ws FROM documents)
SELECT x.dimension, x.id AS a, y.id AS b, len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))) AS likeness FROM w x JOIN w y ON x.dimension = y.dimension AND x.id < y.id AND least(len(x.ws), len(y.ws)) >= 0.8 * greatest(len(x.ws), len(y.ws)) AND len(x.ws) > 0
WHERE len(list_intersect(x.ws, y.ws)) >= 0.8 * len(list_distinct(list_concat(x.ws, y.ws)))""")
def review_merge_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as issues: those of one language with nearly the same words."""
    rows = b.corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("dimension"), word_set("content").alias("words"))
    return duplicates.review_pairs(rows.filter(F.size("words") > 0))


_NAMES = ["alpha", "beta", "gamma", "delta", "epsilon"]
_BODY = "'f(' || CASE WHEN p_size % 2 = 0 THEN 'alpha=alpha' ELSE 'alpha' END || ', ' || CASE WHEN p_size % 3 = 0 THEN 'beta=beta' ELSE 'beta + 1' END || ', ' || CASE WHEN p_size % 5 <> 0 THEN 'gamma = gamma' ELSE 'gamma, gamma' END || ', delta=delta, epsilon=epsilon)'"


@query(f"""WITH b AS (SELECT p_partkey AS id, {_BODY} AS body FROM part), x AS (SELECT id, body, unnest({_NAMES}) AS p FROM b),
m AS (SELECT id, count(*) AS total, count(*) FILTER (len(regexp_extract_all(body, '\\b' || p || '\\s*=\\s*' || p || '\\b')) > 0 AND 2 * len(regexp_extract_all(body, '\\b' || p || '\\s*=\\s*' || p || '\\b')) >= len(regexp_extract_all(body, '\\b' || p || '\\b'))) AS passed FROM x GROUP BY id)
SELECT id, total, passed, CASE WHEN passed >= 20 OR passed / total >= 0.8 THEN 4 ELSE 3 END AS tier, 'high' AS confidence FROM m WHERE passed >= 20 OR passed / total >= 0.8""")
def passthrough_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(*map(F.lit, _NAMES)).alias("params"), F.expr(_BODY).alias("body"))
    return duplicates.passthrough(f)


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.concat(F.lit("p"), "l_partkey").alias("file")).distinct()


_COMMITS = """commits AS (SELECT DISTINCT l_orderkey AS sha, 'p' || l_partkey AS file FROM lineitem), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY file) AS r FROM commits) WHERE r <= 40),
pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM top x JOIN top y ON x.sha = y.sha AND x.file < y.file GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {_COMMITS} SELECT * FROM pairs")
def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.temporal_pairs(_commits(spark, sf_dir))


@query(f"""WITH {_COMMITS}, e AS (SELECT a AS file, b AS neighbour, together FROM pairs UNION ALL SELECT b, a, together FROM pairs)
SELECT * FROM (SELECT file, neighbour, together, row_number() OVER (PARTITION BY file ORDER BY together DESC, neighbour)::INTEGER AS rank FROM e WHERE file IN (SELECT 'p' || p_partkey FROM part WHERE p_size <= 10)) WHERE rank <= 6""")
def temporal_ripple(spark: SparkSession, sf_dir: str) -> DataFrame:
    focus = b.table(spark, sf_dir, "part").filter("p_size <= 10").select(F.concat(F.lit("p"), "p_partkey").alias("file"))
    return insight.ripple(insight.temporal_pairs(_commits(spark, sf_dir)), focus)


def _gate_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = b.table(spark, sf_dir, "lineitem")
    found = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_linenumber")).alias("line"), (F.col("l_partkey") % 4 + 1).alias("tier"), F.lit("smells").alias("detector"), F.when(F.col("l_partkey") % 3 == 0, "fixed").otherwise("open").alias("status"))
    changed = li.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("file")).agg(F.min("l_linenumber").alias("start"), F.max("l_linenumber").alias("end"))
    return found, changed


_GATE = """found AS (SELECT l_orderkey AS file, CASE WHEN l_suppkey % 9 <> 0 THEN l_linenumber END AS line, l_partkey % 4 + 1 AS tier, CASE WHEN l_partkey % 3 = 0 THEN 'fixed' ELSE 'open' END AS status FROM lineitem WHERE l_returnflag = 'R'),
changed AS (SELECT l_orderkey AS file, min(l_linenumber) AS s, max(l_linenumber) AS e FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
hit AS (SELECT f.* FROM found f JOIN changed c ON f.file = c.file AND (f.line IS NULL OR f.line BETWEEN c.s AND c.e) WHERE status = 'open')"""


@query(f"WITH {_GATE} SELECT file, count(*) AS n, min(tier) AS worst FROM hit GROUP BY file")
def gate_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.on_changed(*_gate_inputs(spark, sf_dir)).groupBy("file").agg(F.count("*").alias("n"), F.min("tier").alias("worst"))


@query(f"WITH {_GATE} SELECT count(*) AS new, count(*) FILTER (tier <= 2) AS severe, count(*) FILTER (tier <= 1) AS critical, 0::BIGINT AS blocked, count(*) <= 3 AND count(*) FILTER (tier <= 2) = 0 AS passes FROM hit")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.gate(*_gate_inputs(spark, sf_dir))


@query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0)
SELECT query, id, round(c, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 24""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to each whose id is divisible by 100, of all."""
    v = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return insight.nearest(v, v.filter("id % 100 = 0"), 24).withColumn("score", F.round("score", 6))


@query(f"""{_C}, a AS (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS word FROM benchmark WHERE item_id % 100 = 0), q AS (SELECT query, word, count(*) AS q FROM a GROUP BY ALL), t AS (SELECT query, count(*) AS total FROM a GROUP BY query),
d AS (SELECT doc_id AS id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(content), '[a-z0-9_]{{2,}}')) AS word FROM corpus) GROUP BY ALL),
s AS (SELECT query, id, sum(least(n, q)) / any_value(total) AS score FROM d JOIN q USING (word) JOIN t USING (query) GROUP BY query, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 20""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with most words of each passage whose id is divisible by 100, of all."""
    passages = b.table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return insight.lexical(b.corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), "content"), passages, 20)


@query(f"""{_C}, c AS (SELECT path, u.i::INTEGER AS chunk_index, substr(content, u.i::INTEGER * 1560 + 1, 1800) AS content FROM (SELECT *, greatest(ceil((length(content) - 240) / 1560.0), 1)::INTEGER AS n FROM corpus WHERE content <> ''), LATERAL unnest(range(0, n)) AS u(i))
SELECT path, chunk_index, length(content)::INTEGER AS n_chars, substr(sha1(path || '::' || chunk_index || '::' || content), 1, 16) AS row_id FROM c WHERE trim(content) <> ''""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.chunked(b.corpus(spark, sf_dir)).select("path", "chunk_index", F.length("content").alias("n_chars"), "row_id")


@query(f"""{_C}, f AS (SELECT path, doc_id, content, len({_SPLIT}) AS loc FROM corpus), r AS (SELECT doc_id, quality, toxic FROM labels)
SELECT path, CASE WHEN r.doc_id IS NULL THEN 'unreviewed' WHEN toxic = 1 THEN 'changed' ELSE 'stale' END AS reason FROM f LEFT JOIN r USING (doc_id) WHERE loc >= 3 AND (r.doc_id IS NULL OR toxic = 1 OR quality = 0)""")
def review_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.corpus(spark, sf_dir)
    known = c.join(b.table(spark, sf_dir, "labels"), "doc_id").select("path", F.when(F.col("toxic") == 1, "other").otherwise(F.substring(F.sha2("content", 256), 1, 16)).alias("hash"), F.when(F.col("quality") == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp_ntz").alias("reviewed_at"))
    return insight.staleness(with_size(c), known, F.lit("2024-03-02").cast("timestamp_ntz"), min_loc=3)


_TOP = "findings WHERE status = 'open' AND NOT suppressed AND file <> '.'"


@query(f"{_F} SELECT file, count(DISTINCT detector) AS detectors, count(*) AS n FROM {_TOP} GROUP BY file HAVING count(DISTINCT detector) >= 2 ORDER BY detectors DESC, n DESC, file LIMIT 20")
def evidence_signal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.signal_density(b.findings(spark, sf_dir))


@query(f"{_F} SELECT file, count(*) AS n, count(*) FILTER (confidence = 'high') AS high FROM {_TOP} AND detector = 'security' GROUP BY file HAVING count(*) >= 3 ORDER BY n DESC, file LIMIT 20")
def evidence_security_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.security_hotspots(b.findings(spark, sf_dir))


@query("""WITH u AS (SELECT DISTINCT l_suppkey % 20 AS folder, l_suppkey AS file, l_partkey % 400 AS name FROM lineitem), f AS (SELECT DISTINCT folder, file FROM u), s AS (SELECT folder, count(*) AS n FROM f GROUP BY folder HAVING count(*) >= 3),
h AS (SELECT u.folder, name FROM u JOIN s USING (folder) GROUP BY u.folder, name, n HAVING count(*) >= 0.8 * n), w AS (SELECT folder, count(*) AS wanted FROM h GROUP BY folder), g AS (SELECT folder, file, count(*) AS has FROM u JOIN h USING (folder, name) GROUP BY ALL)
SELECT folder, file, wanted - coalesce(has, 0) AS missing FROM f JOIN w USING (folder) LEFT JOIN g USING (folder, file) WHERE wanted - coalesce(has, 0) > 0""")
def sibling_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = b.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("folder"), F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 400).alias("name"))
    return insight.sibling_outliers(li, share=0.8)


@query(f"""{_E}, a AS (SELECT *, array_to_string(string_split(path, '/')[1:2], '/') AS area FROM modules), x AS (SELECT array_to_string(string_split(src, '/')[1:2], '/') AS sa, array_to_string(string_split(dst, '/')[1:2], '/') AS da FROM file_edges)
SELECT area, count(*) AS files, sum(loc)::BIGINT AS loc, (SELECT count(*) FROM x WHERE sa = area AND da <> area) AS links_out, (SELECT count(*) FROM x WHERE da = area AND sa <> area) AS links_in FROM a GROUP BY area HAVING count(*) >= 2""")
def folder_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.folder_profiles(b.modules(spark, sf_dir), b.file_edges(spark, sf_dir))


@query("SELECT 'src/u' || user_id || '.py' AS file, (json_extract_string(props, '$.k'))::INTEGER AS line, event_type || ' failed: ' || event_id AS message FROM events WHERE event_id % 3 <> 0")
def tool_parse_gnu(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    place = F.concat(F.lit("src/u"), "user_id", F.lit(".py:"), k, F.when(F.col("event_id") % 2 == 0, ":7").otherwise(""), F.lit(": "), "event_type", F.lit(" failed: "), "event_id")
    return tools.gnu(b.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "nothing here").otherwise(place).alias("value")))


@query("SELECT 'f' || c_custkey || '.ts' AS file, (c_custkey % 90 + 1)::INTEGER AS line, c_mktsegment || ' \"bad\"' AS message FROM customer WHERE c_custkey % 5 <> 0")
def tool_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = b.table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("f"), key, F.lit(".ts"))
    odd, line, text = key % 2 == 1, key % 90 + 1, F.concat("c_mktsegment", F.lit(' "bad"'))
    item = F.struct(F.when(odd, name).alias("file"), F.when(~odd, name).alias("path"), F.when(odd, line).alias("line"), F.when(~odd, line.cast("string")).alias("row"), F.when(key % 5 != 0, text).alias("message"))
    return tools.flat_json(c.select(F.to_json(F.array(item)).alias("value")))


@query("SELECT o_orderkey AS diff, 'src/f' || o_custkey || '.py' AS file, (o_orderkey % 100 + 1)::INTEGER AS start, (o_orderkey % 100 + o_custkey % 4)::INTEGER AS \"end\" FROM orders WHERE o_custkey % 4 > 0 AND o_orderkey % 7 <> 0")
def diff_ranges_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key, cust = b.table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    size = F.when(cust % 4 == 1, "").otherwise(F.concat(F.lit(","), cust % 4))
    name = F.when(key % 7 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/src/f"), cust, F.lit(".py")))
    text = F.array(F.lit("diff --git"), F.lit("--- a/x"), name, F.concat(F.lit("@@ -3,2 +"), key % 100 + 1, size, F.lit(" @@ def f")), F.lit("+x"))
    return tools.diff_ranges(o.select(key.alias("diff"), F.posexplode(text).alias("line_no", "value")))

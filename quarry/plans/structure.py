"""Queries on files, folders and import graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import files, graph
from quarry.plans import bindings as b
from quarry.plans.registry import query
from quarry.session import small

_C, _P, _E = f"WITH {b.CORPUS}", f"WITH {b.PATHS}", f"WITH {b.FILE_EDGES}"
_LOC = "CASE WHEN content = '' THEN 0 ELSE len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) END"
_DIR = "CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_BASE = "string_split(path, '/')[-1]"
_RULES = (("vendor", ("/de/", "/third_party/")), ("generated", ("/es/",)), ("test", ("m.", "_test.py")), ("config", (".example.net",)), *files.COMMON_ZONES)


@query(f"""{_P} SELECT page_id, CASE WHEN contains('/' || path || '/', '/de/') THEN 'vendor' WHEN contains('/' || path || '/', '/es/') THEN 'generated' WHEN contains(path, 'm.') THEN 'test' WHEN contains({_BASE}, '.example.net') THEN 'config' ELSE 'production' END AS zone FROM paths""")
def zone_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.paths(spark, sf_dir).select("page_id", files.zone(F.col("path"), _RULES).alias("zone"))


@query(f"WITH {b.FINDINGS} SELECT id, zone, CASE WHEN zone = 'test' AND detector = 'structural' THEN 'low' ELSE confidence END AS confidence FROM findings WHERE NOT ((zone = 'generated' AND detector IN ('smells', 'dupes')) OR (zone = 'vendor' AND detector = 'security'))")
def zone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip = small(spark, [("generated", "smells"), ("generated", "dupes"), ("vendor", "security")], "zone string, detector string")
    down = small(spark, [("test", "structural")], "zone string, detector string")
    return files.zone_policy(b.findings(spark, sf_dir), skip, down).select("id", "zone", "confidence")


@query(f"{_P} SELECT page_id FROM paths WHERE NOT (list_contains(string_split(path, '/'), 'fr') OR len(list_filter(string_split(path, '/'), lambda x: starts_with(x, 'm.'))) > 0 OR contains(path, '/en/1') AND regexp_matches(path, '^[^/]*[.]com/en/1.*$'))")
def exclusion_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.paths(spark, sf_dir).filter(~files.excluded(F.col("path"), ("fr", "m.*", "*.com/en/1*"))).select("page_id")


@query(f"{_C} SELECT path, loc FROM (SELECT path, {_LOC}::INTEGER AS loc FROM corpus) WHERE loc > 20")
def corpus_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.large(b.corpus(spark, sf_dir), 20)


_SIGNALS = (files.Signal("capitals", r"^[A-Z]{3}", 2, 1), files.Signal("tables", r"\|", 1, 20), files.Signal("numbers", r"[0-9]{4,}", 3, 0))


@query(f"""{_C}, n AS (SELECT path, {_LOC}::INTEGER AS loc, greatest(len(regexp_extract_all(content, '(?m)^[A-Z]{{3}}')) - 1, 0)::INTEGER AS a, greatest(len(regexp_extract_all(content, '[|]')) - 20, 0)::INTEGER AS t, len(regexp_extract_all(content, '[0-9]{{4,}}'))::INTEGER AS d FROM corpus)
SELECT path, loc, a * 2 + t + d * 3 AS score, concat_ws(',', CASE WHEN a > 0 THEN 'capitals' END, CASE WHEN t > 0 THEN 'tables' END, CASE WHEN d > 0 THEN 'numbers' END) AS signals FROM n WHERE loc >= 3 AND a * 2 + t + d * 3 >= 6""")
def corpus_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.complexity(b.corpus(spark, sf_dir), _SIGNALS, threshold=6, min_loc=3)


@query(f"""WITH t AS (SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, sum(value)::BIGINT AS total FROM events GROUP BY user_id) SELECT user_id, concat_ws(',', CASE WHEN events >= 65 THEN 'events' END, CASE WHEN kinds >= 5 THEN 'kinds' END, CASE WHEN total >= 4000 THEN 'total' END) AS reasons FROM t WHERE (events >= 65)::INT + (kinds >= 5)::INT + (total >= 4000)::INT >= 2""")
def god_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.countDistinct("event_type").alias("kinds"), F.round(F.sum("value")).cast("long").alias("total"))
    return files.gods(t, {"events": 65, "kinds": 5, "total": 4000}).select("user_id", F.array_join("reasons", ",").alias("reasons"))


_CONV = """CASE WHEN s = '' THEN NULL WHEN contains(s, '-') AND lower(s) = s THEN 'kebab-case' WHEN regexp_matches(s, '^[\\p{Lu}]') AND NOT contains(s, '-') THEN 'PascalCase' WHEN regexp_matches(s, '^[\\p{Ll}]') AND regexp_matches(s, '[\\p{Lu}]') AND NOT contains(s, '-') THEN 'camelCase'
    WHEN contains(s, '_') AND lower(s) = s THEN 'snake_case' WHEN lower(s) = s AND regexp_matches(s, '[\\p{Ll}]') AND NOT contains(s, '-') THEN 'flat_lower' END"""
_NAMED = "CASE p_partkey % 7 WHEN 0 THEN lower(p_name) || '-part' WHEN 1 THEN 'part_' || p_partkey WHEN 2 THEN 'Part' || p_partkey WHEN 3 THEN 'Élan' || p_partkey WHEN 4 THEN p_partkey || '-2' WHEN 5 THEN '1' || p_partkey ELSE 'a.test' || p_partkey END"


@query(f"""WITH f AS (SELECT 'src/' || p_brand AS directory, regexp_replace(replace({_NAMED}, ' ', '-'), '[#]', '') AS s FROM part), c AS (SELECT directory, convention, count(*) AS n FROM (SELECT directory, {_CONV} AS convention FROM f) WHERE convention IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY n DESC, convention) AS r, sum(n) OVER (PARTITION BY directory)::BIGINT AS total, first(convention) OVER (PARTITION BY directory ORDER BY n DESC, convention) AS majority FROM c)
SELECT directory, majority, convention AS minority, n, total FROM r WHERE r > 1 AND n >= 5 AND n >= 0.15 * total""")
def naming_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 7 == 0, F.concat(F.lower("p_name"), F.lit("-part"))).when(key % 7 == 1, F.concat(F.lit("part_"), key)).when(key % 7 == 2, F.concat(F.lit("Part"), key))
    name = name.when(key % 7 == 3, F.concat(F.lit("Élan"), key)).when(key % 7 == 4, F.concat(key, F.lit("-2"))).when(key % 7 == 5, F.concat(F.lit("1"), key)).otherwise(F.concat(F.lit("a.test"), key))
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.regexp_replace(F.replace(name, F.lit(" "), F.lit("-")), "#", ""), F.lit(".ts"))
    return files.naming(b.table(spark, sf_dir, "part").select(path.alias("path")))


_FOLDERS = f"""own AS (SELECT {_DIR} AS directory, loc FROM paths), local AS (SELECT directory, count(*) AS files FROM own GROUP BY directory),
anc AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS child FROM (SELECT DISTINCT string_split(directory, '/') AS p FROM own WHERE directory <> ''), LATERAL unnest(range(1, len(p) + 1)) AS u(i)),
kids AS (SELECT directory, count(*) AS children FROM (SELECT CASE WHEN child LIKE '%/%' THEN regexp_replace(child, '/[^/]*$', '') ELSE '' END AS directory FROM anc) WHERE directory <> '' GROUP BY directory),
folders AS (SELECT coalesce(l.directory, k.directory) AS directory, coalesce(files, 0) AS files, coalesce(children, 0) AS children FROM local l FULL JOIN kids k ON l.directory = k.directory)"""
_UP = "CASE WHEN directory LIKE '%/%' THEN regexp_replace(directory, '/[^/]*$', '') ELSE '' END"


@query(f"""{_P}, {_FOLDERS}, sp AS (SELECT {_UP} AS parent, sum((files <= 1 AND children = 0)::INT) AS sparse FROM folders GROUP BY 1),
r AS (SELECT f.*, coalesce(sparse, 0) AS sparse, coalesce(p.children, 0) AS siblings FROM (SELECT *, {_UP} AS up FROM folders) f LEFT JOIN sp ON f.directory = sp.parent LEFT JOIN folders p ON f.up = p.directory)
SELECT directory, files, children, kind FROM (SELECT *, CASE WHEN files > 0 AND (files >= 6 OR children >= 4 OR files + 3 * children >= 9) THEN 'overload' WHEN children >= 8 AND sparse >= 6 AND sparse >= 0.7 * children THEN 'fragmented' WHEN string_split(directory, '/')[-1] IN ('en', 'fr') AND files + children = 1 AND siblings >= 10 THEN 'thin_wrapper' END AS kind FROM r) WHERE kind IS NOT NULL""")
def flat_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.flat_dirs(b.paths(spark, sf_dir), many=6, many_children=4, combined=9, thin=("en", "fr"))


@query(f"""{_P}, own AS (SELECT string_split({_DIR}, '/') AS p, loc FROM paths) SELECT array_to_string(p[1:i], '/') AS directory, count(*) AS files, sum(loc)::BIGINT AS loc, max(loc) AS largest FROM own, LATERAL unnest(range(0, len(p) + 1)) AS u(i) GROUP BY 1""")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.tree(b.paths(spark, sf_dir))


@query(f"{_P}, s AS (SELECT list_sort(list(loc)) AS l FROM paths) SELECT len(l)::BIGINT AS n, l[len(l) // 2 + 1] AS p50, l[len(l) * 9 // 10 + 1] AS p90, l[len(l) * 99 // 100 + 1] AS p99 FROM s")
def evidence_loc_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.loc_percentiles(b.paths(spark, sf_dir))


@query(f"""WITH {b.EDGES}, {b.MODULES}, o AS (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM edges GROUP BY 1), d AS (SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM modules LEFT JOIN o USING (node) LEFT JOIN i USING (node))
SELECT node, fan_in, fan_out, CASE WHEN fan_in + fan_out > 0 THEN round(fan_out / (fan_in + fan_out), 2) ELSE 0.0::DOUBLE END AS instability FROM d""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(b.modules(spark, sf_dir), b.edges(spark, sf_dir))


_S, _T = "src/shared/", "src/tools/"


@query(f"{_E} SELECT src, dst, string_split(dst, '/')[3] AS tool FROM file_edges WHERE starts_with(src, '{_S}') AND starts_with(dst, '{_T}')")
def graph_coupling_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling_violations(b.file_edges(spark, sf_dir), _S, _T)


@query(f"{_E} SELECT src, dst, string_split(src, '/')[3] AS from_tool, string_split(dst, '/')[3] AS to_tool FROM file_edges WHERE starts_with(src, '{_T}') AND starts_with(dst, '{_T}') AND string_split(src, '/')[3] <> string_split(dst, '/')[3]")
def graph_cross_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_tool(b.file_edges(spark, sf_dir), _T)


@query(f"{_E}, e AS (SELECT dst AS path, src, CASE WHEN starts_with(src, '{_T}') THEN string_split(src, '/')[3] END AS tool FROM file_edges WHERE starts_with(dst, '{_S}')) SELECT path, max(tool) AS tool, count(DISTINCT src) AS importers FROM e GROUP BY path HAVING count(DISTINCT tool) = 1 AND count(*) FILTER (tool IS NULL) = 0")
def graph_boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.boundary_candidates(b.file_edges(spark, sf_dir), _S, _T)


@query(f"{_E} SELECT path, loc FROM modules WHERE loc >= 10 AND NOT contains(path, '/t3/') AND path NOT IN (SELECT dst FROM file_edges)")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(b.modules(spark, sf_dir), b.file_edges(spark, sf_dir), entries=("/t3/",))


@query(f"{_E} SELECT path, loc, importer FROM modules JOIN (SELECT dst AS path, min(src) AS importer FROM file_edges GROUP BY dst HAVING count(DISTINCT src) = 1) USING (path) WHERE loc BETWEEN 20 AND 300")
def graph_single_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.single_use(b.modules(spark, sf_dir), b.file_edges(spark, sf_dir))


@query(f"{_E} SELECT path, coalesce(n, 0) AS importers FROM modules LEFT JOIN (SELECT dst AS path, count(DISTINCT src) AS n FROM file_edges GROUP BY dst) USING (path) WHERE loc % 3 = 0 AND coalesce(n, 0) <= 2")
def graph_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.facades(b.modules(spark, sf_dir).withColumn("is_facade", F.col("loc") % 3 == 0), b.file_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {b.EDGES}, e AS (SELECT src, dst FROM edges WHERE NOT deferred), r(a, z) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.z = e.src), s AS (SELECT x.a AS node, greatest(max(x.z), x.a) AS cycle FROM r x JOIN r y ON x.a = y.z AND x.z = y.a WHERE x.a <> x.z GROUP BY x.a)
SELECT node, cycle, count(*) OVER (PARTITION BY cycle) AS size FROM s""")
def graph_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(b.edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {b.EDGES}, w(node, depth) AS (SELECT DISTINCT src, 0 FROM edges WHERE src % 100 = 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON w.node = e.src WHERE w.depth < 60) SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node HAVING min(depth) > 0""")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.edges(spark, sf_dir)
    return graph.reach(e, e.filter("src % 100 = 0").select(F.col("src").alias("node")))


@query(f"""WITH RECURSIVE {b.EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, least(min(b), a) AS component FROM r GROUP BY a""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(b.edges(spark, sf_dir))

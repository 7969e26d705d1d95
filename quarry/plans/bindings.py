"""The engine's inputs as views of the analytic tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema

_DETECTOR = {"signup": "structural", "error": "smells", "click": "dupes", "view": "security", "purchase": "test_coverage"}
CUT = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: a finding for each event, its properties from the number in props and the user."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.create_map(*[F.lit(x) for kv in _DETECTOR.items() for x in kv])[F.col("event_type")]
    user, k = F.col("user_id"), F.col("k")
    file = F.concat(F.lit("src/area"), user % 7, F.lit("/user_"), user, F.lit(".py"))
    holistic = k % 11 == 0
    return e.select(
        F.concat_ws("::", kind, file, F.col("event_id")).alias("id"),
        kind.alias("detector"),
        F.when(holistic, F.lit(".")).otherwise(file).alias("file"),
        (k % 4 + 1).alias("tier"),
        _pick(("high", "medium", "low"), k % 3).alias("confidence"),
        _pick(schema.STATUSES, k % 5).alias("status"),
        _pick(schema.ZONES, user % 6).alias("zone"),
        F.when(F.col("event_id") % 2 == 0, "python").otherwise("typescript").alias("lang"),
        (k % 13 == 0).alias("suppressed"),
        ((k % 7 + 1) * 5 / 10).cast("decimal(10,1)").alias("loc_weight"),
        holistic.alias("holistic"),
        k.alias("detail_count"),
        (k % 3).alias("reopen_count"),
        F.col("ts").alias("first_seen"),
        F.concat(F.lit("smell_"), k % 9).alias("smell_id"),
        user.alias("user_id"),
        F.col("event_id"),
    )


FINDINGS = """findings AS (SELECT detector || '::' || path || '::' || event_id AS id, detector, CASE WHEN k % 11 = 0 THEN '.' ELSE path END AS file, k % 4 + 1 AS tier,
    ['high', 'medium', 'low'][k % 3 + 1] AS confidence, ['open', 'fixed', 'wontfix', 'false_positive', 'auto_resolved'][k % 5 + 1] AS status,
    ['production', 'test', 'config', 'generated', 'script', 'vendor'][user_id % 6 + 1] AS zone, CASE WHEN event_id % 2 = 0 THEN 'python' ELSE 'typescript' END AS lang,
    k % 13 = 0 AS suppressed, ((k % 7 + 1) * 0.5)::DECIMAL(10, 1) AS loc_weight, k % 11 = 0 AS holistic, k AS detail_count, k % 3 AS reopen_count, ts AS first_seen, 'smell_' || (k % 9) AS smell_id, user_id, event_id
    FROM (SELECT *, (json_extract_string(props, '$.k'))::INTEGER AS k, 'src/area' || (user_id % 7) || '/user_' || user_id || '.py' AS path,
        CASE event_type WHEN 'signup' THEN 'structural' WHEN 'error' THEN 'smells' WHEN 'click' THEN 'dupes' WHEN 'view' THEN 'security' WHEN 'purchase' THEN 'test_coverage' END AS detector FROM events))"""


def potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each detector looked at, by language."""
    return findings(spark, sf_dir).groupBy("lang", "detector").agg((F.count("*") * 2 + 7).alias("potential"))


POTENTIALS = "potentials AS (SELECT lang, detector, count(*) * 2 + 7 AS potential FROM findings GROUP BY ALL)"


def two_scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """State after a scan of the first half, and the findings of a scan of the second: one for each detector, user and smell, by its first event."""
    f = findings(spark, sf_dir).withColumn("file", F.concat(F.lit("src/area"), F.col("user_id") % 7, F.lit("/user_"), F.col("user_id"), F.lit(".py")))

    def scan(rows: DataFrame) -> DataFrame:
        first = rows.groupBy("detector", "file", "smell_id").agg(F.min_by(F.struct("tier", "confidence", "status", "zone", "lang", "suppressed", "reopen_count", "first_seen", "user_id"), "event_id").alias("f"))
        return first.select(F.concat_ws("::", "detector", "file", "smell_id").alias("id"), "detector", "file", "f.*")

    return scan(f.filter(F.col("first_seen") < CUT)), scan(f.filter(F.col("first_seen") >= CUT))


SCANS = f"""one AS (SELECT * REPLACE ('src/area' || (user_id % 7) || '/user_' || user_id || '.py' AS file) FROM findings),
firsts AS (SELECT detector || '::' || file || '::' || smell_id AS id, detector, file, first_seen < TIMESTAMP '{CUT}' AS old, arg_min({{'tier': tier, 'confidence': confidence, 'status': status, 'zone': zone, 'lang': lang, 'suppressed': suppressed, 'reopen_count': reopen_count, 'first_seen': first_seen, 'user_id': user_id}}, event_id) AS f FROM one GROUP BY ALL),
state AS (SELECT id, detector, file, f.tier AS tier, f.confidence AS confidence, f.status AS status, f.zone AS zone, f.lang AS lang, f.suppressed AS suppressed, f.reopen_count AS reopen_count, f.first_seen AS first_seen, f.user_id AS user_id FROM firsts WHERE old),
current AS (SELECT id, detector, file, f.tier AS tier, f.confidence AS confidence, f.status AS status, f.zone AS zone, f.lang AS lang, f.suppressed AS suppressed, f.reopen_count AS reopen_count, f.first_seen AS first_seen, f.user_id AS user_id FROM firsts WHERE NOT old)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events as scans, with a score in tenths and counts of raw and ignored findings."""
    f = findings(spark, sf_dir)
    return f.groupBy(F.to_date("first_seen").alias("day")).agg(
        F.count("*").alias("raw_findings"), F.sum(F.col("suppressed").cast("long")).alias("ignored"), (F.sum(F.when(F.col("status") == "open", 0).otherwise(1)) * 1000 / F.count("*")).cast("long").alias("score_tenths")
    )


HISTORY = "history AS (SELECT first_seen::DATE AS day, count(*) AS raw_findings, sum(suppressed::INTEGER)::BIGINT AS ignored, (sum(CASE WHEN status = 'open' THEN 0 ELSE 1 END) * 1000 // count(*))::BIGINT AS score_tenths FROM findings GROUP BY ALL)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id")).alias("path"), F.col("text").alias("content"), "doc_id", "lang", "source")


CORPUS = "corpus AS (SELECT source || '/' || lang || '/' || doc_id AS path, text AS content, doc_id, lang, source FROM documents)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: host and path of their address, without query and fragment."""
    p = F.regexp_extract("url", r"^https?://([^?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(p, "/$", "").alias("path"), F.length("html").cast("long").alias("loc"))


PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/$', '') AS path, length(html)::BIGINT AS loc FROM pages)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as imports between orders of one group of sixteen: of the larger by the smaller key from the first five lines, the other way from others; those of a seventh line are deferred."""
    key = F.col("l_orderkey")
    other = key - key % 16 + F.col("l_partkey") % 16
    up = F.col("l_linenumber") > 5
    pair = table(spark, sf_dir, "lineitem").select(F.when(up, F.least(key, other)).otherwise(F.greatest(key, other)).alias("src"), F.when(up, F.greatest(key, other)).otherwise(F.least(key, other)).alias("dst"), (F.col("l_linenumber") == 7).alias("deferred"))
    return pair.filter("src <> dst").groupBy("src", "dst").agg(F.bool_and("deferred").alias("deferred"))


EDGES = """edges AS (SELECT CASE WHEN up THEN least(k, o) ELSE greatest(k, o) END AS src, CASE WHEN up THEN greatest(k, o) ELSE least(k, o) END AS dst, bool_and(last) AS deferred
    FROM (SELECT l_orderkey AS k, l_orderkey - l_orderkey % 16 + l_partkey % 16 AS o, l_linenumber > 5 AS up, l_linenumber = 7 AS last FROM lineitem) WHERE k <> o GROUP BY 1, 2)"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: every fifth shared code, the others in one of six tools."""
    s = F.col("o_orderkey")
    path = F.when(s % 5 == 0, F.concat(F.lit("src/shared/m"), s, F.lit(".ts"))).otherwise(F.concat(F.lit("src/tools/t"), s % 6, F.lit("/m"), s, F.lit(".ts")))
    return table(spark, sf_dir, "orders").select(s.alias("node"), path.alias("path"), (s * 37 % 400).alias("loc"))


MODULES = "modules AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 5 = 0 THEN 'src/shared/m' || o_orderkey || '.ts' ELSE 'src/tools/t' || (o_orderkey % 6) || '/m' || o_orderkey || '.ts' END AS path, o_orderkey * 37 % 400 AS loc FROM orders)"


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges() between paths."""
    m = modules(spark, sf_dir)
    s, d = m.select(F.col("node").alias("src"), F.col("path").alias("src_path")), m.select(F.col("node").alias("dst"), F.col("path").alias("dst_path"))
    return edges(spark, sf_dir).join(s, "src").join(d, "dst").select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), "deferred")


FILE_EDGES = f"{EDGES}, {MODULES}, file_edges AS (SELECT s.path AS src, d.path AS dst, deferred FROM edges e JOIN modules s ON e.src = s.node JOIN modules d ON e.dst = d.node)"

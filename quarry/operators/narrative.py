"""What to tell about a project: milestones, weak dimensions, actions, lanes of work, and signals of how its code is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions.text import lines
from quarry.operators.graph import components


def milestones(history: DataFrame, marks: tuple[int, ...] = (900, 800)) -> DataFrame:
    """(day, mark) for each scan (day, score_tenths) that first reaches a mark after one below it."""
    w = Window.orderBy("day")  # a row for each scan
    rows = history.withColumn("before", F.lag("score_tenths").over(w))
    crossed = F.filter(F.array(*map(F.lit, marks)), lambda m: (F.col("score_tenths") >= m) & (F.col("before") < m))
    return rows.select("day", F.explode(crossed).alias("mark"))


def weakest(dimensions: DataFrame, most: int = 3) -> DataFrame:
    """(dimension, score) of the lowest strict scores below 100."""
    return dimensions.filter("mode = 'strict' and score < 100").select("dimension", "score").orderBy("score", "dimension").limit(most)


# The order of kinds of action.
ACTIONS = ("issue_queue", "auto_fix", "reorganize", "refactor", "manual_fix", "debt_review")


def actions(open_counts: DataFrame, gains: DataFrame) -> DataFrame:
    """(priority, detector, action, n, gain): detectors with open findings (detector, n), by kind of action, then by what fixing them gains (detector, gain), then by name."""
    kind = F.create_map(*[F.lit(x) for d in schema.DETECTORS for x in (d.name, d.action)])[F.col("detector")]
    place = F.create_map(*[F.lit(x) for i, a in enumerate(ACTIONS) for x in (a, i)])[F.col("action")]
    rows = open_counts.join(gains.select("detector", "gain"), "detector", "left").withColumns({"action": F.coalesce(kind, F.lit("manual_fix")), "gain": F.coalesce("gain", F.lit(0.0))})
    w = Window.orderBy(place, F.desc("gain"), "detector")  # a row for each detector
    return rows.select(F.row_number().over(w).alias("priority"), "detector", "action", "n", "gain")


def lanes(findings: DataFrame) -> DataFrame:
    """(lane, detectors, files): detectors whose open findings share files, put together; lanes can be worked on at a time."""
    rows = findings.filter("status = 'open' and not suppressed and file <> '.'").select("detector", "file").distinct()
    # Detectors are as few as the registry has, so links between them are too.
    ids = rows.select("detector").distinct().withColumn("n", F.xxhash64("detector"))
    marked = rows.join(F.broadcast(ids), "detector")
    first = marked.groupBy("file").agg(F.min("n").alias("dst"))
    links = marked.join(first, "file").select(F.col("n").alias("src"), "dst").distinct()
    found = components(links).join(ids, F.col("node") == F.col("n"))
    named = found.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("detector")), ",").alias("detectors"))
    files = rows.join(found.select("detector", "component"), "detector").groupBy("component").agg(F.countDistinct("file").alias("files"))
    return named.join(files, "component").select(F.col("detectors").alias("lane"), F.size(F.split("detectors", ",")).alias("detectors"), "files")


def style_signals(files: DataFrame, comment: str = r"^\s*(?:#|//|\*|/\*)", log: str = r"(?:console\.|log(?:ger|ging)?\.|print\()", function: str = r"(?:\bdef\s|\bfunction\b|=>)", guard: str = r"\bif\b.*\b(?:None|null|undefined)\b") -> DataFrame:
    """(path, comments, logs, guards, signals): shares of comment lines, and of logs and guards for each function, and how many are high."""
    text = F.col("content")
    n = F.size(lines("content"))
    count = lambda p: F.regexp_count(text, F.lit("(?m)" + p))
    per = F.greatest(count(function), F.lit(1))
    rows = files.filter(n > 0).select("path", (F.size(F.filter(lines("content"), lambda x: x.rlike(comment))) / n).alias("comments"), (count(log) / per).alias("logs"), (count(guard) / per).alias("guards"))
    high = (F.col("comments") > 0.3).cast("int") + (F.col("logs") > 3).cast("int") + (F.col("guards") > 2).cast("int")
    return rows.withColumn("signals", high)


def error_strategy(files: DataFrame) -> DataFrame:
    """(path, strategy): how files report errors: the kind with most marks, the first of equals, or mixed below six tenths; null without marks."""
    marks = {"throw": r"\b(?:throw\s+new|raise\s+\w)", "return_null": r"\breturn\s+(?:null|None|undefined)\b", "result_type": r"\b(?:Result|Either|Ok|Err)\b", "try_catch": r"\b(?:try\s*\{|try\s*:)"}
    rows = files.select("path", *[F.regexp_count("content", F.lit(p)).alias(n) for n, p in marks.items()])
    total = sum((F.col(n) for n in marks), F.lit(0))
    top = F.greatest(*marks)
    first = F.coalesce(*[F.when(F.col(n) == top, F.lit(n)) for n in marks])
    return rows.select("path", F.when(total == 0, None).when(top / total < 0.6, "mixed").otherwise(first).alias("strategy"))


def mixed_patterns(files: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(pair, old, new): files with the old and the new way of doing something, where both occur. One row for each pair."""
    rows = files.agg(*[F.count_if(F.col("content").rlike(p)).alias(f"{n}_{i}") for n, ps in pairs.items() for i, p in enumerate(ps)])
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"{n}_0").alias("old"), F.col(f"{n}_1").alias("new")) for n in pairs])).alias("x")
    return rows.select(table).select("x.*").filter("old > 0 and new > 0")


def mixed_extensions(files: DataFrame) -> DataFrame:
    """(stem, extensions) of files that exist with two endings."""
    p = r"^(.*)\.([^./]+)$"
    rows = files.filter(F.col("path").rlike(p)).select(F.regexp_extract("path", p, 1).alias("stem"), F.regexp_extract("path", p, 2).alias("ext"))
    return rows.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"), F.countDistinct("ext").alias("n")).filter("n >= 2").drop("n")


def smell_hotspots(smells: DataFrame, ids: tuple[str, ...], least: int = 3, most: int = 20) -> DataFrame:
    """(file, a column for each smell id, total) of files with three or more of some smells (file, smell_id)."""
    rows = smells.filter(F.col("smell_id").isin(*ids)).groupBy("file").pivot("smell_id", list(ids)).count().na.fill(0)
    return rows.withColumn("total", sum((F.col(i) for i in ids), F.lit(0))).filter(F.col("total") >= least).orderBy(F.desc("total"), "file").limit(most)


def complexity_hotspots(files: DataFrame, most: int = 20) -> DataFrame:
    """(path, weight) of files (path, loc, complexity, components, monsters): a hundredth of their lines, and their complexity, thrice their components and ten a monster function."""
    weight = F.col("loc") / 100 + F.col("complexity") + 3 * F.col("components") + 10 * F.col("monsters")
    return files.select("path", weight.alias("weight")).orderBy(F.desc("weight"), "path").limit(most)


def memory(commits: DataFrame, focus: DataFrame, most: int = 16) -> DataFrame:
    """(sha, at, files): the latest commits (sha, at, file) that touch a file in focus, with the number of such files."""
    rows = commits.join(focus.select("file").distinct(), "file", "left_semi").groupBy("sha", "at").agg(F.countDistinct("file").alias("files"))
    return rows.orderBy(F.desc("at"), "sha").limit(most)

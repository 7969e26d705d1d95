"""Output of linters and version control as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _entries(rows: DataFrame, file: Column, line: Column, message: Column) -> DataFrame:
    keep = [c for c in rows.columns if c == "source_id"]
    out = rows.select(*keep, F.coalesce(file, F.lit("")).alias("file"), F.coalesce(line, F.lit("0")).try_cast("int").alias("line"), F.coalesce(message, F.lit("")).alias("message"))
    return out.filter("file <> '' and message <> '' and line is not null")


def gnu(lines: DataFrame) -> DataFrame:
    """(file, line, message) of lines (value) of the form file:line: message, or with a column."""
    p = r"^(.+?):(\d+)(?::\d+)?:\s*(.+)$"
    part = lambda i: F.regexp_extract("value", p, i)
    return _entries(lines.filter(F.col("value").rlike(p)), F.trim(part(1)), part(2), F.trim(part(3)))


def _parsed(docs: DataFrame, schema: str) -> DataFrame:
    return docs.withColumn("j", F.from_json("value", schema))


def flat_json(docs: DataFrame) -> DataFrame:
    """Documents (value) that are arrays of objects, with the usual names of fields."""
    item = "struct<file:string,filename:string,path:string,line:string,line_no:string,row:string,message:string,text:string,reason:string>"
    rows = _parsed(docs, "array<string>").withColumn("e", F.explode("j")).withColumn("e", F.from_json("e", item))  # one by one, for odd ones among them
    some = lambda *names: F.coalesce(*[F.when(~F.col(f"e.{n}").isin("", "0"), F.col(f"e.{n}")) for n in names])
    return _entries(rows, some("file", "filename", "path"), some("line", "line_no", "row"), some("message", "text", "reason"))


def golangci(docs: DataFrame) -> DataFrame:
    rows = _parsed(docs, "struct<Issues:array<struct<Text:string,Pos:struct<Filename:string,Line:string>>>>").withColumn("e", F.explode("j.Issues"))
    return _entries(rows, F.col("e.Pos.Filename"), F.col("e.Pos.Line"), F.col("e.Text"))


def rubocop(docs: DataFrame) -> DataFrame:
    rows = _parsed(docs, "struct<files:array<struct<path:string,offenses:array<struct<message:string,location:struct<line:string>>>>>>").withColumn("f", F.explode("j.files")).withColumn("e", F.explode("f.offenses"))
    return _entries(rows, F.col("f.path"), F.col("e.location.line"), F.col("e.message"))


def cargo(lines: DataFrame) -> DataFrame:
    """Lines (value) of JSON; compiler messages with a place count, by their first line."""
    rows = _parsed(lines, "struct<reason:string,message:struct<rendered:string,message:string,spans:array<struct<file_name:string,line_start:string>>>>").filter("j.reason = 'compiler-message' and size(j.message.spans) > 0")
    text = F.coalesce(F.when(F.col("j.message.rendered") != "", F.col("j.message.rendered")), "j.message.message")
    return _entries(rows, F.col("j.message.spans")[0]["file_name"], F.col("j.message.spans")[0]["line_start"], F.trim(F.split(text, "\n")[0]))


def eslint(docs: DataFrame) -> DataFrame:
    rows = _parsed(docs, "array<struct<filePath:string,messages:array<struct<line:string,message:string>>>>").withColumn("f", F.explode("j")).withColumn("e", F.explode("f.messages"))
    return _entries(rows, F.col("f.filePath"), F.col("e.line"), F.col("e.message"))


PARSERS = {"gnu": gnu, "golangci": golangci, "json": flat_json, "rubocop": rubocop, "cargo": cargo, "eslint": eslint}


# Rules that the security scan of all languages has already.
BANDIT_OVERLAP = ("B105", "B106", "B107", "B501", "B502", "B503", "B504", "B505")


def bandit(docs: DataFrame) -> DataFrame:
    """(file, line, message, tier, confidence, rule) of a report. Confidence follows severity; findings that are low in both go, and those that the scan of all languages has."""
    rows = _parsed(docs, "struct<results:array<struct<filename:string,line_number:int,issue_text:string,issue_severity:string,issue_confidence:string,test_id:string>>>").select(F.explode("j.results").alias("e")).select("e.*")
    level = lambda c: F.upper(F.coalesce(c, F.lit("MEDIUM")))
    rows = rows.withColumns({"severity": level("issue_severity"), "sure": level("issue_confidence"), "rule": F.coalesce("test_id", F.lit(""))})
    rows = rows.filter((F.coalesce("filename", F.lit("")) != "") & ~F.col("rule").isin(*BANDIT_OVERLAP) & ~((F.col("severity") == "LOW") & (F.col("sure") == "LOW")))
    known = F.col("severity").isin("HIGH", "LOW")
    return rows.select(
        F.col("filename").alias("file"),
        F.coalesce("line_number", F.lit(0)).alias("line"),
        F.concat(F.lit("["), "rule", F.lit("] "), F.coalesce("issue_text", F.lit(""))).alias("message"),
        F.when(F.col("severity") == "HIGH", 4).otherwise(3).alias("tier"),
        F.when(known, F.lower("severity")).otherwise("medium").alias("confidence"),
        "rule",
    )


# Linter rules and the smells they stand for.
RUFF_SMELLS = {
    "B006": ("mutable_default", "high"),
    "B007": ("unused_loop_var", "medium"),
    "B023": ("func_in_loop", "high"),
    "B026": ("star_after_keyword", "high"),
    "B904": ("raise_without_from", "medium"),
    "BLE001": ("broad_except", "medium"),
    "E711": ("none_comparison", "medium"),
    "E712": ("bool_comparison", "low"),
    "E722": ("bare_except", "high"),
    "F403": ("star_import", "medium"),
    "PGH003": ("type_ignore", "medium"),
    "PLW0603": ("global_keyword", "medium"),
    "RUF012": ("mutable_class_var", "high"),
    "W605": ("invalid_escape", "medium"),
}


def ruff(docs: DataFrame) -> DataFrame:
    """(file, line, smell_id, severity) of a JSON report; other rules go."""
    rows = _parsed(docs, "array<struct<code:string,filename:string,location:struct<row:int>>>").select(F.explode("j").alias("e"))
    known = F.create_map(*[x for code, (smell, severity) in RUFF_SMELLS.items() for x in (F.lit(code), F.struct(F.lit(smell).alias("smell_id"), F.lit(severity).alias("severity")))])
    rows = rows.withColumn("s", F.try_element_at(known, F.col("e.code"))).filter("s is not null")
    return rows.select(F.col("e.filename").alias("file"), F.col("e.location.row").alias("line"), "s.*")


def diff_ranges(lines: DataFrame) -> DataFrame:
    """(file, start, end): ranges that a diff without context adds, from lines (diff, line_no, value). Hunks that only remove go; a file is the last one named before a hunk."""
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    named = F.when(F.col("value").startswith("+++ b/"), F.substring("value", 7, 10_000)).when(F.col("value").startswith("+++ /dev/null"), "")
    rows = lines.withColumn("file", F.last(named, ignorenulls=True).over(Window.partitionBy("diff").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("value").rlike(hunk) & (F.col("file") != ""))
    n = F.regexp_extract("value", hunk, 2)
    size = F.when(n == "", 1).otherwise(n.try_cast("int"))
    start = F.regexp_extract("value", hunk, 1).cast("int")
    return rows.select("diff", "file", start.alias("start"), (start + size - 1).alias("end")).filter(F.col("end") >= F.col("start"))


def git_log(lines: DataFrame) -> DataFrame:
    """(sha, file) of the output of log --name-only --format=commit:%H, from lines (log, line_no, value)."""
    sha = F.when(F.col("value").rlike("^commit:[0-9a-f]+$"), F.substring("value", 8, 64))
    rows = lines.withColumn("sha", F.last(sha, ignorenulls=True).over(Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("value") != "") & ~F.col("value").startswith("commit:") & F.col("sha").isNotNull()).select("sha", F.regexp_replace("value", r"^[./]+", "").alias("file")).distinct()

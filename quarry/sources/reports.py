"""Reports of further analysers as tables: unused names, layers, dead exports, copied fragments and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines that the tools print.
PYFLAKES_IMPORT = r"^(.+):(\d+):\d*\s+'([^']+)'\s+imported but unused"
PYFLAKES_VARIABLE = r"^(.+):(\d+):\d*\s+local variable '([^']+)' is assigned to but never used"
TSC_NAME = r"^(.+)\((\d+),(\d+)\): error TS6133: '(\S+)' is declared but its value is never read\."
TSC_IMPORT = r"^(.+)\((\d+),(\d+)\): error TS6192: All imports in import declaration are unused\."
CONTRACT = r"Broken contract '([^']+)'"
VIOLATION = r"^\s+(\S+)\s+(?:imports|->)\s+(\S+)\s*$"


def pyflakes(lines: DataFrame) -> DataFrame:
    """(file, line, name, category) of printed lines (value): unused imports, but for those of packages' own files, and unused variables."""
    v, imported = F.col("value"), F.col("value").rlike(PYFLAKES_IMPORT)
    part = lambda i: F.when(imported, F.regexp_extract(v, PYFLAKES_IMPORT, i)).otherwise(F.regexp_extract(v, PYFLAKES_VARIABLE, i))
    rows = lines.filter(imported | v.rlike(PYFLAKES_VARIABLE)).select(part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).alias("name"), F.when(imported, "imports").otherwise("vars").alias("category"))
    return rows.filter(~((F.col("category") == "imports") & F.col("file").endswith("__init__.py")))


def tsc_unused(lines: DataFrame) -> DataFrame:
    """(file, line, col, name) of printed lines (value): names that are never read, but for those that start with an underscore, and whole import declarations."""
    v, named = F.col("value"), F.col("value").rlike(TSC_NAME)
    part = lambda i: F.when(named, F.regexp_extract(v, TSC_NAME, i)).otherwise(F.regexp_extract(v, TSC_IMPORT, i))
    rows = lines.filter(named | v.rlike(TSC_IMPORT))
    rows = rows.select(part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("col"), F.when(named, F.regexp_extract(v, TSC_NAME, 4)).otherwise("(entire import)").alias("name"))
    return rows.filter(~F.col("name").startswith("_"))


def layers(reports: DataFrame) -> DataFrame:
    """(id, file, source_pkg, target_pkg, contract) of the import contracts that reports (id, lines) say are broken: each violation belongs to the last contract named before it. A report is one array of lines."""
    named = F.transform("lines", lambda x: F.regexp_extract(x, CONTRACT, 1))
    rows = reports.withColumn("named", named).select("id", "named", F.posexplode("lines").alias("i", "value"))
    rows = rows.filter(F.col("value").rlike(VIOLATION) & ~F.col("value").rlike(CONTRACT))
    before = F.filter(F.slice("named", F.lit(1), F.col("i") + 1), lambda x: x != "")
    rows = rows.withColumn("contract", F.try_element_at(before, F.lit(-1))).filter("contract is not null")
    source, target = F.regexp_extract("value", VIOLATION, 1), F.regexp_extract("value", VIOLATION, 2)
    return rows.select("id", F.concat(F.replace(source, F.lit("."), F.lit("/")), F.lit(".py")).alias("file"), F.element_at(F.split(source, r"\."), -1).alias("source_pkg"), target.alias("target_pkg"), "contract")


_EXPORT = "array<struct<name:string,pos:variant>>"


def knip(docs: DataFrame) -> DataFrame:
    """(file, name, line, kind) of the exports and types that JSON reports (value) list as unused; a line that a report doesn't give is 0."""
    body = F.from_json("value", f"struct<issues:array<struct<file:string,exports:{_EXPORT},types:{_EXPORT}>>>")
    rows = docs.select(F.explode(body["issues"]).alias("i")).filter("coalesce(i.file, '') <> ''")
    kinds = F.array(F.struct(F.lit("export").alias("kind"), F.col("i.exports").alias("of")), F.struct(F.lit("type").alias("kind"), F.col("i.types").alias("of")))
    rows = rows.select(F.col("i.file").alias("file"), F.explode(kinds).alias("k")).select("file", "k.kind", F.explode("k.of").alias("e"))
    pos = F.col("e.pos")
    line = F.coalesce(F.try_variant_get(pos, "$.start.line", "int"), F.try_variant_get(pos, "$.start", "int"), F.try_variant_get(pos, "$", "int"), F.lit(0))
    return rows.filter("coalesce(e.name, '') <> ''").select("file", F.col("e.name").alias("name"), line.alias("line"), "kind")


def copied_fragments(docs: DataFrame) -> DataFrame:
    """(id, files, lines, first_file, first_line) of the copied fragments that JSON reports (value) list, by the hash of their beginnings: those in two files at least; in a file, the least line counts."""
    place = "struct<name:string,start:int>"
    body = F.from_json("value", f"struct<duplicates:array<struct<lines:int,fragment:string,firstFile:{place},secondFile:{place}>>>")
    rows = docs.select(F.explode(body["duplicates"]).alias("d")).filter("d.firstFile.name <> d.secondFile.name")
    key = F.substring(F.sha1(F.substring(F.regexp_replace(F.coalesce("d.fragment", F.lit("")), r"^\s+|\s+$", ""), 1, 200)), 1, 16)
    rows = rows.select(key.alias("id"), F.col("d.lines").alias("lines"), F.explode(F.array("d.firstFile", "d.secondFile")).alias("f"))
    files = rows.groupBy("id", F.col("f.name").alias("file")).agg(F.min(F.coalesce("f.start", F.lit(0))).alias("line"), F.max("lines").alias("lines"))
    return files.groupBy("id").agg(F.count("*").alias("files"), F.max("lines").alias("lines"), F.min(F.struct("file", "line")).alias("first")).filter("files >= 2").select("id", "files", "lines", F.col("first.file").alias("first_file"), F.col("first.line").alias("first_line"))


def graph_report(docs: DataFrame) -> DataFrame:
    """(src, dst) of the import graphs in JSON reports (value): files with imports, or else edges with source or from, and target or to. A file without imports has a row without dst; blank names go."""
    body = F.from_json("value", "struct<files:array<struct<file:string,imports:array<string>>>,edges:array<struct<source:string,from:string,target:string,to:string>>>")
    rows = docs.select(body.alias("b"))
    some = lambda c: F.when(F.trim(c) != "", c)
    own = rows.filter("b.files is not null").select(F.explode("b.files").alias("f")).select(some(F.col("f.file")).alias("src"), F.explode_outer(F.filter(F.coalesce("f.imports", F.array().cast("array<string>")), lambda x: F.trim(x) != "")).alias("dst"))
    either = lambda a, b: some(F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b))
    edges = rows.filter("b.files is null").select(F.explode("b.edges").alias("e")).select(either(F.col("e.source"), F.col("e.from")).alias("src"), either(F.col("e.target"), F.col("e.to")).alias("dst")).filter("dst is not null")
    return own.unionByName(edges).filter("src is not null").distinct()

"""Imports and projects of further languages, by pattern, as links between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clean(path: Column) -> Column:
    """A path without . and with the folders that .. takes back gone."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))), "/")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _links(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").filter("src <> dst").select("src", "dst").distinct()


def _specs(files: DataFrame, pattern: str) -> DataFrame:
    return files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("spec"))


def dart(files: DataFrame, package: str = "") -> DataFrame:
    """(src, dst) of imports, exports and parts by relative path, or of the package itself, whose files are below lib."""
    rows = _specs(files, r"""(?m)^\s*(?:import|export|part)\s+['"]([^'"]+)['"]""")
    own = f"package:{package}/"
    target = F.when(F.col("spec").startswith(own), F.concat(F.lit("lib/"), F.substring("spec", len(own) + 1, 10_000))).when(~F.col("spec").rlike("^[a-z]+:"), _clean(F.concat_ws("/", _folder(F.col("src")), "spec")))
    return _links(rows.select("src", target.alias("dst")), files)


def gdscript(files: DataFrame) -> DataFrame:
    """(src, dst) of preloads, loads and extends by resource path."""
    rows = _specs(files, r"""(?:preload|load)\s*\(\s*['"]res://([^'"]+)['"]""").unionByName(_specs(files, r"""(?m)^\s*extends\s+['"]res://([^'"]+)['"]"""))
    return _links(rows.select("src", F.col("spec").alias("dst")), files)


def go(files: DataFrame, module: str) -> DataFrame:
    """(src, dst): files that import a package of the module, to every file of that package's folder."""
    rows = _specs(files, r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"$""").filter((F.col("spec") == module) | F.col("spec").startswith(module + "/"))
    rows = rows.select("src", F.substring("spec", len(module) + 2, 10_000).alias("folder"))
    homes = files.filter(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")).select(F.col("path").alias("dst"), _folder(F.col("path")).alias("folder"))
    return rows.join(homes, "folder").filter("src <> dst").select("src", "dst").distinct()


def projects(files: DataFrame) -> DataFrame:
    """(project, reference) of project files: references between projects by path, null for a project without one."""
    rows = files.filter(F.col("path").endswith(".csproj"))
    spec = F.explode_outer(F.regexp_extract_all("content", F.lit(r"""<ProjectReference\s+[^>]*Include\s*=\s*["']([^"']+)["']"""), F.lit(1))).alias("spec")
    rows = rows.select(F.col("path").alias("project"), spec)
    return rows.select("project", F.when(F.col("spec").isNotNull(), _clean(F.concat_ws("/", F.when(_folder(F.col("project")) != "", _folder(F.col("project"))), F.replace("spec", F.lit("\\"), F.lit("/"))))).alias("reference"))


def csharp(files: DataFrame) -> DataFrame:
    """(src, dst): files whose using names a namespace, or one above it, to the files that declare it, in their own project or one it refers to. A file belongs to the project in the nearest folder above."""
    code = files.filter(F.col("path").endswith(".cs"))
    homes = files.filter(F.col("path").endswith(".csproj")).select(F.col("path").alias("project"), _folder(F.col("path")).alias("home"))
    parts = F.split(_folder(F.col("path")), "/")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("home")))).alias("u")
    member = code.select("path", up).select("path", "u.*").join(homes, "home").groupBy("path").agg(F.max_by("project", "depth").alias("project"))
    code = code.join(member, "path", "left").withColumn("project", F.coalesce("project", F.lit("")))
    spaces = code.select(F.col("path").alias("dst"), F.col("project").alias("to"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*namespace\s+([\w.]+)"), F.lit(1))).alias("space"))
    names = F.split("space", r"\.")
    above = spaces.select("dst", "to", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "."))).alias("used"))
    uses = code.select(F.col("path").alias("src"), F.col("project").alias("from"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"), F.lit(1))).alias("used")).distinct()
    seen = projects(files).filter("reference is not null").select(F.col("project").alias("from"), F.col("reference").alias("to"))
    own = code.select(F.col("project").alias("from"), F.col("project").alias("to")).distinct()
    hit = uses.join(above, "used").join(seen.unionByName(own).distinct(), ["from", "to"], "left_semi")
    return hit.filter("src <> dst").select("src", "dst").distinct()

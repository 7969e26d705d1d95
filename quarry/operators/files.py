"""Files: zones, exclusions, sizes, names and folders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import basename, dirname, glob_regex, lines, stem

# Zone rules, the first match counts.
COMMON_ZONES = (
    ("vendor", ("/vendor/", "/third_party/", "/vendored/")),
    ("generated", ("/generated/", "/__generated__/")),
    ("test", ("/tests/", "/test/", "/fixtures/")),
    ("script", ("/scripts/", "/bin/")),
)
PYTHON_ZONES = (
    ("generated", ("/migrations/", "_pb2.py", "_pb2_grpc.py")),
    ("test", ("test_", "_test.py", "conftest.py", "/factories/")),
    ("config", ("setup.py", "setup.cfg", "pyproject.toml", "manage.py", "wsgi.py", "asgi.py", "settings.py", "config.py")),
    ("script", ("__main__.py", "/commands/")),
    *COMMON_ZONES,
)
# Folders that are never scanned.
NEVER = ("node_modules", ".git", "__pycache__", ".venv*", "venv*", "dist", "build", ".tox", "*.egg-info")


def zone_match(path: Column, pattern: str) -> Column:
    """A pattern's form says what it means: /folder/, .part of a name, beginning_, _ending, a whole file name, or else any part of a path."""
    base = basename(path)
    if pattern.startswith("/") and pattern.endswith("/"):
        return F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit(pattern))
    if pattern.startswith("."):
        return base.contains(pattern)
    if pattern.endswith("_"):
        return base.startswith(pattern)
    if pattern.startswith("_"):
        return base.endswith(pattern)
    ending = pattern.rpartition(".")[2]
    if "/" not in pattern and "." in pattern and ending.isalnum() and len(ending) <= 5:
        return base == pattern
    return path.contains(pattern)


def zone(path: Column, rules: tuple = COMMON_ZONES, override: Column | None = None) -> Column:
    out = F.lit("production")
    for name, patterns in reversed(rules):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | zone_match(path, p)
        out = F.when(hit, name).otherwise(out)
    return out if override is None else F.when(override.isin("production", "test", "config", "generated", "script", "vendor"), override).otherwise(out)


def excluded(path: Column, patterns: tuple[str, ...] = NEVER) -> Column:
    """Whether a part of the path is a pattern or matches it as a glob, the path matches one with a slash, or begins with it."""
    p = F.regexp_replace(path, r"^[./]+", "")
    out = F.lit(False)
    for e in patterns:
        regex = glob_regex(e)
        part = _any_part(p, regex)
        whole = p.rlike(regex) | p.startswith(e.rstrip("/") + "/") if "/" in e else F.lit(False)
        out = out | part | whole
    return out


def _any_part(path: Column, regex: str) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.rlike(regex))


def zone_policy(findings: DataFrame, skip: DataFrame, downgrade: DataFrame) -> DataFrame:
    """Findings without those whose (zone, detector) is in skip; those in downgrade have low confidence."""
    kept = findings.join(F.broadcast(skip), ["zone", "detector"], "left_anti")  # tables of the registry's size
    kept = kept.join(F.broadcast(downgrade.withColumn("down_", F.lit(True))), ["zone", "detector"], "left")
    return kept.withColumn("confidence", F.when(F.col("down_"), "low").otherwise(F.col("confidence"))).drop("down_")


def with_size(files: DataFrame) -> DataFrame:
    """files (path, content) with loc, the number of lines."""
    return files.withColumn("loc", F.size(lines("content")))


def large(files: DataFrame, threshold: int = 500) -> DataFrame:
    return with_size(files).filter(F.col("loc") > threshold).select("path", "loc")


@dataclass(frozen=True)
class Signal:
    """What a match of a pattern, in a whole text, beyond a threshold adds to a file's complexity; compute, a function of the text's column, counts instead of a pattern."""

    name: str
    pattern: str
    weight: int
    threshold: int
    compute: Callable[[Column], Column] | None = None

    def count(self, text: Column) -> Column:
        return self.compute(text) if self.compute else F.regexp_count(text, F.lit("(?m)" + self.pattern))


def deepest_indent(text: Column) -> Column:
    """How many units the deepest line is indented; a unit is the greatest common divisor of indents up to 16."""
    widths = F.transform(F.filter(lines(text), lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(F.replace(x, F.lit("\t"), F.lit("    ")), "^ *", 0)))

    def unit(w: Column) -> Column:
        small = F.array_distinct(F.filter(w, lambda n: n.between(1, 16)))
        # The divisor is at most 16, so each is tried.
        found = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(16)), lambda d: F.forall(small, lambda n: n % d == 0)))
        return F.when(F.size(small) == 0, 4).otherwise(found)

    return F.element_at(F.transform(F.array(widths), lambda w: F.coalesce(F.floor(F.array_max(w) / unit(w)), F.lit(0)).cast("int")), 1)


# Signals of Python files by pattern.
PYTHON_SIGNALS = (
    Signal("imports", r"^(?:import |from )", 1, 20),
    Signal("many_classes", r"^class\s+\w+", 3, 3),
    Signal("nested_comprehensions", r"\[[^\]]*\bfor\b[^\]]*\bfor\b[^\]]*\]|\{[^}]*\bfor\b[^}]*\bfor\b[^}]*\}", 2, 2),
    Signal("TODOs", r"#\s*(?:TODO|FIXME|HACK|XXX)", 2, 0),
    Signal("deep_nesting", "", 3, 4, deepest_indent),
)


def complexity(files: DataFrame, signals: tuple[Signal, ...], threshold: int = 15, min_loc: int = 50) -> DataFrame:
    """(path, loc, score, signals) of files with a signal and a score of the threshold at least. A signal's count beyond its threshold, times its weight, is added."""
    rows = with_size(files).filter(F.col("loc") >= min_loc)
    counts = {s.name: s.count(F.col("content")) for s in signals}
    rows = rows.withColumns({f"n_{n}": c for n, c in counts.items()})
    over = {s.name: F.greatest(F.col(f"n_{s.name}") - s.threshold, F.lit(0)) for s in signals}
    score = sum((over[s.name] * s.weight for s in signals), F.lit(0))
    named = F.array(*[F.when(over[s.name] > 0, F.lit(s.name)) for s in signals])
    rows = rows.select("path", "loc", score.alias("score"), F.array_join(F.filter(named, lambda x: x.isNotNull()), ",").alias("signals"))
    return rows.filter((F.col("score") >= threshold) & (F.col("signals") != ""))


def gods(classes: DataFrame, rules: dict[str, int], least: int = 2) -> DataFrame:
    """Classes (name, file, loc and a number for each rule) that reach two or more limits, with the reasons."""
    reasons = F.filter(F.array(*[F.when(F.col(c) >= n, F.lit(c)) for c, n in rules.items()]), lambda x: x.isNotNull())
    return classes.withColumn("reasons", reasons).filter(F.size("reasons") >= least)


def convention(name: Column) -> Column:
    """How a file's stem is written, if in a known way. Signs and digits have no case, so they break none."""
    lower = F.lower(name) == name
    dashed = name.contains("-")
    return (
        F.when(dashed & lower, "kebab-case")
        .when(name.rlike(r"^\p{Lu}") & ~dashed, "PascalCase")
        .when(name.rlike(r"^\p{Ll}") & name.rlike(r"\p{Lu}") & ~dashed, "camelCase")
        .when(name.contains("_") & lower, "snake_case")
        .when(lower & name.rlike(r"\p{Ll}") & ~dashed, "flat_lower")
    )


def naming(files: DataFrame, least: int = 5, share: float = 0.15) -> DataFrame:
    """(directory, majority, minority, n, total): ways of naming in a folder that five files and fifteen percent follow, beside the most frequent one; ties by name."""
    rows = files.select(dirname("path").alias("directory"), convention(stem("path")).alias("convention")).filter("convention is not null")
    counts = rows.groupBy("directory", "convention").agg(F.count("*").alias("n"))
    # A folder has five ways at most.
    w = Window.partitionBy("directory")
    ranked = counts.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "convention")), "total": F.sum("n").over(w), "majority": F.first("convention").over(w.orderBy(F.desc("n"), "convention"))})
    return ranked.filter((F.col("r") > 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("directory", "majority", F.col("convention").alias("minority"), "n", "total")


def folders(files: DataFrame) -> DataFrame:
    """(directory, files, children): files in a folder itself, and distinct folders in it; the root, an empty name, has no children."""
    own = files.select(dirname("path").alias("directory"))
    local = own.groupBy("directory").agg(F.count("*").alias("files"))
    parts = F.split("directory", "/")
    ancestors = own.filter("directory <> ''").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("child")).distinct()
    children = ancestors.select(dirname("child").alias("directory")).filter("directory <> ''").groupBy("directory").agg(F.count("*").alias("children"))
    rows = local.join(children, "directory", "full")
    return rows.select("directory", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("children", F.lit(0)).alias("children"))


def flat_dirs(files: DataFrame, many: int = 20, many_children: int = 10, combined: int = 30, thin: tuple[str, ...] = ("components", "utils", "lib", "src")) -> DataFrame:
    """(directory, files, children, kind): folders that hold too much, break into many sparse ones, or wrap one thing in a crowded parent."""
    f = folders(files)
    score = F.col("files") + 3 * F.col("children")
    sparse = f.select(dirname("directory").alias("parent"), ((F.col("files") <= 1) & (F.col("children") == 0)).cast("int").alias("s")).groupBy("parent").agg(F.sum("s").alias("sparse"))
    parents = f.select(F.col("directory").alias("p"), F.col("children").alias("siblings"))
    rows = f.join(sparse, F.col("directory") == F.col("parent"), "left").withColumn("up", dirname("directory")).join(parents, F.col("up") == F.col("p"), "left")
    sparse_n, siblings = F.coalesce("sparse", F.lit(0)), F.coalesce("siblings", F.lit(0))
    kind = (
        F.when((F.col("files") > 0) & ((F.col("files") >= many) | (F.col("children") >= many_children) | (score >= combined)), "overload")
        .when((F.col("children") >= 8) & (sparse_n >= 6) & (sparse_n >= 0.7 * F.col("children")), "fragmented")
        .when(basename("directory").isin(*thin) & (F.col("files") + F.col("children") == 1) & (siblings >= 10), "thin_wrapper")
    )
    return rows.withColumn("kind", kind).filter("kind is not null").select("directory", "files", "children", "kind")


def tree(files: DataFrame) -> DataFrame:
    """(directory, files, loc, largest): sums over everything below each folder, the root being an empty name."""
    parts = F.split("directory", "/")
    up = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    rows = files.withColumn("directory", dirname("path")).select(F.explode(up).alias("directory"), "loc")
    return rows.groupBy("directory").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.max("loc").alias("largest"))


def loc_percentiles(files: DataFrame) -> DataFrame:
    """One row: the sizes at places n // 2, n * 9 // 10 and n * 99 // 100 of all sizes in order. Places are found in counts by size, not by bringing rows together."""
    counts = files.groupBy("loc").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("loc")))
    total = counts.agg(F.sum("n").alias("total"))
    rows = upto.crossJoin(F.broadcast(total))  # one row
    at = lambda num, den: F.min(F.when(F.col("upto") > F.floor(F.col("total") * num / den), F.col("loc")))
    return rows.agg(F.max("total").alias("n"), at(1, 2).alias("p50"), at(9, 10).alias("p90"), at(99, 100).alias("p99"))

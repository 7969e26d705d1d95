"""Rules of languages other than Python, by pattern; the scans are those of scan.py and files.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import lines
from quarry.operators.files import Signal
from quarry.operators.scan import Rule

# Smells of TypeScript lines.
TYPESCRIPT_SMELLS = (
    Rule("smell", "empty_catch", r"catch\s*\([^)]*\)\s*\{\s*\}", "high"),
    Rule("smell", "any_type", r":\s*any\b|<\s*any\b|,\s*any\b(?=\s*(?:,|>))", "medium"),
    Rule("smell", "ts_ignore", r"//\s*@ts-(?:ignore|expect-error)", "medium"),
    Rule("smell", "ts_nocheck", r"^\s*//\s*@ts-nocheck", "high"),
    Rule("smell", "non_null_assert", r"\w+!\.", "low"),
    Rule("smell", "hardcoded_color", r"""(?:color|background|border|fill|stroke)\s*[:=]\s*['"]#[0-9a-fA-F]{3,8}['"]""", "medium"),
    Rule("smell", "hardcoded_rgb", r"rgba?\(\s*\d+", "medium"),
    Rule("smell", "magic_number", r"(?:===?|!==?|>=?|<=?|[+\-*/])\s*\d{4,}", "low"),
    Rule("smell", "hardcoded_url", r"""['"]https?://[^\s'"]+['"]""", "medium"),
    Rule("smell", "todo_fixme", r"//\s*(?:TODO|FIXME|HACK|XXX)", "low"),
    Rule("smell", "debug_tag", r"""(?:['"`])\[([A-Z][A-Z0-9_]{2,})\]\s""", "low"),
    Rule("smell", "voided_symbol", r"^\s*void\s+[a-zA-Z_]\w*\s*;?\s*$", "medium"),
    Rule("smell", "workaround_tag", r"//.*\[([A-Z][a-z]+(?:[A-Z][a-z]+)+)\]", "low"),
    Rule("smell", "as_any_cast", r"\bas\s+any\b", "medium"),
    Rule("smell", "sort_no_comparator", r"\.sort\(\s*\)", "medium"),
)

# Unsafe lines of TypeScript and C#.
TYPESCRIPT_SECURITY = (
    Rule("html", "dangerously_set_inner_html", r"dangerouslySetInnerHTML", "medium"),
    Rule("html", "innerHTML_assignment", r"\.innerHTML\s*=", "medium"),
    Rule("env", "dev_credentials_env", r"(?i)VITE_\w*(?:PASSWORD|SECRET|TOKEN|API_KEY|APIKEY)\b", "high"),
    Rule("redirect", "open_redirect", r"window\.location(?:\.href)?\s*=\s*(?:data\.|response\.|params\.|query\.|\w+\[)", "medium"),
    Rule("jwt", "unverified_jwt_decode", r"atob\s*\(", "high", also=r"""(?:payload\.sub|\.split\s*\(\s*['"]\\?\.['"])"""),
    Rule("eval", "eval_injection", r"\b(?:eval|new\s+Function)\s*\(", "high"),
)
CSHARP_SECURITY = (
    Rule("sql", "sql_interpolation", r'(?i)\b(?:SqlCommand|Execute(?:Reader|NonQuery|Scalar)?)\s*\([^)]*\$"', "high"),
    Rule("sql", "sql_concatenation", r"(?i)\b(?:SqlCommand|Execute(?:Reader|NonQuery|Scalar)?)\s*\([^)]*(?:\+|string\.Format)", "high"),
    Rule("random", "insecure_random", r"(?i)\bnew\s+Random\s*\(\s*\).*(?:token|password|secret|key|nonce|salt|otp)", "medium"),
    Rule("tls", "disabled_tls_verification", r"(?i)ServerCertificateValidationCallback\s*\+=\s*\([^)]*\)\s*=>\s*true", "high"),
    Rule("serial", "binary_formatter", r"(?i)\bBinaryFormatter\b|\bSoapFormatter\b", "high"),
)

# Complexity signals.
GO_SIGNALS = (
    Signal("if/else branches", r"\b(?:if|else\s+if|else)\b", 1, 25),
    Signal("switch/case", r"\b(?:switch|case)\b", 1, 10),
    Signal("select blocks", r"\bselect\b", 2, 5),
    Signal("for loops", r"\bfor\b", 1, 15),
    Signal("goroutines", r"\bgo\s+\w+", 2, 5),
)
DART_SIGNALS = (
    Signal("TODOs", r"//\s*(?:TODO|FIXME|HACK|XXX)", 2, 0),
    Signal("control flow", r"\b(?:if|else\s+if|switch|for|while|catch)\b", 1, 25),
    Signal("classes", r"^\s*(?:abstract\s+)?class\s+\w+", 2, 5),
)


def line_rules(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(path, line_no, kind, name, severity): what the rules find in each line that is not a comment."""
    line = F.col("line")
    rows = files.select("path", F.posexplode(lines("content")).alias("n", "line")).filter(~line.rlike(r"^\s*(?://|#|\*|/\*)"))
    found = F.array(*[F.when(r.hits(line), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"))) for r in rules])
    return rows.select("path", (F.col("n") + 1).alias("line_no"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("path", "line_no", "f.*")


def mixed_concerns(files: DataFrame, min_loc: int = 100, least: int = 3) -> DataFrame:
    """(path, concerns) of long component files that draw, fetch and transform at once."""
    text = F.col("content")
    found = {
        "jsx_rendering": text.rlike(r"return\s*\(?\s*<"),
        "data_fetching": text.rlike(r"useQuery|useMutation|supabase\.|fetch\(|axios"),
        "direct_supabase": text.rlike(r"supabase\.\w+\.\w+\.\w+"),
        "data_transforms": F.regexp_count(text, F.lit(r"\.(map|filter|reduce|sort|flatMap)\s*\(")) >= 3,
        "handlers": F.regexp_count(text, F.lit(r"(?:const|function)\s+handle\w+")) >= 5,
    }
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull())
    return files.filter(F.size(lines("content")) >= min_loc).select("path", names.alias("concerns")).filter(F.size("concerns") >= least)


def deprecated(files: DataFrame) -> DataFrame:
    """(path, symbol, importers): exported names after a deprecation mark, and the other files that mention them."""
    p = r"@deprecated[\s\S]{0,400}?export\s+(?:default\s+)?(?:async\s+)?(?:const|function|class|type|interface|let|var)\s+(\w+)"
    marked = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1)))).alias("symbol"))
    words = files.select(F.col("path").alias("user"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("symbol"))
    used = words.join(marked, "symbol").filter("user <> path").groupBy("path", "symbol").agg(F.countDistinct("user").alias("importers"))
    return marked.join(used, ["path", "symbol"], "left").na.fill(0, ["importers"])


def tagged_logs(files: DataFrame) -> DataFrame:
    """(path, n, tags): console lines with a tag in brackets, by file."""
    tag = r"""console\.\w+\(\s*['"`]\[([^\]]+)\]"""
    rows = files.select("path", F.regexp_extract_all("content", F.lit(tag), F.lit(1)).alias("t")).filter(F.size("t") > 0)
    return rows.select("path", F.size("t").alias("n"), F.array_join(F.array_sort(F.array_distinct("t")), ",").alias("tags"))


def script_imports(files: DataFrame) -> DataFrame:
    """(src, dst, dynamic): imports between script files by relative path or the @/ alias of src/, with the endings the language tries."""
    p = r"""(?:from|import|require)\s*(\()?\s*['"]([^'"]+)['"]"""
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("call"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("spec"))
    rows = files.select(F.col("path").alias("src"), F.explode(both).alias("x")).select("src", "x.spec", (F.col("x.call") == "(").alias("dynamic"))
    folder = F.regexp_replace("src", r"/?[^/]*$", "")
    whole = F.when(F.col("spec").startswith("@/"), F.regexp_replace("spec", "^@/", "src/")).when(F.col("spec").startswith("."), F.concat_ws("/", F.when(folder != "", folder), "spec"))
    # Folders that .. takes back go with it.
    parts = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    clean = F.aggregate(parts, empty, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    rows = rows.withColumn("base", F.array_join(clean, "/")).filter("base is not null").withColumn("k", F.monotonically_increasing_id())
    ends = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("base", F.lit(e)).alias("dst")) for i, e in enumerate(("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"))])
    hit = rows.select("k", "src", "dynamic", F.explode(ends).alias("e")).select("k", "src", "dynamic", "e.*").join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    best = hit.groupBy("k", "src", "dynamic").agg(F.min_by("dst", "rank").alias("dst"))
    return best.filter("src <> dst").groupBy("src", "dst").agg(F.bool_and("dynamic").alias("dynamic"))

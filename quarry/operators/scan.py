"""Line scans: search, security rules and smells by pattern. Rules unroll into columns, so a line is read once for all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import lines


def numbered(files: DataFrame) -> DataFrame:
    """(path, line_no, line, and the other columns of files but content), a row for each line."""
    rest = [c for c in files.columns if c not in ("path", "content")]
    return files.select("path", *rest, F.posexplode(lines("content")).alias("n", "line")).withColumn("line_no", F.col("n") + 1).drop("n")


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line_no, line) of lines with a match."""
    return numbered(files).filter(F.col("line").rlike(pattern)).select("path", "line_no", "line")


def grep_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path) for every name (a word) in names and every file it occurs in, as a word. Words of files meet names in a join, whatever the number of names."""
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?U)\w+"), F.lit(0)))).alias("name"))
    return words.join(names.select("name").distinct(), "name", "left_semi").select("name", "path")


def count_files(files: DataFrame, word: str) -> DataFrame:
    """One row: how many files have the word."""
    return files.filter(F.col("content").rlike(rf"(?U)\b\Q{word}\E\b")).agg(F.count("*").alias("files"))


@dataclass(frozen=True)
class Rule:
    kind: str
    name: str
    pattern: str
    severity: str = "high"
    also: str | None = None
    hint: str = ""

    def hits(self, line: Column) -> Column:
        """Whether a line matches; a hint, a string in every match, spares most lines the pattern."""
        out = line.rlike(self.pattern)
        out = line.contains(self.hint) & out if self.hint else out
        return out & line.rlike(self.also) if self.also else out


# Patterns of secrets and unsafe calls.
SECRET_FORMATS = (
    Rule("secret", "AWS access key", r"AKIA[0-9A-Z]{16}", "critical", hint="AKIA"),
    Rule("secret", "GitHub token", r"gh[ps]_[A-Za-z0-9_]{36,}", "critical", hint="gh"),
    Rule("secret", "Private key block", r"-----BEGIN\s+(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "critical", hint="PRIVATE KEY"),
    Rule("secret", "Stripe key", r"[sr]k_(?:live|test)_[0-9a-zA-Z]{20,}", hint="k_"),
    Rule("secret", "Slack token", r"xox[bpas]-[0-9a-zA-Z-]+", hint="xox"),
    Rule("secret", "JWT token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "medium", hint="eyJ"),
    Rule("secret", "Database connection string with password", r"(?:postgres|mysql|mongodb|redis)://\w+:[^@\s]{3,}@", "critical", hint="://"),
)
UNSAFE = (
    Rule("random", "insecure random", r"(?:Math\.random|random\.random|random\.randint)\s*\(", "medium", also=r"(?i)(?:token|key|nonce|session|salt|secret|password|otp|csrf|auth)", hint="random"),
    Rule("crypto", "TLS verification disabled", r"verify\s*=\s*False", hint="verify"),
    Rule("crypto", "Unverified SSL context", r"ssl\._create_unverified_context\s*\(", hint="ssl._create"),
    Rule("crypto", "TLS rejection disabled", r"rejectUnauthorized\s*:\s*false", hint="rejectUnauthorized"),
    Rule("crypto", "TLS rejection disabled via env", r"NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]0['\"]", hint="NODE_TLS"),
    Rule(
        "log",
        "sensitive data in log",
        r"(?:console\.(?:log|warn|error|info|debug)|log(?:ger)?\.(?:info|debug|warning|error|critical)|logging\.(?:info|debug|warning|error|critical)|\bprint)\s*\(",
        "medium",
        also=r"(?i)(?:password|token|secret|api_key|apikey|credentials|private_key|access_key|authorization)",
        hint="(",
    ),
)
SECRET_NAME = r"(?i)(?:password|passwd|secret|api_key|apikey|token|credentials|auth_token|private_key|access_key|client_secret|secret_key)"
ASSIGNED = r"""(?:^|[\s,;(])(?:const|let|var|export)?\s*([A-Za-z_]\w*)\s*[:=]\s*(['"`])(.+?)\2"""
PLACEHOLDERS = ("", "changeme", "xxx", "yyy", "zzz", "placeholder", "test", "example", "dummy", "none", "null", "undefined", "todo", "fixme")
PLACEHOLDER_STARTS = ("your-", "your_", "<", "${", "{{")
ENVIRONMENT = ("os.environ", "os.getenv", "process.env.", "import.meta.env")


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*(?://|#|\*|/\*)")


def named_secrets(line: Column) -> Column:
    """Names that a line assigns a literal to, where name and literal look like a secret."""
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(ASSIGNED), F.lit(1)).alias("name"), F.regexp_extract_all(line, F.lit(ASSIGNED), F.lit(3)).alias("value"))

    def real(p: Column) -> Column:
        low = F.trim(F.lower(p["value"]))
        out = p["name"].rlike(SECRET_NAME) & ~low.isin(*PLACEHOLDERS) & (F.length(p["value"]) >= 5)
        for start in PLACEHOLDER_STARTS:
            out = out & ~low.startswith(start)
        return out

    environment = F.lit(False)
    for e in ENVIRONMENT:
        environment = environment | line.contains(e)
    # Most lines have neither such a word nor a literal after a sign, and are not taken apart.
    plausible = line.rlike("""[:=]\\s*['"`]""") & line.rlike(SECRET_NAME)
    return F.when(environment | ~plausible, F.array().cast("array<string>")).otherwise(F.transform(F.filter(pairs, real), lambda p: p["name"]))


def security(files: DataFrame, skip_zones: tuple[str, ...] = ("generated", "vendor")) -> DataFrame:
    """(path, line_no, kind, name, severity): what the rules find in each line of files (path, content, zone), but in comments only secrets by format."""
    rows = numbered(files.filter(~F.coalesce("zone", F.lit("production")).isin(*skip_zones)))
    line = F.col("line")
    item = lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"))
    formats = [F.when(r.hits(line), item(r)) for r in SECRET_FORMATS]
    unsafe = [F.when(r.hits(line), item(r)) for r in UNSAFE]
    named = F.transform(named_secrets(line), lambda n: F.struct(F.lit("secret_name").alias("kind"), n.alias("name"), F.lit("high").alias("severity")))
    code = F.concat(named, F.array(*unsafe))
    found = F.concat(F.array(*formats), F.when(is_comment(line), F.slice(code, 1, 0)).otherwise(code))
    rows = rows.select("path", "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return rows.select("path", "line_no", "f.*")


# Smells of Python lines by pattern.
PYTHON_SMELLS = (
    Rule("smell", "eval_exec", r"(?<!\.)(?<!\w)(?:eval|exec)\s*\(", "high"),
    Rule("smell", "magic_number", r"(?:==|!=|>=?|<=?|[+\-*/])\s*\d{4,}", "low"),
    Rule("smell", "todo_fixme", r"#\s*(?:TODO|FIXME|HACK|XXX)", "low"),
    Rule("smell", "hardcoded_url", r"""(?:['"])https?://[^\s'"]+(?:['"])""", "medium"),
    Rule("smell", "debug_tag", r"""(?:f?['"])\[([A-Z][A-Z0-9_]{2,})\]\s""", "low"),
    Rule("smell", "workaround_tag", r"#.*\[([A-Z][a-z]+(?:[A-Z][a-z]+)+)\]", "low"),
    Rule("smell", "stderr_traceback", r"traceback\.print_exc\s*\(", "high"),
)
MATCHES = 50


def smells(files: DataFrame, rules: tuple[Rule, ...] = PYTHON_SMELLS) -> DataFrame:
    """(smell_id, path, severity, n, lines): smells by file; a line counts once for each, and of each smell the first fifty by path and line, as the rule has it."""
    line = F.col("line")
    found = F.array(*[F.when(r.hits(line), F.struct(F.lit(r.name).alias("smell_id"), F.lit(r.severity).alias("severity"))) for r in rules])
    rows = numbered(files).select("path", "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("path", "line_no", "s.*")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("smell_id").orderBy("path", "line_no"))).filter(F.col("r") <= MATCHES)
    return first.groupBy("smell_id", "path", "severity").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("line_no")), 1, 10).alias("lines"))


def census(files: DataFrame, families: dict[str, str], least_areas: int = 5, rare: float = 0.1) -> DataFrame:
    """(area, family, files, areas, outlier): files of each area with each family of patterns; outlier where under a tenth of all areas, five at least, use it."""
    rows = files.select("area", "path", *[F.col("content").rlike(p).alias(n) for n, p in families.items()])
    use = F.explode(F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in families]), lambda x: x.isNotNull())).alias("family")
    grid = rows.select("area", "path", use).groupBy("area", "family").agg(F.countDistinct("path").alias("files"))
    areas = files.select("area").distinct().agg(F.count("*").alias("total"))
    counts = grid.groupBy("family").agg(F.count("*").alias("areas"))
    out = grid.join(counts, "family").crossJoin(F.broadcast(areas))  # one row
    return out.select("area", "family", "files", "areas", ((F.col("total") >= least_areas) & (F.col("areas") < rare * F.col("total"))).alias("outlier"))


# Comparisons and existence checks in tests of scripts, literals without quotes, and labels of placeholders.
COMPARISON = r"expect\(\s*([^)]+?)\s*\)\s*\.(?:toBe|toEqual|toStrictEqual)\(\s*([^)]+?)\s*\)"
DEFINED = r"\.toBeDefined\s*\("
LITERALS = ("true", "false", "null", "undefined")
PLACEHOLDER = r"(?i)\bcoverage smoke\b|\bdirect test coverage entry\b|\bplaceholder\b"


def _literal(token: Column) -> Column:
    """What a literal stands for; null for anything else, whose value is not known."""
    t = F.regexp_replace(F.trim(token), ";+$", "")
    quoted = t.rlike("^(['\"`])(?s:.*)\\1$") & (F.length(t) >= 2)
    number = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.when(t.isin(*LITERALS), t).when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), number).when(quoted, F.concat(F.lit("str:"), F.substring(t, F.lit(2), F.length(t) - 2)))


def placeholder(content: Column, asserts: Column, functions: Column) -> Column:
    """Whether tests only look like tests: literals compared with themselves are all their assertions, with a label that says so or one a test at most, or half of them, with a label; or all are checks that something exists, with a label or three imports at run time."""
    same = F.size(F.filter(lines(content), lambda x: _literal(F.regexp_extract(x, COMPARISON, 1)) == _literal(F.regexp_extract(x, COMPARISON, 2))))
    weak = F.size(F.filter(lines(content), lambda x: x.rlike(DEFINED) & ~x.rlike(COMPARISON)))
    label, imports = content.rlike(PLACEHOLDER), F.regexp_count(content, F.lit(r"\bimport\s*\("))
    whole = (same > 0) & (((same >= asserts) & (label | (asserts <= functions))) | (label & (same >= 0.5 * asserts)))
    return (asserts > 0) & (functions > 0) & (whole | ((weak > 0) | (same > 0)) & (weak >= asserts) & (label | (imports >= 3)))


def test_quality(files: DataFrame, asserts: str, mocks: str, snapshots: str, functions: str, comments: str | None = None) -> DataFrame:
    """(path, asserts, mocks, snapshots, functions, quality) of test files, by numbers of lines with each pattern. comments: what is taken out of files first."""
    if comments:
        files = files.withColumn("content", F.regexp_replace("content", comments, ""))
    l = lines("content")  # noqa: E741
    count = lambda p: F.size(F.filter(l, lambda x: x.rlike(p)))
    rows = files.select("path", count(asserts).alias("asserts"), count(mocks).alias("mocks"), count(snapshots).alias("snapshots"), F.regexp_count("content", F.lit("(?m)" + functions)).alias("functions"), "content")
    a, m, s, f = (F.col(x) for x in ("asserts", "mocks", "snapshots", "functions"))
    quality = (
        F.when(f == 0, "no_tests")
        .when(a == 0, "assertion_free")
        .when(placeholder(F.col("content"), a, f), "placeholder_smoke")
        .when(m > a, "over_mocked")
        .when((s > 0) & (s > a * 0.5), "snapshot_heavy")
        .when(a / f < 1, "smoke")
        .when(a / f >= 3, "thorough")
        .otherwise("adequate")
    )
    return rows.withColumn("quality", quality).drop("content")


def coverage_potential(files: DataFrame) -> DataFrame:
    """One row: files of ten lines or more that count, and the sum of the roots of their sizes, fifty at most each, rounded. files: (path, loc, zone)."""
    rows = files.filter(F.col("zone").isin("production", "script") & (F.col("loc") >= 10))
    return rows.agg(F.count("*").alias("files"), F.round(F.sum(F.least(F.sqrt("loc"), F.lit(50.0)))).cast("long").alias("potential"))

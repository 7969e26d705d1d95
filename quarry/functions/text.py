"""Column functions on paths, names and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def glob_regex(pattern: str) -> str:
    """The regular expression of a file glob: * crosses slashes, ? is one character, [!x] excludes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    """The folder of a path; empty for a path without one."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column | str) -> Column:
    """The file name up to its last point."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def area(path: Column | str) -> Column:
    """The first two parts of a path."""
    return F.array_join(F.slice(F.split(col(path), "/"), 1, 2), "/")


def lines(text: Column | str) -> Column:
    """The lines of a text: any line break counts, and one at the end starts no line."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n"))


def word_set(text: Column | str) -> Column:
    """The distinct lower-case words of three letters or digits at least, sorted."""
    words = F.split(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; zero for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))


def slug(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9_]+", "_"), F.lit("_"))


def singular_plural(a: Column, b: Column) -> Column:
    """Whether one name is the other with an s, es, or ies for y."""
    def more(x: Column, y: Column) -> Column:
        return (y == F.concat(x, F.lit("s"))) | (y == F.concat(x, F.lit("es"))) | (x.endswith("y") & (y == F.concat(F.regexp_replace(x, "y$", ""), F.lit("ies"))))

    return more(a, b) | more(b, a)


def near_miss(a: Column, b: Column) -> Column:
    """Whether two names differ by two edits at most, or by number."""
    return (a != b) & (F.levenshtein(a, b, 2).between(0, 2) | singular_plural(a, b))


def chunks(text: Column | str, size: int = 1800, overlap: int = 240) -> Column:
    """Overlapping parts of a text as (index, content); the last one reaches the end, and blank ones go."""
    t = F.coalesce(col(text), F.lit(""))
    step = size - overlap
    n = F.greatest(F.ceil((F.length(t) - overlap) / F.lit(step)), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_index"), F.substring(t, i * step + 1, F.lit(size)).alias("content")))
    return F.when(F.length(t) == 0, F.array().cast("array<struct<chunk_index:int,content:string>>")).otherwise(F.filter(parts, lambda p: F.trim(p["content"]) != ""))


def age_days(then: Column, now: Column) -> Column:
    """Whole days from one time to another."""
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 86400).cast("long")

"""Column functions on loosely typed values, code comments and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import col

#: Keys of a finding's detail that may hold its line, in order.
LINE_KEYS = ("line", "line_number", "line_no", "lineno", "start_line", "row")


def _whole(value: Column) -> Column:
    """A text as a whole number, if it is written as one."""
    t = F.trim(value)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long"))


def whole_or(value: Column | str, default: int, least: int = 0) -> Column:
    """The whole number a text holds if it is at least least, else the default; null gives the default."""
    n = _whole(col(value))
    return F.when(n >= least, n).otherwise(F.lit(default).cast("long"))


def number_or(value: Column | str, default: float, least: float = 0.0) -> Column:
    """The number a text holds if it is at least least, else the default; null gives the default."""
    n = F.trim(col(value)).try_cast("double")
    return F.when((n >= least) & ~F.isnan(n), n).otherwise(F.lit(default))


def share_or(value: Column | str, default: float = 1.0) -> Column:
    """The number a text holds, brought between 0 and 1; the default for anything else."""
    n = F.trim(col(value)).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(default))


def safe_tier(value: Column | str) -> Column:
    """The tier a text holds, brought between 1 and 4; 4 for anything else."""
    n = _whole(col(value))
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(1)), F.lit(4))).otherwise(F.lit(4)).cast("int")


def line_hint(detail: Column | str) -> Column:
    """The first line above zero that the keys of a detail, a map of texts, hold; null if none does."""
    held = [F.try_element_at(col(detail), F.lit(k)) for k in LINE_KEYS]
    return F.coalesce(*[F.when(F.trim(h).rlike(r"^\d+$") & (F.trim(h).try_cast("long") > 0), F.trim(h).try_cast("long")) for h in held])


def snippet(text: Column | str, limit: int = 280) -> Column:
    """A text in one line, cut to so many characters, with points where it was cut."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), " $", ""), F.lit("...")))


def _string(quote: str) -> str:
    return rf"{quote}[^{quote}\\]*+(?:\\(?s:.)[^{quote}\\]*+)*+(?:{quote}|\z|\\\z)"


def without_comments(text: Column | str) -> Column:
    """Code without // and /* */ comments; strings stay, and what is never closed reaches to the end."""
    strings = "|".join(map(_string, ('"', "'", "`")))
    return F.regexp_replace(col(text), rf"({strings})|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)", "$1")


def _nested(depth: int) -> str:
    return rf"[^()]*+(?:\({_nested(depth - 1)}\)[^()]*+)*+" if depth else r"[^()]*+"


def most_parameters(code: Column | str, depth: int = 6) -> Column:
    """The largest number of parameters of a Python function, without self, cls and starred ones, cut at every comma; parentheses may be nested so deep. Zero without functions."""
    lists = F.regexp_extract_all(F.coalesce(col(code), F.lit("")), F.lit(rf"def\s+\w+\s*\(({_nested(depth)})\)"), F.lit(1))
    trimmed = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    real = lambda s: F.size(F.filter(F.transform(F.split(s, ","), trimmed), lambda p: (p != "") & ~p.isin("self", "cls") & ~p.startswith("*")))
    return F.coalesce(F.array_max(F.transform(lists, real)), F.lit(0))


def longest_function(lines_: Column | str) -> Column:
    """(name, loc) of the longest Python function in an array of lines: it ends before the next line that is not blank and no deeper; the first of equally long ones. Null without functions."""
    deep = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
    marked = lambda ls: F.transform(ls, lambda x, i: F.struct(i.alias("i"), deep(x).alias("deep"), (F.trim(x) != "").alias("full"), x.rlike(r"^\s*def\s+\w").alias("def"), x.alias("x")))
    full = lambda m: F.filter(m, lambda y: y["full"])
    ends = lambda m, d, n: F.coalesce(F.array_min(F.transform(F.filter(m, lambda y: (y["i"] > d["i"]) & (y["deep"] <= d["deep"])), lambda y: y["i"])), n)
    found = lambda m, n: F.array_max(F.transform(F.filter(m, lambda x: x["def"]), lambda d: F.struct((ends(m, d, n) - d["i"]).alias("loc"), (-d["i"]).alias("i"), d["x"].alias("x"))))
    named = lambda d: F.when(d.isNotNull(), F.struct(F.regexp_extract(F.trim(d["x"]), r"^def\s+(\w+)", 1).alias("name"), d["loc"].alias("loc")))
    return _let(col(lines_), lambda ls: _let(full(marked(ls)), lambda m: _let(found(m, F.size(ls)), named)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)

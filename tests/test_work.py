"""Cases of the work queue, values and reports that the tables don't hold."""

import textwrap

from pyspark.sql import functions as F

from quarry.functions import values
from quarry.functions.text import lines
from quarry.operators import work
from quarry.sources import reports


def one(spark, column, text, schema="x string"):
    return spark.createDataFrame([(text,)], schema).select(column.alias("v")).first()["v"]


def test_values(spark):
    x = F.col("x")
    whole = {"7": 7, " 9 ": 9, "+5": 5, "4": 20, "-3": 20, "x": 20, "1.5": 20, "": 20, None: 20, "99999999999999999999": 20}
    assert {k: one(spark, values.whole_or(x, 20, 5), k) for k in whole} == whole
    share = {"0.25": 0.25, "7": 1.0, "-1": 0.0, "x": 1.0, None: 1.0, "nan": 1.0}
    assert {k: one(spark, values.share_or(x), k) for k in share} == share
    assert [one(spark, values.number_or(x, 2.0, 0.1), k) for k in ("0.5", "0.05", None, "y")] == [0.5, 2.0, 2.0, 2.0]
    assert [one(spark, values.safe_tier(x), k) for k in ("0", "3", "9", "", "a", None)] == [1, 3, 4, 4, 4, 4]
    hint = lambda m: one(spark, values.line_hint(x), m, "x map<string,string>")
    assert [hint(m) for m in ({"row": "3", "line": "0"}, {"lineno": " 8 ", "row": "3"}, {"line": "-1"}, {"other": "4"}, None)] == [3, 8, None, None, None]
    assert one(spark, values.snippet(x, 5), " a\n b  cdef ") == "a b c..." and one(spark, values.snippet(x, 2), "a bcd") == "a..."


def test_comments(spark):
    cases = {
        "a // b\nc": "a \nc",
        'x = "// no" // yes': 'x = "// no" ',
        "y /* a\nb */ z": "y  z",
        "open /* to the end": "open ",
        "'it\\'s // in' // out": "'it\\'s // in' ",
        "`t ${'/*'}` + '": "`t ${'/*'}` + '",
        '"never closed // text': '"never closed // text',
        "a / b": "a / b",
        "": "",
    }
    assert {k: one(spark, values.without_comments(F.col("x")), k) for k in cases} == cases
    long = '"' + "a" * 200_000 + '" // c'
    assert one(spark, values.without_comments(F.col("x")), long) == long[:-4]


def test_functions_of_modules(spark):
    code = textwrap.dedent("""\
    def outer(self, a, b=(1, (2, 3)), *args, c: int = 3, **kw):
        x = 1

        def inner(cls):
            pass

    y = 2
    class A:
        def method(
            self,
            p,
            q,
        ):
            return 1
    """)
    assert one(spark, values.most_parameters(F.col("x")), code) == 5  # cut at every comma: a, the three parts of b, and c
    assert tuple(one(spark, values.longest_function(lines("x")), code)) == ("outer", 6)
    assert one(spark, values.longest_function(lines("x")), "x = 1") is None and one(spark, values.most_parameters(F.col("x")), "def f(") == 0


def test_reports(spark):
    text = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    found = reports.pyflakes(text("a.py:3:1 'os' imported but unused", "p/__init__.py:3:1 'os' imported but unused", "p/__init__.py:4: local variable 'x' is assigned to but never used", "nothing")).collect()
    assert [tuple(r) for r in found] == [("a.py", 3, "os", "imports"), ("p/__init__.py", 4, "x", "vars")]
    graph = reports.graph_report(text('{"files":[{"file":"a","imports":["b"," "]},{"file":"c"}],"edges":[{"source":"x","target":"y"}]}', '{"edges":[{"from":"a","to":"d"},{"source":"q"}]}', "broken", None)).collect()
    assert sorted(map(str, (tuple(r) for r in graph))) == sorted(map(str, [("a", "b"), ("c", None), ("a", "d")]))
    layers = spark.createDataFrame([(1, ["Broken contract 'x'", " a.b imports c"]), (2, [" a imports b"]), (3, [])], "id int, lines array<string>")
    assert [tuple(r) for r in reports.layers(layers).collect()] == [(1, "a/b.py", "b", "c", "x")]
    assert reports.knip(text("{}", None, "[]")).count() == 0 and reports.copied_fragments(text("{}", '{"duplicates":[]}')).count() == 0


def test_queue(spark):
    items = spark.createDataFrame([("a", "d", 1, "low", 0.0, 1), ("b", "d", 1, "high", 0.0, 1), ("c", "e", 2, "high", 1.0, 1), ("f", "e", 2, "high", 0.0, 9)], "id string, detector string, tier int, confidence string, weight double, count long")
    clusters = spark.createDataFrame([("k", "c", "refactor"), ("k", "f", "refactor"), ("l", "a", "auto_fix"), ("l", "gone", "auto_fix")], "cluster string, id string, action string")
    assert [(r["id"], r["kind"], r["members"]) for r in work.next_items(work.collapsed(items, clusters), 9).collect()] == [("k", "cluster", 2), ("b", "finding", 1), ("a", "finding", 1)]
    assert work.next_items(work.collapsed(items, clusters.limit(0)), 9, tier=2).first()["id"] == "c"
    none = spark.createDataFrame([], "dimension string, n long")
    dims = spark.createDataFrame([("Good one", 100.0, 0, False, False, []), ("", 1.0, 1, False, False, []), ("New", 0.0, 0, False, False, ["n"])], "name string, strict double, issues int, placeholder boolean, stale boolean, keys array<string>")
    assert [(r["id"], r["command"]) for r in work.subjective_items(dims, none, 150.0).collect()] == [("subjective::new", "prepare")]


def test_prefixes(spark):
    cases = {"/r/src/a.py": True, "src/a.py": True, "/src/a.py": True, "r/src/a.py": False, "srcs/a.py": False, "src\\a.py": True}
    for prefix in ("src", "/r/src/", "src/"):
        assert {k: one(spark, work.under(F.col("x"), prefix, "/r"), k) for k in cases} == cases

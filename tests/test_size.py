"""Work that has to grow no faster than the tables."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import values
from quarry.plans import review
from quarry.sources import python_code

PARTS = "p_partkey long, p_size int"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def parts(spark, tmp_path):
    """A table of parts in one small file."""
    spark.range(40).select(F.col("id").alias("p_partkey"), (F.col("id") % 10 + 1).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return f"file://{tmp_path}"


def facts(spark, texts, kinds=None):
    return python_code.facts(spark.createDataFrame(list(texts.items()), "path string, content string"), kinds)


@pytest.mark.parametrize("made", [review._python_files, review._stateful])
def test_modules_of_one_file_are_parsed_by_many_tasks(spark, parts, made):
    assert made(spark, parts).rdd.getNumPartitions() > 1


def test_facts_of_some_kinds_are_those_of_all(spark):
    text = "import os\nLIMIT = 3\nd = {}\ndef f(a):\n    global d\n    d = a\n    d['x'] = os.path\n    return f(a)\nclass AMixin:\n    def g(self):\n        return self.a\n"
    whole = facts(spark, {"a.py": text, "bad.py": "def"}).collect()
    for kind in {r["kind"] for r in whole}:
        assert facts(spark, {"a.py": text, "bad.py": "def"}, (kind,)).collect() == [r for r in whole if r["kind"] in (kind, "error")]


def test_cohesion_puts_files_together_without_rounds(spark):
    chain = "".join(f"def a_f{i}():\n    return a_f{i + 1}()\n\n" for i in range(8)) + "def a_f8():\n    return 1\n\n" + "#\n" * 200
    apart = "".join(f"def w{i}_f():\n    return 1\n\n" for i in range(9)) + "#\n" * 200
    spark.sparkContext.setJobGroup("cohesion", "built")
    found = python_code.cohesion(facts(spark, {"chain.py": chain, "apart.py": apart}))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("cohesion")) == 0
    spark.sparkContext.setJobGroup("", "")
    assert [tuple(r) for r in found.collect()] == [("apart.py", 9, 9, 9, 0)]


def test_globals_are_found_by_one_parse(spark):
    texts = {"a.py": "now = None\nseen = []\nfree = []\ndef put(x):\n    global now\n    now = x\n    seen.append(x)\n    seen.pop(); seen.pop()\n    other.append(x)\n"}
    found = python_code.mutable_globals(facts(spark, texts))
    assert plan(found).count("MapIn") == 1
    assert {tuple(r) for r in found.collect()} == {("a.py", "now", 1, 1, True), ("a.py", "seen", 2, 2, False)}


def test_stale_imports_meet_at_the_ends_of_names(spark):
    state = "now = None\ndef put(x):\n    global now\n    now = x\n"
    texts = {"src/pkg/a.py": state, "a.py": state, "b.py": state, "user.py": "from pkg.a import now\nfrom .a import now\nfrom x.b import now\nfrom gap import now\nfrom kg.a import now\n"}
    found = python_code.stale_imports(facts(spark, texts))
    want = {(1, "src.pkg.a"), (1, "a"), (2, "src.pkg.a"), (2, "a"), (3, "b"), (5, "a")}
    assert {(r["line"], r["source"]) for r in found.collect()} == want and found.count() == len(want)
    joins = [x for x in plan(found).splitlines() if "Join" in x]
    assert joins and all("end#" in x for x in joins)  # not at the name alone, which many modules may share


def test_keys_are_compared_after_one_parse(spark):
    text = "def f():\n    d = {}\n    d['colour'] = 1\n    d['n'] = 1\n    d['n'] = 2\n    return d['color'], d['n'], d['lost']\ndef g():\n    e = {}\n    e['only'] = 1\n"
    found = python_code.key_flow(facts(spark, {"a.py": text}))
    assert plan(found).count("MapIn") == 1
    want = {("colour", "dead_write"), ("color", "phantom_read"), ("lost", "phantom_read"), ("colour~color", "near_miss"), ("n", "overwritten_key")}
    assert {(r["key"], r["kind"]) for r in found.collect()} == want and found.count() == len(want)


def test_python_imports_asks_for_its_kinds_alone(spark, parts, monkeypatch):
    asked = []
    monkeypatch.setattr(python_code, "facts", lambda files, kinds=None, f=python_code.facts: asked.append(kinds) or f(files, kinds))
    assert review.python_imports(spark, parts).count() > 0 and asked and all(asked)


def test_python_signatures_asks_for_its_kinds_alone(spark, parts, monkeypatch):
    asked = []
    monkeypatch.setattr(python_code, "facts", lambda files, kinds=None, f=python_code.facts: asked.append(kinds) or f(files, kinds))
    assert review.python_signatures(spark, parts).count() > 0 and asked and all(asked)


def test_python_tree_smells_asks_for_its_kinds_alone(spark, parts, monkeypatch):
    asked = []
    monkeypatch.setattr(python_code, "facts", lambda files, kinds=None, f=python_code.facts: asked.append(kinds) or f(files, kinds))
    assert review.python_tree_smells(spark, parts).count() > 0 and asked and all(asked)


def test_python_mixin_contracts_asks_for_its_kinds_alone(spark, parts, monkeypatch):
    asked = []
    monkeypatch.setattr(python_code, "facts", lambda files, kinds=None, f=python_code.facts: asked.append(kinds) or f(files, kinds))
    assert review.python_mixin_contracts(spark, parts).count() > 0 and asked and all(asked)


def test_lines_are_read_once_for_the_longest_function(spark):
    text = "def a():\n    x\n\n    def b(p,\n          q):\n        y\n\t\n    z\ndef c():\n  1\n\n"
    rows = spark.createDataFrame([(text.split("\n"),), (["x = 1"],), (["def a():", " 1", "def b():", " 1"],)], "ls array<string>").select(values.longest_function("ls").alias("f"))
    assert plan(rows).count("RLIKE") == 1
    assert [r["f"] and tuple(r["f"]) for r in rows.collect()] == [("a", 8), None, ("a", 2)]


def test_measures_are_taken_by_many_tasks(spark, parts):
    from quarry.plans import work

    assert work.function_measures(spark, parts).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("t", [0.8, 2 / 3])
def test_alike_sets_meet_and_others_hardly_do(spark, t):
    import random

    from quarry.operators import alike

    rng = random.Random(3)
    words = lambda n: {rng.getrandbits(63) if rng.random() < 0.5 else rng.randrange(40) for _ in range(n)}
    sets = []
    for n in (1, 2, 3, 4, 5, 8, 9, 10, 12, 20, 33, 60, 200) * 3:
        one = words(n)
        sets += [one, {*rng.sample(sorted(one), max(1, round(len(one) * rng.uniform(t, 1))))}, one | words(max(1, n // 9)), words(n)]
    rows = [(i, 7, sorted(s)) for i, s in enumerate(sets)]
    met = {(r["a"], r["b"]) for r in alike.candidates(spark.createDataFrame(rows, "id long, seed long, h array<long>"), t).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= t * len(a | b)}
    assert len(want) > 60 and want <= met and len(met) < len(want) + 0.1 * len(sets) ** 2


def test_review_pairs_with_copies(spark):
    from quarry.operators import duplicates

    words = [f"w{i}" for i in range(10)]
    rows = [(5, "d", words), (3, "d", words), (9, "d", words[:8]), (1, "e", words), (4, "d", words[:7]), (8, "d", ["w1"])]
    got = sorted(map(tuple, duplicates.review_pairs(spark.createDataFrame(rows, "id long, dimension string, words array<string>")).collect()))
    assert got == [("d", 3, 5, 1.0), ("d", 3, 9, 0.8), ("d", 4, 9, 7 / 8), ("d", 5, 9, 0.8)]


def test_pairs_are_not_made_at_single_words(spark):
    from quarry.operators import duplicates

    # Sets of words that many have, each two alike to a half at most.
    rows = spark.range(300).selectExpr("id", "'d' as dimension", "transform(sequence(0, 19), i -> concat('w', i * 16 + pmod(xxhash64(id, i), 16))) as words")
    spark.sparkContext.setJobGroup("pairs", "made")
    found = duplicates.review_pairs(rows)
    joins = [x for x in plan(found).splitlines() if "Join" in x]
    assert found.count() == 0 and joins and not any("word#" in x for x in joins)


def test_vectors_are_multiplied_as_matrices(spark):
    from quarry.operators import insight

    rows = [(i, [float((i * 7 + d * d) % 5 - 2) for d in range(4)]) for i in range(50)] + [(50, None), (51, [1.0]), (52, [0.0] * 4), (53, [None, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = v.filter("id % 10 = 0 or id > 50")
    found = insight.nearest(v, asked, 6)
    assert "zip_with" not in plan(found)
    pairs = v.crossJoin(asked.select(F.col("id").alias("query"), F.col("embedding").alias("q"))).select("query", "id", insight.cosine(F.col("embedding"), F.col("q")).alias("score"))
    want = insight._first(pairs, 6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("query", "id", "score", "rank").collect()))


def test_components_take_few_rounds_of_ever_fewer_links(spark, monkeypatch):
    from quarry.operators import graph

    kept = []
    monkeypatch.setattr(graph, "settled", lambda df, f=graph.settled: kept.append(f(df)) or kept[-1])
    links = [(i, i + 1) for i in range(1, 9)] + [(100, i) for i in range(101, 110)] + [(200, 200), (302, 301), (303, 301), (303, 304)]
    found = graph.components(spark.createDataFrame(links, "src long, dst long"))
    want = {**dict.fromkeys(range(1, 10), 1), **dict.fromkeys(range(100, 110), 100), 200: 200, **dict.fromkeys((301, 302, 303, 304), 301)}
    assert {r["node"]: r["component"] for r in found.collect()} == want and found.count() == len(want)
    assert kept[-1].isEmpty() and kept[3].count() < len(links) / 2

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import rules

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(docs, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in rules.features(docs).collect():
        assert tuple(r[n] for n in names) == counts(texts[(r["doc_id"] - 1) // 3])


def test_buckets_order_numbers_and_stand_near_them(spark):
    x = F.col("id")
    rows = spark.range(0, 40_000).select(x, rules.bucket(x).alias("b"), rules.lowest(rules.bucket(x)).alias("low")).orderBy("id").collect()
    assert all(b["b"] in (a["b"], a["b"] + 1) for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["low"] <= r["id"] <= r["low"] * 17 / 16 + 1 for r in rows)


def test_sketches_merge_by_adding(spark):
    rows = spark.range(1000).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") * 7 % 500).alias("r_x"))
    whole = rules.sketches(rows.withColumn("source", F.lit("all")), ["x"]).collect()
    parts = rules.sketches(rows, ["x"]).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    assert {r["bucket"]: r["n"] for r in whole} == {r["bucket"]: r["n"] for r in parts}


def test_cutoffs_adapt_to_groups(spark):
    prose = " ".join(f"w{i}" for i in range(80))
    noisy = " ".join(f"w{i}|" if i % 4 == 0 else f"w{i}" for i in range(80))
    rows = [(i, prose + f" {i}", "en", "plain") for i in range(60)] + [(100 + i, noisy + f" {i}", "en", "tables") for i in range(60)]
    rows += [(500, noisy + " z", "en", "plain"), (501, " ".join(f"w{i}***" for i in range(80)), "en", "tables"), (502, "too few", "en", "plain"), (503, noisy, "fr", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, rules.Policy(min_rows=30)).collect()}
    assert [kept[i] for i in (0, 100, 500, 501, 502)] == [True, True, False, False, False]
    assert all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60))


@pytest.mark.parametrize("share", [3, 6])
def test_a_source_of_junk_is_measured_by_others(spark, share):
    """In one source of eleven, 30 or 60 of 100 documents are junk; one more source is legitimately noisier than others."""
    prose = lambda i: " ".join(f"w{(i * 7 + k) % 997}" for k in range(80 + i % 5))
    rows = [(s * 100 + i, prose(s * 100 + i) + (" ###!" * 60 if s == 0 and i % 10 < share else " a|b" * 4 if s == 1 and i % 2 else " c$" if i % 7 == 0 else ""), "en", f"s{s}") for s in range(12) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, rules.Policy(min_rows=50)).collect()}
    junk = {i for i in range(100) if i % 10 < share}
    assert not any(kept[i] for i in junk)
    assert sum(kept[r[0]] for r in rows if r[0] not in junk) >= 0.97 * (len(rows) - len(junk))


def test_cutoffs_move_with_the_data(spark):
    docs = spark.createDataFrame([(i, " ".join("x#" if (k * 13 + i) % m == 0 else f"w{(i * 31 + k * 7) % 997}" for k in range(90)), "en", f"s{m}") for m in (3, 9, 40) for i in range(60)], "doc_id long, text string, lang string, source string")
    policy = rules.Policy(min_rows=30, quantile_num=3, quantile_den=4)
    counted = rules.features(docs).withColumns({f"r_{n}": c for n, c in rules.rates().items()})
    cut = {r["source"]: r["c_symbol"] for r in rules.cutoffs(rules.sketches(counted, list(policy.events)), policy, ["source"]).collect()}
    assert cut["s3"] > 2 * cut["s9"] > 2 * cut["s40"] > 0


def test_filter_keeps_columns(spark, docs, odd_docs, empty_docs):
    for d in (docs, odd_docs, empty_docs):
        out = rules.filter_documents(d)
        assert out.schema == d.schema or out.columns == d.columns
        out.collect()
    long = " ".join(f"word{i}" for i in range(70))
    twice = spark.createDataFrame([(1, long, None, None, 9)] * 2, "doc_id long, text string, lang string, source string, n_words int")
    assert [r["n_words"] for r in rules.filter_documents(twice).collect()] == [9, 9]


@pytest.mark.parametrize("text,failed", [("w " * 49, True), (" ".join(map(str, range(50))), False), ("a b c " * 30, True)])
def test_base_rules(spark, text, failed):
    assert rules.judge(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()["base_failed"] is failed

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import minhash, overlap, simhash
from quarry.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text, size=5):
    w = re.findall(WORD, text or "")
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash_estimates_and_next_texts(docs, texts):
    rows = minhash.with_next(minhash.fingerprints(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), ["text", "signature"])
    rows = rows.withColumn("edited", minhash.edited(F.col("text"), F.col("next_text"))).withColumn("es", minhash.signature(F.col("edited")))
    rows = rows.withColumns({"near": minhash.likeness(F.col("signature"), F.col("es")), "near_next": minhash.likeness(F.col("signature"), F.col("next_signature")), "back": minhash.unpacked(F.col("fingerprint"))})
    found = {r["doc_id"]: r for r in rows.collect()}
    order = [t or "" for t in reversed(texts)]
    ids = [i * 3 + 1 for i in reversed(range(len(texts)))]
    assert len(found) == len(texts)
    by_text = {}
    errors = []
    for k, (i, text) in enumerate(zip(ids, order, strict=True)):
        following, r = order[(k + 1) % len(order)], found[i]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert (r["next_text"], r["edited"]) == (following, edited)
        assert r["back"] == r["signature"] and len(r["signature"]) in (0, minhash.BINS)
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        errors += [r["near"] - jaccard(shingles(text), shingles(edited)), r["near_next"] - jaccard(shingles(text), shingles(following))]
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.02


def test_minhash_next_of_odd_tables(spark, odd_docs, empty_docs):
    rows = minhash.with_next(odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"]).collect()
    assert len(rows) == 5 and all(r["next_text"] is not None for r in rows)
    one = spark.createDataFrame([(4, "only")], "doc_id long, text string")
    assert minhash.with_next(one, ["text"]).first()["next_text"] == "only"
    assert minhash.with_next(empty_docs.select("doc_id", "text"), ["text"]).count() == 0


def fingerprint(text, size=3):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def test_simhash_equals_brute_force(docs, texts):
    want = [fingerprint(t) for t in texts]
    ids = [i * 3 + 1 for i in range(len(texts))]
    rows = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows} == dict(zip(ids, want, strict=True))
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(ids, want)


def test_simhash_of_a_long_text_in_parts(monkeypatch, texts):
    whole = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert [simhash.fingerprint(t) for t in texts] == whole


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_of_crowded_fingerprints(spark, parts, monkeypatch):
    """Chains, crowds around a centre, links of every distance and number of blocks, and negative numbers."""
    rng = np.random.default_rng(parts)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63)) * 2 + 1
        fps.add(centre)
        for _ in range(25):
            x = centre
            for b in rng.choice(64, size=int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    chain = 1 << 63
    for k in range(12):
        chain ^= 7 << 3 * k
        fps.add(chain)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "blocks", lambda n: [(1 << 64 * (i + 1) // parts) - (1 << 64 * i // parts) for i in range(parts)])
    rows = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    found = {r["doc_id"]: r["component_id"] for r in simhash.classes(rows).collect()}
    assert found == classes(range(len(fps)), fps)


def test_dedup_keeps_one_of_each_class(docs, odd_docs, empty_docs, texts):
    ids = [i * 3 + 1 for i in range(len(texts))]
    want = set(classes(ids, [fingerprint(t) for t in texts]).values())
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    odd = simhash.deduplicate(odd_docs)
    assert odd.columns == odd_docs.columns and sorted(r["doc_id"] for r in odd.collect() if r["doc_id"]) == [1, 7]
    assert simhash.deduplicate(empty_docs).count() == 0


A, B, C, D = "one two three four five", "six seven eight nine ten", "some other words than these", "words of a fourth text"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(3, A), (5, A), (5, B)], [(3, A), (5, B)]),
        ([(5, B), (5, C)], [(5, B), (5, C)]),
        ([(None, A), (None, B), (None, C), (1, A)], [(1, A), (None, B), (None, C)]),
        ([(None, D), (None, D), (2, A), (2, A), (2, None), (4, "")], [(None, D), (2, A), (2, None)]),
    ],
)
def test_dedup_goes_by_rows(spark, rows, want):
    key = lambda r: (str(r[0]), str(r[1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for dedup in (simhash.deduplicate, overlap.deduplicate):
        assert sorted([(r["doc_id"], r["text"]) for r in dedup(docs).collect()], key=key) == sorted(want, key=key)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (201, 200), (5, 5), (300, None)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 0 for i in range(31)} | {100: 0, 200: 200, 201: 200}
    assert {r["node"]: r["label"] for r in rows} == want and len(rows) == len(want)


def test_edited_hash(spark):
    row = spark.createDataFrame([("héllo wörld!", "日本")], "a string, b string").select(minhash.edited(F.col("a"), F.col("b")).alias("e")).first()
    assert hashlib.sha256(row["e"].encode()).hexdigest() == hashlib.sha256("héllo wö日本".encode()).hexdigest()

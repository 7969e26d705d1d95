import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import licences, lm, pieces


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    good = [f"good{i}" for i in range(40)]
    bad = [f"bad{i}" for i in range(40)]
    rows = []
    for i in range(300):
        own = good if i % 2 else bad
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.7 else good + bad) for _ in range(rng.randint(5, 60)))))
    rows += [(900, None), (901, ""), (902, "  "), (903, "Good1 GOOD1 good1"), (904, "never seen words")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(1, 200, 2)] + [(1,)], "doc_id long")


def plain(texts, hot, i):
    """Losses of text i by models of the others."""

    def counts(group):
        u, b, starts = Counter(), Counter(), 0
        for j in group:
            u.update(texts[j]), b.update(zip(["", *texts[j]], texts[j], strict=False))
            starts += bool(texts[j])
        u[""] = starts
        return u, b, sum(len(texts[j]) for j in group)

    (tu, tb, tn), (gu, gb, gn) = (counts([j for j in group if j != i]) for group in (sorted(hot & texts.keys()), sorted(texts)))
    ratio, out = tn / gn, [0.0, 0.0]
    for v, w in zip(["", *texts[i]], texts[i], strict=False):
        known = gu[w] >= 2
        follows = known and (v == "" or gu[v] >= 2)
        prior = lm.PRIOR * (gu[w] if known else 1) / gn
        for k, (u, b, r) in enumerate(((tu, tb, 1.0), (gu, gb, ratio))):
            uni = ((r * u[w] if known else 0) + prior) / (tn + lm.PRIOR)
            out[k] -= math.log(((r * b[v, w] if follows else 0) + lm.BACKOFF * uni) / ((r * u[v] if follows else 0) + lm.BACKOFF))
    return [x / len(texts[i]) for x in out]


def test_scores_equal_brute_force(labelled):
    docs, target = labelled
    rows = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs.withColumn("hot", F.lit(True)), target).collect()}
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in docs.collect()}
    hot = {r["doc_id"] for r in target.collect()}
    assert len(rows) == len(texts)
    for i in (1, 2, 77, 250, 903, 904):
        r = rows[i]
        assert r["n_tokens"] == len(texts[i])
        assert [r["target_loss"], r["background_loss"]] == pytest.approx(plain(texts, hot, i), rel=1e-9)
        assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"])
    assert all(rows[i]["score"] is None and rows[i]["n_tokens"] == 0 for i in (900, 901, 902))


def test_scores_tell_held_out_texts_apart(labelled):
    docs, target = labelled
    rows = [r for r in lm.cross_entropy_difference(docs, target).collect() if 200 <= r["doc_id"] < 300]
    good, bad = ([r["score"] for r in rows if r["doc_id"] % 2 == k] for k in (1, 0))
    assert sum(g < b for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_new_texts_and_odd_tables(spark, labelled, odd_docs, empty_docs):
    docs, target = labelled
    models = lm.fit(docs, F.col("doc_id") % 2 == 1)
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in docs.collect()}
    new = "good1 good2 zzz"
    r = lm.score(spark.createDataFrame([(1, new)], "doc_id long, text string"), models).first()
    assert [r["target_loss"], r["background_loss"]] == pytest.approx(plain(texts | {-1: new.split()}, {i for i in texts if i % 2}, -1), rel=1e-9)
    assert lm.cross_entropy_difference(empty_docs, empty_docs.select("doc_id")).count() == 0
    assert lm.cross_entropy_difference(odd_docs, target).count() == 5 and lm.cross_entropy_difference(docs, empty_docs).filter("score is not null").count() == 302


def test_every_repeated_word_and_bigram_counts(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(70_000)]
    tokens = words + words + words
    rng.shuffle(tokens)
    texts = {i: tokens[k : k + 1500] + ["common", "pair"] * 3 for i, k in enumerate(range(0, len(tokens), 1500))}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    hot = set(range(0, len(texts), 2))
    rows = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in hot], "doc_id long")).collect()}
    for i in (0, 1, 139):
        assert [rows[i]["target_loss"], rows[i]["background_loss"]] == pytest.approx(plain(texts, hot, i), rel=1e-9)


def dice(a, b):
    x, y = (set(zip(w, w[1:], strict=False)) for w in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def plain_windows(text):
    """Windows that start as far before an anchor as in the template."""
    if "\n" not in text or not any(h in text.lower() for h in licences.HINTS):
        return set()
    words, lines = licences._words(text), [len(licences._words(x)) for x in text.split("\n")]
    found = set()
    for (name, n, anchors), t in zip(licences._windows(), [licences._words(t) for ts in licences.TEMPLATES.values() for t in ts], strict=True):
        assert (n >= licences.LONG) == bool(anchors) and all(f"{t[o]} {t[o + 1]}" == g for o, g in anchors)
        for o, g in anchors:
            for i in range(len(words) - 1):
                at = max(i - o, 0)
                if f"{words[i]} {words[i + 1]}" == g and (d := dice(words[at : at + n], t)) >= licences.LEAST:
                    found.add((round(d, 12), name, 1 + sum(sum(lines[: k + 1]) <= at for k in range(len(lines)))))
    return found


def test_wrapped_notices_and_whole_licences_are_found(spark):
    import textwrap

    notice = textwrap.wrap(licences.TEMPLATES["GPL-3.0"][1], 70)
    code = [f"value_{i} = compute({i}) + other[{i}]" for i in range(80)]
    commented = "\n".join(["/*", *[f" * {x}" for x in notice], " */", *code])
    middle = "\n".join([*code[:30], *textwrap.wrap(licences.TEMPLATES["MIT"][2], 60), *code[30:]])
    bsd = "\n".join(["Copyright (c) 2020, Someone", "All rights reserved.", "", *textwrap.wrap(licences.TEMPLATES["BSD-2-Clause"][0], 75)])
    one_line = "Some words before. " + licences.TEMPLATES["MPL-2.0"][0] + " And words after it, quite a few of them, to the end of this line.\nend"
    docs = spark.createDataFrame(list(enumerate([commented, middle, bsd, one_line, "\n".join(code)])), "doc_id int, text string")
    rows = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert [(rows[i]["licence"], rows[i]["line"]) for i in range(5)] == [("GPL-3.0", 2), ("MIT", 31), ("BSD-2-Clause", 4), ("MPL-2.0", 1), (None, None)]


def test_licences_equal_brute_force(spark, docs, odd_docs, empty_docs):
    mit, apache = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["Apache-2.0"][1]
    texts = ["# " + mit.replace(". ", ".\n# "), mit.upper(), "some prose\nreleased under the mit licence.\nReleased under the MIT License!\nend", apache.replace("License", "license") + " Copyright 2020", "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", "no licence here", "", None, " ".join(mit.split()[:60]), "Licensed under", "a b\n# " + apache.replace(" ", "\n", 40) + "\n" + mit.replace("software", "thing").replace(". ", ".\n") + "\nmore"]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        segments = list(enumerate((text or "").split("\n"), 1)) + ([(0, text)] if "\n" in (text or "") else [])
        want = {(round(d, 12), name, i) for i, s in segments for name, ts in licences.TEMPLATES.items() for t in ts if (d := dice(licences._words(s), licences._words(t))) >= licences.LEAST}
        want |= plain_windows(text or "")
        assert {(round(m["dice"], 12), m["licence"], m["line"]) for m in r["matches"]} == want
        best = min(want, key=lambda m: (-m[0], m[1], m[2]), default=(None,) * 3)
        assert (r["licence"], r["line"]) == best[1:]
    assert licences.scan(docs).filter("licence is not null").count() == 0
    assert licences.scan(odd_docs).count() == 5 and licences.scan(empty_docs).count() == 0


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_round_trip(lattice, texts):
    rng = random.Random(2)
    signs = ["a", "b", "th", "e", " ", "  ", "\n", "é", "日", "▁", "\U0001f600", " the", "ing", "\t", "\x00"]
    cases = [t or "" for t in texts] + ["".join(rng.choices(signs, k=rng.randint(0, 20))) for _ in range(500)]
    ids = lattice.encode(cases, [pieces.row_key(i, 0) for i in range(len(cases))])
    assert [lattice.decode(x) for x in ids] == cases


def test_pieces_follow_the_weights_of_the_lattice(lattice):
    def all_of(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if found := lattice.pieces.get(s[:k]):
                for rest, w in all_of(s[k:]):
                    yield (int(np.frombuffer(found[1], "<u4")[0]), *rest), found[0] + w

    want = dict(all_of(" thing"))
    total, n = sum(map(math.exp, want.values())), 8000
    seen = Counter(tuple(x.tolist()) for x in lattice.encode(["thing"] * n, [pieces.row_key(i, 3) for i in range(n)]))
    assert set(seen) <= set(want) and len(seen) > 1
    for k, w in want.items():
        p = math.exp(w) / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_pieces_depend_on_key_and_seed_only(spark, docs, texts, lattice, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    one = {r["doc_id"]: r for r in pieces.encode(docs, path, verify=True).collect()}
    two = {r["doc_id"]: bytes(r["piece_ids"]) for r in pieces.encode(docs.repartition(7), path).collect()}
    assert {k: bytes(r["piece_ids"]) for k, r in one.items()} == two and all(r["lossless"] for r in one.values())
    assert any(bytes(r["piece_ids"]) != two[r["doc_id"]] for r in pieces.encode(docs, path, seed=1).collect())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert back == {i * 3 + 1: t or "" for i, t in enumerate(texts)}
    long = " ".join(t for t in texts if t)[:30_000]
    (whole,) = lattice.encode([long], [9])
    monkeypatch.setattr(pieces, "CHUNK", 500)
    assert lattice.encode([long], [9])[0].tolist() == whole.tolist()


def test_pieces_of_odd_and_empty_tables(odd_docs, empty_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode(odd_docs, path, verify=True).collect()
    assert len(rows) == 5 and all(r["lossless"] for r in rows)
    assert pieces.encode(empty_docs, path).count() == 0

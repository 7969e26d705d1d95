import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, crf, overlap, packing, queries, rules, secrets
from quarry.llm.common import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [a + b for a in ("the", "an", "ion", "re", "st", "al") for b in ("ed", "ing", "or", "um", "", "ix")]
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 400))) for _ in range(80)]
    texts[10] += " token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end"
    texts += texts[:15] + [t + " more" for t in texts[15:25]] + ["few words", "a b c " * 60, None, " ".join(w + "***" for w in rng.choices(words, k=90))]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}", {r[0]: r[1] for r in rows}


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def labels(texts):
    """A class for each text, by exact comparison of all pairs."""
    sets, label = [shingled(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                label = [label[j] if n == label[i] else n for n in label]
    return label


def test_stages_equal_plain_python(spark, folder):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in rules.judge(docs).filter("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert one.schema == docs.schema and {r["doc_id"] for r in one.collect()} == kept
    assert not kept & {i for i, t in texts.items() if not t or len(t.split()) < 50 or t.startswith("a b c") or "***" in t} and len(kept) == len(texts) - 4
    ids = sorted(kept)
    two = corpus_pipeline.near_dedup(spark, one, sf_dir)
    label = labels([texts[i] for i in ids])
    left = {min(i for i, n in zip(ids, label, strict=True) if n == k) for k in label}
    assert len(left) == len(ids) - 25
    assert two.schema == docs.schema and {r["doc_id"] for r in two.collect()} == left
    three = corpus_pipeline.secret_scan(spark, two, sf_dir)
    clean = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == docs.columns and set(clean) == left
    for i, r in clean.items():
        assert r["text"] == (texts[i] if i != 10 else texts[i][: texts[i].index(" token")] + " <SECRET>\" end") and r["n_chars"] == len(r["text"])
    library = Tokenizer.from_file(tokenizer())
    for r in corpus_pipeline.pack(spark, three, sf_dir).collect():
        ids = np.array(library.encode(clean[r["doc_id"]]["text"]).ids + [0], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_near_dedup_takes_edited_copies(spark):
    """Copies with 1 to 10 of 100 words changed, in small groups and in one of 60, and unlike texts with a common passage: what stays is what exact comparison of all pairs keeps."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(40)]
    texts = []

    def edited(words, share):
        words = list(words)
        at = rng.randrange(len(words) - 60)
        for k in range(max(1, round(share * len(words)))):
            words[at + k if share > 0.02 else rng.randrange(len(words))] = word()
        return words

    for percent in range(1, 11):
        one = [word() for _ in range(rng.randint(200, 500))]
        texts += [one, edited(one, percent / 100), edited(one, percent / 100)]
    big = [word() for _ in range(300)]
    texts += [edited(big, 0.01) for _ in range(60)] + [[word() for _ in range(100)] + passage for _ in range(20)]
    texts = [" ".join(t) for t in texts] + ["", None, "one two", "One  two", "three"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    label = labels(texts)
    want = {min(i for i, n in enumerate(label) if n == k) for k in label}
    assert len(want) < len(texts) - 70
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_near_dedup_of_a_large_group_in_blocks(spark, monkeypatch):
    """A group of copies edited so much that many of them are alike to few, in several blocks, and rows of repeated and null ids."""
    monkeypatch.setattr(overlap, "BLOCK", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    first, texts = [word() for _ in range(120)], []
    for _ in range(150):
        words = list(first)
        at = rng.randrange(110)
        words[at : at + rng.randint(1, 16)] = [word() for _ in range(8)]
        texts.append(" ".join(words))
    rng.shuffle(texts)
    ids = [None if i % 10 == 0 else i // 2 for i in range(len(texts))]
    label = labels(texts)
    assert 3 < len(set(label)) < 140
    least = {k: min(((ids[i] is None, ids[i] or 0) for i, n in enumerate(label) if n == k)) for k in label}
    docs = spark.createDataFrame([(ids[i], t, "en", "s", i) for i, t in enumerate(texts)], DOCS)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert len({label[r["n_chars"]] for r in kept}) == len(kept) == len(least)
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == least[label[r["n_chars"]]] for r in kept)


def test_run_applies_all_stages(spark, folder):
    sf_dir, _ = folder
    docs, want = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    want = key(docs)
    assert key(corpus_pipeline.run(spark, sf_dir)) == want and want


def peak(work):
    """MB that Python and numpy take at most while work() runs, and what it returns."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def some_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(2000)]
    return [" ".join(rng.choices(words, k=300)) for _ in range(1800)]


def test_scanner_takes_few_texts_at_a_time():
    texts, model = some_texts(), crf.trained()
    assert sum(map(len, texts)) > 3 << 20
    found, mb = peak(lambda: list(secrets.Scanner(model).scan(texts)))
    assert len(found) == len(texts) and mb < 60


def test_pack_encodes_few_texts_at_a_time(monkeypatch):
    """What the pipeline asks of the encoder: less memory than by default, the same ids."""
    asked = {}
    monkeypatch.setattr(packing, "pack_documents", lambda docs, path, **options: asked.update(options))
    corpus_pipeline.pack(None, None, "")
    texts = some_texts()
    texts.append(" ".join(texts))

    def ids(encoder):
        return [(zlib.crc32(x.tobytes()), len(x)) for _, flat, counts in encoder.encode(texts) for x in np.split(flat, np.cumsum(counts)[:-1])]

    got, mb = peak(lambda: ids(bpe.Encoder(tokenizer(), **asked)))
    want, more = peak(lambda: ids(bpe.Encoder(tokenizer())))
    assert got == want and len(got) == len(texts) and mb < 0.7 * more


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_registered_queries():
    names = queries.queries()
    assert sorted(int(n[2:].partition("_")[0]) for n in names) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)
    assert secrets.redacted("abc", [], "x") == "abc"

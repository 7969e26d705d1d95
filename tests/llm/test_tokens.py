import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, packing, records
from quarry.llm.common import tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer())


def ids_of(library, texts):
    return [np.array(e.ids + [0], "<u4") for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def mine(encoder, texts):
    out = []
    for first, ids, counts in encoder.encode(texts):
        assert first == len(out)
        out += np.split(ids, np.cumsum(counts)[:-1])
    return out


SIGNS = [" ", "  ", "\n", "\t", " ", "'", "'s", "'ll", "'t", "s", "é", "1", "²", "!?", "日", "\U0001f600", "<|endoftext|>", "\x85", "é"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(SIGNS), max_size=12).map("".join)), min_size=1, max_size=5))
def test_encoder_equals_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    library = Tokenizer.from_file(tokenizer())
    assert [x.tolist() for x in mine(bpe.encoder(tokenizer()), texts)] == [x.tolist() for x in ids_of(library, texts)]


def test_strings_of_added_tokens_are_these_tokens(library):
    end = "<|endoftext|>"
    texts = [end, end + "a", "a" + end, f"a{end}b", f"a {end} b", "plain", end * 3, "", None, "<|endoftext", "x " * 50 + end + " y" * 50, "last"]
    assert [x.tolist() for x in mine(bpe.Encoder(tokenizer()), texts)] == [x.tolist() for x in ids_of(library, texts)]
    assert ids_of(library, [f"a{end}b"])[0].tolist() == [64, 50256, 65, 0]


def test_long_texts_are_cut_without_a_trace(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    texts = ["word " * 100 + "end", "x" * 200, " " * 150 + "a", "a\n \n" * 60, "short"]
    assert [x.tolist() for x in mine(bpe.Encoder(tokenizer()), texts)] == [x.tolist() for x in ids_of(library, texts)]


def test_records_round_trip(spark, docs, texts, library, tmp_path):
    folder = records.write(docs, tokenizer(), f"file://{tmp_path}/r")
    rows = sorted(records.read(spark, folder).collect(), key=lambda r: r["start"])
    want = ids_of(library, texts)
    assert [r["doc_id"] for r in rows] == [i * 3 + 1 for i in range(len(texts))]
    at = 0
    for r, ids in zip(rows, want, strict=True):
        assert (bytes(r["ids"]), r["start"]) == (ids.tobytes(), at)
        at += len(ids)
    some = {r["doc_id"]: bytes(r["ids"]) for r in records.pick(spark, folder, spark.createDataFrame([(7,), (31,), (999,)], "doc_id long")).collect()}
    assert some == {7: want[2].tobytes(), 31: want[10].tobytes()}


def test_frames_detect_damage():
    good = records.frame(5, np.array([1, 2, 50_000], np.uint32), 2) + records.frame(None, np.array([], np.uint32), 4)
    assert [(k, x.tolist()) for k, x in records.frames(good)] == [(5, [1, 2, 50_000]), (None, [])]
    for place in range(len(good)):
        bad = bytearray(good)
        bad[place] ^= 1
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(good[:-1]))


def test_records_of_odd_and_empty_tables(spark, odd_docs, empty_docs):
    folder = records.write(odd_docs, tokenizer())
    rows = sorted(records.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 7]
    assert records.read(spark, records.write(empty_docs, tokenizer())).count() == 0


def test_packing_places_every_piece_once(docs, texts, library):
    rows = packing.pack_documents(docs, tokenizer(), with_ids=True).collect()
    ids = dict(zip([i * 3 + 1 for i in range(len(texts))], ids_of(library, texts), strict=True))
    by_sequence, by_doc = {}, {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] <= 2048 and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and bytes(r["ids"]) == piece.tobytes()
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, parts in by_doc.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(length == 2048 for _, _, length in parts[1:]) and sum(p[2] for p in parts) == len(ids[doc])
    assert len(by_sequence) == -(-sum(map(len, ids.values())) // 2048)


def test_packing_keeps_every_constraint():
    counts = {1: 40, 7: 30, 100: 25, 900: 6, 1500: 3, 2048: 2}
    for capacity in (packing.Capacity(), packing.Capacity(documents=5), packing.Capacity(cost=1_500_000 + 2048**2 // 2), packing.Capacity(documents=9, weights=(1, 1, 1), choose="dot"), packing.Capacity(documents=9, weights=(1, 0.5, 0.5))):
        if capacity.cost < 2048**2:
            counts = {k: v for k, v in counts.items() if k * k <= capacity.cost}
        runs, n = packing.plan(counts, capacity)
        bins, placed = {}, dict.fromkeys(counts, 0)
        for length in counts:
            own = sorted(r for r in runs if r[0] == length)
            for k, (_, rank, first, each, offset) in enumerate(own):
                end = own[k + 1][1] if k + 1 < len(own) else counts[length]
                assert rank == placed[length]
                for item in range(end - rank):
                    bins.setdefault(first + item // each, []).append((offset + item % each * length, length))
                placed[length] = end
        assert placed == counts and set(bins) == set(range(n))
        for items in bins.values():
            items.sort()
            assert [o for o, _ in items] == [sum(x for _, x in items[:i]) for i in range(len(items))]
            assert sum(x for _, x in items) <= capacity.tokens and len(items) <= capacity.documents and sum(x * x for _, x in items) <= capacity.cost
    with pytest.raises(ValueError):
        packing.plan({3000: 1}, packing.Capacity())


def test_packing_of_odd_and_empty_tables(odd_docs, empty_docs):
    rows = packing.pack_documents(odd_docs, tokenizer()).collect()
    assert len(rows) == 5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    assert packing.pack_documents(empty_docs, tokenizer()).count() == 0


def test_sequences_hold_their_ids(docs, texts, library):
    packed = packing.pack_documents(docs, tokenizer(), with_ids=True).cache()
    for row in packing.sequences(packed).collect():
        assert len(row["ids"]) == 4 * sum(p["length"] for p in row["parts"])

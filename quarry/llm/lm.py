"""Cross-entropy difference (Moore and Lewis, 2010): a target and a background bigram model of one vocabulary.

Words are split at white space and lower-cased. The background is all documents, the target those
marked. Both models are matched: one vocabulary, one smoothing, and the background's counts scaled to the
target's number of tokens, so that neither gives less to what it has not seen. A word is in the vocabulary
of a text's models if other texts have it twice or more in all; any other is unknown. A bigram's
probability is its count, smoothed towards the word's, and this towards its share of all tokens.

Counts are exact and kept in tables, so models grow with the corpus; the driver gets two numbers. Texts
are put into blocks. A block sends its distinct words and bigrams, as sorted hashes in pages, with its
counts; each page sums up over all blocks and answers with one sum for each hash, in the order asked. So a
very common bigram costs an entry a block, not a row a document, and hashes spread entries evenly over
pages whatever the words are. Hashes have so many bits more than the corpus has bytes that of a
billion entries some ten share theirs with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import block_rows, blocks, materialise, send

#: Weights of the lower orders, in counts: of a word in a bigram's probability, of its share of all tokens in a word's.
BACKOFF, PRIOR = 1000.0, 50.0
#: Times that other texts have a known word, at least.
LEAST = 2
#: Distinct words whose hashes a task holds.
HELD = 200_000
CHUNK = 4 << 20
#: Bits of a hash beyond those that number the bytes of a corpus.
SPARE = 24
_BLANK = b" \t\n\x0b\x0c\r"
#: Hashes that stand for the start of a text and for all tokens.
START, TOTAL = 0, 1


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    data = (text or "").lower().encode()
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in _BLANK:
            end += 1
        yield data[at:end].split()
        at = end


def word_hash(word: bytes) -> int:
    """The 64-bit hash of a word, other than START and TOTAL."""
    import xxhash

    x = xxhash.xxh64_intdigest(word)
    return x + 2 if x in (START, TOTAL) else x


class _Hashes(dict):
    """Hashes of words, held while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        self[word] = found = word_hash(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, part), np.uint64, len(part)) for part in words(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each bigram of word hashes."""
    return _mixed(_mixed(before + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15) + now)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte of all of them, compressed."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = next((k for k in range(8, 0, -1) if planes[:, k - 1].any()), 0)
    return bytes([used]) + pa.compress(np.ascontiguousarray(planes[:, :used].T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    if used := data[0]:
        planes[:, :used] = np.frombuffer(pa.decompress(data[1:], used * n, codec="zstd", asbytes=True), np.uint8).reshape(used, n).T
    return planes.view("<u8").ravel()


class _Block:
    """The texts of a block as numbers, and its entries: keys, ascending, with counts t of the target and g of all texts."""

    def __init__(self, row: pa.Table, hot: np.ndarray, width: int):
        """row: of a block; hot: the ids of it that are of the target."""
        hashes = _Hashes()
        ids = [hashes.of(text.as_py()) for text in block_rows(row).column(1)]
        del hashes
        self.doc_id = row.column("ids").combine_chunks().flatten()
        self.hot = np.isin(self.doc_id.fill_null(0).to_numpy(), hot) & self.doc_id.is_valid().to_numpy(zero_copy_only=False)
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.text = np.repeat(np.arange(len(ids)), self.sizes)
        self.words, at = np.unique(np.concatenate([np.array([START, TOTAL], np.uint64), *ids]), return_inverse=True)
        del ids
        self.now = at[2:].astype(np.int32)
        # START and TOTAL are the least hashes, so they come first.
        self.before = np.concatenate([np.zeros(1, np.int32), self.now[:-1]])[: len(self.now)]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        pairs, at = np.unique(self.before.astype(np.int64) * len(self.words) + self.now, return_inverse=True)
        self.pair = at.astype(np.int32)
        del at
        hot, some = self.hot[self.text], self.sizes > 0
        n = len(self.words)
        unigrams = np.stack([np.bincount(self.now[hot], minlength=n), np.bincount(self.now, minlength=n)])
        unigrams[:, 0] = (some & self.hot).sum(), some.sum()
        unigrams[:, 1] = hot.sum(), len(hot)
        bigrams = np.stack([np.bincount(self.pair[hot], minlength=len(pairs)), np.bincount(self.pair, minlength=len(pairs))])
        keys = np.concatenate([_mixed(self.words), pair_hash(self.words[pairs // n], self.words[pairs % n])]) >> np.uint64(64 - width)
        self.keys, self.at = np.unique(keys, return_inverse=True)
        both = np.concatenate([unigrams, bigrams], 1)
        self.t, self.g = (np.bincount(self.at, x, len(self.keys)).astype(np.uint64) for x in both)

    def rows(self, width: int, pages: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
        """Page, number of entries, keys as steps within the page, and counts."""
        page = (self.keys >> np.uint64(width - pages)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(page)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(page)], strict=True):
            low = self.keys[a:b] - (np.uint64(page[a]) << np.uint64(width - pages))
            yield int(page[a]), b - a, _packed(np.diff(low, prepend=np.uint64(0))), _packed(self.t[a:b]), _packed(self.g[a:b])

    def losses(self, t: np.ndarray, g: np.ndarray, counted: bool) -> np.ndarray:
        """Mean negative log-probabilities of the words of each text, by sums t and g of its entries: in rows, of the target and of the background.

        counted: whether the sums have the texts' own counts, which are then taken off.
        """
        sums, ends, n = np.zeros((2, len(self.sizes))), np.cumsum(self.sizes), len(self.words)
        t, g = t[self.at].astype(np.float64), g[self.at].astype(np.float64)
        first = 0
        while first < len(ends):
            # Some texts at a time, as own counts take room.
            begin = ends[first] - self.sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + (1 << 18), "right")))
            part = slice(begin, ends[last - 1])
            text, now, before, pair = (x[part] for x in (self.text, self.now, self.before, self.pair))
            first = last
            if not len(text):
                continue
            starts = before == 0
            off = np.full(len(text), float(counted))
            hot = off * self.hot[text]

            def own(at: np.ndarray, size: int, text: np.ndarray = text) -> np.ndarray:
                _, which, many = np.unique(text * size + at, return_inverse=True, return_counts=True)
                return many[which].astype(np.float64)

            mine, both = own(now, n), own(pair, len(self.at) - n)
            context = np.where(starts, 1.0, np.concatenate([[1.0], mine[:-1]]))
            total_t, total_g = t[1] - hot * self.sizes[text], g[1] - off * self.sizes[text]
            word_t, word_g = t[now] - hot * mine, g[now] - off * mine
            context_t, context_g = t[before] - hot * context, g[before] - off * context
            pair_t, pair_g = t[n + pair] - hot * both, g[n + pair] - off * both
            known = word_g >= LEAST
            follows = known & (starts | (context_g >= LEAST))
            ratio = np.where(total_g > 0, total_t / np.maximum(total_g, 1), 0.0)
            share = np.where(known, word_g, 1.0) / np.maximum(total_g, 1)
            uni_t = (known * word_t + PRIOR * share) / (total_t + PRIOR)
            uni_g = (known * ratio * word_g + PRIOR * share) / (total_t + PRIOR)
            sums[0] += np.bincount(text, -np.log((follows * pair_t + BACKOFF * uni_t) / (follows * context_t + BACKOFF)), len(self.sizes))
            sums[1] += np.bincount(text, -np.log((follows * ratio * pair_g + BACKOFF * uni_g) / (follows * ratio * context_g + BACKOFF)), len(self.sizes))
        return sums / np.maximum(self.sizes, 1)


_ENTRIES = "page long, block long, n long, keys binary, t binary, g binary"


_HOT = "block long, doc_id long"


def _blocks(docs: DataFrame) -> DataFrame:
    return blocks(docs.select("doc_id", "text"), "blocks")


def _entries(table: DataFrame, hot: DataFrame, width: int, pages: int) -> DataFrame:
    """(_ENTRIES) of blocks, of whose ids those in hot (_HOT) are of the target."""

    def run(row: pa.Table, hot: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _none(_ENTRIES)
        page, n, keys, t, g = zip(*_Block(row, hot.column("doc_id").to_numpy(), width).rows(width, pages), strict=True)
        columns = [pa.array(page, pa.int64()), pa.array(row.column("block").to_pylist() * len(page), pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, t, g))]
        return pa.table(columns, names=[c.split()[0] for c in _ENTRIES.split(", ")])

    send(table.sparkSession)
    return table.select("block", "ids", "rows").groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(run, _ENTRIES)


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in map(str.split, schema.split(", "))})


def _decoded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of entries of each row, and the keys and counts of all."""
    n = rows.column("n").to_numpy()
    out = [[_unpacked(x.as_py(), k) for x, k in zip(rows.column(c), n.tolist(), strict=True)] for c in ("keys", "t", "g")]
    return n, np.concatenate([np.cumsum(k) for k in out[0]]), np.concatenate(out[1]), np.concatenate(out[2])


def _summed(keys: np.ndarray, t: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    found, at = np.unique(keys, return_inverse=True)
    return found, at, [np.bincount(at, x, len(found)).astype(np.uint64) for x in (t, g)]


_SUMS = "block long, page long, n long, t binary, g binary"


def _answered(rows: pa.Table, at: np.ndarray, sums: list[np.ndarray]) -> pa.Table:
    ends = np.cumsum(rows.column("n").to_numpy())
    t, g = ([_packed(x[at[b - n : b]]) for n, b in zip(rows.column("n").to_numpy(), ends, strict=True)] for x in sums)
    return pa.table([rows.column("block"), rows.column("page"), rows.column("n"), pa.array(t, pa.binary()), pa.array(g, pa.binary())], names=[c.split()[0] for c in _SUMS.split(", ")])


def _scores(table: DataFrame, sums: DataFrame, hot: DataFrame, width: int, counted: bool) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of the texts of blocks, by the sums of their entries."""
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(row: pa.Table, found: pa.Table) -> pa.Table:
        if not row.num_rows:
            return _none(schema)
        page = found.column("page").to_numpy()
        hot, sums = found.filter(pa.array(page < 0)), found.filter(pa.array(page >= 0)).sort_by("page")
        block = _Block(row, hot.column("n").to_numpy(), width)
        t, g = (np.concatenate([_unpacked(x.as_py(), n) for x, n in zip(sums.column(c), sums.column("n").to_pylist(), strict=True)]) for c in ("t", "g"))
        columns = [pa.array(x, mask=block.sizes == 0) for x in block.losses(t, g, counted)]
        return pa.table([block.doc_id, pa.array(block.sizes), *columns], names=names)

    # What belongs to a block comes in one table: its sums, and on pages below zero its ids of the target.
    marks = hot.select("block", F.lit(-1).cast("long").alias("page"), F.col("doc_id").alias("n"), F.lit(None).cast("binary").alias("t"), F.lit(None).cast("binary").alias("g"))
    rows = table.select("block", "ids", "rows").groupBy("block").cogroup(sums.unionByName(marks).groupBy("block")).applyInArrow(run, schema)
    return rows.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _sizes(table: DataFrame) -> tuple[int, int]:
    """Bits of a hash, and of a page's number, for a corpus."""
    r = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    # Pages grow with the blocks, so neither the rows of a page nor the entries of a row become too many.
    return min(64, SPARE + int(r["size"]).bit_length()), 10 + (int(r["n"]) >> 10).bit_length()


@dataclass
class Models:
    """The counts of both models by page (page, n, keys, t, g), and the bits of hashes and of page numbers."""

    counts: DataFrame
    width: int
    pages: int


def fit(docs: DataFrame, is_target: str | Column) -> Models:
    """Both models, from all of docs (doc_id, text and a boolean column): the background counts every document, the target those marked; null is not marked."""
    marked = F.col(is_target) if isinstance(is_target, str) else is_target
    # Rows are told apart by their own numbers here, for ids may repeat in and out of the target.
    numbered = materialise(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.coalesce(marked, F.lit(False)).alias("hot")), "marked")
    table = _blocks(numbered)
    hot = _of_target(table, numbered.filter("hot").select(F.col("doc_id").alias("mark_")))
    width, pages = _sizes(table)

    def merge(rows: pa.Table) -> pa.Table:
        _, keys, t, g = _decoded(rows)
        found, _, (t, g) = _summed(keys, t, g)
        return pa.table([rows.column("page").slice(0, 1), pa.array([len(found)]), *(pa.array([_packed(x)], pa.binary()) for x in (np.diff(found, prepend=np.uint64(0)), t, g))], names=["page", "n", "keys", "t", "g"])

    counts = _entries(table, hot, width, pages).groupBy("page").applyInArrow(merge, "page long, n long, keys binary, t binary, g binary")
    return Models(materialise(counts, "model"), width, pages)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of docs that the models have not counted: mean losses of a token in nats, and target less background. Texts without words, null ones too, have no losses."""
    table = _blocks(docs)
    hot = table.sparkSession.createDataFrame([], _HOT)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        _, keys, t, g = _decoded(asked)
        sums = [np.zeros(len(keys), np.uint64)] * 2
        if known.num_rows:
            _, have, *counts = _decoded(known)
            spot = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            sums = [np.where(have[spot] == keys, x[spot], np.uint64(0)) for x in counts]
        return _answered(asked, np.arange(len(keys)), sums)

    asked = _entries(table, hot, models.width, models.pages).groupBy("page")
    # Pages of the model that nothing asks for answer nothing.
    sums = asked.cogroup(models.counts.groupBy("page")).applyInArrow(lambda a, k: answer(a, k) if a.num_rows else _none(_SUMS), _SUMS)
    return _scores(table, sums, hot, models.width, counted=False)


def _of_target(table: DataFrame, marks: DataFrame) -> DataFrame:
    """(_HOT) of the ids of blocks that marks (mark_), distinct, has. Only ids are dealt out."""
    ids = table.select("block", F.explode("ids").alias("doc_id")).distinct()
    return materialise(ids.join(marks, F.col("doc_id") == F.col("mark_")).select("block", "doc_id"), "hot")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of docs (doc_id, text), by models fitted on them whose target is the documents with an id in target_ids (doc_id).

    score is the target's loss less the background's; lower is more like the target. What the models
    counted of a document is taken off before it is scored, so a text's score does not depend on
    whether it was among the target's. Texts without words, null and empty ones too, have neither losses
    nor score; a very long text is a block by itself. Ids may repeat or be null on either side, and
    repeated rows count and are scored as often; other columns of docs have no influence; an empty table
    gives an empty one. The ids of the target meet the ids of blocks, without texts.
    """
    table = _blocks(docs)
    hot = _of_target(table, target_ids.select(F.col("doc_id").cast("long").alias("mark_")).filter("mark_ is not null").distinct())
    width, pages = _sizes(table)

    def total(rows: pa.Table) -> pa.Table:
        _, keys, t, g = _decoded(rows)
        _, at, sums = _summed(keys, t, g)
        return _answered(rows, at, sums)

    sums = _entries(table, hot, width, pages).groupBy("page").applyInArrow(total, _SUMS)
    return _scores(table, sums, hot, width, counted=True)

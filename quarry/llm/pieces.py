"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A piece weighs exp(SHARPNESS * score - COST) with the score of the model file (no lower than the least
rank); characters without a piece, and the sign that stands for a space in pieces, become byte pieces.
Forward sums over the lattice of a text give, at every place, how likely each piece is that ends
there; from the end of the text backwards, pieces are drawn by these. The numbers drawn are hashes of
the row's key, the seed and the place, so a row has the same segmentation on every run and machine.

No piece of the model reaches over the start of a run of spaces or a line feed, so lattices fall into
short units. The distinct units of a batch are filtered together, place by place, and stay in a worker's
store for later batches; all units of a batch are sampled together, step by step. Bounds of draws are
whole numbers, found unit by unit, so what is in the store or in a batch has no influence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow, held

SHARPNESS, COST = 0.001, 1.0
SPACE = "▁"
#: Characters sampled at a time; a longer text is taken apart between units.
CHUNK = 1 << 21
#: Nodes of lattices that a worker remembers, but for those of the last chunk.
NODES = 2_000_000
#: The code of what is no beginning of a piece.
UNBEGUN = -2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits, but for the largest, for keys and places."""
    x = _mixed(key + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.minimum((x >> np.uint64(32)).astype(np.uint32), np.uint32(0xFFFFFFFE))


def row_key(key: object, seed: int) -> int:
    """A 64-bit key of a row key; null is a key too."""
    import xxhash

    return xxhash.xxh64_intdigest(repr(key), seed=seed)


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces: dict[str, tuple[float, bytes]] = {}
        self.bytes_of = [b""] * size
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_ids[self.bytes_of[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(SPACE, " ")
                self.bytes_of[i] = text.encode()
                self.pieces[text] = (SHARPNESS * max(model.get_score(i), -float(size)) - COST, np.uint32(i).tobytes())
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces):
            raise ValueError("a piece of the model reaches over units")
        self.byte_weight = -SHARPNESS * size - COST
        self.longest = max(map(len, self.pieces))
        self.size = size
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        # Hashes of all pieces and of their beginnings; which of them are pieces.
        known: dict[str, int] = {}
        for text, (_, data) in self.pieces.items():
            for k in range(1, len(text)):
                known.setdefault(text[:k], -1)
            known[text] = int(np.frombuffer(data, "<u4")[0])
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest = np.array([self._hash(t) for t in known], np.uint64)
        if len(np.unique(rest)) < len(rest) or not rest.all():
            raise ValueError("two pieces have one hash")
        value = np.array(list(known.values()), np.int32)
        while len(rest):  # what finds its place taken goes to the next table
            bits = max(8, len(rest).bit_length() + 3)
            hashes, pieces = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            _, first = np.unique(self._spot(rest, len(self.tables), bits), return_index=True)
            spot = self._spot(rest[first], len(self.tables), bits)
            hashes[spot], pieces[spot] = rest[first], value[first]
            self.tables.append((bits, hashes, pieces))
            rest, value = np.delete(rest, first), np.delete(value, first)
        self.weight = np.zeros(size)
        for w, data in self.pieces.values():
            self.weight[np.frombuffer(data, "<u4")[0]] = w
        # The store of lattices: of each node its first edge; of each edge its bound, where it starts in its
        # unit, and its code; where the nodes of a level of units filtered together start; the places of units.
        self.first_edge, self.level_at = np.empty(0, np.int32), np.empty(0, np.int32)
        self.bound, self.start, self.code = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.units: dict[str, int] = {}
        self.filled = 0, 0, 0

    @staticmethod
    def _spot(h: np.ndarray, table: int, bits: int) -> np.ndarray:
        return (h * np.uint64((0xD6E8FEB86659FD93 + 2 * table) * (table + 1) & 0xFFFFFFFFFFFFFFFF | 1)) >> np.uint64(64 - bits)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _edges(self, cp: np.ndarray, level: np.ndarray, many: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and codes of all pieces in units, by end, the longest of an end first.

        Characters stand level by level: the first ones of all units, then the second ones, the longest
        units first, so many[k] units have a character k, from first[k] on. A code is the id of a piece,
        or the character plus the number of ids, for its bytes.
        """
        at = end = np.arange(len(cp))
        up, column, h = level, at - first[level], np.zeros(len(cp), np.uint64)
        found = []
        for size in range(1, self.longest + 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (cp[end].astype(np.uint64) + np.uint64(1))
            code = np.full(len(h), UNBEGUN, np.int64)
            for i, (bits, hashes, pieces) in enumerate(self.tables):
                spot = self._spot(h, i, bits)
                hit = np.flatnonzero(hashes[spot] == h)
                code[hit] = pieces[spot[hit]]
            begun = code != UNBEGUN
            if size == 1:
                code = np.where(code < 0, self.size + cp.astype(np.int64), code)
            whole = code >= 0
            found.append((at[whole], end[whole], code[whole]))
            up = up + 1
            on = np.flatnonzero(begun & (column < many[up]))
            if not len(on):
                break
            at, up, column, h = at[on], up[on], column[on], h[on]
            end = first[up] + column
        starts, ends, codes = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        order = np.argsort(ends, kind="stable")  # of few sorted runs
        return starts[order], ends[order], codes[order]

    def _filtered(self, units: list[str]) -> None:
        """Forward filtering: puts the lattices of units, none empty, into the store."""
        units = sorted(units, key=len, reverse=True)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        levels = int(sizes[0])
        many = np.append(len(units) - np.searchsorted(sizes[::-1], np.arange(levels), side="right"), 0)
        first = np.cumsum(many) - many
        level = np.repeat(np.arange(levels), many[:-1])
        begin = np.cumsum(sizes) - sizes
        cp = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        cp = cp[begin[np.arange(len(cp)) - first[level]] + level]
        starts, ends, codes = self._edges(cp, level, many, first)
        wide = 1 + (codes >= self.size + 0x80) + (codes >= self.size + 0x800) + (codes >= self.size + 0x10000)
        weights = np.where(codes < self.size, self.weight[np.minimum(codes, self.size - 1)], self.byte_weight * wide)
        heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))  # a character always ends some piece
        each = np.diff(np.append(heads, len(ends)))
        from_ = level[starts]
        # What a piece follows is the character a level before; before the first one there is nothing.
        before = np.where(from_ > 0, first[np.maximum(from_ - 1, 0)] + (starts - first[from_]), len(cp))
        total, share = np.zeros(len(cp) + 1), np.empty(len(ends))
        for k in range(levels):
            x, y = first[k], first[k] + many[k]
            a, b = heads[x], heads[y] if y < len(heads) else len(ends)
            w = weights[a:b] + total[before[a:b]]
            top = np.maximum.reduceat(w, heads[x:y] - a)
            w = np.exp(w - np.repeat(top, each[x:y]))
            whole = np.add.reduceat(w, heads[x:y] - a)
            total[x:y] = top + np.log(whole)
            share[a:b] = w / np.repeat(whole, each[x:y])
        # Upper bounds of draws, one edge of every end after another; the last one of an end takes all that is left.
        upto, rank = share, 1
        while len(of := np.flatnonzero(each > rank)):
            spot = heads[of] + rank
            upto[spot] += upto[spot - 1]
            rank += 1
        bounds = np.minimum(upto * 2.0**32, 2.0**32 - 2).astype(np.uint32)
        bounds[heads + each - 1] = 0xFFFFFFFF
        nodes, edges, steps = self.filled
        if len(self.first_edge) < nodes + len(cp):
            self.first_edge = np.concatenate([self.first_edge[:nodes], np.empty(max(nodes, len(cp)), np.int32)])
        if len(self.bound) < edges + len(ends):
            self.bound, self.start, self.code = (np.concatenate([x[:edges], np.empty(max(edges, len(ends)), x.dtype)]) for x in (self.bound, self.start, self.code))
        if len(self.level_at) < steps + levels:
            self.level_at = np.concatenate([self.level_at[:steps], np.empty(max(steps, levels), np.int32)])
        self.first_edge[nodes : nodes + len(cp)] = heads + edges
        self.bound[edges : edges + len(ends)], self.start[edges : edges + len(ends)], self.code[edges : edges + len(ends)] = bounds, from_, codes
        self.level_at[steps : steps + levels] = first[:-1] + nodes
        self.units.update(zip(units, range(steps << 32, (steps << 32) + len(units)), strict=True))
        self.filled = nodes + len(cp), edges + len(ends), steps + levels

    def _stored(self, units: list[str]) -> np.ndarray:
        """Where the lattices of units are: the rows of their first places in level_at times 2^32, plus their columns. Lattices are kept until they are many."""
        found = list(map(self.units.get, units))
        new = [u for u, x in zip(units, found, strict=True) if x is None]
        if new:
            if self.filled[0] > NODES:
                self.units.clear()
                self.filled, new = (0, 0, 0), units
            self._filtered(new)
            found = list(map(self.units.__getitem__, units))
        return np.array(found, np.int64)

    def sample(self, text: str, firsts: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (none empty) that stand in a row in text, and the number of each. places: of each text's start in its row."""
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        data = text.encode()
        n = len(cp)
        space, feed = cp == 32, cp == 10
        cut = feed.copy()
        cut[0] = True
        cut[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        cut[firsts] = True
        starts = np.flatnonzero(cut)
        place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # bytes that characters start with
        offsets = np.append(place[starts], len(data)).astype(np.int32)
        strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        which = strings.indices.to_numpy()
        at = self._stored(strings.dictionary.to_pylist())[which]
        doc = np.searchsorted(firsts, starts, side="right") - 1
        key, shift = keys[doc], (places - firsts)[doc]
        chosen = np.full(n + 1, -1, np.int32)
        base, end, row, column = starts, np.diff(np.append(starts, n)), at >> 32, at & 0xFFFFFFFF
        while len(base):
            spot = base + end
            drawn = draws(key, spot + shift)
            edge = self.first_edge[self.level_at[row + end - 1] + column]
            later = np.flatnonzero(drawn >= self.bound[edge])
            while len(later):
                edge[later] += 1
                later = later[drawn[later] >= self.bound[edge[later]]]
            chosen[spot] = self.code[edge]
            end = self.start[edge]
            on = np.flatnonzero(end > 0)
            base, end, row, column, key, shift = base[on], end[on], row[on], column[on], key[on], shift[on]
        spots = np.flatnonzero(chosen >= 0)
        code = chosen[spots].astype(np.int64)
        other = np.flatnonzero(code >= self.size)
        signs = [chr(c - self.size).encode() for c in code[other].tolist()]
        each = np.ones(len(code), np.int64)
        each[other] = [len(d) for d in signs]
        ids = np.repeat(code, each)
        total = np.concatenate([[0], np.cumsum(each)])
        if len(other):
            ids[np.repeat(total[other], each[other]) + np.arange(each[other].sum()) - np.repeat(np.cumsum(each[other]) - each[other], each[other])] = [self.byte_ids[b] for d in signs for b in d]
        ends = np.append(firsts[1:], n)
        return ids.astype("<u4"), np.diff(total[np.concatenate([[0], np.searchsorted(spots, ends, side="right")])])

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text. A text that is not empty gets a space before it, which decode() takes off."""
        out: list[np.ndarray] = []
        group: list[int] = []

        def flush() -> None:
            some = [i for i in group if texts[i]]
            rows = [" " + texts[i] for i in some]
            size = np.array([len(r) for r in rows], np.int64)
            found: dict[int, np.ndarray] = {}
            if some:
                ids, counts = self.sample("".join(rows), np.cumsum(size) - size, np.array([keys[i] for i in some], np.uint64), np.zeros(len(some), np.int64))
                found = dict(zip(some, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
            out.extend(found.get(i, np.zeros(0, np.uint32)) for i in group)
            group.clear()

        total = 0
        for i, text in enumerate(texts):
            if total + len(text) > CHUNK:
                flush()
                total = 0
            total += len(text)
            if len(text) > CHUNK:
                out.append(self._long(" " + text, keys[i]))
                total = 0
            else:
                group.append(i)
        flush()
        return out

    def _long(self, text: str, key: int) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = at + CHUNK
            while end < len(text) and not (text[end] == "\n" or text[end - 1] == "\n" or text[end] == " " != text[end - 1]):
                end += 1
            parts.append(self.sample(text[at:end], np.array([0]), np.array([key], np.uint64), np.array([at]))[0])
            at = end
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids were made of."""
        size = self.lengths[ids]
        at = np.cumsum(size) - size
        data = self.flat[np.arange(size.sum()) + np.repeat(self.offsets[ids] - at, size)].tobytes().decode()
        return data.removeprefix(" ")


def lattice(path: str) -> Lattice:
    return held(("pieces", path), lambda: Lattice(path))


def encode(docs: DataFrame, model: str, seed: int = 0, key: str = "doc_id", verify: bool = False) -> DataFrame:
    """docs with piece_ids (binary, little-endian unsigned 32 bits), sampled by seed and the column key, and with verify lossless: whether decoding gives the text back.

    Null texts count as empty and have no ids. Rows of one key and text have the same ids. Columns of
    these names are replaced.
    """
    own = [c for c in docs.columns if c not in ("piece_ids", "lossless")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 768):
                part = batch.slice(k, 768)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = pieces.encode(texts, [row_key(x, seed) for x in part.column(key).to_pylist()])
                columns = [*[part.column(c) for c in own], pa.array([x.tobytes() for x in ids], pa.binary())]
                names = [*own, "piece_ids"]
                if verify:
                    columns.append(pa.array([pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()))
                    names.append("lossless")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = F.lit(None).cast("binary").alias("piece_ids"), F.lit(None).cast("boolean").alias("lossless")
    chosen = [F.col(f"`{c}`") for c in own]
    return arrow(docs.select(*chosen), run, docs.select(*chosen, *extra[: 1 + verify]).schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows with text, decoded from piece_ids; null ids give null."""
    own = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model)
        for batch in batches:
            texts = [x if x is None else pieces.decode(np.frombuffer(x, "<u4")) for x in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(texts, pa.string())], names=[*own, "text"])

    chosen = [F.col(f"`{c}`") for c in own]
    return arrow(rows.select(*chosen), run, rows.select(*chosen, F.lit(None).cast("string").alias("text")).schema)

"""Byte-level BPE over Arrow batches of whole texts.

The tokenizers library encodes each distinct piece of its pre-tokenisation once; numpy cuts the texts
into these pieces and puts the ids together. The cut follows the public pattern of this tokenizer
family: contractions, then runs of letters, numbers or other signs with one space before them at most,
then white space, whose last character stays apart if text follows. To which class a character
belongs is asked from the library, so its Unicode tables decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import held

LETTER, NUMBER, SIGN, SPACE, BLANK, UNKNOWN = 0, 1, 2, 3, 4, 255
#: Characters that are cut and encoded at a time; longer texts are cut at a single space between words.
CHUNK = 3 << 20
#: Pieces the library gets at a time.
ROW = 4096
#: Distinct pieces a worker remembers in each of two generations.
REMEMBERED = 160_000


class Encoder:
    """Encodes with a byte-level tokenizers file, as the library does by default: strings of added tokens become these tokens."""

    def __init__(self, path: str, end_id: int | None = 0, chunk: int = CHUNK):
        from tokenizers import Tokenizer

        self.chunk = chunk
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if end_id is None else np.uint32(end_id).tobytes()
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.id_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _class(self, c: str) -> int:
        if c == " ":
            return SPACE
        for with_, kind in (("a", LETTER), ("1", NUMBER), ("!", SIGN)):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(with_ + c)) == 1:
                return kind
        return BLANK

    def _starts(self, cp: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where pieces start; docs: where the texts start (none of them empty)."""
        kind = self.classes[cp]
        if (kind == UNKNOWN).any():
            for c in np.unique(cp[kind == UNKNOWN]):
                self.classes[c] = self._class(chr(c))
            kind = self.classes[cp]
        n = len(cp)
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        before[docs] = UNKNOWN
        after = np.empty(n, np.uint8)
        after[:-1] = kind[1:]
        after[-1] = UNKNOWN
        after[docs[1:] - 1] = UNKNOWN
        white = kind >= SPACE
        last = white & (after < SPACE)
        at = np.where(white, (before < SPACE) | (before == UNKNOWN) | last, (before != kind) & (before != SPACE))
        quote = np.flatnonzero((cp == 39) & at)
        if len(quote):
            ends = np.append(docs[1:], n)
            end = ends[np.searchsorted(ends, quote, side="right")]
            pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
            one = np.where(quote + 1 < end, pad[quote + 1], 0)
            two = np.where(quote + 2 < end, pad[quote + 2], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            at[quote[short | long] + 1] = False
            for found, size in ((short, 2), (long, 3)):
                nxt = quote[found] + size
                nxt = nxt[nxt < end[found]]
                at[nxt[kind[nxt] == LETTER]] = True
        return np.flatnonzero(at)

    def _ask(self, pieces: list[str], sizes: np.ndarray) -> list[bytes]:
        """What the library gives for each piece; sizes: in bytes.

        A piece of a space and other signs is cut off alone also where it follows another piece, so
        such pieces go in long rows, and their ids are told apart by the bytes each id stands for.
        """
        out: list[bytes] = [b""] * len(pieces)
        apart = [i for i, p in enumerate(pieces) if len(p) < 2 or p[0] != " " or p[1].isspace()]
        for k in range(0, len(apart), ROW):
            part = apart[k : k + ROW]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        alone = set(apart)
        joint = [i for i in range(len(pieces)) if i not in alone]
        for k in range(0, len(joint), ROW):
            part = joint[k : k + ROW]
            (e,) = self.tokenizer.encode_batch_fast(["".join([pieces[i] for i in part])], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            upto, ends = np.cumsum(self.id_bytes[ids]), np.cumsum(sizes[part])
            cut = np.searchsorted(upto, ends) + 1
            if not np.array_equal(upto[cut - 1], ends):
                raise ValueError("a piece was not cut off alone")
            data, cut = ids.tobytes(), (cut * 4).tolist()
            for i, a, b in zip(part, [0, *cut], cut, strict=False):
                out[i] = data[a:b]
        return out

    def _ids(self, pieces: list[str], sizes: np.ndarray) -> list[bytes]:
        got = list(map(self.new.get, pieces))
        unknown = []
        for i in [i for i, x in enumerate(got) if x is None]:
            x = self.old.get(pieces[i])
            if x is None:
                unknown.append(i)
            else:
                got[i] = self.new[pieces[i]] = x
        if unknown:
            asked = [pieces[i] for i in unknown]
            found = self._ask(asked, sizes[unknown])
            self.new.update(zip(asked, found, strict=True))
            for i, x in zip(unknown, found, strict=True):
                got[i] = x
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return got

    def _encode(self, text: str, lengths: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that stand in a row in text, and the number of each."""
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        firsts = np.cumsum(lengths) - lengths
        some = np.flatnonzero(lengths > 0)
        starts = self._starts(cp, firsts[some]) if len(some) else np.zeros(0, np.int64)
        data = text.encode()
        place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # bytes that characters start with
        offsets = np.append(place[starts], len(data)).astype(np.int32)
        del place, cp
        strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        known = self._ids(strings.dictionary.to_pylist(), pc.binary_length(strings.dictionary).to_numpy())
        which = strings.indices.to_numpy()
        ends = np.searchsorted(starts, firsts + lengths)  # pieces up to the end of each text
        if end and self.end:
            which = np.insert(which, ends, len(known))
            known = [*known, self.end]
            ends = ends + np.arange(1, len(ends) + 1)
        sizes = np.array(list(map(len, known)), np.int64) >> 2
        flat = np.frombuffer(b"".join(known), "<u4")
        at = np.cumsum(sizes) - sizes
        each = sizes[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(upto[-1]) + np.repeat(at[which] - upto[:-1], each)]
        counts = np.diff(upto[np.concatenate([[0], ends])])
        return ids, counts

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Parts of the texts in order: index of the first, ids of all in a row, number of ids of each.

        Null counts as empty. Each text's ids end with the end id. Texts with strings of added tokens
        are left to the library as a whole.
        """
        first, group, total = 0, [], 0
        for i, text in enumerate(texts):
            text = text or ""
            odd = any(t in text for t in self.added)
            if group and (odd or total + len(text) > self.chunk):
                yield first, *self._encode("".join(group), np.array([len(x) for x in group], np.int64), True)
                first, group, total = i, [], 0
            if odd or len(text) > self.chunk:
                yield i, *(self._whole(text) if odd else self._long(text))
                first = i + 1
                continue
            group.append(text)
            total += len(text)
        if group:
            yield first, *self._encode("".join(group), np.array([len(x) for x in group], np.int64), True)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        ids = np.concatenate([ids, np.frombuffer(self.end, "<u4")])
        return ids, np.array([len(ids)])

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts, at = [], 0
        while at < len(text):
            cut = at + self.chunk
            while (cut := text.find(" ", cut)) >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
                cut += 1
            cut = len(text) if cut < 0 else cut
            parts.append(self._encode(text[at:cut], np.array([cut - at]), cut == len(text))[0])
            at = cut
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])


def encoder(path: str, end_id: int | None = 0, chunk: int = CHUNK) -> Encoder:
    """The worker's encoder for a file; a worker keeps it from task to task."""
    return held(("bpe", path, end_id, chunk), lambda: Encoder(path, end_id, chunk))


def encoded(encoder: Encoder, batch: pa.RecordBatch, rows: int = 4096) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids and numbers of ids of parts of a batch (key, text); Python strings exist for a few rows at a time."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        for first, ids, counts in encoder.encode(part.column(1).to_pylist()):
            yield part.column(0).slice(first, len(counts)), ids, counts

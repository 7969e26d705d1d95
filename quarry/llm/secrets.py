"""Secret scans: three fixed patterns, and a conditional random field that adds spans to theirs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import crf
from quarry.llm.common import arrow, held

#: Kinds in their order among spans of equal start.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api_key", "apikey")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

#: Characters that are tokenised at a time; a longer text is taken apart at white space.
CHUNK = 3 << 19
#: Characters of shorter texts that are tokenised together.
GROUP = 1 << 19
#: Distinct tokens whose scores a worker remembers in each of two generations.
REMEMBERED = 80_000

Span = tuple[str, int, int]
_SIGNS = [crf.KINDS.index(k) for k in ("assign", "quote", "open")]


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind. Matches too short are dropped after they took their place."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # A run is taken whole, so one pattern for long runs finds the same.
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_WORD, _JOIN, _EQUAL, _SPACE, _OTHER = range(5)


def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    word = re.compile(r"\w")
    for c in range(0x110000):
        s = chr(c)
        if s.isspace():
            table[c] = _SPACE
        elif s.isalnum() or s == "_":
            table[c] = _WORD if word.match(s) else _OTHER
    for s in "+/.~-":
        table[ord(s)] = _JOIN
    table[ord("=")] = _EQUAL
    return table


class Scanner:
    """Tags many texts at a time with a model."""

    table: np.ndarray | None = None

    def __init__(self, model: crf.Model):
        self.model = model
        self.new: dict[str, tuple[float, float, float, int]] = {}
        self.old: dict[str, tuple[float, float, float, int]] = {}
        if Scanner.table is None:
            Scanner.table = _classes()

    def _known(self, tokens: list[str]) -> np.ndarray:
        rows = []
        for t in tokens:
            r = self.new.get(t)
            if r is None:
                r = self.old.get(t)
                if r is None:
                    r = (*self.model.own(t), crf.kind(t))
                self.new[t] = r
            rows.append(r)
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return np.array(rows, np.float64).reshape(-1, 4)

    def tokens(self, text: str, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Starts, ends and strings of the tokens of texts that stand in a row in text, none across two."""
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n, c = len(cp), self.table[cp]
        new = np.ones(n, bool)
        new[1:] = c[1:] != c[:-1]
        new[firsts] = True
        at = np.flatnonzero(new)
        kind, ends = c[at], np.append(at[1:], n)
        lead = np.zeros(n, bool)
        lead[firsts] = True
        head = lead[at]  # runs that no earlier run belongs to
        before = np.concatenate([[_SPACE], kind[:-1]])
        before[head] = _SPACE
        after = np.concatenate([kind[1:], [_SPACE]])
        after[:-1][head[1:]] = _SPACE
        inner = (kind == _JOIN) & (before == _WORD) & (after == _WORD)
        joined = np.concatenate([[False], inner[:-1]]) & (kind == _WORD)
        tail = (kind == _EQUAL) & (before == _WORD)
        goes_on = inner | joined | tail
        group = np.flatnonzero(~goes_on)
        starts, stops = at[group], ends[np.append(group[1:], len(at)) - 1]
        kinds = kind[group]
        keep = kinds != _SPACE
        starts, stops, kinds = starts[keep], stops[keep], kinds[keep]
        sizes = np.where(kinds == _WORD, 1, stops - starts)  # other characters are tokens each
        many = np.repeat(np.arange(len(starts)), sizes)
        step = np.arange(len(many)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = starts[many] + step
        stops = np.where(kinds[many] == _WORD, stops[many], starts + 1)
        black = cp[c != _SPACE]
        wide = np.ones(len(black), np.int32)
        for top in (0x80, 0x800, 0x10000):
            wide += black >= top
        place = np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)
        offsets = place[np.concatenate([[0], np.cumsum(stops - starts)])]
        data = black.tobytes().decode("utf-32-le").encode()
        strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        return starts, stops, strings

    def tag(self, texts: list[str], file: int | None = None) -> list[list[tuple[int, int]]]:
        """Spans of each text that the model tags: a begin, or an inside after an outside, and the insides that follow. file: the kind of the file, if texts are parts of one."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        bounds = np.cumsum(lengths) - lengths
        some = np.flatnonzero(lengths)
        if not len(some):
            return found
        starts, stops, strings = self.tokens("".join(texts), bounds[some])
        if not len(starts):
            return found
        known, which = self._known(strings.dictionary.to_pylist()), strings.indices.to_numpy()
        doc = np.searchsorted(bounds[some], starts, side="right") - 1
        edge = crf.KINDS.index("edge")
        kinds = known[:, 3].astype(np.int64)[which]
        n = len(kinds)
        first = np.searchsorted(doc, np.arange(len(some)))
        place = np.arange(n) - first[doc]
        if file is None:
            share = np.bincount(doc, np.isin(kinds, _SIGNS), len(some)) / np.maximum(np.bincount(doc, minlength=len(some)), 1)
            files = np.array([crf.file_kind(x) for x in share.tolist()])
        else:
            files = np.full(len(some), file)
        score = known[:, :3][which]
        for i in range(3):
            near = np.full(n, edge)
            near[i + 1 :] = kinds[: n - i - 1]
            near[place <= i] = edge
            score += self.model.before[i][near]
        near = np.append(kinds[1:], edge)
        near[np.append(doc[1:] != doc[:-1], True)] = edge
        score += self.model.after[near] + self.model.file[files[doc]]
        open_ = np.flatnonzero(score[:, 0] - score[:, 1:].max(1) <= self.model.safe)
        if not len(open_):
            return found
        ends = np.append(first[1:], n)
        breaks = np.flatnonzero((np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])) + 1
        for a, b in zip(open_[np.append(0, breaks)].tolist(), open_[np.append(breaks, len(open_)) - 1].tolist(), strict=True):
            d = doc[a]
            tags = self.model.best(score[a : b + 1], a > first[d], b + 1 < ends[d])
            own, base = found[some[d]], bounds[some[d]]
            for i, t in enumerate(tags, a):
                if t == crf.BEGIN or t == crf.INSIDE and (i == a or not tags[i - a - 1]):
                    own.append((int(starts[i] - base), int(stops[i] - base)))
                elif t == crf.INSIDE:
                    own[-1] = (own[-1][0], int(stops[i] - base))
        return found

    def scan(self, texts: list[str]) -> Iterator[list[Span]]:
        """All spans of each text, by start, then kind: the base spans, and those of the model that no base span holds."""
        group: list[str] = []
        for text in [*texts, None]:
            if text is None or sum(map(len, group)) + len(text) > GROUP:
                for t, tagged in zip(group, self.tag(group), strict=True):
                    yield merged(base_spans(t), tagged)
                group = []
            if text is not None and len(text) > CHUNK:
                yield merged(base_spans(text), self._long(text))
            elif text is not None:
                group.append(text)

    def _long(self, text: str) -> list[tuple[int, int]]:
        """A long text in parts that end at white space; what a part finds near its ends comes from parts around them. The kind of its file is that of all parts."""
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            while end < len(text) and not text[end].isspace():
                end += 1
            parts.append((at, end))
            at = end
        signs = total = 0
        for a, b in parts:
            strings = self.tokens(text[a:b], np.zeros(1, np.int64))[2]
            kinds = self._known(strings.dictionary.to_pylist())[:, 3].astype(np.int64)[strings.indices.to_numpy()]
            signs, total = signs + int(np.isin(kinds, _SIGNS).sum()), total + len(kinds)
        file, found, margin = crf.file_kind(signs / max(total, 1)), [], 1 << 14
        for at, end in parts:
            a, b = max(0, at - margin), min(len(text), end + margin)
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            found += [(s + a, e + a) for s, e in self.tag([text[a:b]], file)[0] if at <= s + a < end]
        return found


def merged(base: list[Span], tagged: list[tuple[int, int]]) -> list[Span]:
    """base, by start, and of tagged what no base span holds."""
    extra, upto, i = [], -1, 0
    for a, b in sorted(tagged):
        while i < len(base) and base[i][1] <= a:
            upto, i = max(upto, base[i][2]), i + 1
        if b > upto:
            extra.append(("crf", a, b))
    return sorted([*base, *extra], key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str, spans: list[Span], mask: str) -> str:
    """text with each stretch that spans cover replaced by mask."""
    out, at, upto = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= upto:
            out += [text[at:a], mask]
        upto = max(upto, b)
        at = upto
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, redact: str | None = None) -> DataFrame:
    """docs with spans, an array of (kind, start, end) in code points, end exclusive; a column of that name is replaced.

    With redact, text has that string in place of what the spans cover. Null texts have no spans and
    stay null; an empty table gives an empty one. The model is fitted on the driver and sent along.
    """
    model = crf.trained()
    weights, moves = model.weights, model.moves
    own = [c for c in docs.columns if c != "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held(("crf", weights.tobytes()), lambda: Scanner(crf.Model(weights, moves)))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column("text").to_pylist()
                spans = list(scanner.scan([t or "" for t in texts]))
                if redact is not None:
                    texts = [t if t is None else redacted(t, s, redact) for t, s in zip(texts, spans, strict=True)]
                rows = pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([*[pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in own], rows], names=[*own, "spans"])

    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField("spans", SPANS)])
    return arrow(docs.select(*[F.col(f"`{c}`") for c in own]), run, schema)


def joined(spans: Column, base: bool = False) -> Column:
    """kind:start:end of spans, comma-joined; with base, without those of the model."""
    shown = F.filter(spans, lambda s: s["kind"] != "crf") if base else spans
    return F.array_join(F.transform(shown, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

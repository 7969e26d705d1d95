"""A linear-chain conditional random field that tags tokens as secret begin, inside or outside.

A token's features are its shape, the kinds of the three tokens before and the one after it, and a
feature of its file: how many signs of assignments, quotes and brackets are in the whole of it. Weights
are fitted here, by gradient steps on the likelihood of labelled lines of files that labelled_lines()
makes from a seed. Decoding is exact Viterbi. It skips what can't be a secret: where
outside scores above the other tags by more than any two transitions can give back, the best path is
outside, so the chain falls into short stretches between such tokens.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Word characters, joined by some signs, with equals signs at the end; any other character alone.
TOKEN = re.compile(r"\w+(?:[+/.~-]+\w+)*=*|\S")
#: Words that announce a secret, and beginnings of well-known kinds of keys.
KEYWORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "key", "credential", "credentials", "auth", "authorization", "bearer", "access_key", "secret_key", "private_key", "client_secret")
PREFIXES = ("ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "eyJ", "AKIA", "ASIA", "AIza", "SG.", "npm_", "pypi-", "hf_")

_KEYWORDS, _ENDS = frozenset(KEYWORDS), tuple("_" + k for k in KEYWORDS)
_QUOTES, _ASSIGN = "\"'`", ":="
#: Kinds of a neighbour.
KINDS = ("edge", "keyword", "assign", "quote", "comma", "open", "sign", "number", "plain", "mixed", "is")
FILES = 3


def kind(token: str) -> int:
    low = token.lower()
    bare = low.rstrip("=")
    if bare in _KEYWORDS or bare.endswith(_ENDS):
        name = "keyword"
    elif len(token) == 1 and not token.isalnum():
        name = "assign" if token in _ASSIGN else "quote" if token in _QUOTES else "comma" if token in ",;.|" else "open" if token in "([{<" else "sign"
    elif low in ("is", "ist", "est", "es", "was"):
        name = "is"
    elif token.isdigit():
        name = "number"
    else:
        name = "plain" if token.isalpha() else "mixed"
    return KINDS.index(name)


def _size(n: int) -> int:
    return sum(n >= x for x in (2, 4, 8, 12, 16, 24, 40))


def _spread(token: str) -> int:
    return min(5, len(set(token)).bit_length())


#: Features of a token itself: places of their weights.
SHAPES = 8 + 16 + 6 + 6 + 6 + 12


def shape(token: str) -> list[int]:
    """Active features of a token: length, kinds of characters, changes between them, share of digits, spread of characters, and marks."""
    n = len(token)
    classes = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in token]
    has = {c: classes.count(c) for c in "luds"}
    mix = sum(1 << i for i, c in enumerate("luds") if has[c])
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False)) - (n > 1 and classes[0] == "u" and classes[1] == "l")
    on = [_size(n), 8 + mix, 24 + min(5, changes // 2 if changes > 3 else changes // 3), 30 + min(5, 6 * has["d"] // n), 36 + _spread(token)]
    marks = (
        token.startswith(PREFIXES) and n >= 16,
        n >= 16 and all(c in "0123456789abcdef" for c in token) and has["d"] > 0 and has["l"] > 0,
        n >= 8 and has["d"] == n,
        any(ord(c) > 127 for c in token),
        "@" in token or token.startswith(("http", "www.")),
        n == 1 and not token.isalnum(),
        token.isalpha() and (token.islower() or token.istitle() or token.isupper()),
        n >= 12 and changes * 3 >= n and has["d"] > 0,
        n >= 8 and has["d"] > 0 and has["l"] + has["u"] > 0,
        token.count(".") > 1 or token.count("/") > 1,
        bool(re.fullmatch(r"[0-9][0-9.,:/-]*", token)),
        kind(token) == KINDS.index("keyword"),
    )
    return on + [42 + i for i, m in enumerate(marks) if m]


# Places of weights: shapes, kinds one, two and three tokens before, kinds one after, the file, and a constant.
_BEFORE = SHAPES
_AFTER = _BEFORE + 3 * len(KINDS)
_FILE = _AFTER + len(KINDS)
_BIAS = _FILE + FILES
FEATURES = _BIAS + 1


def file_kind(signs: float) -> int:
    """The feature of a file, from the share of its tokens that are assignment signs, quotes or brackets."""
    return int(signs > 0.02) + int(signs > 0.12)


def _random(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(low, high)))


#: Of made-up files, by style: the chance of a secret in a line, that it has a name before it, and that a line has a code that only looks like one.
STYLES = {"prose": (0.15, 0.9, 0.3), "notes": (0.5, 0.75, 0.1), "settings": (0.7, 0.75, 0.0)}


def signs(kinds: list[int]) -> float:
    """The share of tokens, by their kinds, that are assignment signs, quotes or brackets."""
    return sum(kinds.count(KINDS.index(k)) for k in ("assign", "quote", "open")) / max(len(kinds), 1)


def labelled_lines(n: int, seed: int) -> list[tuple[list[str], list[int], int]]:
    """n made-up lines as tokens, tags and the kind of their file; files have some lines of one style each, and their kind is found from all their tokens."""
    rng = random.Random(seed)
    syllables = "th an in er on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung sch keit ión qué ée aux ö ü ß que mente ado cion elle eau".split()
    alnum = string.ascii_letters + string.digits

    def word() -> str:
        w = "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3, 4, 5))))
        return rng.choice((w, w, w, w, w.capitalize(), w.upper(), w + rng.choice((".", ",")), w + "-" + w))

    def secret() -> str:
        return rng.choice(
            (
                lambda: rng.choice(PREFIXES) + _random(rng, alnum, 16, 40),
                lambda: _random(rng, "0123456789abcdef", 32, 64),
                lambda: _random(rng, alnum + "+/", 24, 64) + rng.choice(("", "=", "==")),
                lambda: _random(rng, alnum, 20, 44),
                lambda: "eyJ" + _random(rng, alnum, 20, 40) + "." + _random(rng, alnum, 20, 40) + "." + _random(rng, alnum + "_-", 20, 40) + "x",
                lambda: "AKIA" + _random(rng, string.ascii_uppercase + string.digits, 16, 16),
            )
        )()

    def weak() -> str:  # only in context
        return rng.choice((lambda: _random(rng, alnum, 8, 16), lambda: rng.choice(syllables).capitalize() + rng.choice(syllables) + _random(rng, string.digits, 2, 4), lambda: _random(rng, alnum + "_", 10, 20)))()

    def harmless() -> str:
        return rng.choice(
            (
                lambda: _random(rng, string.digits, 1, 16),
                lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
                lambda: f"{rng.choice(syllables)}.{rng.choice(syllables)}{rng.randint(1, 99)}@{rng.choice(syllables)}.com",
                lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
                lambda: f"https://{rng.choice(syllables)}.com/{rng.choice(syllables)}/{rng.randint(1, 999)}",
                lambda: f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
                lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
                lambda: word() + rng.choice(("###", "***", "$$$", "%%%", "&&&", "!!", "!")),
                lambda: f"{rng.choice(syllables)}_{rng.choice(syllables)}_{rng.choice(syllables)}",
                lambda: "| " + word(),
                lambda: rng.choice(KEYWORDS),
                lambda: f"{rng.choice(KEYWORDS)} {rng.choice(('of', 'for', 'and', 'ring', 'is'))} {word()}",
                lambda: f"{rng.choice(syllables)} = {rng.choice((word(), str(rng.randint(0, 9999))))}",
                lambda: f"{rng.choice(syllables)}: {word()}",
                lambda: _random(rng, string.ascii_uppercase, 2, 12) + "-" + str(rng.randint(1, 9999)),
                lambda: "".join(w.capitalize() for w in rng.choices(syllables, k=4)),
            )
        )()

    def line(style: str) -> tuple[list[str], list[int]]:
        hot, named, coded = STYLES[style]
        parts: list[tuple[str, bool]] = [(word(), False) for _ in range(rng.randint(8, 24) if style == "prose" else rng.randint(2, 9))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            parts.insert(rng.randint(0, len(parts)), (harmless(), False))
        if rng.random() < coded:
            parts.insert(rng.randint(0, len(parts)), (weak(), False))
        if style == "settings":
            parts[:0] = [(f"{rng.choice(syllables)}_{rng.choice(syllables)} {rng.choice('=:')} {rng.choice(('', '[', '{', chr(34)))}", False)]
        if rng.random() < hot:
            at, quote = rng.randint(0, len(parts)), rng.choice(("", '"', "'", "`"))
            if rng.random() < named:
                lead = rng.choice(KEYWORDS)
                lead = rng.choice((lead, lead.upper(), lead.capitalize())) + rng.choice((" =", "=", ":", " :", " is", '":', " :="))
                parts[at:at] = [(f"{lead} {quote}" if rng.random() < 0.7 else f"{lead}{quote}", False), (secret() if rng.random() < 0.6 else weak(), True), (quote, False)]
            elif style == "settings" and rng.random() < 0.5:
                parts[at:at] = [(f"{rng.choice(syllables)} = {quote}", False), (weak(), True), (quote, False)]
            else:
                parts[at:at] = [(quote, False), (secret(), True), (quote, False)]
        tokens, tags = [], []
        for text, is_hot in parts:
            found = TOKEN.findall(text)
            tokens += found
            tags += [BEGIN if is_hot and not i else INSIDE if is_hot else OUTSIDE for i in range(len(found))]
        return tokens, tags

    out: list[tuple[list[str], list[int], int]] = []
    while len(out) < n:
        style = rng.choice(list(STYLES))
        lines = [line(style) for _ in range(rng.randint(4, 16))]
        file = file_kind(signs([kind(t) for tokens, _ in lines for t in tokens]))
        out += [(tokens, tags, file) for tokens, tags in lines]
    return out[:n]


def _encode(tokens: list[str], file: int) -> np.ndarray:
    """A row of active features for each token, filled with the last place, which has no weight."""
    kinds = [KINDS.index("edge")] * 3 + [kind(t) for t in tokens] + [KINDS.index("edge")]
    rows = np.full((len(tokens), 24), FEATURES, np.int64)
    for i, t in enumerate(tokens):
        on = shape(t) + [_BEFORE + k * len(KINDS) + kinds[i + 2 - k] for k in range(3)] + [_AFTER + kinds[i + 4], _FILE + file, _BIAS]
        rows[i, : len(on)] = on
    return rows


class Model:
    """weights: of each feature for each tag; moves: of a tag after a tag."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.plain: dict[tuple, tuple[float, ...]] = {}
        x = (BEGIN, INSIDE)
        m = moves
        self.give_back = max(m[a, t] + m[t, b] - m[a, OUTSIDE] - m[OUTSIDE, b] for a in range(3) for b in range(3) for t in x)
        self.at_edge = max(max(m[a, t] - m[a, OUTSIDE], m[t, a] - m[OUTSIDE, a], 0) for a in range(3) for t in x)
        self.safe = max(self.give_back, self.at_edge) + 1e-6
        k = len(KINDS)
        #: Scores of tags by the kinds of neighbours and of the file.
        self.before = [weights[_BEFORE + i * k : _BEFORE + (i + 1) * k] for i in range(3)]
        self.after = weights[_AFTER : _AFTER + k]
        self.file = weights[_FILE : _FILE + FILES] + weights[_BIAS]
        gain = lambda w: float((w[:, 1:].max(1) - w[:, 0]).max())
        #: What neighbours and file can take from the lead of outside at most.
        self.context = sum(gain(w) for w in (*self.before, self.after, self.file))

    def own(self, token: str) -> tuple[float, ...]:
        """Scores of a token by itself. Plain words that agree in what shape() looks at are scored once."""
        case = token.islower() + 2 * token.istitle() + 4 * token.isupper() if token.isalpha() else 0
        if not case or not (token.isascii() or all(c.islower() or c.isupper() for c in token)):
            return tuple(self.weights[shape(token)].sum(0).tolist())
        key = (case, _size(len(token)), _spread(token), token.isascii(), token.startswith(PREFIXES), token.lower() in _KEYWORDS, len(token) >= 16 and token.startswith(PREFIXES), len(token) == 1)
        if key not in self.plain:
            self.plain[key] = tuple(self.weights[shape(token)].sum(0).tolist())
        return self.plain[key]

    def best(self, scores: np.ndarray, after_outside: bool, before_outside: bool) -> list[int]:
        """Viterbi over rows of tag scores, between outside tags or the ends of the chain."""
        m = self.moves
        value = scores[0] + (m[OUTSIDE] if after_outside else 0)
        back = []
        for row in scores[1:]:
            step = value[:, None] + m
            back.append(step.argmax(0))
            value = step.max(0) + row
        tag = int((value + (m[:, OUTSIDE] if before_outside else 0)).argmax())
        path = [tag]
        for b in reversed(back):
            path.append(tag := int(b[tag]))
        return path[::-1]

    def tag(self, tokens: list[str], file: int) -> list[int]:
        """Viterbi over the whole chain, without skipping."""
        return self.best(np.vstack([self.weights, np.zeros(3)])[_encode(tokens, file)].sum(1), False, False) if tokens else []


@lru_cache
def trained(lines: int = 1600, seed: int = 11, steps: int = 80) -> Model:
    """Fitted by AdaGrad on the log-likelihood of labelled_lines(lines, seed), with a little weight decay."""
    data = labelled_lines(lines, seed)
    longest = max(len(t) for t, _, _ in data)
    x = np.full((lines, longest, 24), FEATURES, np.int64)
    y = np.zeros((lines, longest), np.int64)
    mask = np.zeros((lines, longest), bool)
    for i, (tokens, tags, file) in enumerate(data):
        x[i, : len(tokens)] = _encode(tokens, file)
        y[i, : len(tokens)] = tags
        mask[i, : len(tokens)] = True
    w, m = np.zeros((FEATURES + 1, 3)), np.zeros((3, 3))
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    hot = np.eye(3)[y] * mask[..., None]
    pair = mask[:, 1:] & mask[:, :-1]
    seen = np.einsum("ita,itb->ab", hot[:, :-1] * pair[..., None], hot[:, 1:])
    flat = x[mask].ravel()

    def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for _ in range(steps):
        e = np.where(mask[..., None], w[x].sum(2), 0.0)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], log_sum(alpha[:, t - 1][:, :, None] + m, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], log_sum(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
        total = log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + m + (e + beta)[:, 1:, None, :] - total[:, None, None, None]) * pair[..., None, None]
        miss = (node - hot)[mask]
        dw = np.stack([np.bincount(flat, np.repeat(miss[:, k], x.shape[2]), FEATURES + 1) for k in range(3)], 1) / lines + 1e-4 * w
        dm = (edge.sum((0, 1)) - seen) / lines + 1e-4 * m
        dw[FEATURES] = 0
        gw += dw * dw
        gm += dm * dm
        w -= 0.4 * dw / np.sqrt(gw)
        m -= 0.4 * dm / np.sqrt(gm)
    return Model(w[:FEATURES], m)

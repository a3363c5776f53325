"""Secret scan: fixed patterns, and a character convolutional network over further candidates.

The patterns give the base findings. Candidates are all runs of token characters of SHORTEST or more, or what
the base findings leave of them; the network sees each one with its surrounding context. One of more
than VALUE characters is seen through every window of VALUE characters in it and through each of its
parts between separators as if it stood alone, and its score is the highest of these.

The network is trained here on labelled findings: candidates that a pattern found, and made-up
values of formats that no pattern knows (``FORMATS``), are secrets; candidates that no pattern found, and
made-up ordinary tokens (``ORDINARY``), are not. The training candidates also come without their context,
and the secrets with that of other candidates, so that the network has to learn what the values
look like and not only the words before them. Candidates of the corpus that no pattern covers but that
look like secrets to a first network, context aside, are left out when the final one is trained.

It learns from every distinct window of every candidate. They are dealt by their hashes to pieces of about ``PIECE``; a
task goes on from the last network over a piece and the made-up values, and the networks of a turn's pieces are averaged.
There are ``TURNS`` turns, each with its share of the pieces, so a large corpus is gone through once and a small one ``EPOCHS`` times.
Where a class has more than ``WEIGH`` rows in a piece, each of its words comes in one form only: as it is or in capitals, with its context or alone.
A class of the corpus weighs as ``WEIGH`` rows of the made-up values at most; one of fewer rows is whole in every piece.

A quarter of the distinct values is kept for calibration (Platt's logistic scaling) and for the
thresholds, by counts of all kept candidates in steps of their logits: for each kind of value (hexadecimal, letters and digits, with separators) the highest one that
still recalls ``RECALL`` of the kept secrets, with and without their context, or a higher one if more than ``FALSE`` of
the kept ordinary values of the corpus or of the made-up ones would pass. Candidates that no pattern covers and that reach their kind's threshold are
added as kind ``model``. A word is only added if words are among the labelled secrets (20 kept ones at least). Words (letters in one case) are ordinary whatever the first network says, and
the corpus's own words are learned in capitals too. Every candidate of every whole text is scored, all of it.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, written
from ._text import mask_runs, slices, string_bytes, tidied

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SHORTEST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
#: A class of the corpus weighs as much as this many rows at most.
WEIGH = 2000
#: Distinct windows of the corpus that a task learns from at a time, and the turns that their networks are averaged in.
PIECE, TURNS = 1 << 15, 4
#: Rows of a piece that are few enough for all epochs.
FEW = 18000
#: Steps of a logit that kept values are counted by.
GRID = 256
#: Made-up values of each format, and ordinary tokens of each kind.
MADE_UP = 400
RECALL, FALSE = 0.97, 0.001
EPOCHS, JUDGE_EPOCHS, STEP = 12, 3, 192
BEFORE, HEAD, TAIL, AFTER = 20, 28, 12, 8
VALUE = HEAD + TAIL
WIDTH = BEFORE + VALUE + AFTER
#: Windows of a long candidate that are worked out together; bounds the working memory.
BLOCK = 1 << 14
_FILTERS, _SPAN, _HIDDEN = 24, 5, 16

_SYMBOL = np.full(256, 1, np.uint8)  # 0 is padding, 1 anything else
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"':=+/_.-@,;#"):
    _SYMBOL[ord(_c)] = _i + 2
_SYMBOLS = int(_SYMBOL.max()) + 1
# symbols that aren't separators in a token, and hexadecimal digits
_INNER, _HEXES = np.zeros(_SYMBOLS, bool), np.zeros(_SYMBOLS, bool)
_INNER[2:64] = _INNER[_SYMBOL[ord("+")]] = True
_HEXES[[_SYMBOL[ord(c)] for c in "0123456789abcdefABCDEF"]] = _HEXES[0] = True
_TOKEN, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_TOKEN[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"]] = True
_HEX[48:58] = _HEX[97:103] = True

_ALNUM, _LOW = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits


def _some(r: random.Random, of: str, least: int, most: int | None = None) -> str:
    return "".join(r.choices(of, k=r.randint(least, most or least)))


def _name(r: random.Random, least: int = 3, most: int = 9) -> str:
    """Something like a word: consonants and vowels in turn."""
    return "".join(r.choice("aeiou" if k % 2 else "bcdfghklmnprstvw") for k in range(r.randint(least, most)))


#: Made-up secrets: widely used formats of access tokens, keys and passwords.
FORMATS: dict[str, Callable[[random.Random], str]] = {
    "prefixed": lambda r: r.choice(("ghp_", "gho_", "glpat-", "npm_", "sk_live_", "pk_test_")) + _some(r, _ALNUM, 20, 36),
    "web token": lambda r: ".".join(("eyJ" + _some(r, _ALNUM + "_-", 17, 40), "eyJ" + _some(r, _ALNUM + "_-", 30, 80), _some(r, _ALNUM + "_-", 43))),
    "cloud key": lambda r: "AIza" + _some(r, _ALNUM + "_-", 35),
    "chat token": lambda r: f"xox{r.choice('bpar')}-{_some(r, string.digits, 10, 13)}-{_some(r, string.digits, 10, 13)}-{_some(r, _ALNUM, 24)}",
    "base64": lambda r: _some(r, _ALNUM + "+/", 22, 60) + r.choice(("", "=", "==")),
    "hexadecimal": lambda r: _some(r, r.choice(("0123456789abcdef", "0123456789ABCDEF")), 16, 40),
    "letters and digits": lambda r: _some(r, r.choice((_ALNUM, _LOW)), 14, 32),
    "password": lambda r: _some(r, _ALNUM, 5, 9) + r.choice("+_=.-") + _some(r, _ALNUM + "+_=.-", 6, 10),
}
#: Made-up tokens that aren't secrets.
ORDINARY: dict[str, Callable[[random.Random], str]] = {
    "path": lambda r: "/".join(_name(r) for _ in range(r.randint(2, 5))) + r.choice(("", "/index.html", f"/{r.randint(1, 9999)}", ".txt")),
    "site": lambda r: "www." + _name(r) + r.choice((".com", ".org", ".net")) + "/" + _name(r) + f"/{r.randint(1990, 2030)}/{r.randint(1, 12):02}",
    "date": lambda r: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}",
    "number": lambda r: _some(r, string.digits, 12, 20),
    "grouped number": lambda r: "-".join(_some(r, string.digits, 3, 4) for _ in range(r.randint(3, 5))),
    "word": lambda r: r.choice((str.lower, str.upper, str.capitalize))(_name(r, 12, 18)) + r.choice(("", "", ".")),
    "hyphenated": lambda r: "-".join(_name(r) for _ in range(r.randint(2, 4))) + "-" + _name(r, 4, 8),
    "identifier": lambda r: "_".join(_name(r) for _ in range(r.randint(2, 4))) + f"_{r.randint(1, 9999)}",
    "camel case": lambda r: _name(r) + "".join(_name(r).capitalize() for _ in range(r.randint(2, 3))) + str(r.randint(0, 99)),
    "version": lambda r: f"{_name(r)}-{r.randint(0, 20)}.{r.randint(0, 40)}.{r.randint(0, 99)}-rc{r.randint(1, 9)}",
    "file": lambda r: f"IMG_{r.randint(1990, 2030)}{r.randint(101, 1231):04}_{r.randint(0, 235959):06}.jpg",
    "rule": lambda r: r.choice("-=_./+") * r.randint(12, 60),
    "qualified": lambda r: ".".join(_name(r) for _ in range(r.randint(3, 5))),
    "run": lambda r: _some(r, "ab01", 1) * r.randint(12, 40),
}


def made_up(kinds: dict[str, Callable], seed: int = 0, each: int = MADE_UP) -> list[str]:
    r = random.Random(seed)
    return [make(r) for make in kinds.values() for _ in range(each)]


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, in order of start, then kind as listed; offsets in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def window(text: str, start: int, end: int, low: int = 0, high: int | None = None) -> bytes:
    """The candidate and its context (from ``low`` to ``high``) as symbols: WIDTH of them if it has VALUE characters at most, else all of it."""
    value = text[start:end]
    head, tail = (value[:HEAD], value[HEAD:]) if len(value) <= VALUE else (value, "")
    parts = (text[max(low, start - BEFORE) : start].rjust(BEFORE, "\0"), head.ljust(HEAD, "\0"), tail.rjust(TAIL if len(value) <= VALUE else 0, "\0"), text[end : end + AFTER if high is None else min(high, end + AFTER)].ljust(AFTER, "\0"))
    raw = np.frombuffer("".join(parts).encode("latin-1", "replace"), np.uint8)
    out = _SYMBOL[raw]
    out[raw == 0] = 0
    return out.tobytes()


def candidates(text: str, base: list[dict]) -> list[dict]:
    """Runs of token characters, cut into what a base finding covers (label 1) and the rests beside it (2, not trained on); whole runs are 0."""
    out = []
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        pieces = []
        for a, b in sorted((x["start"], min(x["end"], end)) for x in base if x["start"] < end and at < x["end"]):
            if b > at:
                pieces += [(at, max(a, at), 2), (max(a, at), b, 1)]
                at = b
        for a, b, label in [*pieces, (at, end, 2 if pieces else 0)]:
            # in "key=value" the value is what counts
            cut = re.search(r"[=.]+(?=[^=.])", text[a:b]) if label == 1 else None
            a = a + cut.end() if cut and b - a - cut.end() >= SHORTEST else a
            # a rest without the separators that join it to the base finding, which is no context of it
            low, high = 0, None
            if label == 2 and a > m.start():
                low = a = b - len(text[a:b].lstrip("/_=.-"))
            if label == 2 and b < end:
                high = b = a + len(text[a:b].rstrip("/_=.-"))
            if b - a >= SHORTEST:
                out.append({"start": a, "end": b, "label": label, "window": window(text, a, b, low, high)})
    return out


def interesting(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a finding or a candidate, found on the bytes of a whole batch."""
    rows = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return rows
    a, b = mask_runs(_TOKEN[data], offsets)
    hits = [a[b - a >= SHORTEST]]
    a, b = mask_runs(_HEX[data], offsets)
    hits.append(a[b - a >= 24])
    raw = data.tobytes()
    low = raw.lower()
    for text, words in ((low, _WORDS), (raw, (b"AKIA",))):
        for w in words:
            at = text.find(w)
            while at >= 0:
                hits.append(np.array([at]))
                at = text.find(w, at + 1)
    rows[np.searchsorted(offsets, np.concatenate(hits), "right") - 1] = True
    return rows


@dataclass
class Model:
    """Embedding-free convolution (a weight for each place, symbol and filter), a hidden layer, the calibration, and a threshold for each kind."""

    params: list[np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.full(4, 0.5))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        out = [_forward(self.params, windows[k : k + 512])[0] for k in range(0, len(windows), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def highest(self, symbols: np.ndarray) -> float:
        """The highest logit of a long candidate: of all its windows of VALUE characters, and of its parts between separators."""
        conv, c0, w1, b1, w2, b2 = self.params
        best = [self.logits(_parts(symbols)).max(initial=-np.inf)]
        for k in range(0, len(symbols) - WIDTH + 1, BLOCK):
            x = symbols[k : k + BLOCK + WIDTH - 1]
            z = c0 + sum(conv[j][x[j : len(x) - _SPAN + 1 + j]] for j in range(_SPAN))
            pooled = np.concatenate([_sliding_max(z[a:], b - a)[: len(x) - WIDTH + 1] for a, b in _POOLS], 1)
            hidden = np.maximum(np.maximum(pooled, 0) @ w1 + b1, 0)
            best.append((hidden @ w2 + b2[0]).max())
        return float(max(best))

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return self._scaled(self.logits(windows))

    def candidate_scores(self, cands: list[bytes]) -> np.ndarray:
        """The score of each candidate, short or long, as ``window`` gives it."""
        long = np.array([len(c) > WIDTH for c in cands], bool)
        out = np.zeros(len(cands))
        out[~long] = self.logits(np.frombuffer(b"".join(c for c in cands if len(c) == WIDTH), np.uint8).reshape(-1, WIDTH))
        out[long] = [self.highest(np.frombuffer(c, np.uint8)) for c in cands if len(c) > WIDTH]
        return self._scaled(out)

    def accepted(self, cands: list[bytes]) -> np.ndarray:
        return self.candidate_scores(cands) >= self.thresholds[[kind_of(np.frombuffer(c, np.uint8)) for c in cands]]

    def _scaled(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -40, 40)))


def _kinds(windows: np.ndarray) -> np.ndarray:
    """``kind_of`` of windows of WIDTH symbols."""
    value = windows[:, BEFORE : BEFORE + VALUE]
    plain = (_INNER[value] | (value == 0)).all(1)
    return np.where(_is_word(value), 3, np.where(~plain, 2, np.where(_HEXES[value].all(1), 0, 1)))


def kind_of(symbols: np.ndarray) -> int:
    """0: hexadecimal digits only, 1: letters and digits, 2: with separators, 3: a word."""
    value = symbols[BEFORE : len(symbols) - AFTER]
    if _is_word(value[None])[0]:
        return 3
    if not (_INNER[value] | (value == 0)).all():
        return 2
    return 0 if _HEXES[value].all() else 1


def _sliding_max(z: np.ndarray, size: int) -> np.ndarray:
    """Maxima over the rows i to i + size - 1."""
    n = 1
    while n < size:
        step = min(n, size - n)
        z, n = np.maximum(z[:-step], z[step:]), n + step
    return z


def _parts(symbols: np.ndarray) -> np.ndarray:
    """The parts of a long candidate between separators that have the form of a candidate, as if they stood alone."""
    inner = _INNER[symbols]
    inner[:BEFORE] = inner[-AFTER:] = False
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    out = []
    for a, b in zip(edge[::2], edge[1::2]):
        if SHORTEST <= b - a <= VALUE:
            x = np.zeros(WIDTH, np.uint8)
            head = min(HEAD, b - a)
            x[BEFORE : BEFORE + head] = symbols[a : a + head]
            x[WIDTH - AFTER - (b - a - head) : WIDTH - AFTER] = symbols[a + head : b]
            out.append(x)
    return np.array(out, np.uint8).reshape(-1, WIDTH)


def _forward(p: list[np.ndarray], x: np.ndarray):
    conv, c0, w1, b1, w2, b2 = p
    n = WIDTH - _SPAN + 1
    x = x.astype(np.int64)
    z = conv[0].take(x[:, :n], axis=0)
    for k in range(1, _SPAN):
        z += conv[k].take(x[:, k : k + n], axis=0)
    z += c0
    # three pools: before, the value, after
    parts = [z[:, a:b].max(1) for a, b in _POOLS]
    where = [z[:, a:b].argmax(1) + a for a, b in _POOLS]
    pooled = np.concatenate(parts, 1)
    act = np.maximum(pooled, 0)
    hidden = np.maximum(act @ w1 + b1, 0)
    return hidden @ w2 + b2[0], (act, hidden, np.concatenate(where, 1), pooled)


_POOLS = ((0, BEFORE - _SPAN + 1), (BEFORE - _SPAN + 1, BEFORE + HEAD + TAIL), (BEFORE + HEAD + TAIL - _SPAN + 1, WIDTH - _SPAN + 1))


def _cut(value: str, r: random.Random) -> bytes:
    """A made-up value among made-up words as a window of training: one of its windows, if it is long."""
    before = " ".join(_name(r) for _ in range(4)) + r.choice((" ", ": ", "\n", " ("))
    x = window(before + value + r.choice((" ", ", ", ". ", "\n")) + _name(r), len(before), len(before) + len(value))
    at = r.randrange(len(x) - WIDTH + 1)
    return x[at : at + WIDTH]


def _own(formats: dict[str, Callable], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The made-up values as windows with their labels; every second one stands alone."""
    r = random.Random(seed)
    more = [_cut(v, r) for v in made_up(formats, seed)], [_cut(v, r) for v in made_up(ORDINARY, seed + 1)]
    own = np.frombuffer(b"".join(more[0] + more[1]), np.uint8).reshape(-1, WIDTH).copy()
    own[::2] = _bare(own[::2])
    return own, np.repeat([1, 0], [len(more[0]), len(more[1])])


def _trained(params: list[np.ndarray], windows: np.ndarray, labels: np.ndarray, own: np.ndarray, known: np.ndarray, epochs: int, turns: int = 1, seed: int = 0) -> list[np.ndarray]:
    """The network after some passes over a piece of the corpus and the made-up values: ``epochs`` in all turns if there are few rows, one of each piece if there are many.

    Each class of the corpus weighs as ``WEIGH`` rows at most, however many there are, so that neither drowns the made-up values.
    A quarter of the distinct values takes no part, as it is kept for the calibration.
    """
    rng = np.random.default_rng(seed)
    weights = np.ones(len(labels))
    for y in (0, 1):
        n = (labels == y).sum()
        weights[labels == y] = min(1.0, WEIGH / max(n, 1))
    free = _fold(windows, 4) != 0
    x, y, w = windows[free], labels[free], weights[free]
    plain, others = x[y == 0], own.copy()
    if len(plain):  # a quarter of the made-up values gets the contexts of these rows
        lent = plain[rng.integers(0, len(plain), len(own[1::4]))]
        others[1::4, :BEFORE], others[1::4, BEFORE + VALUE :] = lent[:, :BEFORE], lent[:, BEFORE + VALUE :]
    kept = _fold(others, 4) != 0
    others, told = others[kept], known[kept]
    moved = np.concatenate((x[y == 1], others[told == 1]))
    moved_by = np.concatenate((w[y == 1], np.ones((told == 1).sum())))
    negatives = np.concatenate((plain, others[told == 0]))
    if len(negatives):
        moved[:, :BEFORE] = negatives[rng.integers(0, len(negatives), len(moved))][:, :BEFORE]
    # the corpus's own words are ordinary in capitals too, of which there are few; where there are many words, each comes in one of four forms
    word = (y == 0) & _is_word(x[:, BEFORE : BEFORE + VALUE])
    rows, by = x[word], w[word]
    if len(plain) <= WEIGH:
        parts = [(x, y, w), (_capitals(rows), np.zeros(len(rows), int), by)]
    else:
        form, capital = rng.integers(0, 4, len(rows)), _capitals(rows, 0)
        rows = np.where((form % 2 == 1)[:, None], capital, rows)
        once = np.where((form >= 2)[:, None], _bare(rows), rows), np.zeros(len(rows), int), 4 * by
        parts = [(x[~word], y[~word], w[~word])]
    parts += [(others, told, np.ones(len(told)))]
    sides = []
    for label in (0, 1):
        rows, by = (np.concatenate([p[k][p[1] == label] for p in parts]) for k in (0, 2))
        bare = _bare(rows)
        alone = (bare != rows).any(1)
        rows, by = np.concatenate((rows, bare[alone])), np.concatenate((by, by[alone]))
        more = [(moved, moved_by)] if label else [once[::2]] if len(plain) > WEIGH else []
        for extra, extra_by in more:
            rows, by = np.concatenate((rows, extra)), np.concatenate((by, extra_by))
        sides.append((rows, by))
    x, w = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
    y = np.repeat([0.0, 1.0], [len(s[0]) for s in sides]).astype(np.float32)
    passes = max(1, min(epochs, round(epochs * FEW / (turns * len(y)))))
    return _descended(params, x, y, (w * (len(w) / w.sum())).astype(np.float32), passes, rng)


def _is_word(value: np.ndarray) -> np.ndarray:
    """Rows of symbols that are letters, in one case or with a capital at the beginning, and at most periods and hyphens."""
    low, high = _SYMBOL[ord("a")], _SYMBOL[ord("A")]
    small, large = (value >= low) & (value < low + 26), (value >= high) & (value < high + 26)
    letters = (small | large | (value == 0) | (value == _SYMBOL[ord(".")]) | (value == _SYMBOL[ord("-")])).all(1)
    return letters & (~large[:, 1:].any(1) | ~small.any(1))


def _capitals(windows: np.ndarray, alone: int = 2) -> np.ndarray:
    """The same with their values in capitals, every second one (each ``alone``-th; 0: none) alone."""
    out = windows.copy()
    value = out[:, BEFORE : BEFORE + VALUE]
    low = _SYMBOL[ord("a")]
    value[(value >= low) & (value < low + 26)] += 26
    if alone:
        out[::alone] = _bare(out[::alone])
    return out


def _fold(windows: np.ndarray, folds: int) -> np.ndarray:
    """A fold for each window, the same for the same value."""
    return np.array([xxhash.xxh64_intdigest(w[BEFORE : BEFORE + VALUE].tobytes()) % folds for w in windows], np.int64)


def _half(windows: np.ndarray) -> np.ndarray:
    """0 or 1 for each window, by its value; each half has kept values."""
    return _fold(windows, 8) // 4


def _bare(windows: np.ndarray) -> np.ndarray:
    out = windows.copy()
    out[:, :BEFORE] = 0
    out[:, BEFORE + HEAD + TAIL :] = 0
    return out


def _begun(seed: int = 0) -> list[np.ndarray]:
    """A network that hasn't learned anything."""
    rng, pools = np.random.default_rng(seed), len(_POOLS) * _FILTERS
    p = [
        rng.normal(0, 0.2, (_SPAN, _SYMBOLS, _FILTERS)),
        np.zeros(_FILTERS),
        rng.normal(0, (2 / pools) ** 0.5, (pools, _HIDDEN)),
        np.zeros(_HIDDEN),
        rng.normal(0, (2 / _HIDDEN) ** 0.5, _HIDDEN),
        np.zeros(1),
    ]
    return [w.astype(np.float32) for w in p]


def _descended(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weights: np.ndarray, epochs: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Adam on the weighted log loss."""
    p = [w.copy() for w in params]
    m1, m2, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    f = np.tile(np.arange(_FILTERS), len(_POOLS))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), STEP):
            k = order[at : at + STEP]
            out, (act, hidden, where, pooled) = _forward(p, x[k])
            g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[k]) * weights[k] / len(k)
            gh = np.outer(g, p[4]) * (hidden > 0)
            ga = (gh @ p[2].T) * (pooled > 0)
            own, row = x[k].astype(np.int64), np.arange(len(k))[:, None]
            gc = np.stack([np.bincount((own[row, where + s] * _FILTERS + f).ravel(), ga.ravel(), _SYMBOLS * _FILTERS).reshape(_SYMBOLS, _FILTERS) for s in range(_SPAN)])
            grads = [gc, np.bincount(f, ga.sum(0), _FILTERS), act.T @ gh, gh.sum(0), hidden.T @ g, np.array([g.sum()])]
            t += 1
            for i, gi in enumerate(grads):
                gi = (gi + 1e-4 * p[i]).astype(np.float32)
                m1[i] = 0.9 * m1[i] + 0.1 * gi
                m2[i] = 0.999 * m2[i] + 0.001 * gi * gi
                p[i] = p[i] - 0.003 * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return [w.astype(np.float32) for w in p]


def _kept(windows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept quarter, each candidate with and without its context: the words before them gave the labels, and won't
    be there for the secrets that the patterns miss."""
    held = _fold(windows, 4) == 0
    return np.concatenate((windows[held], _bare(windows[held]))), np.concatenate((labels[held], labels[held]))


def _counted(params: list[np.ndarray], windows: np.ndarray, labels: np.ndarray) -> Counter:
    """How many windows there are of each (label, kind, step of GRID of the logit)."""
    z = np.floor(np.clip(Model(params).logits(windows), -64, 64) * GRID).astype(np.int64)
    return Counter(zip(np.asarray(labels).tolist(), _kinds(windows).tolist(), z.tolist()))


def _calibrated(params: list[np.ndarray], corpus: dict[tuple, int], own: dict[tuple, int]) -> Model:
    """Platt's scaling and the thresholds by the counts of all kept values, of the corpus and made up."""
    model = Model(params)
    tables = [np.array([(*k, n) for k, n in sorted(c.items())], np.int64).reshape(-1, 4) for c in (corpus, own)]
    shares = []
    for t, most in zip(tables, (2 * WEIGH // 4, None)):  # each class of the corpus weighs as in training
        w = t[:, 3].astype(np.float64)
        for y in (0, 1):
            n = w[t[:, 0] == y].sum()
            if most and n > most:
                w[t[:, 0] == y] *= most / n
        shares.append(w)
    each, share = np.concatenate(tables), np.concatenate(shares)
    y, kinds, z = each[:, 0].astype(np.float64), each[:, 1], (each[:, 2] + 0.5) / GRID
    # Platt's scaling, with his smoothed targets and a weak prior at no scaling, by damped Newton steps
    ones, zeros = (y * share).sum(), ((1 - y) * share).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, prior, w = np.stack((z, np.ones_like(z)), 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        u = a @ w
        return float((share * (np.logaddexp(0, u) - target * u)).sum() + 0.5 * ((w - prior) ** 2).sum())

    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (share * q * (1 - q))[:, None]).T @ a + np.eye(2), a.T @ (share * (q - target)) + w - prior)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    model.scale, model.shift = float(w[0]), float(w[1])

    def of(rows: np.ndarray, weights: np.ndarray, label: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps in order, and their weights; few kept values of a kind say little of it: then those of all kinds count."""
        own = (rows[:, 0] == label) & (rows[:, 1] == kind)
        own = own if rows[own, 3].sum() >= 20 else rows[:, 0] == label
        order = np.argsort(rows[own, 2], kind="stable")
        return rows[own, 2][order], weights[own][order]

    for kind in range(4):
        if kind == 3 and each[(y == 1) & (kinds == 3), 3].sum() < 20:
            model.thresholds[3] = np.inf  # no secrets are known that are words
            continue
        steps, by = of(each, share, 1, kind)
        # the beginning of the step in which the share of those missed would be passed
        at = [steps[np.searchsorted(np.cumsum(by), (1 - RECALL) * by.sum(), "right")]] if len(steps) else [0]
        for rows in tables:  # of the kept ordinary ones, of the corpus and made up, a share of FALSE may pass at most, even where that costs recall
            steps, by = of(rows, rows[:, 3], 0, kind)
            if len(steps):
                passing = by.sum() - np.cumsum(by)  # those above each step
                at.append(steps[np.argmax(passing <= FALSE * by.sum())] + 1)
        model.thresholds[kind] = float(model._scaled(np.float64(max(at) / GRID)))
    return model


_FOUND = "doc_id long, base array<struct<start:int,end:int,kind:string>>, cands array<struct<start:int,end:int,label:int,window:binary>>"


def _scan(df: DataFrame, text: str, doc_id: str, whole: bool = False) -> DataFrame:
    """The base findings and the candidates of each row; a base finding is a candidate too, if it has the form of one."""
    arrow_rows(df.sparkSession)
    schema = _FOUND + (", text string" if whole else "")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("window", pa.binary())]))
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column(1))
                base, cands = [[]] * part.num_rows, [[]] * part.num_rows
                for i in np.flatnonzero(interesting(data, offsets)).tolist():
                    t = part.column(1)[i].as_py()
                    base[i] = [{"start": a, "end": b, "kind": k} for a, b, k in base_findings(t)]
                    cands[i] = candidates(t, base[i])
                out = [part.column(0), pa.array(base, kind), pa.array(cands, cand)]
                yield pa.RecordBatch.from_arrays(out + [part.column(1)] * whole, ["doc_id", "base", "cands"] + ["text"] * whole)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _rows(found: DataFrame) -> DataFrame:
    """(label, window, piece) of each distinct window of all candidates; a long candidate has one for each of its places."""
    each = found.select(F.explode("cands").alias("c")).where("c.label < 2").select("c.label", "c.window")
    places = F.explode(F.sequence(F.lit(1), F.length("window") - (WIDTH - 1)))
    short, long = each.where(F.length("window") <= WIDTH), each.where(F.length("window") > WIDTH)
    long = long.distinct().select("label", "window", places.alias("at")).select("label", F.substring("window", F.col("at"), F.lit(WIDTH)).alias("window"))
    return short.union(long).distinct()


_STATES = "which int, state array<long>"
_COUNTS = "which int, label int, kind int, step long, n long"
_ARROW = {
    _STATES: pa.schema([("which", pa.int32()), ("state", pa.list_(pa.int64()))]),
    _COUNTS: pa.schema([("which", pa.int32()), ("label", pa.int32()), ("kind", pa.int32()), ("step", pa.int64()), ("n", pa.int64())]),
}


def _pieces(rows: DataFrame, n: int, work: Callable[[np.ndarray, np.ndarray], list[dict]], schema: str) -> DataFrame:
    """``work`` of each piece's windows (in order, so that the order of arrival doesn't matter) and labels."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                t = t.filter(t["window"].is_valid())
                out = work(np.frombuffer(b"".join(t["window"].to_pylist()), np.uint8).reshape(-1, WIDTH), t["label"].to_numpy())
                yield pa.RecordBatch.from_pylist(out, _ARROW[schema])

        for b in batches:
            piece = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]
            for i, j in zip(edges, edges[1:]):
                if i < j:
                    if piece[i] != now:
                        yield from done()
                        held.clear()
                        now = int(piece[i])
                    held.append(b.slice(i, j - i))
        yield from done()

    return rows.select("piece", "label", "window").repartition(n, "piece").sortWithinPartitions("piece", "label", "window").mapInArrow(run, schema)


_FIXED = 1 << 36


def _flat(params: list[np.ndarray]) -> list[int]:
    """The numbers in fixed point: their sums don't depend on the order."""
    return np.round(np.concatenate([p.ravel() for p in params]).astype(np.float64) * _FIXED).astype(np.int64).tolist()


def _averaged(states: DataFrame, like: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """The means of the networks (which, state) that the pieces give, as many as ``like`` has, summed in tasks."""
    got = states.select("which", F.posexplode("state").alias("at", "x")).groupBy("which", "at").agg(F.sum("x").alias("x"), F.count("*").alias("n")).toArrow()
    got = got.sort_by([("which", "ascending"), ("at", "ascending")])
    which, x = got["which"].to_numpy(), got["x"].to_numpy() / got["n"].to_numpy() / _FIXED
    out = []
    for k, params in enumerate(like):
        flat, at, new = x[which == k].astype(np.float32), 0, []
        for p in params:
            new.append(flat[at : at + p.size].reshape(p.shape) if len(flat) else p)
            at += p.size
        out.append(new)
    return out


def train(found: DataFrame, formats: dict[str, Callable] | None = None) -> Model:
    """Fits the network on all candidates of a written scan, as the head of this module says."""
    own, known = _own(FORMATS if formats is None else formats)
    rows = written(_rows(found))
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    few = [y for y in (0, 1) if n.get(y, 0) <= WEIGH]
    whole = rows.where(F.col("label").isin(few)).toArrow().sort_by([("label", "ascending"), ("window", "ascending")])
    whole_x, whole_y = np.frombuffer(b"".join(whole["window"].to_pylist()), np.uint8).reshape(-1, WIDTH), whole["label"].to_numpy()
    count = -(-sum(n.get(y, 0) for y in (0, 1) if y not in few) // PIECE)
    if count:
        dealt = rows.where(~F.col("label").isin(few)).select(F.pmod(F.xxhash64("window"), F.lit(count)).cast("int").alias("piece"), "label", "window")
    else:
        dealt = rows.sparkSession.range(1).selectExpr("0 AS piece", "0 AS label", "cast(null AS binary) AS window")
    turns = max(1, min(count, TURNS))

    def over(work: Callable[[np.ndarray, np.ndarray], list[dict]], schema: str, turn: int | None = None) -> DataFrame:
        part = dealt if turn is None else dealt.where(F.col("piece") % turns == turn)
        return _pieces(part, max(1, count if turn is None else count // turns), lambda x, y: work(np.concatenate((whole_x, x)), np.concatenate((whole_y, y))), schema)

    def counts(work: Callable[[np.ndarray, np.ndarray], list[Counter]], models: int) -> list[dict]:
        told = over(lambda x, y: [{"which": k, "label": c[0], "kind": c[1], "step": c[2], "n": m} for k, found in enumerate(work(x, y)) for c, m in found.items()], _COUNTS)
        out: list[dict] = [{} for _ in range(models)]
        for which, label, kind, step, m in told.groupBy("which", "label", "kind", "step").agg(F.sum("n")).collect():  # bounded by the steps of GRID
            out[which][label, kind, step] = m
        return out

    begun = _trained(_begun(), own[:0], known[:0], own, known, JUDGE_EPOCHS)
    own_kept = _kept(own, known)
    # each half of the corpus's ordinary candidates is looked at by a network that hasn't learned them; words aren't in doubt
    seen = lambda y, half, k: (y == 1) | (half == k)
    judged = over(lambda x, y: [{"which": k, "state": _flat(_trained(begun, x[s], y[s], own, known, JUDGE_EPOCHS))} for k in (0, 1) for s in [seen(y, _half(x), k)]], _STATES)
    nets = _averaged(judged, [begun, begun])
    told = counts(lambda x, y: [_counted(nets[k], *_kept(x[s], y[s])) for k in (0, 1) for s in [seen(y, _half(x), k)]], 2)
    judges = [_calibrated(nets[k], told[k], _counted(nets[k], *own_kept)) for k in (0, 1)]

    def sure(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (y == 1) | _is_word(x[:, BEFORE : BEFORE + VALUE])
        half = _half(x)
        for k in (0, 1):
            other = np.flatnonzero(~keep & (half != k))
            keep[other] = judges[k].scores(_bare(x[other])) < 0.5
        return x[keep], y[keep]

    net = begun
    for turn in range(turns):
        net = _averaged(over(lambda x, y: [{"which": 0, "state": _flat(_trained(net, *sure(x, y), own, known, EPOCHS, turns, turn))}], _STATES, turn), [net])[0]

    def final(x: np.ndarray, y: np.ndarray) -> list[Counter]:
        x, y = _kept(*sure(x, y))
        return [_counted(net, x, y)]

    return _calibrated(net, counts(final, 1)[0], _counted(net, *own_kept))


def _judged(model: Model, bases: list[list[dict]], cands: list[list[dict]]) -> list[list[tuple[int, int, str]]]:
    """All spans of each row: the network judges the candidates of a batch together."""
    fresh = [(i, c) for i, own in enumerate(cands) for c in own if c["label"] != 1]
    spans = [[(x["start"], KINDS.index(x["kind"]), x["end"]) for x in base] for base in bases]
    for k in range(0, len(fresh), BLOCK):
        part = fresh[k : k + BLOCK]
        for (i, c), ok in zip(part, model.accepted([c["window"] for _, c in part])):
            if ok:
                spans[i].append((c["start"], 3, c["end"]))
    return [[(a, b, KINDS[k]) for a, k, b in sorted(own)] for own in spans]


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Findings of each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, comma-joined. Null and
    empty texts have none; a null doc_id stays null; repeated rows are kept; no rows give no rows;
    other columns aren't read.
    """
    found = written(_scan(df, text, doc_id))
    model = train(found)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, cands = b.column(1).to_pylist(), b.column(2).to_pylist()
            spans = _judged(model, base, cands)
            own = [_digest([(y["start"], y["end"], y["kind"]) for y in x]) for x in base]
            count = [pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            out = [b.column(0), *count[:3], pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own]), pa.array([_digest(x) for x in spans]), count[3]]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with all their columns; in ``text`` every finding is replaced by the mark (overlapping ones by one).

    Null texts stay null, repeated rows stay and are changed alike, no rows give no rows.
    """
    rows = df.select((F.col("doc_id") if "doc_id" in df.columns else F.lit(None)).alias("doc_id"), "text")
    model = train(written(_scan(rows, "text", "doc_id").where(F.size("cands") > 0).select("doc_id", "cands")))
    at = df.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column(at))
                hot = np.flatnonzero(interesting(data, offsets)).tolist()
                if not hot:
                    yield part
                    continue
                texts = part.column(at).to_pylist()
                for i, t in zip(hot, clean([texts[i] for i in hot], model, mark)):
                    texts[i] = t
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.column(at).type))

    return df.mapInArrow(run, df.schema)


def clean(texts: list[str], model: Model, mark: str) -> list[str]:
    """The texts with every finding replaced by the mark."""
    bases = [[{"start": a, "end": b, "kind": k} for a, b, k in base_findings(t)] for t in texts]
    out = []
    for text, spans in zip(texts, _judged(model, bases, [candidates(t, b) for t, b in zip(texts, bases)])):
        parts, at, reach = [], 0, -1
        for a, b, _ in spans:
            if a >= reach:
                parts += [text[at:a], mark]
            at = reach = max(reach, b)
        out.append("".join([*parts, text[at:]]))
    return out

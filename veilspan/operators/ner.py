"""Names from a model's token predictions, and a hook for model back ends."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon, default_lexicon

TOKEN = "struct<label:string,start:int,end:int,confidence:double>"
ACCEPTED = ("PER", "PERSON")
CONJUNCTIONS = frozenset(("и", "а", "но", "да"))
_GAP = re.compile(r"[\s-]*")
Token = tuple[str, int, int, float]


def dedupe(tokens: Iterable[Token]) -> list[Token]:
    """One prediction for each (start, end), the most confident, in order: windows of a long text overlap."""
    best: dict[tuple[int, int], Token] = {}
    for t in tokens:
        if (t[1], t[2]) not in best or t[3] > best[t[1], t[2]][3]:
            best[t[1], t[2]] = t
    return sorted(best.values(), key=lambda t: (t[1], t[2]))


@functools.lru_cache(maxsize=1024)
def _label(label: str) -> tuple[str, str]:
    """The B or I before a label's hyphen, if there is one, and the label."""
    prefix, _, rest = label.upper().rpartition("-") if label.count("-") == 1 else ("", "", label.upper())
    return prefix, rest


def runs(text: str, tokens: Iterable[Token], accepted: Iterable[str] = ACCEPTED) -> Iterator[list[tuple[str, Token]]]:
    """Neighbouring accepted tokens with only blanks and hyphens between them, each with its B or I prefix."""
    labels, run, end = {x.upper() for x in accepted}, [], 0
    for t in sorted(tokens, key=lambda t: (t[1], t[2])):
        prefix, label = _label(t[0])
        fits = label in labels and 0 <= t[1] < t[2] <= len(text)
        if run and not (fits and t[1] >= end and _GAP.fullmatch(text, end, t[1])):
            yield run
            run, end = [], 0
        if fits:
            run.append((prefix, t))
            end = max(end, t[2])
    if run:
        yield run


def names(text: str, tokens: Iterable[Token], minimum: float = 0.80, lexicon: Lexicon | None = None, accepted: Iterable[str] = ACCEPTED) -> list[tuple[str, int, int, float]]:
    """PERSON spans: runs are cut at B- and at conjunctions that stand alone; a name is as sure as its least sure token."""
    known = (lexicon or default_lexicon()).is_known
    out = []
    for run in runs(text, tokens, accepted):
        groups: list[list[Token]] = [[]]
        for prefix, t in run:
            alone = text[t[1] : t[2]].casefold() in CONJUNCTIONS and not text[t[1] - 1 : t[1]].strip() and not text[t[2] : t[2] + 1].strip()
            if (prefix == "B" or alone) and groups[-1]:
                groups.append([])
            if not alone:
                groups[-1].append(t)
        for g in filter(None, groups):
            a, b, sure = g[0][1], g[-1][2], min(t[3] for t in g)
            if sure >= minimum and not known(text[a:b]):
                out.append(("PERSON", a, b, sure))
    return out


def suspicious(text: str, tokens: Iterable[Token], accepted: Iterable[str] = ACCEPTED) -> bool:
    """Whether a run is longer than four words, which a name hardly is."""
    return any(len(re.findall(r"\w+", text[r[0][1][1] : r[-1][1][2]])) > 4 for r in runs(text, tokens, accepted))


#: Characters of text whose tokens are held together.
SLICE = 1 << 18
_TOKEN = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])
_MATCH = pa.struct([("pii_type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about SLICE characters, of a row at least."""
    begin, held = 0, 0
    for k, n in enumerate([*pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), None]):
        if n is None or k > begin and held + n > SLICE:
            if k > begin:
                yield begin, k
            begin, held = k, 0
        held += n or 0


def _in_slices(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``one`` of each row (the first column is the texts); only a slice's objects are held in Python."""
    parts = [pa.array([one(*row) for row in zip(*(c.slice(a, b - a).to_pylist() for c in columns))], kind) for a, b in _slices(columns[0])]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def from_predictions(text: Column, tokens: Column, minimum: float = 0.80, lexicon: Lexicon | None = None) -> Column:
    """Matches of a column of token predictions."""

    def one(t, p):
        if t is None or p is None:
            return None
        return [{"pii_type": k, "value": t[a:b], "start": a, "end": b, "confidence": c} for k, a, b, c in names(t, [tuple(x.values()) for x in p], minimum, lexicon)]

    @F.arrow_udf("array<struct<pii_type:string,value:string,start:int,end:int,confidence:double>>")
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        return _in_slices(one, pa.list_(_MATCH), texts, found)

    return run(text, tokens)


def predict(text: Column, load: Callable[[], Callable[[str], Iterable[Token]]]) -> Column:
    """Token predictions of a back end. ``load`` makes it once a task; it gives (label, start, end, confidence) for a text."""

    @F.arrow_udf(f"array<{TOKEN}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            yield _in_slices(lambda t: None if t is None else [dict(zip(("label", "start", "end", "confidence"), x)) for x in dedupe(model(t))], pa.list_(_TOKEN), texts)

    return run(text)


def windows(n_tokens: int, size: int = 512, stride: int = 64) -> list[tuple[int, int]]:
    """Token windows that a model sees; neighbours share ``stride`` tokens."""
    out, at = [], 0
    while True:
        out.append((at, min(n_tokens, at + size)))
        if at + size >= n_tokens:
            return out
        at += size - stride


class WindowModel(Protocol):
    """A token classifier that sees a bounded number of tokens at a time."""

    labels: Mapping[int, str]

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """The ids of all tokens of a text, and where each begins and ends in it."""

    def __call__(self, windows: list[list[int]]) -> list[list[tuple[int, float]]]:
        """For each window a label's id and its confidence for each token."""


def merged(found: dict[tuple[int, int], Token], labels: Mapping[int, str], offsets: Iterable[tuple[int, int]], predicted: Iterable[tuple[int, float]]) -> None:
    """Adds a window's predictions: of two of the same span the more confident counts, the earlier window's if they are equal.

    Tokens without extent (a model's marks) are left out. An id without a label is an error.
    """
    for span, (label, sure) in zip(offsets, predicted, strict=True):
        if span[0] == span[1]:
            continue
        known = found.get(span)
        if label not in labels:
            raise ValueError(f"the model gave an unknown label {label}")
        if known is None or sure > known[3]:
            found[span] = (labels[label], *span, sure)


def _tokens(labels: Mapping[int, str], offsets: list[tuple[int, int]], predicted: list[tuple[int, float]], outside: str) -> list[Token]:
    """The tokens of a text, in order; of those outside, which only end a name, the first after each of the others."""
    ordered = all(a < b for a, b in itertools.pairwise(offsets))
    if not ordered:  # a model's tokens can have the same span, or come in another order
        found: dict[tuple[int, int], Token] = {}
        merged(found, labels, offsets, predicted)
        return [found[span] for span in sorted(found)]
    inside = {k for k, label in labels.items() if label != outside}
    own = [i for i, p in enumerate(predicted) if p[0] in inside and offsets[i][0] != offsets[i][1]]
    out: list[Token] = []
    for n, i in enumerate(own):
        out.append((labels[predicted[i][0]], *offsets[i], predicted[i][1]))
        j, end = i + 1, own[n + 1] if n + 1 < len(own) else len(offsets)
        while j < end and offsets[j][0] == offsets[j][1]:
            j += 1
        if j < end:
            out.append((outside, *offsets[j], predicted[j][1]))
    return out


def _predicted(model: WindowModel, texts: list[str | None], room: int, stride: int, batch: int, outside: str = "O") -> list[list[Token] | None]:
    """The tokens of some texts, whose windows go to the model together; a text's last windows decide on what they share with those before."""
    best: list[list[tuple[int, float]]] = [[] for _ in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, list[int]]] = []
    known = set(model.labels)

    def passed() -> None:
        held.sort(key=lambda w: len(w[2]))
        told = []
        for k in range(0, len(held), batch):
            told += list(zip(held[k : k + batch], model([w[2] for w in held[k : k + batch]]), strict=True))
        for (row, at, ids), predicted in sorted(told, key=lambda w: w[0][:2]):
            if len(ids) != len(predicted):
                raise ValueError("the model gave another number of labels than it was given tokens")
            if not known.issuperset([p[0] for p in predicted]):
                merged({}, model.labels, spans[row][at : at + len(ids)], predicted)  # an error, unless of tokens without extent
            own = best[row]
            shared = len(own) - at
            for i in range(shared):
                if predicted[i][1] > own[at + i][1]:
                    own[at + i] = predicted[i]
            own += predicted[shared:]
        held.clear()

    for row, t in enumerate(texts):
        if t is None:
            continue
        ids, spans[row] = model.encode(t)
        for a, b in windows(len(ids), room, stride) if ids else ():
            held.append((row, a, ids[a:b]))
            if len(held) >= 8 * batch:
                passed()
    passed()
    return [None if t is None else _tokens(model.labels, own, p, outside) for t, own, p in zip(texts, spans, best)]


FOUND = f"struct<entities:array<{TOKEN}>,matches:array<struct<pii_type:string,value:string,start:int,end:int,confidence:double>>>"


def with_predictions(
    df: DataFrame,
    text: str,
    load: Callable[[], WindowModel],
    size: int = 512,
    stride: int = 64,
    specials: int = 2,
    batch: int = 32,
    minimum: float = 0.80,
    lexicon: Lexicon | None = None,
    outside: str = "O",
    to: str = "ner",
) -> DataFrame:
    """Adds FOUND: the tokens that a model labels as anything but ``outside``, and the names that they make up, for texts of any length.

    The model takes ``size`` tokens at most, ``specials`` of which are its own marks; windows share ``stride`` tokens. The windows of
    many texts go to it together, ``batch`` at a time, those of like length beside each other (so that padding is short). ``load``
    makes the model once a task. Only the tokens of about ``SLICE`` characters of text (a text at least) are held at a time. A null text
    has null, one without tokens empty arrays.
    """
    room = size - specials
    if not 0 <= stride < room:
        raise ValueError("windows must go on")
    at, schema = df.columns.index(text), df.withColumn(to, F.lit(None).cast(FOUND)).schema
    kind = pa.struct([("entities", pa.list_(_TOKEN)), ("matches", pa.list_(_MATCH))])

    def found(t: str | None, tokens: list[Token] | None) -> dict | None:
        if t is None:
            return None
        own = [dict(zip(("label", "start", "end", "confidence"), x)) for x in tokens if x[0] != outside]
        return {"entities": own, "matches": [{"pii_type": k, "value": t[a:b], "start": a, "end": b, "confidence": c} for k, a, b, c in names(t, tokens, minimum, lexicon)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            for a, b in _slices(rows.column(at)):
                part = rows.slice(a, b - a)
                texts = part.column(at).to_pylist()
                out = [found(t, p) for t, p in zip(texts, _predicted(model, texts, room, stride, batch, outside))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*part.schema.names, to])

    return df.mapInArrow(run, schema)


class CapitalisedWindows:
    """A stand-in for a windowed model in tests: a capitalised word is B-PER, or I-PER if the token before it is one."""

    labels = {0: "O", 1: "B-PER", 2: "I-PER"}
    _token = re.compile(r"([A-ZА-ЯЁ]\w+)|\w+|[^\w\s]")
    _told = (((0, 0.9), (0, 0.9)), ((1, 0.9), (2, 0.9)))

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = list(self._token.finditer(text))
        return [m.lastindex or 0 for m in found], [m.span() for m in found]

    def __call__(self, windows: list[list[int]]) -> list[list[tuple[int, float]]]:
        return [[self._told[x][before] for x, before in zip(w, (0, *w))] for w in windows]


class CapitalisedBackend:
    """A stand-in for a model in tests: capitalised words are B-PER, or I-PER after another one."""

    def __call__(self, text: str) -> list[Token]:
        out, end = [], -2
        for m in re.finditer(r"[A-ZА-ЯЁ]\w+", text):
            out.append(("I-PER" if m.start() == end + 1 else "B-PER", m.start(), m.end(), 0.9))
            end = m.end()
        return out

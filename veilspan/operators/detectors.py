"""Detectors: each looks at a Doc and yields (type, start, end, confidence).

``REGISTRY`` lists them in order. ``detect_udf`` fuses the ones that a policy needs in one Arrow UDF, so a
text crosses to Python once; ``spans.py`` has column expressions of those that need no context.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.checks import digits_of, inn, luhn, numeric_date, sequential, snils, valid_date
from ..functions.context import Doc, Rule, confidence
from ..functions.lexicon import Lexicon

Found = tuple[str, int, int, float]
Detector = Callable[[Doc], Iterable[Found]]
MATCH = "struct<pii_type:string,value:string,start:int,end:int,confidence:double>"
#: Some rules drop their own candidates under this, whatever the policy's threshold.
OWN_LIMIT = 0.80


def scan(kind: str, pattern: str, sure: float = 1.0) -> Detector:
    """All matches, with one confidence."""
    found = P.compiled(pattern)

    def run(doc: Doc) -> Iterator[Found]:
        return ((kind, m.start(), m.end(), sure) for m in found.finditer(doc.text))

    return run


def scored(kind: str, pattern: str, rule: Rule, limit: float = 0.0, keep: Callable[[re.Match], bool] = lambda m: True, ignore_case: bool = False) -> Detector:
    """All matches that ``keep`` admits, scored by their context."""
    found = P.compiled(pattern, ignore_case)

    def run(doc: Doc) -> Iterator[Found]:
        for m in found.finditer(doc.text):
            if keep(m):
                sure = confidence(doc, m.start(), m.end(), rule)
                if sure >= limit:
                    yield kind, m.start(), m.end(), sure

    return run


def gated(test: Callable[[Doc], bool], detector: Detector) -> Detector:
    """Spares a text the patterns of a detector that can't match in it. The tests are necessary conditions of a match."""
    return lambda doc: detector(doc) if test(doc) else ()


def digits_needed(total: int, run: int = 1) -> Callable[[Doc], bool]:
    return lambda doc: doc.digits[0] >= total and doc.digits[1] >= run


def word_needed(*words: str) -> Callable[[Doc], bool]:
    return lambda doc: any(w in doc.folded for w in words)


def joined(*parts: Detector) -> Detector:
    def run(doc: Doc) -> Iterator[Found]:
        for part in parts:
            yield from part(doc)

    return run


_PHONE, _PASSPORT, _PASSPORT_WORDS, _CARD, _SNILS, _INN = (P.compiled(x) for x in (P.PHONE, P.PASSPORT, P.PASSPORT_WORDS, P.CARD, P.SNILS, P.INN))
_PASSPORT_WORDS = P.compiled(P.PASSPORT_WORDS, True)


def phone_strong(doc: Doc) -> Iterator[Found]:
    for m in _PHONE.finditer(doc.text):
        around = doc.folded[max(0, m.start() - P.CORPORATE_REACH) : m.end() + P.CORPORATE_REACH]
        if not digits_of(m[0]).startswith("8800") and not any(w in around for w in P.CORPORATE):
            yield "PHONE", m.start(), m.end(), 0.99


def passport_internal(doc: Doc) -> Iterator[Found]:
    for m in _PASSPORT.finditer(doc.text):
        if m[1] != "00" and m[2] != "000000":
            licence = confidence(doc, m.start(), m.end(), P.LICENSE_STRONG_RULE) >= 0.99
            yield "PASSPORT", m.start(), m.end(), 0.50 if licence else 0.99


def passport_in_words(doc: Doc) -> Iterator[Found]:
    """Series and number apart, so that the words between them stay open."""
    for m in _PASSPORT_WORDS.finditer(doc.text):
        if m["series"][:2] != "00" and m["number"] != "000000":
            yield from (("PASSPORT", *m.span(part), 0.99) for part in ("series", "number"))


def snils_number(doc: Doc) -> Iterator[Found]:
    return (("SNILS", m.start(), m.end(), 1.0) for m in _SNILS.finditer(doc.text) if snils(digits_of(m[0])))


def inn_number(doc: Doc) -> Iterator[Found]:
    for m in _INN.finditer(doc.text):
        sure = 1.0 if inn(m[0]) else confidence(doc, m.start(), m.end(), P.INN_RULE)
        if sure >= OWN_LIMIT:
            yield "INN", m.start(), m.end(), sure


def card_number(doc: Doc) -> Iterator[Found]:
    for m in _CARD.finditer(doc.text):
        number = digits_of(m[0])
        if luhn(number):
            yield "CARD", m.start(), m.end(), 1.0
        elif not sequential(number) and (sure := confidence(doc, m.start(), m.end(), P.CARD_RULE)) >= OWN_LIMIT:
            yield "CARD", m.start(), m.end(), sure


def has_card(doc: Doc) -> bool:
    """A Luhn card, or any in the context of one, anywhere in the text; worked out once a text."""
    if doc._has_card is None:
        doc._has_card = any(luhn(digits_of(m[0])) or confidence(doc, m.start(), m.end(), P.CARD_RULE) >= OWN_LIMIT for m in _CARD.finditer(doc.text))
    return doc._has_card


def pin(require_card: bool) -> Detector:
    every = scored("PIN", P.digits(4), P.PIN_RULE)

    def run(doc: Doc) -> Iterator[Found]:
        alone = None
        for kind, a, b, sure in every(doc):
            if alone is None:
                alone = require_card and not has_card(doc)
            yield kind, a, b, min(sure, 0.50) if alone else sure

    return run


def _real_numeric(m: re.Match) -> bool:
    return numeric_date(int(m[1]), int(m[2]), int(m[3])) is not None


def _real_words(m: re.Match) -> bool:
    day = P.DAY_WORDS[" ".join(m["day"].lower().split())]
    return not m["year"] or valid_date(day, P.MONTHS_RU.index(m["month"].lower()) + 1, int(m["year"]))


def _real_month(m: re.Match) -> bool:
    return not m["year"] or valid_date(int(m["day"]), P.MONTHS_RU.index(m["month"].lower()) + 1, int(m["year"]))


def _real_english(m: re.Match) -> bool:
    year, month, day = m["year"] or m["year2"], m["month"] or m["month2"], m["day"] or m["day2"]
    return not year or valid_date(int(day), P.MONTHS_EN.index(month.lower()) + 1, int(year))


def _in_russian(doc: Doc) -> bool:
    return doc.cyrillic and any(m in doc.folded for m in P.MONTHS_RU)


def _in_english(doc: Doc) -> bool:
    return doc.digits[0] > 0 and any(m in doc.folded for m in P.MONTHS_EN)


_numeric = digits_needed(4)
birth_date = joined(
    gated(_numeric, scored("DATE_OF_BIRTH", P.DATE, P.BIRTH_DATE_RULE, keep=_real_numeric)),
    gated(_in_russian, scored("DATE_OF_BIRTH", P.DATE_WORDS, P.BIRTH_DATE_RULE, keep=_real_words, ignore_case=True)),
    gated(_in_russian, scored("DATE_OF_BIRTH", P.DATE_MONTH, P.BIRTH_DATE_RULE, OWN_LIMIT, _real_month, True)),
    gated(_in_english, scored("DATE_OF_BIRTH", P.DATE_ENGLISH, P.BIRTH_DATE_RULE, OWN_LIMIT, _real_english, True)),
)
issue_date = joined(
    gated(_numeric, scored("PASSPORT_ISSUE_DATE", P.DATE, P.ISSUE_DATE_RULE, keep=_real_numeric)),
    gated(_in_russian, scored("PASSPORT_ISSUE_DATE", P.DATE_WORDS, P.ISSUE_DATE_RULE, OWN_LIMIT, _real_words, True)),
    gated(_in_russian, scored("PASSPORT_ISSUE_DATE", P.DATE_MONTH, P.ISSUE_DATE_RULE, OWN_LIMIT, _real_month, True)),
)

# Values that follow a marker up to a delimiter.
_STOP = re.compile(r"[,;!?\n.]")
_BLANKS = re.compile(r"[ \t]*")
_IN_PLACE = re.compile(r"(?<!\w)в ", re.I)
_DATE_HERE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?=...)|[0-9]{2}/[0-9]{2}/(?=...)|[0-9]{2,} (?:" + "|".join(P.MONTHS_RU) + ")", re.S)


def _next_letter(text: str, at: int) -> str:
    """The character after the period at ``at`` and blanks, or nothing."""
    return text[_BLANKS.match(text, at + 1).end() :][:1]


def value_end(text: str, start: int, keep_period: Callable[[str], bool]) -> int:
    """Where a value ends: at a delimiter, or a period unless what follows it says to go on."""
    at = start
    while m := _STOP.search(text, at):
        if m[0] != "." or not keep_period(_next_letter(text, m.start())):
            return m.start()
        at = m.end()
    return len(text)


def _open_ended(kind: str, rule: Rule, value: Callable[[Doc, str, int], tuple[int, int] | None], whole_words: bool) -> Detector:
    def run(doc: Doc) -> Iterator[Found]:
        for phrase in rule.plus:
            for at in doc.places(phrase):
                stop = at + len(phrase)
                if whole_words and (doc.text[at - 1 : at].isalnum() and at or doc.text[stop : stop + 1].isalnum()):
                    continue
                span = value(doc, phrase, stop)
                if span and span[1] > span[0]:
                    yield kind, *span, confidence(doc, *span, rule)

    return run


def _place(doc: Doc, phrase: str, at: int) -> tuple[int, int] | None:
    start = _BLANKS.match(doc.text, at).end()
    start += next((len(p) for p in P.PLACE_PREFIXES if doc.folded.startswith(p, start)), 0)
    if phrase in ("родился", "родилась"):  # a date can stand between: go on to the word "в"
        m = _IN_PLACE.search(doc.text, start)
        if not m:
            return None
        start = m.end()
    return start, value_end(doc.text, start, str.isalpha)


def _citizenship(doc: Doc, phrase: str, at: int) -> tuple[int, int]:
    start = re.compile(r"[ \t:;]*").match(doc.text, at).end()
    return start, value_end(doc.text, start, lambda c: c.isalpha() and not c.isupper())


def _authority(doc: Doc, phrase: str, at: int) -> tuple[int, int]:
    start = _BLANKS.match(doc.text, at).end()
    end = value_end(doc.text, start, str.isalpha)
    date = _DATE_HERE.search(doc.text, start, end + 12)
    end = min(end, date.start()) if date else end
    return start, start + len(doc.text[start:end].rstrip(" \t"))


birth_place = _open_ended("BIRTH_PLACE", P.BIRTH_PLACE_RULE, _place, False)
citizenship = _open_ended("CITIZENSHIP", P.CITIZENSHIP_RULE, _citizenship, True)
authority = _open_ended("PASSPORT_AUTHORITY", P.AUTHORITY_RULE, _authority, True)

_NAME_RUN, _NAME_LATIN, _NAME_ANY, _NAME_TITLE = (P.compiled(x) for x in (P.NAME_RUN, P.NAME_LATIN, P.NAME_ANY, P.NAME_TITLE))
_WORD = re.compile(r"\S+")
_AFTER_MARKER = re.compile(r"[ \t:;—–-]*")


def person(lexicon: Lexicon) -> Detector:
    """Names by the dictionaries, Latin names, and names after strong markers."""

    def dictionary(doc: Doc) -> Iterator[Found]:
        for m in _NAME_RUN.finditer(doc.text):
            tokens = [(t.group().casefold(), m.start() + t.start(), m.start() + t.end()) for t in _WORD.finditer(m[0])]
            for n, i in ((n, i) for n in (3, 2) for i in range(len(tokens) - n + 1)):
                part = tokens[i : i + n]
                words = [t[0] for t in part]
                if lexicon.is_full_name(words) and not lexicon.is_known(" ".join(words)):
                    yield "PERSON", part[0][1], part[-1][2], 0.95
                    break

    def latin(doc: Doc) -> Iterator[Found]:
        for m in _NAME_LATIN.finditer(doc.text):
            sure = 0.95 if len(m[0].split()) > 2 else confidence(doc, m.start(), m.end(), P.NAME_LATIN_RULE)
            if sure >= OWN_LIMIT:
                yield "PERSON", m.start(), m.end(), sure

    def marked(doc: Doc) -> Iterator[Found]:
        for marker, sure in P.NAME_MARKERS.items():
            for at in doc.places(marker):
                start = _AFTER_MARKER.match(doc.text, at + len(marker)).end()
                m = (_NAME_ANY if marker in P.NAME_ANY_CASE else _NAME_TITLE).match(doc.text, start)
                if not m:
                    continue
                words = m[0].casefold().split()
                if marker in P.NAME_NEEDS_KNOWN and not any(w in lexicon.first or w in lexicon.patronymic for w in words):
                    continue
                if not lexicon.is_known(m[0]):
                    yield "PERSON", m.start(), m.end(), sure

    russian = joined(dictionary, marked)
    return joined(gated(lambda doc: doc.cyrillic, russian), latin)


def custom_terms(terms: Iterable[str]) -> Detector | None:
    """Whole words of a consumer's own terms, in any case; None without terms."""
    parts = [re.escape(t) for t in terms if t]
    if not parts:
        return None
    found = re.compile(r"\b(?:" + "|".join(parts) + r")\b", re.I)
    return lambda doc: (("CUSTOM_TERM", m.start(), m.end(), 1.0) for m in found.finditer(doc.text))


def _address(doc: Doc) -> Iterator[Found]:
    from .address import detect

    return (("ADDRESS", a, b, 0.95) for a, b in detect(doc.text))


def registry(require_card_for_pin: bool = True, lexicon: Lexicon | None = None) -> dict[str, Detector]:
    """The default detectors by type, in order."""
    n = digits_needed
    return {
        "EMAIL": gated(word_needed("@"), scan("EMAIL", P.EMAIL)),
        "PHONE": gated(
            n(8),
            joined(
                gated(n(11), phone_strong),
                gated(n(10, 10), scored("PHONE", P.digits(10), P.PHONE_RULE)),
                gated(word_needed("+"), scored("PHONE", P.PHONE_FOREIGN, P.PHONE_FOREIGN_RULE, OWN_LIMIT)),
            ),
        ),
        "PASSPORT": joined(
            gated(n(10, 6), passport_internal),
            gated(n(9, 7), scored("PASSPORT", P.PASSPORT_FOREIGN, P.PASSPORT_FOREIGN_RULE, OWN_LIMIT)),
            gated(n(7, 7), scored("PASSPORT", P.PASSPORT_ALPHA, P.PASSPORT_ALPHA_RULE, OWN_LIMIT)),
            gated(n(7, 7), scored("PASSPORT", P.MILITARY, P.PASSPORT_FOREIGN_RULE, OWN_LIMIT)),
            gated(word_needed("сери"), passport_in_words),
        ),
        "SNILS": gated(n(11, 3), snils_number),
        "INN": joined(gated(n(10, 10), inn_number), gated(n(13, 13), scored("INN", P.digits(13), P.INN_RULE, OWN_LIMIT))),
        "KPP": gated(n(9, 9), scored("KPP", P.digits(9), P.KPP_RULE, OWN_LIMIT)),
        "OGRN": gated(n(13, 13), scored("OGRN", P.digits(13), P.OGRN_RULE, OWN_LIMIT)),
        "CARD": gated(n(13), card_number),
        "DATE_OF_BIRTH": birth_date,
        "BIRTH_PLACE": birth_place,
        "CITIZENSHIP": citizenship,
        "PASSPORT_AUTHORITY": authority,
        "PASSPORT_UNIT_CODE": gated(n(6, 3), scored("PASSPORT_UNIT_CODE", P.UNIT_CODE, P.UNIT_CODE_RULE)),
        "PASSPORT_ISSUE_DATE": issue_date,
        "DRIVING_LICENSE": gated(n(10, 6), scored("DRIVING_LICENSE", P.LICENSE, P.LICENSE_RULE)),
        "ADDRESS": gated(lambda doc: doc.cyrillic or word_needed("address", "registered at", "lives at")(doc), _address),
        "CVV": gated(n(3, 3), scored("CVV", P.digits(3), P.CVV_RULE)),
        "PIN": gated(n(4, 4), pin(require_card_for_pin)),
        "CARD_HOLDER": scored("CARD_HOLDER", P.CARD_HOLDER, P.CARD_HOLDER_RULE),
        "PERSON": person(lexicon or Lexicon()),
    }


TYPES = tuple(registry(lexicon=Lexicon()))
#: Detectors that users add: name to function(text) -> [(type, start, end, confidence)].
PLUGINS: dict[str, Callable[[str], Iterable[Found]]] = {}


def register_detector(name: str, function: Callable[[str], Iterable[Found]]) -> None:
    """Adds a detector to those that ``detect`` runs. The function is sent to the executors."""
    PLUGINS[name] = function


def find(text: str, detectors: Iterable[Detector]) -> list[Found]:
    """All candidates, by (start, end, type)."""
    doc = Doc(text)
    return sorted((f for d in detectors for f in d(doc)), key=lambda f: (f[1], f[2], f[0]))


def detect(
    text: Column,
    types: Iterable[str] | None = None,
    require_card_for_pin: bool = True,
    terms: Iterable[str] = (),
    lexicon: Lexicon | None = None,
    plugins: dict[str, Callable] | None = None,
    degradation: str = "fail_closed",
) -> Column:
    """Candidates of the detectors of ``types`` (None: all) as an array of matches; null for a null text.

    Detectors of other types aren't run: their candidates would be dropped before overlaps are
    resolved, so they can't change the result. A plug-in that fails stops the query with
    ``fail_closed`` and is left out for that text with ``rule_only``.
    """
    wanted = None if types is None else frozenset(types)
    words, extra = tuple(terms), dict(PLUGINS if plugins is None else plugins)

    @F.pandas_udf(f"array<{MATCH}>")
    def run(texts: pd.Series) -> pd.Series:
        # built once a batch; the patterns are compiled once a worker
        all_of = registry(require_card_for_pin, lexicon)
        chosen = [d for t, d in all_of.items() if wanted is None or t in wanted]
        own = custom_terms(words)
        chosen += [own] if own else []

        def one(text: str | None):
            if text is None:
                return None
            found = find(text, chosen)
            for function in extra.values():
                try:
                    found += list(function(text))
                except Exception:
                    if degradation != "rule_only":
                        raise
            found.sort(key=lambda f: (f[1], f[2], f[0]))
            return [{"pii_type": t, "value": text[a:b], "start": a, "end": b, "confidence": float(c)} for t, a, b, c in found]

        return texts.map(one)

    return run(text)

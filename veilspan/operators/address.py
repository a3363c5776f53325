"""Addresses: texts are cut into segments, segments are classified, and runs of them grown into addresses.

A run counts if it has an anchor (a street, or a house or flat number after its word), two places,
or a postal code with a place or an address label. Only the names in it are reported, without the
service words around them, so "г. Москва, ул. Ленина, д. 5" gives Москва, Ленина and 5.
``parse`` gives the parts of a whole run by type, as they stand in the text before they are cut to names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mark the parts of an address.
_SETTLEMENT = "город|гор|г|село|с|посёлок|поселок|пос|п|деревня|дер|станица|ст-ца|станция|пгт|рп|гп|хутор|хут|аул|аал|слобода|сл"
_REGION = "область|обл|край|район|р-н|республика|респ|округ|АО"
_STREET = (
    "улица|ул|проспект|просп|пр-кт|пр-т|пр-зд|пр-д|проезд|переулок|пер|шоссе|ш|бульвар|б-р|набережная|наб|площадь|пл|тупик|туп|"
    "линия|аллея|микрорайон|мкрн|мкр|квартал|кв-л|тракт|дорога|въезд|съезд|вал"
)
_HOUSE = {
    "house": "дом|здание|д",
    "corpus": "корпус|корп|кор|к",
    "stroenie": "строение|стр",
    "litera": "литера|лит",
    "flat": "квартира|кв",
    "office": "офис|оф",
    "room": "помещение|помещ|пом|комната|комн|ком",
    "possession": "владение|влд",
}
_LABEL = "адрес(?:у)?|регистраци[яи]|проживает|зарегистрирована?|прописка|индекс"
_PERSONAL = re.compile(r"\b(?:адрес регистрации|регистраци[яи]|проживает|зарегистрирована?|прописка)\b", re.I)
_COUNTRY = re.compile(
    r"(?:RUS|UKR|TJK|UZB|KAZ|BLR|ARM|GEO|AZE|KGY|KGZ|ABH|MDA|Россия|Таджикистан|Узбекистан|Азербайджан|Армения|Грузия|Казахстан|Беларусь|Киргизия|Кыргызстан|Молдова|Туркменистан)\.?",
    re.I,
)
_ORGANISATION = re.compile(
    r"\b(?:ПАО|ОАО|ЗАО|ООО|НКО|АНО|ФГУП|МУП|ОГРН|банк|отделени[ея]|банкомат|офис|пункт выдачи|компания|организация|юридический адрес)\b",
    re.I,
)
_SERVICE_LINE = re.compile(r"\b(?:горяч(?:ая|ей) лини[яи]|служб[аы] поддержки|контактный центр)\b", re.I)
_ENGLISH = re.compile(r"\b(?:address|registered at|lives at)\b\s*:?\s*", re.I)
# Abbreviations whose period ends no sentence.
_ABBREVIATIONS = frozenset(
    ("г", "ул", "д", "кв", "п", "обл", "с", "ст", "к", "пер", "просп", "ш", "наб", "пл", "корп", "стр", "оф", "в", "о", "мкр", "тер", "уч", "им", "гор", "пос", "дер", "респ", "пр", "р-н", "пр-т", "б-р", "лит", "пом", "ком", "линия")
)
ORGANISATION_REACH = 60

_HOUSE_WORDS = "|".join(sorted("|".join(_HOUSE.values()).split("|"), key=len, reverse=True))
_NUMBER = r"(?:№\s*)?(?:д\.\s*)?(?:[0-9]+(?:\s*[/\\-]\s*[0-9]+)?(?:\s?[а-яё](?![а-яё]))?|[А-ЯЁ](?![А-Яа-яё])|б/н|н/д)"
_SERVICE = re.compile(rf"(?<![\w-])(?:{_SETTLEMENT}|{_REGION}|{_STREET}|{_HOUSE_WORDS})(?![\w-])\.?", re.I)
_NAME = r"[А-ЯЁ][а-яё]*(?:[-.][А-ЯЁа-яё]+)*\.?|[А-ЯЁ]{2,}|[0-9]+(?:-?[а-яё]{1,3})?(?![0-9])|им(?:\.|ени)|лет(?:ия)?"
_STREET_PART = re.compile(
    rf"(?<![\w-])(?:{_STREET})(?![\w-])\.?\s*(?:{_NAME})(?:\s+(?:{_NAME}))*(?:\s+(?:{_STREET})(?![\w-])\.?(?:\s+[А-ЯЁ]\.?[А-ЯЁ]?\.?)?)?"
    rf"|(?:[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+)*\s+)+(?:{_STREET})(?![\w-])\.?(?:\s+[0-9]+[а-яё]?(?:/[0-9]+)?)?",
)
_HOUSE_PART = re.compile(rf"(?<![\w-])(?:{_HOUSE_WORDS})(?![\w-])\.?\s*{_NUMBER}(?:\s*(?:{_HOUSE_WORDS})\.?\s*{_NUMBER})*", re.I)
_PLACE_PART = re.compile(rf"(?<![\w-])(?i:{_SETTLEMENT})(?![\w-])\.?\s*[А-ЯЁ][\w-]*(?:\s+[А-ЯЁ][\w-]*)*")
_REGION_PART = re.compile(rf"(?:[А-ЯЁ][\w-]*\s+)+(?i:{_REGION})(?![\w-])\.?|(?<![\w-])(?i:{_REGION})(?![\w-])\.?\s+[А-ЯЁ][\w-]*(?:\s+[А-ЯЁ][\w-]*)*")
_ZIP_PART = re.compile(r"(?<![0-9])[0-9]{6}(?![0-9])")
_BARE = re.compile(r"[0-9]{1,4}\s?[а-яё]?(?:[/\\][0-9]+)?", re.I)
#: A name and a number without any word for what they are: "Садовая 5", "Полевая 12/1", "ЛЕСНАЯ 7 к 2".
_PAIR = re.compile(r"([А-ЯЁ][А-ЯЁа-яё-]{2,})\s+([0-9]{1,3}[А-ЯЁа-яё]?)(?:\s*к\.?\s*([0-9]+)|([/\\][0-9]+))?(?![.0-9])")
#: Marks of a line that a machine has put together.
_MACHINE = re.compile(r"•|;;|\b(?:RUS|Россия|UKR|TJK|UZB|KAZ|BLR|KGZ|ABH)\b", re.I)
_PROPER = re.compile(r"[А-ЯЁ][\w.-]*(?:\s+[А-ЯЁа-яё][\w.-]*){0,3}|[А-ЯЁ][А-ЯЁ -]{2,}")
_CAPITALS = re.compile(r"[А-ЯЁ][\w-]*(?:\s+[А-ЯЁ][\w-]*)*")
_LABELLED = re.compile(rf"\b(?:{_LABEL})\b", re.I)
_CUT = re.compile(r"[,;:\n•·()]|[.!?](?=\s|$)")


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: str  #: zip, country, region, place, street, house, pair (a name and a number), number, name, or label
    after: str  #: the delimiter after it


def _is_pair(part: str) -> bool:
    m = _PAIR.fullmatch(part)
    return m is not None and not _SERVICE.fullmatch(m[1])


def _is_abbreviation(text: str, period: int) -> bool:
    word = re.search(r"[\w-]*$", text[max(0, period - 12) : period]).group().casefold()
    return word in _ABBREVIATIONS


def _classify(text: str, start: int, end: int) -> tuple[int, int, str] | None:
    """The part of a segment that belongs to an address, and its kind."""
    part = text[start:end]
    if _ZIP_PART.fullmatch(part):
        return start, end, "zip"
    if _COUNTRY.fullmatch(part):
        return start, end, "country"
    if _is_pair(part):
        return start, end, "pair"
    for pattern, kind in ((_STREET_PART, "street"), (_HOUSE_PART, "house"), (_REGION_PART, "region"), (_PLACE_PART, "place"), (_ZIP_PART, "zip")):
        if m := pattern.search(part):
            a = m.start()
            before = part[:a].strip()
            if before and (_CAPITALS.fullmatch(before) or _ZIP_PART.fullmatch(before)) and not _LABELLED.search(before):
                a = 0  # "Подольск ул. Ленина"
            tail = _HOUSE_PART.match(part, m.end() + len(part[m.end() :]) - len(part[m.end() :].lstrip())) or re.compile(r"\s+[0-9]+[а-яё]?(?:/[0-9]+)?(?!\w)").match(part, m.end())
            return start + a, start + (tail.end() if tail else m.end()), kind
    if _LABELLED.search(part):
        return start, end, "label"
    if _BARE.fullmatch(part):
        return start, end, "number"
    if _PROPER.fullmatch(part):
        return start, end, "name"
    return None


def segments(text: str) -> list[list[Segment]]:
    """Runs of neighbouring address-like segments."""
    out, run, at = [], [], 0
    cuts = [m for m in _CUT.finditer(text) if not (m[0] == "." and _is_abbreviation(text, m.start()))]
    for m in [*cuts, None]:
        stop = m.start() if m else len(text)
        a = at + len(text[at:stop]) - len(text[at:stop].lstrip())
        b = at + len(text[at:stop].rstrip())
        delimiter = m[0] if m else ""
        if b > a:
            found = _classify(text, a, b)
            if found is None or (found[0] > a and run):
                out, run = out + [run], []
            if found:
                run.append(Segment(*found, delimiter))
            if found and found[1] < b:  # prose goes on after it
                out, run = out + [run], []
        if delimiter and delimiter in ".!?\n":
            out, run = out + [run], []
        at = m.end() if m else stop
    return [r for r in [*out, run] if r]


def _accepted(text: str, run: list[Segment]) -> list[Segment]:
    """The run without labels and without what isn't tied to a marker; nothing if it is no address."""
    labelled = any(s.kind == "label" for s in run) or bool(_LABELLED.search(text[max(0, run[0].start - 40) : run[0].start]))
    last_label = max((i for i, s in enumerate(run) if s.kind == "label"), default=-1)
    run = run[last_label + 1 :]
    while run and run[0].kind == "name" and _ORGANISATION.search(text[run[0].start : run[0].end]):
        run = run[1:]  # an organisation before its address
    if not run:
        return []
    while run and run[-1].kind == "name" and run[-1].start > 0 and not any(s.kind in ("street", "house", "pair", "region", "place", "zip") for s in run[:-1]):
        run = run[:-1]
    kinds = [s.kind for s in run]
    places = kinds.count("place") + kinds.count("region")
    # what no word marks needs something else around it that is an address's, or a line made by a machine
    beside = places or "country" in kinds or "zip" in kinds or labelled or _MACHINE.search(text) is not None and len(kinds) > 1
    if "pair" in kinds and not beside:
        return []
    anchored = "street" in kinds or "pair" in kinds or "house" in kinds and (places or "name" in kinds or labelled or len(kinds) > 1 or kinds == ["house"])
    if not (anchored or places >= 2 or "zip" in kinds and (labelled or places or "name" in kinds and len(kinds) > 1) or "country" in kinds and places):
        return []
    before = text[max(0, run[0].start - ORGANISATION_REACH) : run[0].start]
    hits = list(_ORGANISATION.finditer(before))
    if hits and not _PERSONAL.search(before[hits[-1].end() :]):
        return []
    return [] if _SERVICE_LINE.search(text[run[0].start : run[-1].end]) else run


def names(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a segment without the service words at its sides and between numbers."""
    pair = _PAIR.fullmatch(text, start, end)
    if pair and not _SERVICE.fullmatch(pair[1]):
        return [pair.span(1), (pair.start(2), pair.end(4) if pair[4] else pair.end(2)), *([pair.span(3)] if pair[3] else [])]
    out, at = [], start
    marks = [m.span() for m in _SERVICE.finditer(text, start, end)]
    inner = [(a, b) for a, b in marks if a == start or b == end or not text[start:a].strip(" ,;") or re.match(r"\s*(?:№\s*)?[0-9]", text[b:end])]
    for a, b in [*inner, (end, end)]:
        piece = text[at:a]
        left = at + len(piece) - len(piece.lstrip(" ,;.№"))
        right = at + len(piece.rstrip(" ,;№"))
        if right > left:
            out.append((left, right))
        at = b
    return out


def detect(text: str) -> list[tuple[int, int]]:
    """Spans of the names in all addresses of a text, in order."""
    out = []
    for run in segments(text):
        for s in _accepted(text, run):
            out += names(text, s.start, s.end)
    if not out and (m := _ENGLISH.search(text)):
        rest = re.compile(r"[^,;\n]+")
        out = [(a + len(p) - len(p.lstrip()), a + len(p.rstrip(" ."))) for a, p in ((x.start(), x[0]) for x in rest.finditer(text, m.end())) if p.strip(" .")]
    return sorted(set(out))


def mask(text: str, placeholder: str = "[АДРЕС]") -> str:
    """The text with every name of an address replaced."""
    out, at = [], 0
    for a, b in detect(text):
        out += [text[at:a], placeholder]
        at = b
    return "".join([*out, text[at:]])


def _house_parts(part: str) -> list[tuple[str, str]]:
    kinds = {w: k for k, words in _HOUSE.items() for w in words.split("|")}
    each = list(re.finditer(rf"(?<![\w-])({_HOUSE_WORDS})(?![\w-])\.?\s*({_NUMBER})", part, re.I))
    return [(kinds[m[1].casefold()], m[2].strip(" .,;№")) for m in each]


def _granules(part: str, kind: str) -> list[tuple[str, str]]:
    if kind in ("zip", "country"):
        return [(kind, part.strip())]
    if kind == "house":
        return _house_parts(part)
    if kind == "number":
        return [("number", part)]
    if kind == "pair":
        name, house, corpus, fraction = _PAIR.fullmatch(part.strip()).groups()
        return [("street", name), ("house", house + (fraction or "")), *([("corpus", corpus)] if corpus else [])]
    if kind == "region":
        return [("district" if re.search(r"\b(?:р-н|район)\b", part, re.I) else "region", part)]
    if kind == "street":
        tail = _house_parts(part)
        m = _HOUSE_PART.search(part)
        body = part[: m.start()] if m else part
        value = " ".join(body[a:b] for a, b in names(body, 0, len(body)))
        bare = re.search(r"\s([0-9]+[а-яё]?(?:/[0-9]+)?)$", value)
        if bare and not tail:
            value, tail = value[: bare.start()], [("house", bare[1])]
        return [("street", value.strip(" ,.")), *tail]
    value = " ".join(part[a:b] for a, b in names(part, 0, len(part)))
    return [("city" if kind == "place" else "place", value.strip(" ,."))]


def parse(text: str) -> list[dict]:
    """Each address with its parts: {start, end, text, granules: [{type, value}]}.

    A bare number is a house, or a flat after a house; a place name before a house is a street, and
    beside a street a city.
    """
    out = []
    for run in segments(text):
        run = _accepted(text, run)
        if not run:
            continue
        parts: list[list[str]] = []
        for s in run:
            for kind, value in _granules(text[s.start : s.end], s.kind):
                if kind == "number":
                    kind = "flat" if any(k in ("house", "corpus", "stroenie", "litera") for k, _ in parts) else "house"
                parts.append([kind, value])
        for p, following in zip(parts, parts[1:]):
            if p[0] == "place" and following[0] in ("house", "flat"):
                p[0] = "street"
                break
        if any(k == "street" for k, _ in parts):
            for p in parts:
                if p[0] == "place" and re.fullmatch(r"[А-ЯЁ][а-яё\s-]+", p[1]):
                    p[0] = "city"
                    break
        a, b = run[0].start, run[-1].end
        out.append({"start": a, "end": b, "text": text[a:b], "granules": [{"type": k, "value": v} for k, v in parts]})
    return out


def granules(text: Column) -> Column:
    """The parts of all addresses of a text, as an array of structs (type, value); null for a null text."""

    @F.pandas_udf("array<struct<type:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [g for a in parse(t) for g in a["granules"]])

    return run(text)

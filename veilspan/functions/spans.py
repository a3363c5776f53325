"""Span detection and masking as column expressions: no Python runs on the executors.

A match is a struct (pii_type, value, start, end, confidence); offsets count code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .checks import digits_col, inn_col, luhn_col, snils_col

MATCH = "struct<pii_type:string,value:string,start:int,end:int,confidence:double>"
MATCHES = f"array<{MATCH}>"
#: More characters than a string can have.
_MOST = 1 << 30


def java(pattern: str, ignore_case: bool = False) -> str:
    r"""A Python pattern for Java: \w, \s and \b are Unicode there only with a flag."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern.replace("(?P<", "(?<")


def spans(text: Column, pattern: str | Column, kind: str, confidence: Column | float = 1.0, keep: Callable[[Column], Column] | None = None, hint: Column | None = None) -> Column:
    """All matches of a pattern (a Java one, or a column of them) as an array; ``keep`` tests a value.
    ``hint`` is a cheap condition that every text with a match fulfils; without one the pattern itself is tried.

    The texts between the matches give the offsets: each start is the length of all that is before it.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    values = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, p, -1)
    def step(acc: Column, x: Column) -> dict[str, Column]:
        start = acc["at"] + F.length(x["gap"])
        return {"at": start + F.length(x["value"]), "found": F.array(F.struct(x["value"].alias("value"), start.alias("start")))}

    pairs = F.arrays_zip(values.alias("value"), F.slice(gaps, 1, F.size(values)).alias("gap"))
    found = let(pairs, lambda every: _fold(every, {"at": F.lit(0)}, {"found": "array<struct<value:string,start:int>>"}, step)["found"])
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["value"]))
    conf = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    out = F.transform(
        found,
        lambda x: F.struct(F.lit(kind).alias("pii_type"), x["value"].alias("value"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), conf.alias("confidence")),
    )
    # texts that can't match skip the work
    return F.when(text.isNull(), F.lit(None).cast(MATCHES)).when(F.regexp_like(text, p) if hint is None else hint, out).otherwise(F.array().cast(MATCHES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements of an array that a fold goes through before it adds what it has made of them to the whole.
_CHUNK = 128


def _fold(items: Column, begin: dict[str, Column], made: dict[str, str], step: Callable[[Column, Column], dict[str, Column]], enter: dict[str, Callable] | None = None, leave: dict[str, Callable] | None = None) -> Column:
    """A struct of what a fold over an array comes to: running values (``begin``) and the arrays ``made`` (by type) that its steps add to.

    An array is written anew for each element that is added to it. So the fold goes through chunks and adds the
    elements of a chunk together, and the cost of many elements is nearly their sum. ``enter`` (accumulator, chunk) and ``leave``
    (accumulator, chunk) give values that are others within a chunk, and after it.
    """
    enter, leave = enter or {}, leave or {}
    empty = {k: F.array().cast(t) for k, t in made.items()}
    struct = lambda fields: F.struct(*(c.alias(k) for k, c in fields.items()))

    def inner(acc: Column, x: Column) -> Column:
        new = step(acc, x)
        return struct({**{k: new.get(k, acc[k]) for k in begin}, **{k: F.concat(acc[k], new[k]) for k in made}})

    def outer(acc: Column, chunk: Column) -> Column:
        first = struct({**{k: enter[k](acc, chunk) if k in enter else acc[k] for k in begin}, **empty})
        return let(F.aggregate(chunk, first, inner), lambda x: struct({**{k: leave[k](acc, chunk) if k in leave else x[k] for k in begin}, **{k: F.concat(acc[k], x[k]) for k in made}}))

    count = F.ceil(F.size(items) / _CHUNK).cast("int")
    chunks = F.when(F.size(items) == 0, F.array(items)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.slice(items, (k - 1) * _CHUNK + 1, F.lit(_CHUNK))))
    return F.aggregate(chunks, struct({**begin, **empty}), outer)


def email(text: Column) -> Column:
    return spans(text, java(P.EMAIL), "EMAIL", hint=text.contains("@"))


def card_luhn(text: Column) -> Column:
    return spans(text, java(P.CARD), "CARD", keep=lambda v: luhn_col(digits_col(v)))


def snils(text: Column) -> Column:
    return spans(text, java(P.SNILS), "SNILS", keep=lambda v: snils_col(digits_col(v)))


def inn_checked(text: Column) -> Column:
    return spans(text, java(P.INN), "INN", keep=inn_col)


def phone_plain(text: Column) -> Column:
    """Strong phone numbers without the test for a corporate line."""
    return spans(text, java(P.PHONE), "PHONE", 0.99, lambda v: ~digits_col(v).startswith("8800"))


def latin_names(text: Column) -> Column:
    """Runs of three capitalised Latin words."""
    return spans(text, java(P.NAME_LATIN), "PERSON", 0.95, lambda v: F.size(F.split(v, java(r"\s+"))) >= 3)


NATIVE = {"EMAIL": email, "CARD": card_luhn, "SNILS": snils, "INN": inn_checked}


def in_order(matches: Column) -> Column:
    """By (start, end, type)."""
    keyed = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["pii_type"].alias("kind"), m.alias("m"))))
    return F.transform(keyed, lambda k: k["m"])


def eligible(matches: Column, minimum: Column | float = P.MIN_CONFIDENCE, types: Column | None = None, with_terms: Column | bool = True) -> Column:
    """Matches of the threshold and of enabled types; custom terms count as enabled where terms are set."""
    low = F.lit(minimum) if isinstance(minimum, (int, float)) else minimum
    terms = F.lit(with_terms) if isinstance(with_terms, bool) else with_terms

    def ok(m: Column) -> Column:
        on = F.lit(True) if types is None else F.array_contains(types, m["pii_type"]) | ((m["pii_type"] == "CUSTOM_TERM") & terms)
        return (m["confidence"] >= low) & on

    return F.filter(matches, ok)


def _greedy(matches: Column) -> Column:
    """Of matches that hang together: the most confident, longest, leftmost, first by type; then the next that is free of it, and so on."""
    ranked = F.array_sort(
        F.transform(
            matches,
            lambda m: F.struct((-m["confidence"]).alias("a"), (m["start"] - m["end"]).alias("b"), m["start"].alias("c"), m["pii_type"].alias("d"), m.alias("m")),
        )
    )

    def step(acc: Column, r: Column) -> Column:
        m = r["m"]
        clash = F.exists(acc, lambda x: (m["end"] > x["start"]) & (m["start"] < x["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(m)))

    return F.when(F.size(matches) < 2, matches).otherwise(F.aggregate(ranked, F.array().cast(MATCHES), step))


def resolve(matches: Column) -> Column:
    """Disjoint matches in text order: the most confident first, then the longest, the leftmost, and by type.

    A choice depends only on matches that hang together by overlaps, so the text is swept from left to right and such
    groups are decided one by one: many matches in a text cost no more than their sum.
    """
    def step(acc: Column, m: Column) -> dict[str, Column]:
        apart = m["start"] >= acc["reach"]
        return {
            "reach": F.greatest(acc["reach"], m["end"]),
            "group": F.when(apart, F.array(m)).otherwise(F.concat(acc["group"], F.array(m))),
            "done": F.when(apart, _greedy(acc["group"])).otherwise(F.array().cast(MATCHES)),
        }

    begin = {"reach": F.lit(0), "group": F.array().cast(MATCHES)}
    swept = let(in_order(matches), lambda every: let(_fold(every, begin, {"done": MATCHES}, step), lambda x: F.concat(x["done"], _greedy(x["group"]))))
    return F.when(F.size(matches) < 2, matches).otherwise(in_order(swept))


def decisions(candidates: Column, eligible_ones: Column, selected: Column) -> Column:
    """What became of each candidate, without values or offsets: safe to log.

    Candidates are sorted among the selected and eligible ones, so that those equal to one come right behind it.
    """

    def tagged(matches: Column, tag: int) -> Column:
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["pii_type"].alias("kind"), m["confidence"].alias("confidence"), m["value"].alias("value"), F.lit(tag).alias("tag")))

    every = F.array_sort(F.concat(tagged(selected, 0), tagged(eligible_ones, 1), tagged(candidates, 2)))
    log = "array<struct<pii_type:string,confidence:double,action:string>>"
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("confidence"), F.lit("").alias("value"))
    def step(acc: Column, x: Column) -> dict[str, Column]:
        key = F.struct(*(x[c].alias(c) for c in ("start", "end", "kind", "confidence", "value")))
        action = F.when(acc["chosen"] == key, "masked").when(acc["fit"] == key, "overlap_rejected").otherwise("below_threshold")
        entry = F.array(F.struct(x["kind"].alias("pii_type"), x["confidence"].alias("confidence"), action.alias("action")))
        return {
            "chosen": F.when(x["tag"] == 0, key).otherwise(acc["chosen"]),
            "fit": F.when(x["tag"] == 1, key).otherwise(acc["fit"]),
            "log": F.when(x["tag"] == 2, entry).otherwise(F.array().cast(log)),
        }

    return F.when(candidates.isNotNull(), let(every, lambda e: _fold(e, {"chosen": none, "fit": none}, {"log": log}, step)["log"]))


def placeholder(kind: Column, index: Column, value: Column, mode: str) -> Column:
    """typed_placeholder, synthetic or format_preserving."""
    if mode == "synthetic":
        names = F.create_map(*[F.lit(x) for pair in P.SYNTHETIC.items() for x in pair])
        return F.concat(F.coalesce(F.try_element_at(names, kind), F.lit("PII")), F.lit("_"), index.cast("string"))
    if mode == "format_preserving":
        return F.regexp_replace(F.regexp_replace(value, r"(?U)\S", "*"), r"(?U)\s", " ")
    return F.concat(F.lit("__PII_"), kind, F.lit("_"), index.cast("string"), F.lit("__"))


def mask_struct(text: Column, matches: Column, mode: str = "typed_placeholder", offsets: Column | None = None) -> Column:
    """struct(masked, mapping): mapping has (masked_start, placeholder, value) in order, so the text can be restored exactly in every mode.

    ``matches`` are resolved. ``offsets`` maps a type to the number already used before this text.
    """
    used = (lambda kind: F.coalesce(F.try_element_at(offsets, kind), F.lit(0))) if offsets is not None else (lambda kind: F.lit(0))
    # numbered within each type, and put in order again
    kinds = F.array_distinct(F.transform(matches, lambda m: m["pii_type"]))
    numbered = F.flatten(F.transform(kinds, lambda k: F.transform(F.filter(matches, lambda m: m["pii_type"] == k), lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), (i + 1 + used(k)).alias("n"), m.alias("m")))))
    pairs = "array<struct<masked_start:int,placeholder:string,value:string>>"

    def step(acc: Column, x: Column) -> dict[str, Column]:
        # the text is used up from the left, and only its parts are kept
        gap, mark = x["start"] - acc["at"], placeholder(x["m"]["pii_type"], x["n"], x["m"]["value"], mode)
        entry = F.struct((acc["length"] + gap).alias("masked_start"), mark.alias("placeholder"), x["m"]["value"].alias("value"))
        return {
            "at": x["end"],
            "rest": F.substring(acc["rest"], gap + x["end"] - x["start"] + 1, F.lit(_MOST)),
            "length": acc["length"] + gap + F.length(mark),
            "parts": F.array(F.substring(acc["rest"], F.lit(1), gap), mark),
            "map": F.array(entry),
        }

    def through(chunk: Column) -> Column:
        return F.element_at(chunk, -1)["end"]

    # within a chunk only its own stretch of the text is used up
    begin = {"at": F.lit(0), "rest": text, "length": F.lit(0)}
    enter = {"rest": lambda acc, chunk: F.substring(acc["rest"], F.lit(1), through(chunk) - acc["at"])}
    leave = {"rest": lambda acc, chunk: F.substring(acc["rest"], through(chunk) - acc["at"] + 1, F.lit(_MOST))}
    made = {"parts": "array<string>", "map": pairs}
    spliced = let(F.array_sort(numbered), lambda every: let(_fold(every, begin, made, step, enter, leave), lambda x: F.struct(F.array_join(F.concat(x["parts"], F.array(x["rest"])), "").alias("masked"), x["map"].alias("mapping"))))
    return F.when(F.size(matches) == 0, F.struct(text.alias("masked"), F.array().cast(pairs).alias("mapping"))).when(matches.isNotNull(), spliced)


def demask(masked: Column, mapping: Column) -> Column:
    """Restores a masked text by the places in its mapping; exact in every mode."""
    def ends(e: Column) -> Column:
        return e["masked_start"] + F.length(e["placeholder"])

    def step(acc: Column, e: Column) -> dict[str, Column]:
        gap = e["masked_start"] - acc["at"]
        return {
            "at": ends(e),
            "rest": F.substring(acc["rest"], ends(e) - acc["at"] + 1, F.lit(_MOST)),
            "parts": F.array(F.substring(acc["rest"], F.lit(1), gap), e["value"]),
        }

    begin = {"at": F.lit(0), "rest": masked}
    enter = {"rest": lambda acc, chunk: F.substring(acc["rest"], F.lit(1), ends(F.element_at(chunk, -1)) - acc["at"])}
    leave = {"rest": lambda acc, chunk: F.substring(acc["rest"], ends(F.element_at(chunk, -1)) - acc["at"] + 1, F.lit(_MOST))}
    restored = let(mapping, lambda every: let(_fold(every, begin, {"parts": "array<string>"}, step, enter, leave), lambda x: F.array_join(F.concat(x["parts"], F.array(x["rest"])), "")))
    return F.when(F.size(mapping) == 0, masked).otherwise(restored)


PLACEHOLDER = r"__PII_[A-Z_]+_[0-9]+__"


def demask_by_map(text: Column, mapping: Column) -> Column:
    """Replaces typed placeholders anywhere in a text by a map's values; what is put in isn't looked at again."""
    keys = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    gaps = F.split(text, PLACEHOLDER, -1)
    values = F.transform(keys, lambda k: F.coalesce(F.try_element_at(mapping, k), k))
    return F.array_join(F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")


def kinds_present(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["pii_type"])))

"""Context scores as column expressions, and the detectors that need nothing else: no Python runs on the executors.

A candidate's window on either side is cut out of the text once. Of each phrase the nearest occurrence on a side counts:
one farther away has a longer gap and all marks of the nearer one between. (No phrase overlaps itself, so
each occurrence in a window is one of the text.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .checks import digits_col, inn_col, luhn_col, sequential_col
from .context import SOFT_FACTOR, Rule
from .spans import MATCHES, java, let, spans

#: A rule that has no threshold of its own keeps all its candidates; others drop those under this.
OWN_LIMIT = 0.80


def folded(text: Column) -> Column:
    """Lower case of the same length: a character whose lower case is longer stays."""
    low = F.lower(text)
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c)), "")
    return F.when(F.length(low) == F.length(text), low).otherwise(each)


def _passed(between: Column, abbreviations: bool) -> Column:
    """0 across a hard boundary, SOFT_FACTOR across a soft one, else 1."""
    hard = F.regexp_replace(between, r"(?<=[\p{L}\p{Nl}\p{No}])\.", "") if abbreviations else between
    return F.when(F.regexp_like(hard, F.lit("[,.;!?\n]")), 0.0).when(F.regexp_like(between, F.lit("[:—–]")), SOFT_FACTOR).otherwise(1.0)


def _influence(left: Column, right: Column, phrases: dict[str, float], rule: Rule) -> Column:
    """The strongest phrase in the windows before and after a candidate."""
    if not phrases:
        return F.lit(0.0)
    table = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(p[::-1]).alias("turned"), F.lit(float(w)).alias("weight")) for p, w in phrases.items()])

    def of(gap: Column, between: Callable[[Column], Column], weight: Column) -> Column:
        near = weight * F.pow(1.0 - gap / F.lit(float(rule.window + 1)), F.lit(rule.power)) if rule.power != 1 else weight * (1.0 - gap / F.lit(float(rule.window + 1)))
        return F.when((gap >= 0) & (gap <= rule.window), near * _passed(between(gap), rule.abbreviations)).otherwise(0.0)

    def one(x: Column) -> Column:
        before, after = F.instr(F.reverse(left), x["turned"]) - 1, F.instr(right, x["phrase"]) - 1
        return F.greatest(
            of(before, lambda gap: F.substring(left, F.length(left) - gap + 1, gap), x["weight"]),
            of(after, lambda gap: F.substring(right, F.lit(1), gap), x["weight"]),
        )

    # few phrases of a rule are near a candidate, and those that aren't count nothing
    near = F.filter(table, lambda x: F.contains(left, x["phrase"]) | F.contains(right, x["phrase"]))
    return F.coalesce(F.array_max(F.transform(near, one)), F.lit(0.0))


def confidence(left: Column, right: Column, rule: Rule) -> Column:
    score = F.lit(rule.base) + _influence(left, right, rule.plus, rule) - _influence(left, right, rule.minus, rule)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def reach(rule: Rule) -> int:
    return rule.window + max(len(p) for p in (*rule.plus, *rule.minus))


def with_windows(text: Column, found: Column, width: int, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` (match, window before it, window after it) of each match; the text is taken apart only if there are matches."""

    def of_all(chars: Column) -> Column:
        def one(m: Column) -> Column:
            begin = F.greatest(m["start"] - width, F.lit(0))
            left = F.array_join(F.slice(chars, begin + 1, m["start"] - begin), "")
            right = F.array_join(F.slice(chars, m["end"] + 1, F.lit(width)), "")
            return let(F.struct(left.alias("l"), right.alias("r")), lambda w: body(m, w["l"], w["r"]))

        return F.transform(found, one)

    return F.when(F.size(found) > 0, let(F.split(folded(text), ""), of_all)).otherwise(F.array().cast(MATCHES))


def _as(m: Column, sure: Column) -> Column:
    return F.struct(m["pii_type"].alias("pii_type"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"), sure.alias("confidence"))


def scored(text: Column, pattern: str, kind: str, rule: Rule, limit: float = 0.0, certain: Callable[[Column], Column] | None = None, keep: Callable[[Column], Column] | None = None, hint: Column | None = None) -> Column:
    """All matches with their context's confidence; those for whose value ``certain`` holds are sure, and ``keep`` drops values that aren't."""

    def scores(found: Column) -> Column:
        def one(m: Column, left: Column, right: Column) -> Column:
            sure = confidence(left, right, rule)
            return _as(m, sure if certain is None else F.when(certain(m["value"]), 1.0).otherwise(sure))

        out = with_windows(text, found, reach(rule), one)
        return F.filter(out, lambda m: m["confidence"] >= limit) if limit else out

    return F.when(text.isNull(), F.lit(None).cast(MATCHES)).otherwise(let(spans(text, java(pattern), kind, keep=keep, hint=hint), scores))


def _digits(text: Column, n: int) -> Column:
    return text.rlike(f"[0-9]{{{n}}}")


def kpp(text: Column) -> Column:
    return scored(text, P.digits(9), "KPP", P.KPP_RULE, OWN_LIMIT, hint=_digits(text, 9))


def ogrn(text: Column) -> Column:
    return scored(text, P.digits(13), "OGRN", P.OGRN_RULE, OWN_LIMIT, hint=_digits(text, 13))


def inn(text: Column) -> Column:
    long = scored(text, P.digits(13), "INN", P.INN_RULE, OWN_LIMIT, hint=_digits(text, 13))
    return F.concat(scored(text, P.INN, "INN", P.INN_RULE, OWN_LIMIT, certain=inn_col, hint=_digits(text, 10)), long)


def card(text: Column) -> Column:
    luhn = lambda v: luhn_col(digits_col(v))
    return scored(text, P.CARD, "CARD", P.CARD_RULE, OWN_LIMIT, certain=luhn, keep=lambda v: luhn(v) | ~sequential_col(digits_col(v)))


def cvv(text: Column) -> Column:
    return scored(text, P.digits(3), "CVV", P.CVV_RULE, hint=_digits(text, 3))


def unit_code(text: Column) -> Column:
    return scored(text, P.UNIT_CODE, "PASSPORT_UNIT_CODE", P.UNIT_CODE_RULE, hint=text.rlike("[0-9]{3}-[0-9]{3}"))


def license(text: Column) -> Column:
    return scored(text, P.LICENSE, "DRIVING_LICENSE", P.LICENSE_RULE, hint=_digits(text, 6))


def card_holder(text: Column) -> Column:
    return scored(text, P.CARD_HOLDER, "CARD_HOLDER", P.CARD_HOLDER_RULE)


def phone(text: Column) -> Column:
    strong = spans(text, java(P.PHONE), "PHONE", 0.99, lambda v: ~digits_col(v).startswith("8800"))
    corporate = F.array(*[F.lit(w) for w in P.CORPORATE])

    def line(m: Column, left: Column, right: Column) -> Column:
        around = F.concat(left, let(F.lower(m["value"]), lambda v: v), right)
        return _as(m, F.when(F.exists(corporate, lambda w: F.contains(around, w)), 0.0).otherwise(m["confidence"]))

    plain = let(strong, lambda found: F.filter(with_windows(text, found, P.CORPORATE_REACH, line), lambda m: m["confidence"] > 0))
    plain = F.when(text.isNull(), F.lit(None).cast(MATCHES)).otherwise(plain)
    ten = scored(text, P.digits(10), "PHONE", P.PHONE_RULE, hint=_digits(text, 10))
    return F.concat(plain, ten, scored(text, P.PHONE_FOREIGN, "PHONE", P.PHONE_FOREIGN_RULE, OWN_LIMIT, hint=text.contains("+")))


def pin(text: Column, require_card: bool = True) -> Column:
    """Codes after a marker; without any card in the text (one that passes the check, or is called one) they are unsure."""
    found = scored(text, P.digits(4), "PIN", P.PIN_RULE, hint=_digits(text, 4))
    if not require_card:
        return found
    cards = scored(text, P.CARD, "CARD", P.CARD_RULE, OWN_LIMIT, certain=lambda v: luhn_col(digits_col(v)))
    unsure = F.transform(found, lambda m: _as(m, F.least(m["confidence"], F.lit(0.5))))
    return F.when(F.size(found) == 0, found).when(F.size(cards) > 0, found).otherwise(unsure)


#: Detectors by type that are the same as those of ``operators.detectors``.
NATIVE_CONTEXT = {
    "PHONE": phone,
    "INN": inn,
    "KPP": kpp,
    "OGRN": ogrn,
    "CARD": card,
    "PASSPORT_UNIT_CODE": unit_code,
    "DRIVING_LICENSE": license,
    "CVV": cvv,
    "PIN": pin,
    "CARD_HOLDER": card_holder,
}

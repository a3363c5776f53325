"""Native span expressions, resolution, masking and restoring."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.functions import checks, patterns, spans
from veilspan.functions.context import Doc, Rule, confidence
from veilspan.operators import detectors, masking, restore

TEXTS = [
    None,
    "",
    "😀 mail a.b@c.example.com 😀",
    "x@y.zz,q@w.ee",
    "я@b.com яa@b.com",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (269) 555-3296 4524132264652876 4524132264652876",
    "087-654-303 00, 08765430300, 7707083893",
    "é́ 500100732259 x",
    "__PII_EMAIL_1__ and me@there.org",
    "Straße a@b.co\nnext c@d.co",
]


def test_spans_are_the_regex_matches(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for pattern, column in ((patterns.EMAIL, spans.email), (patterns.CARD, lambda t: spans.spans(t, spans.java(patterns.CARD), "CARD")), (patterns.NAME_LATIN, lambda t: spans.spans(t, spans.java(patterns.NAME_LATIN), "N"))):
        for r in df.select("text", column(F.col("text")).alias("m")).collect():
            if r.text is None:
                assert r.m is None
                continue
            assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.text)]
            assert all(r.text[m.start : m.end] == m.value for m in r.m)


def test_native_like_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    t = F.col("text")
    own = detectors.detect(t, ("EMAIL", "CARD", "SNILS", "INN"))
    native = F.concat(spans.email(t), spans.card_luhn(t), spans.snils(t), spans.inn_checked(t))
    for r in df.select(spans.in_order(native).alias("a"), F.filter(own, lambda m: m["confidence"] == 1.0).alias("b")).collect():
        assert r.a == r.b


def test_checksums_like_columns(spark):
    digits = [str(n) for n in (0, 7, 4111111111111111, 4111111111111112, 79927398713, 7707083893, 7707083894, 500100732259, 500100732250)] + ["08765430300", "08765430301", "0" * 13, "1234567890123456", ""]
    df = spark.createDataFrame([(d,) for d in digits], "d string")
    d = F.col("d")
    for r in df.select("d", checks.luhn_col(d).alias("luhn"), checks.snils_col(d).alias("snils"), checks.inn_col(d).alias("inn"), checks.sequential_col(d).alias("seq")).collect():
        assert (bool(r.luhn), bool(r.snils), bool(r.inn), bool(r.seq)) == (checks.luhn(r.d), checks.snils(r.d), checks.inn(r.d), checks.sequential(r.d)), r


def test_calendar(spark):
    rows = [(d, m, y) for d in (0, 1, 28, 29, 30, 31, 32) for m in (0, 1, 2, 4, 12, 13) for y in (1899, 1900, 2000, 2023, 2024, 2100, 2101)]
    df = spark.createDataFrame(rows, "d int, m int, y int")
    for r in df.select("*", checks.date_col(F.col("d"), F.col("m"), F.col("y")).alias("ok")).collect():
        assert r.ok == checks.valid_date(r.d, r.m, r.y), r
    assert checks.full_year(30) == 1930 and checks.full_year(29) == 2029 and checks.full_year(150) is None


@pytest.mark.parametrize(
    ("weight", "window", "power", "soft", "reach"),
    [(0.30, 64, 1.0, False, 10), (0.35, 64, 1.0, False, 18), (0.35, 64, 1.0, True, 3), (0.40, 64, 1.0, False, 24), (0.45, 64, 1.0, True, 16), (0.45, 120, 0.5, False, 83), (0.40, 48, 1.0, False, 18), (0.50, 120, 0.5, True, 67)],
)
def test_how_far_a_phrase_reaches(weight, window, power, soft, reach):
    rule = Rule({"метка": weight}, window=window, power=power)

    def sure(gap):
        between = (":" if soft else " ") + " " * (gap - 1)
        return confidence(Doc("метка" + between + "X"), 5 + gap, 6 + gap, rule)

    assert sure(reach) >= 0.80 > sure(reach + 1)


def test_boundaries():
    rule = Rule({"тел": 0.45}, {"заказ": 0.55})
    sure = lambda t: confidence(Doc(t), t.index("#"), t.index("#") + 1, rule)
    assert sure("тел #") > 0.9
    assert sure("тел, #") == rule.base
    assert sure("тел г. #") > 0.8  # a period after a letter is an abbreviation
    assert sure("тел 5. #") == rule.base
    assert sure("ТЕЛ # заказ") < 0.55
    assert confidence(Doc("ßßß тел #"), 8, 9, rule) == confidence(Doc("sss тел #"), 8, 9, rule)


spans_strategy = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from([0.5, 0.8, 0.9, 1.0]), st.sampled_from(["A", "B"])), max_size=12)


@settings(max_examples=60, deadline=None)
@given(spans_strategy)
def test_resolution_properties(found):
    chosen = restore.resolve((k, a, a + n, c) for a, n, c, k in found)
    assert all(x[2] <= y[1] for x, y in zip(chosen, chosen[1:]))
    for a, n, c, k in found:  # every other one clashes with one that ranks no lower
        if (k, a, a + n, c) not in chosen:
            assert any(x[1] < a + n and a < x[2] and (-x[3], x[1] - x[2], x[1], x[0]) <= (-c, -n, a, k) for x in chosen)


def test_resolution_column_like_python(spark):
    import random

    r = random.Random(0)
    docs = [[(r.choice("AB"), "v", a := r.randrange(30), a + r.randint(1, 8), r.choice([0.8, 0.9, 1.0])) for _ in range(r.randrange(12))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), f"id int, found {spans.MATCHES}")
    for row in df.select("found", spans.resolve(F.col("found")).alias("out")).collect():
        want = restore.resolve((m.pii_type, m.start, m.end, m.confidence) for m in row.found)
        assert [(m.pii_type, m.start, m.end, m.confidence) for m in row.out] == want


@pytest.mark.parametrize("mode", ["typed_placeholder", "synthetic", "format_preserving"])
def test_round_trip_in_every_mode(spark, mode):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    out = masking.demask(masking.mask(df, policy=masking.Policy(mode=mode))).collect()
    assert all(r.restored == r.text for r in out)


def test_modes_and_numbers(spark):
    df = spark.createDataFrame([("a@b.co и a@b.co, карта 4111 1111 1111 1111",)], "text string")
    shown = {m: masking.mask(df, policy=masking.Policy(mode=m)).first() for m in ("typed_placeholder", "synthetic", "format_preserving")}
    assert shown["typed_placeholder"].masked == "__PII_EMAIL_1__ и __PII_EMAIL_2__, карта __PII_CARD_1__"
    assert shown["synthetic"].masked == "user@example.com_1 и user@example.com_2, карта 4000 0000 0000 0000_1"
    assert shown["format_preserving"].masked == "****** и ******, карта **** **** **** ****"
    assert shown["typed_placeholder"].pii_types == ["CARD", "EMAIL"]
    assert {d.action for d in shown["typed_placeholder"].decisions} >= {"masked"}
    assert not any("value" in d.asDict() for d in shown["typed_placeholder"].decisions)


def test_detectors_run_once(spark):
    df = spark.createDataFrame([("a@b.co",)], "text string")
    masked = masking.mask(df).select("text", F.explode_outer("matches").alias("m"), "masked").where("m is not null")
    assert masked._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_other_types_cannot_change_the_result(spark):
    text = "паспорт 4509 123456, ИНН 7707083893, пин 4321 карта 4111 1111 1111 1111"
    df = spark.createDataFrame([(text,)], "text string")
    pruned = masking.mask(df, policy=masking.Policy(("PIN", "INN"))).first()
    whole = detectors.find(text, [d for d in detectors.registry().values()])
    want = restore.resolve(f for f in whole if f[3] >= 0.8 and f[0] in ("PIN", "INN"))
    assert [(m.pii_type, m.start, m.end, m.confidence) for m in pruned.matches] == want


def test_gates_never_lose_a_match():
    from veilspan.functions.lexicon import Lexicon

    samples = TEXTS[1:] + ["СЕРИЯ 4509 № 123456", "Phone +44 20 7946 0958", "born on March 15, 1990", "двадцать ПЕРВОГО мая 1990 года родился", "Lives at 5 Oak St", "АБ 1234567 военный билет", "загранпаспорт 71 1234567"]
    import veilspan.operators.detectors as d

    gated = d.gated
    try:
        open_ones = None
        d.gated = lambda test, detector: detector
        open_ones = d.registry(lexicon=Lexicon())
    finally:
        d.gated = gated
    shut = d.registry(lexicon=Lexicon())
    for t in samples:
        assert d.find(t, shut.values()) == d.find(t, open_ones.values()), t


def test_demask_by_map(spark):
    df = spark.createDataFrame([("x __PII_EMAIL_1__ y __PII_EMAIL_10__ __PII_A_1__", {"__PII_EMAIL_1__": "__PII_EMAIL_10__", "__PII_EMAIL_10__": "b"}), ("none", {}), (None, {})], "t string, m map<string,string>")
    out = [r[0] for r in df.select(spans.demask_by_map(F.col("t"), F.col("m"))).collect()]
    assert out == ["x __PII_EMAIL_10__ y b __PII_A_1__", "none", None]


def test_ten_thousand_matches_in_a_text(spark):
    """Overlaps, decisions, masking and restoring of a text with very many matches take no longer than their number asks for."""
    import time

    n = 10_000
    text = "é a@b.co " * n
    df = spark.createDataFrame([(text,)], "text string")
    begun = time.perf_counter()
    out = masking.demask(masking.mask(df, policy=masking.Policy(("EMAIL",)), native=True)).first()
    took = time.perf_counter() - begun
    assert out.masked == "".join(f"é __PII_EMAIL_{k}__ " for k in range(1, n + 1)) and out.restored == text
    assert len(out.mapping) == len(out.decisions) == n and {d.action for d in out.decisions} == {"masked"}
    # a chain of overlaps, all of which hang together, and many small groups
    rows = ", ".join(f"named_struct('pii_type', 'T{k % 3}', 'value', 'v', 'start', {3 * k}, 'end', {3 * k + 2 + k % 5}, 'confidence', {0.8 + k % 7 / 100}D)" for k in range(400))
    got = spark.sql(f"SELECT array({rows}) m").select(spans.resolve(F.col("m")).alias("r")).first().r
    chosen = []
    each = [(f"T{k % 3}", 3 * k, 3 * k + 2 + k % 5, 0.8 + k % 7 / 100) for k in range(400)]
    for t, a, b, c in sorted(each, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
        if all(b <= y[1] or a >= y[2] for y in chosen):
            chosen.append((t, a, b, c))
    assert [(m.pii_type, m.start, m.end) for m in got] == [x[:3] for x in sorted(chosen, key=lambda x: x[1:3])]
    assert took < 60, took

"""Context scores without Python against the Python detectors."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import native_context, patterns
from veilspan.functions.context import Rule
from veilspan.operators import detectors, masking
from veilspan.operators.masking import Policy

TYPES = ("EMAIL", "SNILS", *native_context.NATIVE_CONTEXT)
PHRASES = sorted({p for v in vars(patterns).values() if isinstance(v, Rule) for p in (*v.plus, *v.minus)} | set(patterns.CORPORATE))
VALUES = [
    "8 (916) 123-45-67", "+7 916 1234567", "8 800 555-35-35", "9161234567", "+49 30 123 4567", "770701001", "1027700132195", "7707083893", "7707083894", "500100732259",
    "4111 1111 1111 1111", "4111 1111 1111 1112", "1234567890123456", "123", "1234", "770-001", "77 15 123456", "IVAN PETROV", "MARIA-ANNA IVANOVA", "112-233-445 95", "a@b.co",
]
BETWEEN = [" ", ": ", ", ", ". ", "! ", "\n", " — ", "; ", " т. е. ", " a.b ", " 😀 ", " ß ", " İ ", " ² .", "", " " * 30, " слово " * 8, "ё" * 50]


def texts(seed, n=300):
    r = random.Random(seed)
    case = lambda p: r.choice([p, p, p.upper(), p.capitalize()])
    out = []
    for _ in range(n):
        parts = [r.choice(BETWEEN)]
        for _ in range(r.randint(1, 6)):
            parts += [case(r.choice(PHRASES)) if r.random() < 0.5 else r.choice(VALUES), r.choice(BETWEEN)]
        out.append("".join(parts))
    return out


def plain(found):
    return sorted((m["pii_type"], m["value"], m["start"], m["end"], round(m["confidence"], 9)) for m in found)


def check(df):
    """The candidates of each type, side by side."""
    for kind in TYPES:
        own = detectors.detect(F.col("text"), (kind,))
        other = masking.native_candidates(F.col("text"), Policy((kind,)))
        for r in df.select("text", own.alias("a"), other.alias("b")).collect():
            assert (r.a is None) == (r.b is None)
            assert r.a is None or plain(r.a) == plain(r.b), (kind, r.text)


@pytest.mark.parametrize("seed", [1, 2])
def test_native_equals_python(spark, seed):
    check(spark.createDataFrame([(t,) for t in [*texts(seed), None, "", " ", "карта " + "x" * 64 + "4111111111111112", "cvv" + "." * 64 + "123"]], "text string").repartition(4))


def test_native_equals_python_on_all_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet").select("text"))


def test_masks_are_the_same_and_no_python_runs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(3, 150))], "i int, text string")
    for policy in (Policy(TYPES), Policy(("PIN", "CARD"), require_card_for_pin=False)):
        native = masking.mask(df, policy=policy, native="context")
        assert "Python" not in native._jdf.queryExecution().toString()
        assert {r.i: (r.masked, r.mapping) for r in native.select("i", "masked", "mapping").collect()} == {r.i: (r.masked, r.mapping) for r in masking.mask(df, policy=policy).select("i", "masked", "mapping").collect()}
    with pytest.raises(ValueError, match="ADDRESS"):
        masking.mask(df, policy=Policy(("ADDRESS",)), native="context")

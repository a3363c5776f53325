"""Work is dealt to all cores, and what a step doesn't need isn't sent to it."""

import pytest
from pyspark.sql import functions as F

from veilspan.functions.tables import parts
from veilspan.operators.masking import Policy
from veilspan.plans import catalogue
from veilspan.streaming import keyed, sessions


def _requests(spark):
    rows = [(0, "a", "x" * 400_001), (1, "a", "mail u@mail.example.com"), (2, "a", "я" * 200_001), (3, "a", None), (4, None, "x" * 400_001), (5, "b", "x" * 400_000)]
    return spark.createDataFrame(rows, "seq long, payload_id string, payload string").withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))


def test_large_payloads_are_not_shuffled(spark):
    got = {r.seq: (r.large, r.size) for r in sessions.requests(_requests(spark)).select("seq", "large", F.length("payload").alias("size")).collect()}
    assert got == {0: (True, None), 1: (False, 23), 2: (True, None), 3: (False, None), 4: (True, None), 5: (False, 400_000)}
    for limits in (None, sessions.Limits(entries=1)):
        status = {r.seq: r.status for r in sessions.process_batch(_requests(spark), Policy(("EMAIL",)), limits).collect()}
        assert status == {0: 413, 1: 200, 2: 413, 3: 422, 4: 422, 5: 200 if limits is None else 429}


@pytest.mark.parametrize("name", ["detect_several_types", "address_granules", "address_spans", "ner_names", "sql_table_function", "native_context_masks"])
def test_texts_of_customers_are_dealt_to_all_partitions(spark, sf, name):
    """The table is one piece of few bytes, so it would be one task."""
    assert catalogue.QUERIES[name](spark, sf).rdd.getNumPartitions() >= parts(spark)


def test_sessions_are_dealt_to_all_partitions(spark):
    assert sessions.process_batch(_requests(spark), Policy(("EMAIL",))).rdd.getNumPartitions() == parts(spark)


class _Handle:
    """A store that counts its calls."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, *schema):
        return self

    getMapState = getValueState

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("timer")

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_session_is_three_calls_to_the_store():
    handle = _Handle()
    processor = keyed.SessionProcessor(Policy(("EMAIL",)), False)
    processor.init(handle)
    row = ("a", 0, "mail u@mail.example.com", True, False, 1_700_000_000_000_000)
    out = list(processor.handleInputRows(("a",), iter([row]), handle))
    assert [(r.status, r.result) for r in out] == [(200, "mail __PII_EMAIL_1__")]
    assert handle.calls == ["get", "timer", "update"]
    handle.calls.clear()
    assert [r.outcome for r in processor.handleInputRows(("a",), iter([row]), handle)] == ["retry"]
    assert handle.calls == ["get"]  # nothing has changed


def test_tokens_are_made_by_slices(spark, monkeypatch):
    """A batch's tokens aren't all Python objects at once, and slices change no result."""
    import pyarrow as pa

    from veilspan.operators import ner

    model, held = ner.CapitalisedBackend(), []

    def one(text):
        held.append(text)
        return text

    real = pa.array
    monkeypatch.setattr(ner, "SLICE", 100)
    texts = real(["Anna Belova met Oleg"] * 50 + [None, "", "x" * 500])
    assert [b - a for a, b in ner._slices(texts)] == [5] * 9 + [7, 1]
    assert ner._in_slices(one, pa.string(), texts).to_pylist() == texts.to_pylist() == held
    assert ner._in_slices(one, pa.string(), real([], pa.string())).to_pylist() == []
    got = spark.createDataFrame([(t,) for t in texts.to_pylist()], "text string").select(ner.predict(F.col("text"), ner.CapitalisedBackend).alias("t"), "text").collect()
    assert [r.t and [tuple(x) for x in r.t] for r in got] == [None if r.text is None else model(r.text) for r in got]

"""Sessions, chunks, policies, models, readers, evaluation, names by a model, and analytics."""

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspan.operators import analytics, evaluation, masking, ner, policy, restore
from veilspan.operators.masking import Policy, mask, mask_chat
from veilspan.sources import readers
from veilspan.streaming import sessions

START = datetime(2024, 1, 1)
EMAIL = Policy(("EMAIL",))
EVENTS = "seq long, ts timestamp, payload_id string, payload string"


def at(seq, seconds, who, payload):
    return seq, START + timedelta(seconds=seconds), who, payload


STORY = [
    at(0, 0, "a", "mail x@y.zz"),
    at(1, 1, "a", "mail x@y.zz"),
    at(2, 2, "a", "mail __PII_EMAIL_1__"),
    at(3, 3, "a", "mail __PII_EMAIL_1__"),
    at(4, 4, "a", "something else"),
    at(5, 121, "a", "mail x@y.zz"),
    at(6, 122, "a", "mail x@y.zz"),
    at(7, 183, "a", "mail x@y.zz"),
    at(0, 0, "b", "nothing in here"),
    at(1, 5, "b", "nothing in here"),
    at(2, 899, "b", "nothing in here"),
    at(3, 900, "b", "nothing in here"),
    at(0, 0, "", "empty id is fine"),
    at(0, 0, "big", "x" * 400_001),
    at(0, 0, "wide", "я" * 200_001),
    at(0, 0, None, "no id"),
    at(1, 0, "c", None),
]
ANSWERS = {
    ("a", 0): (200, "mask"),
    ("a", 1): (200, "retry"),
    ("a", 2): (200, "demask"),
    ("a", 3): (200, "retry"),
    ("a", 4): (409, "conflict"),
    ("a", 5): (200, "retry"),
    ("a", 6): (410, "expired"),
    ("a", 7): (200, "mask"),
    ("b", 0): (200, "mask"),
    ("b", 1): (200, "retry"),
    ("b", 2): (200, "retry"),
    ("b", 3): (410, "expired"),
    ("", 0): (200, "mask"),
    ("big", 0): (413, "too_large"),
    ("wide", 0): (413, "too_large"),
    (None, 0): (422, "invalid"),
    ("c", 1): (422, "invalid"),
}


def test_batch_sessions(spark):
    out = sessions.process_batch(spark.createDataFrame(STORY, EVENTS), EMAIL).collect()
    assert {(r.payload_id, r.seq): (r.status, r.outcome) for r in out} == ANSWERS
    result = {(r.payload_id, r.seq): r.result for r in out}
    assert result["a", 0] == "mail __PII_EMAIL_1__" and result["a", 2] == "mail x@y.zz" and result["a", 4] is None
    assert {r.name: r.value for r in sessions.outcome_counts(spark.createDataFrame(out)).collect()}["requests_mask"] == 4


def test_limits_of_a_service(spark):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    story = [
        ("a", 0, at(0), "one"), ("b", 1, at(1), "two"), ("c", 2, at(2), "three"), ("a", 3, at(3), "one"),  # the third finds no room, the first goes on
        ("c", 4, at(901), "three"),  # both have expired and are tombstones
        ("a", 5, at(902), "one"), ("x", 6, at(903), "x"), ("y", 7, at(904), "y"),
        ("b", 8, at(3000), "big" * 1000), (None, 9, at(3001), "x"), ("z", 10, at(3002), "z" * 400_001),
    ]
    df = spark.createDataFrame(story, "payload_id string, seq long, ts timestamp, payload string")
    got = {r.seq: (r.status, r.outcome) for r in sessions.process_batch(df, EMAIL, sessions.Limits(entries=2, bytes=4000, tombstones=3)).collect()}
    assert got[0] == got[1] == (200, "mask") and got[2] == (429, "full") and got[3] == (200, "retry")
    assert got[4] == (200, "mask") and got[5] == (410, "expired") and got[6] == (200, "mask") and got[7] == (429, "full")
    assert got[8] == (429, "full") and got[9] == (422, "invalid") and got[10] == (413, "too_large")
    dead = {r.seq: r.status for r in sessions.process_batch(df, EMAIL, sessions.Limits(tombstones=2)).collect()}
    assert dead[4] == 200 and dead[5] == 410 and dead[6] == 429
    free = {(r.seq, r.status, r.outcome) for r in sessions.process_batch(df, EMAIL).collect()}
    assert {(r.seq, r.status, r.outcome) for r in sessions.process_batch(df, EMAIL, sessions.Limits(shards=7)).collect()} == free
    store = sessions.Store(sessions.Limits())
    store.request("a", 0.0, "text", str)
    store.clear()
    assert not store.live and store.size == 0


def test_a_failed_request_leaves_no_session():
    def broken(text):
        raise ValueError("down")

    assert sessions.step(None, 0.0, "text", broken) == (None, 500, None, "error")


def test_round_robin_over_many_partitions(spark):
    """Wide and narrow rows, adaptive execution on and off: each row's backend is its place in the order."""
    from veilspan.operators import policy

    n = 60_000
    ids = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            for rows in (ids, ids.withColumn("text", F.repeat(F.lit("x"), 200))):
                out = policy.round_robin(rows.repartition(7), "k", 5, partitions=9)
                assert out.where(F.col("backend") != F.col("k") % 5).count() == 0 and out.count() == n
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
    assert policy.round_robin(ids.limit(0), "k", 5).count() == 0


def test_masking_refuses_columns_that_it_would_overwrite(spark):
    from veilspan.operators import masking

    df = spark.createDataFrame([("a@b.co", "keep")], "text string, masked string")
    with pytest.raises(ValueError, match="masked"):
        masking.mask(df, policy=EMAIL)
    out = masking.mask(df.withColumnRenamed("masked", "_found"), policy=EMAIL).first()
    assert out._found == "keep" and out.masked == "__PII_EMAIL_1__"


CHUNKS = "request_id string, seq long, chunk string, is_last boolean, mapping array<struct<placeholder:string,value:string>>"


def chunked(text, n, mapping, who="r"):
    parts = [text[i : i + n] for i in range(0, len(text), n)] or [""]
    return [(who, i, p, i == len(parts) - 1, list(mapping.items()) if i == 0 else None) for i, p in enumerate(parts)]


MAPPING = {"__PII_EMAIL_1__": "x@y.zz", "__PII_PERSON_1__": "Иван __PII_EMAIL_1__"}
MASKED = "a __PII_EMAIL_1____PII_PERSON_1__ b __PII_ c __PII_EMAIL_2__ _"


@pytest.mark.parametrize("n", range(1, 20))
def test_chunks_cut_anywhere(n):
    d = restore.ChunkDemasker(MAPPING)
    got = "".join(d.feed(MASKED[i : i + n]) for i in range(0, len(MASKED), n)) + d.flush()
    assert got == "a x@y.zzИван __PII_EMAIL_1__ b __PII_ c __PII_EMAIL_2__ _" == restore.demask(MASKED, MAPPING)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab_1", max_size=40), st.dictionaries(st.text(alphabet="ab_1", min_size=1, max_size=5), st.text(alphabet="xyz", max_size=3), max_size=4), st.lists(st.integers(0, 40), max_size=5))
def test_chunks_hold_no_more_than_needed(text, mapping, cuts):
    d = restore.ChunkDemasker(mapping)
    at, out = 0, []
    for c in [*sorted(min(c, len(text)) for c in cuts), len(text)]:
        out.append(d.feed(text[at:c]))
        at = c
        assert d.held == "" or any(k.startswith(d.held) and k != d.held for k in mapping)
    assert not mapping or set("".join(out) + d.flush()) <= set("ab_1xyz")


def test_chunk_queries(spark):
    rows = chunked(MASKED, 7, MAPPING) + chunked("plain", 2, {}, "p") + chunked("", 3, {}, "e")
    gap = [r for r in chunked(MASKED, 7, MAPPING, "gap") if r[1] != 2]
    out = sessions.demask_batch(spark.createDataFrame(rows + gap, CHUNKS).repartition(3)).collect()
    text = {}
    for r in sorted(out, key=lambda r: r.seq):
        text[r.request_id] = text.get(r.request_id, "") + r.text
    assert text["r"] == restore.demask(MASKED, MAPPING) and text["p"] == "plain" and text["e"] == ""
    assert restore.demask(MASKED, MAPPING).startswith(text["gap"]) and len([r for r in out if r.request_id == "gap"]) == 2


def test_sse():
    event = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}], "id": 1})
    d = restore.SseDemasker({"__PII_A_1__": "Ё"})
    lines = [event("x __PII"), event("_A_"), "", ": comment", "data: {bad", 'data: {"choices": []}', event("1__ y __P"), "data: [DONE]"]
    out = [x for line in lines for x in d.feed(line)]
    text = [json.loads(x[6:])["choices"][0]["delta"]["content"] for x in out if x.startswith('data: {"choices": [{')]
    assert "".join(text) == "x Ё y __P" and out[-1] == "data: [DONE]"
    assert "" in out and ": comment" in out and "data: {bad" in out and 'data: {"choices": []}' in out


def test_policies(spark, tmp_path):
    file = tmp_path / "policies.json"
    file.write_text(json.dumps({"consumers": [{"consumer_id": "a", "enabled_pii_types": ["EMAIL", "CARD"], "excluded_pii_types": ["CARD"], "api_keys": ["k"]}, {"enabled": True}, {"consumer_id": "off", "enabled": False}, {"consumer_id": "default", "min_confidence": 0.9}]}))
    table = policy.load_policies(spark, str(file))
    rows = {r.consumer_id: r for r in table.collect()}
    assert set(rows) == {"a", "off", "default"} and rows["a"].effective_types == ["EMAIL"]
    assert len(rows["default"].effective_types) == 17 and rows["default"].min_confidence == 0.9 and rows["a"].min_confidence == 0.8
    asked = spark.createDataFrame([(1, "a", "k"), (2, "a", "z"), (3, "off", None), (4, "who", None), (5, None, None), (6, "default", None)], "id int, consumer_id string, api_key string")
    assert [r.id for r in policy.check_access(asked, table).where("allowed").orderBy("id").collect()] == [1, 6]
    assert {r.id: r.policy.consumer_id for r in policy.with_policy(asked, table).collect()} == {1: "a", 2: "a", 3: "off", 4: "default", 5: "default", 6: "default"}


def test_last_good_configuration_is_kept(spark, tmp_path):
    file, now = tmp_path / "models.json", [0.0]
    good = {"models": [{"name": "m", "api_base": "http://x//", "model": ""}, {"name": "n"}, {"api_base": "http://z"}]}
    file.write_text(json.dumps(good))
    cache = policy.Reloading(lambda: policy.load_models(spark, str(file)), 10, lambda: now[0])
    assert [tuple(r) for r in cache.get(spark).collect()] == [("m", "http://x", "m")]
    file.write_text("{broken")
    now[0] = 11
    assert cache.get(spark).count() == 1
    file.write_text(json.dumps({"models": []}))
    assert cache.get(spark).count() == 1  # a failed read waits as long again
    now[0] = 22
    assert cache.get(spark).count() == 0
    with pytest.raises(Exception):
        policy.Reloading(lambda: policy.load_models(spark, str(tmp_path / "none.json"))).get(spark)


def test_readers(spark, tmp_path):
    words = tmp_path / "words.txt"
    words.write_text("﻿Анна,1\n анна \n\nBob\nО\nПетровна\n")
    got = lambda df: sorted(r[0] for r in df.collect())
    assert got(readers.csv_first_field(spark, str(words))) == ["bob", "анна", "о", "петровна"]
    assert got(readers.lexicon_filter(readers.csv_first_field(spark, str(words)), "first")) == ["анна", "петровна"]
    assert got(readers.lexicon_filter(readers.csv_first_field(spark, str(words)), "patronymic")) == ["петровна"]
    assert readers.word_list(spark, str(tmp_path / "missing.txt")).count() == 0
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"text": "Анна"}\nbroken\n{"text": "анна", "n": 1}\n')
    assert got(readers.json_lines_field(spark, str(lines))) == ["анна"]
    payload = tmp_path / "p.json"
    payload.write_text('{"payload": "x", "payload_id": "1"}\n')
    assert readers.payloads(spark, str(payload)).first() == ("x", "1")
    cases = tmp_path / "cases.csv"
    cases.write_text('id,category,kind,text,expected_masked,expected_span,note,expected_entities\n1,EMAIL,positive,"say ""a@b.co"",\nok",true,a@b.co,,"[{""type"": ""EMAIL"", ""start"": 5, ""end"": 11, ""value"": ""a@b.co""}]"\n')
    rows = readers.cases(spark, str(cases), "own").withColumn("expected", readers.entities(F.col("expected_entities")))
    assert rows.select(F.size(readers.entity_errors(F.col("text"), F.col("expected")))).first()[0] == 0
    masked = mask(rows.select("dataset", "id", "text", "expected"), policy=EMAIL).withColumnRenamed("matches", "actual")
    total = evaluation.quality(masked).where("dataset = 'own' and pii_type is null").first()
    assert (total.tp, total.fp, total.f1) == (1, 0, 1.0)


@pytest.mark.parametrize("bad", ['{"type": "A"}', "[1]", '[{"type": "A", "start": 2, "end": 1, "value": ""}]', '[{"type": "A", "start": -1, "end": 1, "value": ""}]', '[{"type": "A"}]', "nonsense"])
def test_malformed_entities_fail(spark, bad):
    with pytest.raises(Exception, match="malformed|CAST|parse"):
        spark.createDataFrame([(bad,)], "j string").select(readers.entities(F.col("j"))).collect()


def test_matching_of_entities():
    e = ("EMAIL", 0, 10)
    assert evaluation.match_case([e], [e])["EMAIL"]["tp"] == 1
    assert evaluation.match_case([e], [("EMAIL", 2, 12)])["EMAIL"] == {"tp": 0, "fp": 0, "fn": 0, "span_errors": 1, "type_errors": 0, "partial_leaks": 1, "overmasking": 1}
    assert evaluation.match_case([e], [("PHONE", 0, 10)])["EMAIL"]["type_errors"] == 1
    both = evaluation.match_case([e, ("EMAIL", 20, 30)], [("EMAIL", 5, 10), e])
    assert both["EMAIL"]["tp"] == 1 and both["EMAIL"]["fn"] == 1 and both["EMAIL"]["fp"] == 1
    assert evaluation.match_case([], [e])["EMAIL"]["fp"] == 1 and evaluation.match_case([], []) == {}


def test_ratios_and_ratchet(spark):
    each = spark.createDataFrame([("d", "A", 8, 1, 1, 0, 0, 0, 0), ("d", "B", 0, 0, 0, 0, 0, 0, 0)], "dataset string, pii_type string, " + ", ".join(f"{c} int" for c in evaluation.COUNTS))
    table = evaluation.rollup(each)
    rows = {r.pii_type: r for r in table.where("dataset = 'd'").collect()}
    assert abs(rows["A"].precision - 8 / 9) < 1e-12 and rows["B"].f1 == 0.0
    m = evaluation.macro_micro(table).first()
    assert abs(m.macro_f1 - rows["A"].f1 / 2) < 1e-12 and abs(m.micro_f1 - rows["A"].f1) < 1e-12
    assert evaluation.ratchet(table, spark.createDataFrame([("d", 0.89)], "dataset string, f1 double")).count() == 0
    assert evaluation.ratchet(table, spark.createDataFrame([("d", 0.95)], "dataset string, f1 double")).count() == 1


def test_names_by_a_model():
    text = "Иванов Иван и Полищук-Белая Максим. Лев Толстой"
    words = [(m.start(), m.end()) for m in __import__("re").finditer(r"\w+", text)]
    b = [("B-PER", *words[0], 0.9), ("I-PER", *words[1], 0.85), ("I-PER", *words[2], 0.9), ("I-PER", *words[3], 0.9), ("I-PER", *words[4], 0.9), ("I-PER", *words[5], 0.95), ("B-PER", *words[6], 0.99), ("I-PER", *words[7], 0.99)]
    assert [(text[a:z], c) for _, a, z, c in ner.names(text, b)] == [("Иванов Иван", 0.85), ("Полищук-Белая Максим", 0.9)]
    assert ner.suspicious(text, b)
    assert ner.names(text, [("PERSON", 0, 6, 0.7), ("B-ORG", 7, 11, 0.9), ("B-PER", 90, 99, 0.9), ("B-PER", 5, 5, 0.9)]) == []
    assert ner.dedupe([("a", 0, 2, 0.1), ("b", 0, 2, 0.9)]) == [("b", 0, 2, 0.9)]
    assert ner.windows(1000) == [(0, 512), (448, 960), (896, 1000)] and ner.windows(10) == [(0, 10)]


def test_chat_numbers_go_on(spark):
    rows = [(1, 0, "a@b.co"), (1, 1, "none"), (1, 2, "c@d.co e@f.co"), (2, 0, "g@h.co"), (2, 1, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    for native in (True, False):
        got = {(r.conv_id, r.turn): r.masked for r in mask_chat(df, EMAIL, native=native).collect()}
        assert got == {(1, 0): "__PII_EMAIL_1__", (1, 1): "none", (1, 2): "__PII_EMAIL_2__ __PII_EMAIL_3__", (2, 0): "__PII_EMAIL_1__", (2, 1): None}


def test_stacks_and_exporter(spark):
    lines = spark.createDataFrame([("a;b;pii.py:x 3",), ("_worker;wait 4",), ("q 1",), ("x",)], "value string")
    stacks = readers.folded_stacks(lines)
    kind = analytics.categorise(F.col("frames"), [("D", ["pii.py"])], "_worker", ("pii.py",))
    assert {r.category: r.samples for r in analytics.profile_shares(stacks, kind).collect()} == {"D": 3, "Idle": 4, "Other": 1}
    assert analytics.top_functions(stacks, kind, 1).first().function == "wait"
    assert [r[0] for r in analytics.exporter(spark.createDataFrame([("b", 2), ("a", 1)], "name string, value long")).collect()] == ["veilspan_a 1", "veilspan_b 2"]
    echo = analytics.echo_report(spark.createDataFrame([("__PII_DATE_OF_BIRTH_1__ x@y.zz",)], "text string")).first()
    assert (echo.placeholders, echo.raw_emails) == (1, 1)


def test_late_events_are_dropped(spark, tmp_path):
    """A stream with a watermark closes its windows and leaves late rows out."""
    source = tmp_path / "in"
    source.mkdir()
    for i, seconds in enumerate((0, 600, 700, 5, 1300)):
        spark.createDataFrame([(START + timedelta(seconds=seconds), "x")], "ts timestamp, event_type string").coalesce(1).write.mode("append").json(str(source / f"{i}"))
    rows = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(source))
    out = analytics.windowed_counts(rows, late="1 minute").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    got = {r.window_start: r.n for r in spark.table("late").collect()}
    assert got.get(START) == 1 and START + timedelta(seconds=600) in got


def test_annotation_of_cases(spark):
    rows = [("1", "EMAIL", "a@b.co then c@d.co", "a@b.co; c@d.co"), ("2", "EMAIL", "none", None), ("3", "CVV", "😀 12 3", "12")]
    df = spark.createDataFrame(rows, "id string, category string, text string, expected_span string")
    got = readers.annotated(df).withColumn("e", readers.entities(F.col("expected_entities")))
    assert {r.id: [(e.type, e.start, e.end, e.value) for e in r.e] for r in got.collect()} == {"1": [("EMAIL", 0, 6, "a@b.co"), ("EMAIL", 12, 18, "c@d.co")], "2": [], "3": [("CVV", 2, 4, "12")]}
    with pytest.raises(Exception, match="exactly once"):
        readers.annotated(spark.createDataFrame([("1", "A", "x x", "x")], "id string, category string, text string, expected_span string")).collect()


def test_sql_functions(spark):
    from veilspan.plans import sql

    sql.register(spark, EMAIL)
    spark.createDataFrame([(1, "mail a@b.co"), (2, None)], "id int, text string").createOrReplaceTempView("t_sql")
    assert [tuple(r) for r in spark.sql("SELECT t.id, s.* FROM t_sql t, LATERAL detect_spans(t.text) s").collect()] == [(1, "EMAIL", "a@b.co", 5, 11, 1.0)]
    assert [r[0] for r in spark.sql("SELECT pii_mask(text) FROM t_sql ORDER BY id").collect()] == ["mail __PII_EMAIL_1__", None]


LINES = "request_id string, seq long, line string, mapping array<struct<placeholder:string,value:string>>"


def test_event_streams(spark):
    event = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    lines = [event("x __PII_EMAIL"), event("_1__ y __P"), "", ": note", "data: [DONE]"]
    rows = [("r", i, x, list(MAPPING.items()) if i == 0 else None) for i, x in enumerate(lines)] + [("s", 0, event("plain"), None)]
    out = sorted(map(tuple, sessions.demask_sse_batch(spark.createDataFrame(rows, LINES).repartition(2)).collect()))
    text = "".join(json.loads(x[3][6:])["choices"][0]["delta"]["content"] for x in out if x[3].startswith("data: {") and x[0] == "r")
    assert text == "x x@y.zz y __P" and [x[3] for x in out if x[0] == "r"][-1] == "data: [DONE]"


def test_synthetic_payloads_come_back(spark):
    rows = readers.synthetic_payloads(spark, 50)
    both = rows.select(F.lit(0).alias("seq"), F.lit(START).alias("ts"), "payload_id", "payload")
    first = sessions.process_batch(both).select("payload_id", "result", "status")
    assert first.where("status = 200 and result like '%__PII_EMAIL_1__%__PII_PHONE_1__'").count() == 50
    again = both.union(first.select(F.lit(1), F.lit(START), "payload_id", "result"))
    back = sessions.process_batch(again).where("seq = 1").join(rows, "payload_id")
    assert back.where("result = payload and outcome = 'demask'").count() == 50


def test_chat_detectors_run_once_and_columns_are_kept(spark, tmp_path, monkeypatch):
    """Each text of a conversation is looked at once, and no column of the input is overwritten."""
    from veilspan.operators import detectors

    log = tmp_path / "calls"

    def counted(text):
        with log.open("a") as f:
            f.write("x")
        return [("MARK", 0, 1, 0.99)] if text else []

    rows = spark.createDataFrame([(i % 5, i, f"text {i}") for i in range(50)], "conv_id long, turn long, text string").repartition(3)
    monkeypatch.setattr(masking, "candidates", lambda t, policy, lexicon=None: detectors.detect(t, (), plugins={"mark": counted}))
    out = mask_chat(rows, Policy(())).collect()
    assert len(out) == 50 and len(log.read_text()) == 50
    assert {r.masked[: r.masked.index(" ")] for r in out if r.conv_id == 0} == {f"__PII_MARK_{k}__ext" for k in range(1, 11)}
    with pytest.raises(ValueError, match="masked"):
        mask_chat(rows.withColumn("masked", F.lit("keep")), EMAIL)


def test_sql_functions_obey_their_policy(spark):
    from veilspan.plans import sql

    spark.createDataFrame([(1, "mail a@b.co and card 4111 1111 1111 1111")], "id int, text string").createOrReplaceTempView("t_policy")
    for types, want in ((("EMAIL",), ["EMAIL"]), (("CARD",), ["CARD"]), (("EMAIL", "CARD"), ["EMAIL", "CARD"]), ((), [])):
        sql.register(spark, Policy(types))
        assert [r[0] for r in spark.sql("SELECT s.pii_type FROM t_policy t, LATERAL detect_spans(t.text) s ORDER BY s.start").collect()] == want
        masked = spark.sql("SELECT pii_mask(text) FROM t_policy").first()[0]
        assert all((f"__PII_{k}_1__" in masked) == (k in want) for k in ("EMAIL", "CARD"))
    sql.register(spark, Policy(("EMAIL",), min_confidence=1.1))
    assert spark.sql("SELECT s.* FROM t_policy t, LATERAL detect_spans(t.text) s").count() == 0


def test_windows_equal_one_pass(spark):
    """Texts of any length, through windows of ten tokens in batches of three, against the model without windows."""
    import random

    class Context(ner.CapitalisedWindows):
        """Labels depend on the token before; the two ends of a window are less sure than its middle."""

        labels = {0: "O", 1: "B-PER", 2: "I-PER", 9: "O"}

        def __call__(self, windows):
            assert all(len(w) <= 10 for w in windows) and len(windows) <= 3
            sure = lambda k, n: 0.9 if n < 10 or 3 <= k < n - 3 else 0.85
            return [[(label, sure(k, len(w))) for k, (label, _) in enumerate(one)] for w, one in zip(windows, super().__call__(windows))]

    r = random.Random(9)
    word = lambda: r.choice(["Anna", "Bo", "said", "to", ",", "x", "Carl-Otto", "é", "Öl"])
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 9, 10, 11, 12, 17, 18, 19, 40, 41, 500)] + [None, "  ", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    found = ner.with_predictions(df, "t", Context, 12, 6, 2, 3, outside="").select("i", "ner").collect()
    got = {x.i: x.ner and x.ner.entities for x in found}
    plain = ner.CapitalisedWindows()
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        ids, spans = plain.encode(t)
        want = [(plain.labels[label], *span) for span, (label, _) in zip(spans, plain([ids])[0])]
        assert [(x.label, x.start, x.end) for x in got[i]] == want, t
        assert [(m.start, m.end) for m in next(x.ner.matches for x in found if x.i == i)] == [(a, b) for _, a, b, _ in ner.names(t, [(*w, 0.9) for w in want])]
    with pytest.raises(ValueError):
        ner.with_predictions(df, "t", Context, 10, 8, 2)


def test_an_unknown_label_is_an_error_and_the_surer_window_counts():
    found = {}
    ner.merged(found, {0: "O", 1: "PER"}, [(0, 2), (2, 2), (3, 5)], [(1, 0.5), (7, 1.0), (0, 0.9)])
    ner.merged(found, {0: "O", 1: "PER"}, [(0, 2), (3, 5)], [(0, 0.5), (1, 0.95)])
    assert found == {(0, 2): ("PER", 0, 2, 0.5), (3, 5): ("PER", 3, 5, 0.95)}
    with pytest.raises(ValueError, match="unknown label"):
        ner.merged({}, {0: "O"}, [(0, 1)], [(3, 0.9)])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_bytes_cut_anywhere(n):
    text = "ж __PII_EMAIL_1____PII_PERSON_1__ 😀 é__PII_ ё"
    data = text.encode()
    d = restore.ByteDemasker(MAPPING)
    assert "".join(d.feed(data[i : i + n]) for i in range(0, len(data), n)) + d.flush() == restore.demask(text, MAPPING)
    d = restore.ByteDemasker({})
    assert d.feed(b"a\xd0") == "a" and d.cut == b"\xd0" and d.flush() == "�"


def test_byte_chunks_like_text(spark):
    from veilspan.streaming import keyed

    text = "ж __PII_EMAIL_1__ 😀" * 3
    replies = spark.createDataFrame([("r", text, list(MAPPING.items())), ("e", "", None)], "request_id string, masked string, mapping array<struct<placeholder:string,value:string>>")
    for size in (1, 3, 7, 1000):
        out = keyed.restore_batch(sessions.echo_bytes(replies, size), "bytes").orderBy("seq").collect()
        assert "".join(x.text for x in out if x.request_id == "r") == restore.demask(text, MAPPING)
        assert [x.text for x in out if x.request_id == "e"] == [""]
    cut = [x for x in sessions.echo_bytes(replies, 1).collect() if x.request_id == "r" and x.seq < 9]
    held = keyed.restore_batch(spark.createDataFrame(cut, "request_id string, seq long, chunk binary, is_last boolean, mapping array<struct<placeholder:string,value:string>>"), "bytes").collect()
    assert "".join(x.text for x in sorted(held, key=lambda x: (x.seq, x.part))) == text[:8]


def test_windows_make_tokens_of_names_only():
    """Of tokens outside only those that end a name are made, and names and entities are those of all tokens, merged window by window."""
    r = random.Random(2)

    class Unsure(ner.CapitalisedWindows):
        def __call__(self, windows):
            return [[(label, r.choice((0.7, 0.85, 0.9))) for label, _ in w] for w in super().__call__(windows)]

    for _ in range(50):
        text = " ".join(r.choice(("Anna", "Maria-Eva", "word", "x", "и", "- -", "Ян .")) for _ in range(r.randint(0, 120)))
        log, model = [], Unsure()
        calls = Unsure.__call__
        model.__class__ = type("Logged", (Unsure,), {"__call__": lambda self, w: (log.append((w, calls(self, w))), log[-1][1])[1]})
        got = ner._predicted(model, [text, None], 10, 4, 1)
        ids, offsets = model.encode(text)
        told = {}
        for w, out in log:
            told.setdefault(tuple(w[0]), []).append(out[0])
        whole = {}
        for a, b in ner.windows(len(ids), 10, 4) if ids else ():
            ner.merged(whole, model.labels, offsets[a:b], told[tuple(ids[a:b])].pop(0))
        want = [whole[s] for s in sorted(whole)]
        assert got[1] is None and [t for t in got[0] if t[0] != "O"] == [t for t in want if t[0] != "O"]
        assert ner.names(text, got[0]) == ner.names(text, want)
        assert sum(t[0] == "O" for t in got[0]) <= sum(t[0] != "O" for t in got[0])

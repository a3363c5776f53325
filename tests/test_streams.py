"""Streams with state by key against their batch forms."""

import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspan.functions import patterns
from veilspan.operators import restore
from veilspan.operators.masking import Policy
from veilspan.streaming import keyed, sessions

START = datetime(2024, 1, 1)
EMAIL = Policy(("EMAIL",))
EVENTS = "seq long, ts timestamp, payload_id string, payload string"
CHUNKS = "request_id string, seq long, ts timestamp, chunk string, is_last boolean, mapping array<struct<placeholder:string,value:string>>"
LINES = "request_id string, seq long, ts timestamp, line string, mapping array<struct<placeholder:string,value:string>>"
MAPPING = {"__PII_EMAIL_1__": "x@y.zz", "__PII_PERSON_1__": "Иван __PII_EMAIL_1__"}
P_CARD = patterns.SYNTHETIC["CARD"]
MASKED = "a __PII_EMAIL_1____PII_PERSON_1__ b __PII_ c __PII_EMAIL_2__ _"


def at(seconds):
    return START + timedelta(seconds=seconds)


class Files:
    """A stream of JSON files, one a micro-batch, that a query is run over until they are used up; more can be added then."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0
        (path / "in").mkdir(parents=True)

    def add(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.json(str(self.path / "in" / f"{self.n:04d}"))
            self.n += 1

    def run(self, build, name):
        """Rows of this run: those of the micro-batches since the last one."""
        spark = self.spark
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep a query going for ever
        reader = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(self.path / "in"))
        out = []
        query = (
            build(reader).writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).queryName(name).outputMode("append")
            .option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start()
        )
        try:
            assert query.awaitTermination(300)
        finally:
            query.stop()
            spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        return out


def answers(rows):
    return sorted(((r.payload_id, r.seq, r.status, r.result, r.outcome) for r in rows), key=repr)


def requests(seed, ids=4, n=60):
    """Requests of some ids over half an hour, with retries, restores, conflicts, expiry and what comes after it."""
    r = random.Random(seed)
    out, now = [], 0
    for seq in range(n):
        now += r.choice([0, 1, 5, 40, 70, 130])
        who = f"id{r.randrange(ids)}"
        payload = r.choice([f"mail {who}@y.zz", f"mail {who}@y.zz", "mail __PII_EMAIL_1__", "plain", None if seq % 17 == 3 else "mail __PII_EMAIL_1__"])
        out.append((seq, at(now), who, payload))
    return out


def test_sessions_like_batch_in_any_order_of_arrival(spark, tmp_path):
    """Rows that wait for the watermark are answered as the batch answers them, however they are dealt to micro-batches."""
    rows = requests(1)
    want = answers(sessions.process_batch(spark.createDataFrame(rows, EVENTS), EMAIL).collect())
    end = [(10_000, at(200_000), "end", "x")], [(10_001, at(400_000), "end", "x")]  # moves the watermark past all others, twice
    r = random.Random(2)
    mixed = [x for k in range(0, len(rows), 20) for x in r.sample(rows[k : k + 20], len(rows[k : k + 20]))]
    files = Files(spark, tmp_path, EVENTS)
    files.add(mixed[:15], mixed[15:32], mixed[32:], *end)
    out = files.run(lambda s: keyed.process_stream(s, EMAIL, late="2 hours", wait=True), "waiting")
    assert [x for x in answers(out) if x[0] != "end"] == want


def test_sessions_as_they_arrive_and_restarts(spark, tmp_path):
    """Answers at once, in order of arrival; a query that is stopped and started again goes on where it was."""
    rows = requests(3)
    want = answers(sessions.process_batch(spark.createDataFrame(rows, EVENTS), EMAIL).collect())
    files = Files(spark, tmp_path, EVENTS)
    files.add(rows[:20], rows[20:30])
    build = lambda s: keyed.process_stream(s, EMAIL, late="1 minute")
    first = files.run(build, "first")
    files.add(rows[30:])
    assert answers(first + files.run(build, "second")) == want


def test_late_and_forbidden_rows_are_answered(spark, tmp_path):
    schema = EVENTS + ", allowed boolean"
    files = Files(spark, tmp_path, schema)
    files.add(
        [(0, at(0), "a", "mail x@y.zz", True), (1, at(0), "b", "mail x@y.zz", False), (2, at(1), "b", "mail x@y.zz", None)],
        [(3, at(5000), "c", "hello", True)],
        [(4, at(5001), "c", "hello", True)],  # a's session and tombstone have gone by now
        [(5, at(2), "a", "mail x@y.zz", True), (6, at(3), "new", "never seen", True), (7, at(4990), "c", "hello", True), (8, at(2), "a", "x" * 400_001, True), (9, at(4), "a", "x", False)],
        [(10, at(5002), "a", "mail x@y.zz", True)],
    )
    out = files.run(lambda s: keyed.process_stream(s, EMAIL, late="1 second"), "late_rows")
    assert {r.seq: (r.status, r.outcome) for r in out} == {
        0: (200, "mask"), 1: (403, "forbidden"), 2: (403, "forbidden"), 3: (200, "mask"), 4: (200, "retry"),
        5: (410, "late"), 6: (410, "late"), 7: (200, "retry"), 8: (413, "too_large"), 9: (403, "forbidden"), 10: (200, "mask"),
    }
    batch = sessions.process_batch(spark.createDataFrame([(0, at(0), "a", "m", False), (1, at(1), "a", "m", True)], schema), EMAIL)
    assert {r.seq: r.status for r in batch.collect()} == {0: 403, 1: 200}
    shard = sessions.process_batch(spark.createDataFrame([(0, at(0), "a", "m", False), (1, at(1), "a", "m", True)], schema), EMAIL, sessions.Limits())
    assert {r.seq: r.status for r in shard.collect()} == {0: 403, 1: 200}


def test_a_stream_begins_with_the_sessions_of_a_batch(spark, tmp_path):
    rows = requests(5, n=40)
    want = answers(sessions.process_batch(spark.createDataFrame(rows, EVENTS), EMAIL).collect())
    before, after = spark.createDataFrame(rows[:25], EVENTS), rows[25:]
    first = sessions.process_batch(before, EMAIL).collect()
    files = Files(spark, tmp_path, EVENTS)
    files.add(after)
    out = files.run(lambda s: keyed.process_stream(s, EMAIL, initial=sessions.open_sessions(before, EMAIL)), "handed_over")
    assert answers([*first, *out]) == want


def chunked(text, n, mapping, who, begin=0):
    parts = [text[i : i + n] for i in range(0, len(text), n)] or [""]
    return [(who, i, at(begin + i), p, i == len(parts) - 1, list(mapping.items()) if i == 0 else None) for i, p in enumerate(parts)]


def test_chunks_in_any_order_like_batch(spark, tmp_path):
    """Out of order, repeated, and with a chunk missing; the stream stands still for days of clock time without losing one."""
    gap = [r for r in chunked(MASKED, 7, MAPPING, "gap") if r[1] not in (2, 5)]
    cut = chunked(MASKED, 9, MAPPING, "cut")[:2]  # ends within a placeholder
    rows = chunked(MASKED, 7, MAPPING, "r") + chunked("plain", 2, {}, "p") + chunked("", 3, {}, "e") + gap + cut
    r = random.Random(4)
    mixed = r.sample(rows, len(rows))
    mixed = mixed + mixed[:5]  # repeated rows
    end = [("end", 0, at(100_000), "", True, None)], [("end2", 0, at(200_000), "", True, None)]
    want = sorted(map(tuple, keyed.restore_batch(spark.createDataFrame(mixed, CHUNKS).repartition(3)).collect()))
    text = {}
    for x in want:
        text[x[0]] = text.get(x[0], "") + x[3]
    assert text["r"] == restore.demask(MASKED, MAPPING) and text["p"] == "plain" and text["e"] == ""
    assert {x[4] for x in want if x[0] == "gap"} == {"ok", "held", "beyond"} and {x[4] for x in want if x[0] == "cut"} == {"ok", "held"}
    assert {x[1] for x in want if x[0] == "gap"} >= {r[1] for r in gap}  # every chunk comes out
    files = Files(spark, tmp_path, CHUNKS)
    files.add(mixed[:9], mixed[9:20], mixed[20:], *end)
    got = files.run(lambda s: keyed.restore_stream(s, late="1 hour", idle="5 minutes"), "chunks_mixed")
    assert sorted(tuple(x) for x in got if not x.request_id.startswith("end")) == want
    # the same rows as the batch form of whole requests
    whole = [r for r in rows if r[0] in ("r", "p", "e")]
    plain = sessions.demask_batch(spark.createDataFrame(whole, CHUNKS)).collect()
    assert sorted((x[0], x[1], x[3]) for x in want if x[0] in ("r", "p", "e")) == sorted(map(tuple, plain))


class Store:
    """A bucket's state in memory, with the calls that a worker would make to the state store."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def _call(self, f):
        def called(*args):
            self.calls += 1
            return f(*args)

        return called

    def getValueState(self, name, schema):
        return SimpleNamespace(get=self._call(lambda: self.value), update=self._call(lambda v: setattr(self, "value", v)), clear=self._call(lambda: setattr(self, "value", None)))

    def getMapState(self, name, key, value):
        return SimpleNamespace(getValue=self._call(self.map.__getitem__), updateValue=self._call(self.map.__setitem__), removeKey=self._call(self.map.__delitem__))

    def registerTimer(self, at):
        self._call(self.timers.add)(at)

    def deleteTimer(self, at):
        self._call(self.timers.remove)(at)


def bucket(store, idle=300.0):
    """A processor over the state, given micro-batches of rows (request_id, seq, second, body, is_last, mapping) and the watermark; or the watermark alone, for timers."""
    p = keyed.OrderProcessor("chunks", idle)
    p.init(store)

    def run(rows, watermark):
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark * 1000)
        if rows:
            frame = pd.DataFrame([(w, s, b, last, json.dumps([{"placeholder": k, "value": v} for k, v in m]) if m else None, t * 1_000_000) for w, s, t, b, last, m in rows], columns=["request_id", "seq", "body", "is_last", "mapping", "at"])
            out = list(p.handleInputRows((0,), iter([frame[:7], frame[7:]]), times))
        else:
            out = [f for t in sorted(store.timers) if t <= watermark * 1000 for f in p.handleExpiredTimer((0,), times, None)]
            store.timers -= {t for t in store.timers if t <= watermark * 1000}
        return [tuple(r) for f in out for r in f.itertuples(index=False)]

    return run


@pytest.mark.parametrize("n", [10, 400])
def test_calls_to_the_store_dont_grow_with_requests(n):
    rows = [(f"r{i}", seq, 100 + i % 60, f"{c} __PII_EMAIL_1__", seq == 2, list(MAPPING.items()) if seq == 0 else None) for i in range(n) for seq, c in enumerate("abc")]
    store = Store()
    run = bucket(store)
    out = run(rows, 50)
    assert sorted(out) == sorted((r[0], r[1], 0, f"{'abc'[r[1]]} x@y.zz", "ok") for r in rows) and store.calls <= 4
    assert run(rows[: n * 2], 50) == [] and store.calls <= 8  # repeated rows
    assert run([], 399) == [] and len(json.loads(store.value[1])) == n
    assert run([], 1000) == [] and store.value is None and not store.map and not store.timers and store.calls <= 16


def test_a_bucket_holds_few_early_rows_and_forgets_each_request_in_its_time(monkeypatch):
    monkeypatch.setattr(keyed, "_EARLY", 5)
    texts = {f"r{i}": MASKED * (i % 3 + 1) for i in range(9)}
    rows = [(w, s, 100 + 20 * k, b, last, m) for k, (w, t) in enumerate(texts.items()) for w, s, _, b, last, m in chunked(t, 11, MAPPING, w)]
    lost = [r for r in chunked(MASKED, 11, MAPPING, "lost") if r[1] != 1]
    rows = random.Random(8).sample(rows + [(w, s, 250, b, last, m) for w, s, _, b, last, m in lost], len(rows) + len(lost))
    store = Store()
    run = bucket(store)
    out = run(rows[:20], 0) + run(rows[20:35], 0) + run(rows[10:], 0)
    assert {w: "".join(x[3] for x in sorted(out) if x[0] == w) for w in texts} == {w: restore.demask(t, MAPPING) for w, t in texts.items()}
    assert {k[0] for k in store.map} == {"lost"} and store.timers == {400_000}
    assert run([], 410) == [] and store.timers == {420_000} and len(json.loads(store.value[1])) == 9
    # a forgotten request's row is late; a known one's isn't, whatever its time
    assert run([("r0", 0, 100, "x", True, None), ("r8", 0, 100, "x", True, None)], 410) == [("r0", 0, 0, "x", "late")]
    got = run([], 600)
    assert {x[4] for x in got} == {"held", "beyond"} and {x[1] for x in got} >= {r[1] for r in lost} - {0} and store.value is None and not store.map and not store.timers


def test_many_requests_share_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 3)
    rows = [x for i in range(40) for x in chunked(MASKED[: 5 + i], 7, MAPPING, f"r{i}", begin=i * 20) if i % 4 or x[1] != 1]
    mixed = random.Random(9).sample(rows, len(rows))
    want = sorted(map(tuple, keyed.restore_batch(spark.createDataFrame(rows, CHUNKS)).collect()))
    assert {x[4] for x in want} == {"ok", "held", "beyond"}
    files = Files(spark, tmp_path, CHUNKS)
    files.add(mixed[:60], mixed[60:90], mixed[80:], [("end", 0, at(100_000), "", True, None)], [("end2", 0, at(200_000), "", True, None)])
    got = files.run(lambda s: keyed.restore_stream(s, late="1 hour", idle="5 minutes"), "buckets")
    assert sorted(tuple(x) for x in got if not x.request_id.startswith("end")) == want


def test_late_chunks_come_out(spark, tmp_path):
    rows = chunked("one __PII_EMAIL_1__ two", 30, MAPPING, "late") + chunked("x", 1, {}, "now", 5000)
    files = Files(spark, tmp_path, CHUNKS)
    files.add(rows[1:], [("now2", 0, at(9000), "y", True, None)], rows[:1])
    got = {r.request_id: (r.text, r.state) for r in files.run(lambda s: keyed.restore_stream(s, late="1 second"), "chunks_late")}
    assert got == {"now": ("x", "ok"), "now2": ("y", "ok"), "late": ("one x@y.zz two", "late")}


def test_event_streams_like_batch(spark, tmp_path):
    event = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    lines = [event("x __PII_EMAIL"), event("_1__ y __P"), "", ": note", "data: {bad", "data: [DONE]"]
    rows = [("r", i, at(i), x, list(MAPPING.items()) if i == 0 else None) for i, x in enumerate(lines)]
    rows += [("open", 0, at(0), event("plain __PII"), list(MAPPING.items())), ("gap", 0, at(0), event("a"), None), ("gap", 2, at(1), event("b"), None)]
    want = sorted(map(tuple, keyed.restore_batch(spark.createDataFrame(rows, LINES).repartition(3), "events").collect()))
    text = "".join(json.loads(x[3][6:])["choices"][0]["delta"]["content"] for x in want if x[3].startswith('data: {"ch') and x[0] == "r")
    assert text == "x x@y.zz y __P" and [x[3] for x in want if x[0] == "r"][-1] == "data: [DONE]"
    assert {x[4] for x in want if x[0] == "open"} == {"ok", "held"} and {x[4] for x in want if x[0] == "gap"} == {"ok", "beyond"}
    files = Files(spark, tmp_path, LINES)
    mixed = random.Random(6).sample(rows, len(rows))
    files.add(mixed[:3], mixed[3:], [("end", 0, at(100_000), "", None)], [("end", 1, at(200_000), "", None)])
    got = files.run(lambda s: keyed.restore_stream(s, "events", late="1 hour"), "events_mixed")
    assert sorted(tuple(x) for x in got if x.request_id != "end") == want
    plain = sessions.demask_sse_batch(spark.createDataFrame([r for r in rows if r[0] == "r"], LINES)).collect()
    assert sorted(x[:4] for x in want if x[0] == "r") == sorted(map(tuple, plain))


def test_metrics_equal_a_recount(spark, tmp_path):
    """What the listener adds up over two runs is what a count over all answers, and the state store, come to."""
    import time

    from veilspan.streaming import metrics

    rows = requests(7)
    files = Files(spark, tmp_path, EVENTS)
    files.add(rows[:20], rows[20:40])
    listener = metrics.Metrics("requests_test", interval=0.5)
    spark.streams.addListener(listener)
    try:
        observed = lambda s: metrics.process_stream(s, "requests_test", EMAIL, late="1 minute")
        first = files.run(observed, "metered")
        files.add(rows[40:], [(10_000, at(20_000), "end", "x")])
        second = files.run(observed, "metered_again")
        deadline = time.monotonic() + 30
        while listener.values()["process_mask_total"] < sum(r.outcome == "mask" for r in first + second) and time.monotonic() < deadline:
            time.sleep(0.2)  # progress is reported a little later
    finally:
        spark.streams.removeListener(listener)
    got = listener.values()
    by = lambda *names: sum(r.outcome in names for r in first + second)
    assert [got[n] for n in metrics.OUTCOMES] == [by(*names) for names in metrics.OUTCOMES.values()]
    assert got["process_new_id_total"] == by("mask") and by("mask") > 4 and by("retry") and by("demask") and by("conflict")
    assert got["store_evictions_total"] == got["process_new_id_total"] - got["store_sessions"]
    gauges = metrics.stored(spark, str(tmp_path / "state"))
    assert {n: got[n] for n in gauges} == gauges and gauges["store_sessions"] >= 1 and gauges["store_pending"] == 0
    lines = listener.text().splitlines()
    assert len(lines) == 28 and len(metrics.KINDS) == 14
    assert lines[0] == "# TYPE veilspan_uptime_seconds gauge" and f"veilspan_process_mask_total {by('mask')}" in lines
    target = tmp_path / "metrics.prom"
    for _ in range(2):
        listener.write(spark, f"file://{target}")
    assert target.read_text().splitlines()[2:-1] == lines[2:-1] and not (tmp_path / "metrics.prom.new").exists()
    # the metric text can be read back
    from veilspan.sources import readers

    assert readers.prometheus(spark.createDataFrame([(x,) for x in lines], "value string")).count() == 14


def test_a_report_counts_once_and_gauges_go_on():
    from veilspan.streaming import metrics

    m = metrics.Metrics("x", {"store_sessions": 5}, interval=1.0, clock=iter([0.0, 2.5]).__next__)
    one = dict.fromkeys([*metrics.OUTCOMES, *metrics.SUMS], 1) | {"store_sessions": -2}
    for batch in (0, 0, 1):
        m.add("q", batch, one, 1500.0)
    got = m.values()
    assert got["process_mask_total"] == 2 and got["store_sessions"] == 1 and got["uptime_seconds"] == 2.5 and got["trigger_delay_ms"] == 500.0


REQUESTS = "n int, consumer_id string, api_key string, text string"


def test_policies_change_while_a_stream_runs(spark, tmp_path):
    from veilspan.streaming import policies

    file = tmp_path / "policies.json"

    def save(*consumers):
        file.write_text(json.dumps({"consumers": list(consumers)}))

    mail, card = {"consumer_id": "a", "enabled_pii_types": ["EMAIL"]}, {"consumer_id": "a", "enabled_pii_types": ["CARD"], "masking_mode": "synthetic"}
    base = {"consumer_id": "default", "enabled_pii_types": ["EMAIL", "CARD"], "excluded_pii_types": ["EMAIL"]}
    text = "x@y.zz 4111 1111 1111 1111"
    feed = policies.PolicyFile(str(file))
    with pytest.raises(Exception):
        feed.get(spark)
    files = Files(spark, tmp_path, REQUESTS)

    def batch(n, *rows):
        files.add([(n, *r, text) for r in rows])
        reader = spark.readStream.schema(REQUESTS).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        q = policies.write_masked(reader, feed, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True)
        assert q.awaitTermination(120) and q.exception() is None
        out = spark.read.parquet(str(tmp_path / "out")).where(f"n = {n}").orderBy("consumer_id").collect()
        return [(r.consumer, r.status, r.masked) for r in out]

    save(mail, base)
    assert batch(0, ("a", None), ("b", None)) == [("a", 200, "__PII_EMAIL_1__ 4111 1111 1111 1111"), ("default", 200, "x@y.zz __PII_CARD_1__")]
    save(card | {"api_keys": ["k"]})
    assert batch(1, ("a", "k"), ("a2", None)) == [("a", 200, f"x@y.zz {P_CARD}_1"), (None, 403, None)]
    assert batch(2, ("a", "wrong")) == [("a", 403, None)]
    for broken in ("{not json", json.dumps({"consumers": [mail, mail]}), json.dumps({"consumers": [mail | {"enabled_pii_types": ["NO_SUCH"]}]}), json.dumps({"consumers": [mail | {"masking_mode": "loud"}]}), json.dumps({"consumers": [mail | {"min_confidence": 7}]})):
        file.write_text(broken)
        assert [r.consumer_id for r in feed.get(spark).collect()] == ["a"] and feed.error is not None
    assert batch(3, ("a", "k")) == [("a", 200, f"x@y.zz {P_CARD}_1")]
    file.unlink()
    assert batch(4, ("a", "k")) == [("a", 200, f"x@y.zz {P_CARD}_1")]
    save(mail | {"enabled": False})
    assert batch(5, ("a", None)) == [("a", 403, None)] and feed.error is None


def test_each_row_is_masked_by_its_own_policy_once(spark):
    from veilspan.operators import policy
    from veilspan.streaming import policies

    table = policy.policies_of(spark.createDataFrame([("m", ["EMAIL"], 0.5), ("t", ["CARD"], 0.8)], "consumer_id string, enabled_pii_types array<string>, min_confidence double").select("*", *[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in policy._CONSUMER.split(", ")) if n not in ("consumer_id", "enabled_pii_types", "min_confidence")]))
    rows = spark.createDataFrame([("m", "a@b.co"), ("t", "a@b.co"), ("m", None), (None, "a@b.co")], "consumer_id string, text string")
    got = {(r.consumer_id, r.text): (r.status, r.masked) for r in policies.mask_requests(rows, table).collect()}
    assert got == {("m", "a@b.co"): (200, "__PII_EMAIL_1__"), ("t", "a@b.co"): (200, "a@b.co"), ("m", None): (200, None), (None, "a@b.co"): (403, None)}


def test_a_restarted_sink_repeats_nothing(spark, tmp_path):
    """Killed between the sink's commit and Spark's, and with files of failed tasks lying about: the same content."""
    from veilspan.sources import sinks

    rows = chunked(MASKED, 7, MAPPING, "r") + chunked("plain", 2, {}, "p") + chunked("other text", 3, {}, "o", 50)
    files = Files(spark, tmp_path, CHUNKS)
    out, state = tmp_path / "sink", tmp_path / "c"

    def run():
        reader = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        q = sinks.write_stream(keyed.restore_stream(reader, late="1 hour"), f"file://{out}", str(state), availableNow=True)
        assert q.awaitTermination(120) and q.exception() is None

    def content():
        got = sinks.committed(spark, str(out), keyed.RESTORED)
        return sorted(map(tuple, got.collect())), {r.request_id: r.body for r in sinks.bodies(got).collect()}

    files.add(rows[:6], rows[6:12])
    run()
    before = content()[0]
    lists = sorted(p.name for p in (out / "lists").glob("0*"))
    last = max((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the driver had died before it knew of the last micro-batch
    (state / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    (out / "rows" / "orphan.json").write_text('{"request_id": "r", "seq": 0, "part": 0, "text": "twice", "state": "ok"}\n')
    (out / "lists" / ".half").write_text('{"epoch": 0, "file": "orphan.json", "rows": 1}\n')
    run()
    assert content()[0] == before and sorted(p.name for p in (out / "lists").glob("0*")) == lists
    files.add(rows[12:])
    run()
    got, body = content()
    want = sorted(map(tuple, keyed.restore_batch(spark.createDataFrame(rows, CHUNKS)).collect()))
    assert sorted(r[:5] for r in got) == want
    assert body == {"r": restore.demask(MASKED, MAPPING), "p": "plain", "o": "other text"}

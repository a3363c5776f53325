"""Streams with state by key: sessions, and chunks and event streams that come in any order.

All three are stateful processors: values and maps in the state store, timers in event time. A session is a key of its own, and its processor
takes rows (``transformWithState``), as a data frame for each key costs more than its work; requests of chunks and events are dealt to buckets, and
theirs takes data frames (``transformWithStateInPandas``), as calls to the store for each request cost more than restoring it.
Time is the rows' ``ts`` and the watermark behind the latest of them, so a stream that stands still forgets nothing.
Rows behind the watermark aren't dropped by Spark but come to the processor, which answers them: the column
that carries the watermark is left out below it, and ``ts`` goes on as a plain number.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tables import parts
from ..operators.masking import CONSUMER_DEFAULT, Policy
from ..operators.restore import ByteDemasker, ChunkDemasker, Masker, SseDemasker
from .sessions import RESULT, SESSION_OVERHEAD, TOMBSTONE_SECONDS, Session, requests, step

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Changes that a row brings about, beside its answer; a row without status is a change that time brought about.
METERS = ("new_ids", "evicted", "sessions", "tombstones", "bytes", "pending")
METERED = RESULT + "".join(f", {m} long" for m in METERS)
_ANSWER = Row(*[c.split()[0] for c in METERED.split(", ")])


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need a state store with column families; set for the session unless it has one of its own."""
    if spark.conf.get(_STORE).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_STORE, _ROCKSDB)


def timed(rows: DataFrame, late: str, *columns: str) -> DataFrame:
    """The columns and ``at`` (microseconds of ts) below a watermark that no column carries."""
    return rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).select(*columns, "at")


@dataclass
class Kept:
    """A session, and whether it has been counted as evicted (its tombstone stays)."""

    session: Session
    gone: bool = False

    def bytes(self, key: str) -> int:
        return len(self.session.original.encode()) + len(self.session.masked.encode()) + len(key.encode()) + SESSION_OVERHEAD

    @property
    def due(self) -> float:
        """When time changes it next."""
        return self.session.expires_at + (TOMBSTONE_SECONDS if self.gone else 0.0)


class Ledger:
    """One id's session as time and requests go on, and the changes of the meters since they were last read."""

    def __init__(self, key: str, kept: Kept | None, mask: Callable[[str], str]):
        self.key, self.kept, self._mask = key, kept, mask
        self._changes = dict.fromkeys(METERS, 0)

    def changes(self) -> tuple[int, ...]:
        out = tuple(self._changes.values())
        self._changes = dict.fromkeys(METERS, 0)
        return out

    def count(self, **changes: int) -> None:
        for name, n in changes.items():
            self._changes[name] += n

    def pass_time(self, now: float) -> None:
        """Expired sessions become tombstones, and these go when their time is over."""
        if self.kept and not self.kept.gone and self.kept.session.expires_at <= now:
            self.count(evicted=1, sessions=-1, tombstones=1, bytes=-self.kept.bytes(self.key))
            self.kept.gone = True
        if self.kept and self.kept.gone and self.kept.due <= now:
            self.count(tombstones=-1)
            self.kept = None

    def request(self, now: float, payload: str | None, allowed: bool, late: bool, large: bool = False) -> tuple[int, str | None, str]:
        if not allowed:
            return 403, None, "forbidden"
        if large:
            if not late:
                self.pass_time(now)
            return 413, None, "too_large"
        if not isinstance(payload, str):
            return 422, None, "invalid"
        if late and self.kept is None:
            status = step(None, now, payload, lambda text: text)[1]
            return (413, None, "too_large") if status == 413 else (410, None, "late")
        if not late:
            self.pass_time(now)
        before = self.kept.session if self.kept else None
        session, status, result, outcome = step(before, now, payload, self._mask)
        if session is not None and session is not before and not (self.kept and self.kept.gone):
            weight = self.kept.bytes(self.key) if self.kept else 0
            self.kept = Kept(session)
            self.count(bytes=self.kept.bytes(self.key) - weight, **({} if before else {"sessions": 1, "new_ids": 1}))
        return status, result, outcome


class SessionProcessor(StatefulProcessor):
    """Sessions by id. With ``wait`` rows are kept until the watermark has passed them and taken in order of (ts, seq),
    so answers equal those of the batch form whatever the order of arrival; otherwise they are answered in the micro-batch they come in."""

    def __init__(self, policy: Policy, wait: bool):
        self._policy, self._wait = policy, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # the session (null without one) and the time of its timer (milliseconds; 0: none) are one value, as each call to the store takes its time
        self._session = handle.getValueState("session", "original string, masked string, completed boolean, expires_at double, gone boolean, timer long")
        self._inbox = handle.getMapState("inbox", "at long, seq long, n long", "payload string, allowed boolean, large boolean")

    def _ledger(self, key: str) -> tuple[Ledger, tuple | None]:
        """The id's session, and the state as it is stored."""
        found = self._session.get()
        kept = Kept(Session(*found[:4]), found[4]) if found and found[0] is not None else None
        return Ledger(key, kept, lambda text: Masker(self._policy).mask(text)), tuple(found) if found else None

    def _store(self, ledger: Ledger, waiting: list[tuple], stored: tuple | None, gone_off: bool = False) -> None:
        """Writes the state back if it has changed, and sets the one timer to the next time that changes something."""
        kept, was = ledger.kept, stored[5] if stored and not gone_off else 0
        due = [int(-(-kept.due * 1000 // 1))] if kept else []
        due += [min(waiting)[0] // 1000 + 1] if waiting else []
        at = min(due, default=0)
        if was and was != at:
            self._handle.deleteTimer(was)
        if at and was != at:
            self._handle.registerTimer(at)
        s = kept.session if kept else None
        new = (s.original, s.masked, s.completed, s.expires_at, kept.gone, at) if s else (None, None, None, None, None, at)
        if at and new != stored:
            self._session.update(new)
        elif not at and stored:
            self._session.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        (ledger, stored), out = self._ledger(key[0]), []
        if self._wait:
            waiting = list(self._inbox.keys())
            n = max((k[2] for k in waiting), default=0)
            ready = []
            for _, seq, payload, allowed, large, at in rows:
                n += 1
                if at < now:
                    ready.append((at, seq, n, payload, allowed, large))
                else:
                    self._inbox.updateValue((at, seq, n), (payload, allowed, large))
                    waiting.append((at, seq, n))
                    ledger.count(pending=1)
        else:
            waiting = []
            ready = [(at, seq, n, payload, allowed, large) for n, (_, seq, payload, allowed, large, at) in enumerate(rows)]
        for at, seq, _, payload, allowed, large in sorted(ready, key=lambda r: r[:3]):
            out.append(_ANSWER(key[0], seq, *ledger.request(at / 1e6, payload, allowed, at < now, large), *ledger.changes()))
        self._store(ledger, waiting, stored)
        left = ledger.changes()
        if any(left):
            out.append(_ANSWER(key[0], None, None, None, None, *left))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        (ledger, stored), out = self._ledger(key[0]), []
        waiting = sorted(self._inbox.keys())
        for k in [k for k in waiting if k[0] < now * 1000]:
            payload, allowed, large = self._inbox.getValue(k)
            self._inbox.removeKey(k)
            ledger.count(pending=-1)
            out.append(_ANSWER(key[0], k[1], *ledger.request(k[0] / 1e6, payload, allowed, False, large), *ledger.changes()))
        waiting = [k for k in waiting if k[0] >= now * 1000]
        ledger.pass_time(now / 1e3)
        left = ledger.changes()
        if any(left):
            out.append(_ANSWER(key[0], None, None, None, None, *left))
        self._store(ledger, waiting, stored, gone_off=True)
        yield from out

    def handleInitialState(self, key, initialState, timerValues) -> None:
        ledger, stored = self._ledger(key[0])
        ledger.kept = Kept(Session(initialState.original, initialState.masked, initialState.completed, initialState.expires_at))
        self._store(ledger, [], stored)

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, policy: Policy = CONSUMER_DEFAULT, late: str = "1 minute", wait: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """``process_stream`` with the meters and the rows that only carry meters (their status is null)."""
    use_rocksdb(events.sparkSession)
    rows = requests(events).where("payload_id is not null and ts is not null")
    groups = timed(rows, late, "payload_id", "seq", "payload", "allowed", "large").groupBy("payload_id")
    known = initial.select("payload_id", "original", "masked", "completed", "expires_at").groupBy("payload_id") if initial is not None else None
    return groups.transformWithState(SessionProcessor(policy, wait), METERED, "append", "eventTime", known)


def process_stream(events: DataFrame, policy: Policy = CONSUMER_DEFAULT, late: str = "1 minute", wait: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """``process_batch`` as a streaming query: answers (RESULT) to requests (seq, ts, payload_id, payload[, allowed]).

    A session's state goes when the watermark (``late`` behind the latest row) has passed the end of its tombstone. A row
    behind the watermark whose id has no session is 410 "late", as its session may have been there and gone; it never opens
    one. ``allowed`` false is 403. Without ``wait`` a key's rows of a micro-batch are put in order and answered at once;
    with it they are answered when the watermark has passed them, in order over all micro-batches. ``initial``: sessions
    (payload_id, original, masked, completed, expires_at) that are open when the stream begins, as ``sessions.open_sessions``
    gives them. Rows without id or ts are left out.
    """
    out = answer_stream(events, policy, late, wait, initial)
    return out.where("status is not null").drop(*METERS)


class _Chunks:
    """A stream of text chunks."""

    def __init__(self, mapping: dict[str, str], held: str = "", last: str | None = None):
        self._d = ChunkDemasker(mapping, held)

    def feed(self, body: str, is_last: bool) -> tuple[list[str], bool]:
        return [self._d.feed(body) + (self._d.flush() if is_last else "")], is_last

    def finish(self) -> list[str]:
        left = self._d.flush()
        return [left] if left else []

    held = property(lambda self: self._d.held)
    last = None


class _Events:
    """A stream of server-sent events, by lines."""

    def __init__(self, mapping: dict[str, str], held: str = "", last: str | None = None):
        self._d = SseDemasker(mapping, held, last)

    def feed(self, body: str, is_last: bool) -> tuple[list[str], bool]:
        return self._d.feed(body), body.startswith("data:") and body[5:].strip() == "[DONE]"

    def finish(self) -> list[str]:
        return self._d.finish()

    held = property(lambda self: self._d.held)
    last = property(lambda self: self._d.last)


class _Bytes:
    """A stream of chunks of bytes (in base 64, as state is kept as strings)."""

    def __init__(self, mapping: dict[str, str], held: str = "", last: str | None = None):
        self._d = ByteDemasker(mapping, held, base64.b64decode(last or ""))

    def feed(self, body: str, is_last: bool) -> tuple[list[str], bool]:
        return [self._d.feed(base64.b64decode(body)) + (self._d.flush() if is_last else "")], is_last

    def finish(self) -> list[str]:
        left = self._d.flush()
        return [left] if left else []

    held = property(lambda self: self._d.held)
    last = property(lambda self: base64.b64encode(self._d.cut).decode())


_KINDS = {"chunks": _Chunks, "events": _Events, "bytes": _Bytes}
#: Groups that requests are dealt to; each is a key of the state store. It must stay the same as long as a checkpoint is used.
BUCKETS = 4096
#: Early rows of a bucket that are held in memory within a micro-batch.
_EARLY = 1000
#: Rows that are given out at a time.
_OUT = 1000
RESTORED = "request_id string, seq long, part int, text string, state string"
_NAMES = [c.split()[0] for c in RESTORED.split(", ")]


@dataclass
class Head:
    """How far a request has come: the next number, what is held back, the mapping, the time of the latest row (microseconds), and the numbers of the rows that wait."""

    next: int = 0
    done: bool = False
    held: str = ""
    last: str | None = None
    mapping: str | None = None
    latest: int = 0
    waiting: set[int] = field(default_factory=set)

    def packed(self) -> list:
        """As it is stored: the latest time first, and of a request that has ended nothing else."""
        return [self.latest] if self.done else [self.latest, self.next, self.held, self.last, self.mapping, sorted(self.waiting)]

    @classmethod
    def unpacked(cls, kept: list) -> Head:
        latest, *more = kept
        return cls(more[0], False, *more[1:4], latest, set(more[4])) if more else cls(done=True, latest=latest)


def _pairs(mapping: str | None) -> dict[str, str]:
    return {e["placeholder"]: e["value"] for e in json.loads(mapping)} if mapping else {}


class Order:
    """Takes a request's rows in order of their numbers; what comes out is (number, part, text, state)."""

    def __init__(self, kind: str, head: Head):
        self._kind, self.head = _KINDS[kind], head
        self._restorer = self._kind(_pairs(head.mapping), head.held, head.last)

    def take(self, body: str | None, is_last: bool, mapping: str | None) -> Iterator[tuple]:
        """The row with the next number. A mapping counts from its row on."""
        h = self.head
        if mapping and _pairs(mapping):
            h.mapping = mapping
            self._restorer = self._kind(_pairs(mapping), self._restorer.held, self._restorer.last)
        texts, h.done = self._restorer.feed(body or "", bool(is_last))
        for part, text in enumerate(texts):
            yield h.next, part, text, "ok"
        h.next += 1
        h.held, h.last = self._restorer.held, self._restorer.last

    def finish(self) -> Iterator[tuple]:
        """What is held back when nothing more can come."""
        if not self.head.done:
            for part, text in enumerate(self._restorer.finish()):
                yield self.head.next, part, text, "held"


class Beyond:
    """Rows, in order, that a missing one separates from the beginning of their request: those of a stretch without gaps are restored together."""

    def __init__(self, kind: str, mapping: str | None, state: str):
        self._kind, self._mapping, self._state, self._run = kind, mapping, state, None

    def take(self, seq: int, body: str | None, is_last: bool, mapping: str | None) -> Iterator[tuple]:
        if self._run is not None and seq != self._run.head.next:
            yield from self.left()
        if self._run is None:
            self._run = Order(self._kind, Head(next=seq, mapping=self._mapping))
        yield from ((*r[:3], self._state) for r in self._run.take(body, is_last, mapping))
        self._mapping = self._run.head.mapping

    def left(self) -> Iterator[tuple]:
        run, self._run = self._run, None
        if run is not None:
            yield from ((*r[:3], self._state) for r in run.finish())

    def all(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        for r in rows:
            yield from self.take(*r)
        yield from self.left()


def _frame(key: str, out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key, *r) for r in out], columns=_NAMES)


def _frames(out: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    return (pd.DataFrame(some, columns=_NAMES) for some in batched(out, _OUT))


class Open:
    """A request that has rows in a micro-batch: those that are early wait in ``fresh`` until the micro-batch ends or there are too many."""

    def __init__(self, kind: str, kept: list | None):
        self.known, self.head = kept is not None, Head.unpacked(kept) if kept else Head()
        self.order = Order(kind, self.head) if not self.head.done else None
        self.fresh: dict[int, tuple] = {}
        self.late: list[tuple] = []
        self.on_time = self.known


class OrderProcessor(StatefulProcessor):
    """Restores the rows of a bucket of requests, each request's in order of their numbers, in whatever order they come; those that are early wait in a map state.

    The heads of a bucket's requests are one value (JSON) and have one timer, as each call to the store takes its time. It is read and written
    by the micro-batches in which the bucket has rows or a request of it ends. Requests that have ended are a number in it until they are forgotten.
    """

    def __init__(self, kind: str, idle: float):
        self._kind, self._idle = kind, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._heads = handle.getValueState("heads", "timer long, heads string")
        self._waiting = handle.getMapState("waiting", "request_id string, seq long", "body string, is_last boolean, mapping string")

    def _load(self) -> tuple[dict[str, list], int]:
        """The packed heads by request, and the time of the timer (milliseconds; 0: none)."""
        found = self._heads.get()
        return (json.loads(found[1]), found[0]) if found else ({}, 0)

    def _due(self, kept: list) -> int:
        """When a request ends if nothing more comes (milliseconds)."""
        return kept[0] // 1000 + self._idle

    def _store(self, heads: dict[str, list], timer: int) -> None:
        """Writes the heads; the timer is set to the first that is due, or stays where it is if that is earlier."""
        if not heads:
            self._heads.clear()
            return
        first = min(map(self._due, heads.values()))
        if timer and first < timer:
            self._handle.deleteTimer(timer)
        if not timer or first < timer:
            self._handle.registerTimer(first)
            timer = first
        self._heads.update((timer, json.dumps(heads, ensure_ascii=False, separators=(",", ":"))))

    def _keep(self, who: str, request: Open) -> int:
        """Early rows go to the store; how many."""
        n = len(request.fresh)
        for seq, row in request.fresh.items():
            self._waiting.updateValue((who, seq), row)
        request.head.waiting.update(request.fresh)
        request.fresh.clear()
        return n

    def _taken(self, who: str, seq: int) -> tuple:
        row = self._waiting.getValue((who, seq))
        self._waiting.removeKey((who, seq))
        return row

    def _restored(self, frames: Iterator[pd.DataFrame], now: int) -> Iterator[tuple]:
        heads, timer = self._load()
        here: dict[str, Open] = {}
        early = 0
        for pdf in frames:
            for who, seq, body, is_last, mapping, at in zip(pdf["request_id"], pdf["seq"], pdf["body"], pdf["is_last"], pdf["mapping"], pdf["at"]):
                r = here.get(who)
                if r is None:
                    r = here[who] = Open(self._kind, heads.get(who))
                h, seq, at = r.head, int(seq), int(at)
                row = (body if isinstance(body, str) else None, bool(is_last), mapping if isinstance(mapping, str) else None)
                if not r.known and at < now * 1000:
                    r.late.append((seq, *row))
                    continue
                r.on_time, h.latest = True, max(h.latest, at)
                if h.done or seq < h.next or seq in h.waiting or seq in r.fresh:
                    continue  # a repeated row
                if seq > h.next:
                    r.fresh[seq] = row
                    early += 1
                    if early > _EARLY:
                        early -= sum(self._keep(w, x) for w, x in here.items() if x.fresh)
                    continue
                yield from ((who, *x) for x in r.order.take(*row))
                while not h.done and (h.next in r.fresh or h.next in h.waiting):
                    if h.next in r.fresh:
                        row = r.fresh.pop(h.next)
                        early -= 1
                    else:
                        row = self._taken(who, h.next)
                        h.waiting.discard(h.next)
                    yield from ((who, *x) for x in r.order.take(*row))
                if h.done:
                    early -= len(r.fresh)
                    r.fresh.clear()
                    r.order = None
        for who, r in here.items():
            if r.late:
                yield from ((who, *x) for x in Beyond(self._kind, r.head.mapping, "late").all(sorted(r.late, key=lambda x: x[0])))
            if not r.on_time:
                continue
            self._keep(who, r)
            if r.head.done:
                for seq in r.head.waiting:
                    self._waiting.removeKey((who, seq))
            heads[who] = r.head.packed()
        if any(r.on_time for r in here.values()):
            self._store(heads, timer)

    def _ended(self, now: int) -> Iterator[tuple]:
        heads = self._load()[0]
        for who in [w for w, kept in heads.items() if self._due(kept) <= now]:
            head = Head.unpacked(heads.pop(who))
            if head.done:
                continue
            yield from ((who, *x) for x in Order(self._kind, head).finish())
            left = ((seq, *self._taken(who, seq)) for seq in sorted(head.waiting))
            yield from ((who, *x) for x in Beyond(self._kind, head.mapping, "beyond").all(left))
        self._store(heads, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self._restored(rows, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from _frames(self._ended(timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def _bodies(rows: DataFrame, kind: str, *more: str) -> DataFrame:
    """request_id, seq, body, is_last, mapping (JSON)."""
    body = F.col("line") if kind == "events" else F.base64("chunk") if kind == "bytes" else F.col("chunk")
    is_last = F.lit(False) if kind == "events" else F.coalesce("is_last", F.lit(False))
    return rows.select("request_id", F.col("seq").cast("long").alias("seq"), body.alias("body"), is_last.alias("is_last"), F.to_json("mapping").alias("mapping"), *more)


def restore_stream(rows: DataFrame, kind: str = "chunks", late: str = "1 minute", idle: str = "5 minutes") -> DataFrame:
    """Restored chunks (request_id, seq from 0, ts, chunk, is_last, mapping), of text or (kind ``bytes``) of bytes that may be cut within
    a character, or lines of event streams (kind ``events``; line for chunk and is_last) as RESTORED: ``state`` is ok; held (what was held back at the end of a request that never ended);
    beyond (rows behind a missing one); or late (rows behind the watermark of a request that isn't known any more).

    A request ends ``idle`` of event time after its latest row; until then rows wait for the missing ones, and its number of
    repeated rows doesn't matter. No row is lost: what can't be put in its place comes out as beyond or late. Rows without
    request_id, seq or ts are left out. Equals ``restore_batch`` for rows that aren't late.

    State is by bucket of requests (BUCKETS): a bucket's heads are read and written together, by the micro-batches that concern one of them.
    """
    use_rocksdb(rows.sparkSession)
    known = _bodies(rows, kind, "ts").where("request_id is not null and seq is not null and ts is not null")
    rows = timed(known, late, "request_id", "seq", "body", "is_last", "mapping")
    groups = rows.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS))).groupBy("bucket")
    return groups.transformWithStateInPandas(OrderProcessor(kind, pd.Timedelta(idle).total_seconds()), RESTORED, "append", "eventTime")


def restore_batch(rows: DataFrame, kind: str = "chunks") -> DataFrame:
    """The batch form of ``restore_stream``; a task goes through its sorted rows once and holds what a request holds back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, order, gap, seen = None, None, None, None

        def ended() -> list[tuple]:
            return [] if order is None else [*order.finish(), *(gap.left() if gap else [])]

        for pdf in batches:
            out = []
            for who, seq, body, is_last, mapping in zip(pdf["request_id"], pdf["seq"], pdf["body"], pdf["is_last"], pdf["mapping"]):
                if who != key or order is None:
                    out += [(key, *r) for r in ended()]
                    key, order, gap, seen = who, Order(kind, Head()), None, None
                if seq == seen or order.head.done:
                    continue
                seen = seq
                if seq == order.head.next:
                    out += [(key, *r) for r in order.take(body, is_last, mapping)]
                elif seq > order.head.next:
                    gap = gap or Beyond(kind, order.head.mapping, "beyond")
                    out += [(key, *r) for r in gap.take(seq, body, is_last, mapping)]
            yield pd.DataFrame(out, columns=["request_id", "seq", "part", "text", "state"])
        yield _frame(key, ended())

    known = _bodies(rows, kind).where("request_id is not null and seq is not null")
    return known.repartition(parts(rows.sparkSession), "request_id").sortWithinPartitions("request_id", "seq").mapInPandas(run, RESTORED)

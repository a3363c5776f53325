"""Mask-and-restore sessions keyed by payload id, with expiry, in batch; ``keyed`` has the streams.

A first payload is masked and opens an ACTIVE session. The same payload again gives the same mask; the
mask gives the original and completes the session; anything else is a conflict. Sessions expire;
then the id is gone for a while (a tombstone), and after that it is new again.

Rows of a key are taken in order of time and ``seq`` by one state machine, so no request of a key
has to wait for another one. Each key's state is bounded by the admission limits. Limits on the sessions, bytes and
tombstones of a service (``Limits``) hold for a shard of the ids: a shard is a service of its own, and its rows are
taken one after the other; one shard is the whole service.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.masking import CONSUMER_DEFAULT, Policy
from ..functions.tables import parts
from ..operators.restore import ChunkDemasker, Masker, SseDemasker

ACTIVE_SECONDS, COMPLETED_SECONDS, TOMBSTONE_SECONDS = 900.0, 120.0, 60.0
MAX_BYTES, MAX_TOKENS = 400_000, 100_000
SESSION_OVERHEAD = 512
RESULT = "payload_id string, seq long, status int, result string, outcome string"
SESSION = "payload_id string, original string, masked string, completed boolean, expires_at double"
_SESSION_COLUMNS = [c.split()[0] for c in SESSION.split(", ")]


def tokens(text: Column) -> Column:
    """An estimate: none for an empty text, else a quarter of its characters rounded up, one at least."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4))).cast("int")


def admission(text: Column) -> Column:
    """413 for a payload that is too large in bytes or tokens, else 200."""
    return F.when((F.octet_length(text) > MAX_BYTES) | (tokens(text) > MAX_TOKENS), 413).otherwise(200)


def fingerprint(text: Column) -> Column:
    return F.struct(F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("bytes"))


def session_bytes(original: Column, masked: Column, payload_id: Column) -> Column:
    return F.octet_length(original) + F.octet_length(masked) + F.octet_length(payload_id) + SESSION_OVERHEAD


@dataclass
class Session:
    original: str
    masked: str
    completed: bool
    expires_at: float


def step(session: Session | None, now: float, payload: str, mask: Callable[[str], str]) -> tuple[Session | None, int, str | None, str]:
    """One request: the session after it, status, result and outcome.

    An expired session is a tombstone for TOMBSTONE_SECONDS from its expiry. Equality with the
    original is tested first, so a text without findings is never completed.
    """
    if len(payload.encode()) > MAX_BYTES or (len(payload) + 3) // 4 > MAX_TOKENS:
        return session, 413, None, "too_large"
    if session and session.expires_at <= now:
        if now < session.expires_at + TOMBSTONE_SECONDS:
            return session, 410, None, "expired"
        session = None
    if session is None:
        try:
            masked = mask(payload)
        except Exception:  # a failed request leaves no session behind
            return None, 500, None, "error"
        session = Session(payload, masked, False, now + ACTIVE_SECONDS)
        return session, 200, session.masked, "mask"
    if payload == session.original:
        return session, 200, session.masked, "retry"
    if payload == session.masked:
        if not session.completed:
            session = Session(session.original, session.masked, True, now + COMPLETED_SECONDS)
            return session, 200, session.original, "demask"
        return session, 200, session.original, "retry"
    return session, 409, None, "conflict"


@dataclass(frozen=True)
class Limits:
    """What a shard holds at most: sessions, their bytes, and tombstones; and how many shards there are."""

    entries: int = 100_000
    bytes: int = 512 << 20
    tombstones: int = 50_000
    shards: int = 1


@dataclass
class Store:
    """The sessions and tombstones of a shard, in order of their expiry."""

    limits: Limits
    live: dict[str, Session] = field(default_factory=dict)
    dead: dict[str, float] = field(default_factory=dict)  #: until when an id is gone
    size: int = 0
    _due: list[tuple[float, str]] = field(default_factory=list)
    _gone: list[tuple[float, str]] = field(default_factory=list)

    @staticmethod
    def weight(key: str, session: Session) -> int:
        return len(session.original.encode()) + len(session.masked.encode()) + len(key.encode()) + SESSION_OVERHEAD

    def _bury(self, key: str, now: float) -> None:
        session = self.live.pop(key)
        self.size -= self.weight(key, session)
        until = session.expires_at + TOMBSTONE_SECONDS
        if now < until:
            self.dead[key] = until
            heapq.heappush(self._gone, (until, key))

    def evict(self, now: float) -> None:
        """Sessions that have expired become tombstones, and tombstones whose time is over go; a completed session's old due time is skipped."""
        while self._due and self._due[0][0] <= now:
            _, key = heapq.heappop(self._due)
            if key in self.live and self.live[key].expires_at <= now:
                self._bury(key, now)
        while self._gone and self._gone[0][0] <= now:
            until, key = heapq.heappop(self._gone)
            if self.dead.get(key) == until:
                del self.dead[key]

    def clear(self) -> None:
        self.live.clear(), self.dead.clear(), self._due.clear(), self._gone.clear()
        self.size = 0

    def request(self, key: str, now: float, payload: str, mask: Callable[[str], str]) -> tuple[int, str | None, str]:
        """One request: status, result and outcome. A live session answers first; then a tombstone; a new session needs room."""
        self.evict(now)
        if self.dead.get(key, now) > now:
            large = step(None, now, payload, lambda text: text)[1] == 413
            return (413, None, "too_large") if large else (410, None, "expired")
        before = self.live.get(key)
        if before is None:
            full = len(self.live) >= self.limits.entries or len(self.dead) >= self.limits.tombstones
            # as much as a payload that masking doesn't lengthen
            if full or self.size + self.weight(key, Session(payload, payload, False, now)) > self.limits.bytes:
                large = step(None, now, payload, lambda text: text)[1] == 413
                return (413, None, "too_large") if large else (429, None, "full")
        session, status, result, outcome = step(before, now, payload, mask)
        if session is not None and session is not before:
            self.live[key] = session
            self.size += self.weight(key, session) - (self.weight(key, before) if before else 0)
            heapq.heappush(self._due, (session.expires_at, key))
        return status, result, outcome


def _masker(policy: Policy) -> Callable[[str], str]:
    return lambda text: Masker(policy).mask(text)


_COLUMNS = ["payload_id", "seq", "status", "result", "outcome"]


def requests(events: DataFrame) -> DataFrame:
    """seq, ts, payload_id, payload, allowed, large: a payload that is too large is 413 whatever its session, so it isn't sent on."""
    allowed = F.coalesce(F.col("allowed"), F.lit(False)) if "allowed" in events.columns else F.lit(True)
    large = F.coalesce(admission(F.col("payload")) == 413, F.lit(False))
    return events.select(F.col("seq").cast("long").alias("seq"), "ts", "payload_id", F.when(~large, F.col("payload")).alias("payload"), allowed.alias("allowed"), large.alias("large"))


def process_batch(events: DataFrame, policy: Policy = CONSUMER_DEFAULT, limits: Limits | None = None) -> DataFrame:
    """Answers to a list of requests (seq, ts, payload_id, payload), as if they had come one by one. Null ids or payloads are 422.

    With a column ``allowed`` (see ``policy.check_access``), requests for which it isn't true are 403 and change nothing.

    Without limits rows are dealt by id and sorted; a task goes through them once and holds one session, however many
    requests an id has. With limits they are dealt by shard, and a task holds a shard's sessions, which the limits bound;
    a request that there is no room for is 429.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, key, session = _masker(policy), None, None
        for rows in batches:
            out = []
            for seq, ts, who, payload, ok, large in zip(rows["seq"], rows["ts"], rows["payload_id"], rows["payload"], rows["allowed"], rows["large"]):
                if who != key:
                    key, session = who, None
                if not ok:
                    out.append((who, seq, 403, None, "forbidden"))
                    continue
                if not isinstance(who, str) or not (large or isinstance(payload, str)):
                    out.append((who, seq, 422, None, "invalid"))
                    continue
                if large:
                    out.append((who, seq, 413, None, "too_large"))
                    continue
                session, status, result, outcome = step(session, ts.timestamp(), payload, mask)
                out.append((who, seq, status, result, outcome))
            yield pd.DataFrame(out, columns=_COLUMNS)

    def run_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, shard, store = _masker(policy), None, Store(limits)
        for rows in batches:
            out = []
            for of, seq, ts, who, payload, ok, large in zip(rows["shard"], rows["seq"], rows["ts"], rows["payload_id"], rows["payload"], rows["allowed"], rows["large"]):
                if of != shard:
                    shard, store = of, Store(limits)
                if not ok:
                    out.append((who, seq, 403, None, "forbidden"))
                    continue
                if not isinstance(who, str) or not (large or isinstance(payload, str)):
                    out.append((who, seq, 422, None, "invalid"))
                    continue
                if large:
                    store.evict(ts.timestamp())
                    out.append((who, seq, 413, None, "too_large"))
                    continue
                out.append((who, seq, *store.request(who, ts.timestamp(), payload, mask)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    rows = requests(events)
    if limits is None:
        return rows.repartition(parts(rows.sparkSession), "payload_id").sortWithinPartitions("payload_id", "ts", "seq").mapInPandas(run, RESULT)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("payload_id"), F.lit(limits.shards)))
    return rows.repartition("shard").sortWithinPartitions("shard", "ts", "seq").mapInPandas(run_shards, RESULT)


def open_sessions(events: DataFrame, policy: Policy = CONSUMER_DEFAULT) -> DataFrame:
    """The sessions (payload_id, original, masked, completed, expires_at) as a list of requests leaves them: what a stream can begin with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, key, session, out = _masker(policy), None, None, []

        def kept() -> list[tuple]:
            return [(key, session.original, session.masked, session.completed, session.expires_at)] if session else []

        for rows in batches:
            out = []
            for ts, who, payload, ok in zip(rows["ts"], rows["payload_id"], rows["payload"], rows["allowed"]):
                if who != key:
                    out += kept()
                    key, session = who, None
                if ok and isinstance(payload, str):
                    session = step(session, ts.timestamp(), payload, mask)[0]
            yield pd.DataFrame(out, columns=_SESSION_COLUMNS)
        yield pd.DataFrame(kept(), columns=_SESSION_COLUMNS)

    rows = requests(events).where("payload_id is not null")
    return rows.repartition(parts(rows.sparkSession), "payload_id").sortWithinPartitions("payload_id", "ts", "seq").mapInPandas(run, SESSION)


CHUNK_RESULT = "request_id string, seq long, text string"


def demask_batch(chunks: DataFrame) -> DataFrame:
    """Restored chunks of (request_id, seq from 0, chunk, is_last, mapping); what follows a missing chunk stays out.

    The mapping can be on any chunk up to the first placeholder, and null on the others. A task goes through
    its sorted chunks once and holds what one request holds back.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, following, d = None, 0, None
        for rows in batches:
            out = []
            for who, seq, chunk, last, pairs in zip(rows["request_id"], rows["seq"], rows["chunk"], rows["is_last"], rows["mapping"]):
                if who != key or d is None:
                    key, following, d = who, 0, ChunkDemasker({})
                if seq != following:
                    continue
                if pairs is not None and len(pairs):
                    d = ChunkDemasker({e["placeholder"]: e["value"] for e in pairs}, d.held)
                out.append((who, seq, d.feed(chunk or "") + (d.flush() if last else "")))
                following = -1 if last else seq + 1
            yield pd.DataFrame(out, columns=["request_id", "seq", "text"])

    rows = chunks.select("request_id", "seq", "chunk", "is_last", "mapping")
    return rows.repartition(parts(rows.sparkSession), "request_id").sortWithinPartitions("request_id", "seq").mapInPandas(run, CHUNK_RESULT)


SSE_RESULT = "request_id string, seq long, part int, line string"


def demask_sse_batch(lines: DataFrame) -> DataFrame:
    """Restored lines of event streams (request_id, seq from 0, line, mapping on the first line); a line can give none or several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, following, d = None, 0, None
        for rows in batches:
            out = []
            for who, seq, line, pairs in zip(rows["request_id"], rows["seq"], rows["line"], rows["mapping"]):
                if who != key or d is None:
                    key, following, d = who, 0, SseDemasker({e["placeholder"]: e["value"] for e in (pairs if pairs is not None else [])})
                if seq != following:
                    continue
                out += [(who, seq, i, x) for i, x in enumerate(d.feed(line or ""))]
                following += 1
            yield pd.DataFrame(out, columns=["request_id", "seq", "part", "line"])

    rows = lines.select("request_id", "seq", "line", "mapping")
    return rows.repartition(parts(rows.sparkSession), "request_id").sortWithinPartitions("request_id", "seq").mapInPandas(run, SSE_RESULT)


def echo_chunks(replies: DataFrame, size: int = 7, text: str = "masked") -> DataFrame:
    """Replies of a back end that echoes, cut to chunks of ``size`` characters, for tests of the way back."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    out = replies.select("request_id", "mapping", F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"), n.alias("_n"))
    return out.select("request_id", F.col("seq").cast("long").alias("seq"), F.expr(f"substring(_t, seq * {size} + 1, {size})").alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("is_last"), F.when(F.col("seq") == 0, F.col("mapping")).alias("mapping"))


def echo_bytes(replies: DataFrame, size: int = 7, text: str = "masked") -> DataFrame:
    """``echo_chunks`` cut to ``size`` bytes, wherever that is in a character."""
    data = F.col(text).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / size).cast("int"))
    out = replies.select("request_id", "mapping", data.alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"), n.alias("_n"))
    return out.select("request_id", F.col("seq").cast("long").alias("seq"), F.expr(f"substring(_t, seq * {size} + 1, {size})").alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("is_last"), F.when(F.col("seq") == 0, F.col("mapping")).alias("mapping"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """The service's counters, as rows (name, value)."""
    return results.groupBy(F.concat(F.lit("requests_"), "outcome").alias("name")).agg(F.count("*").alias("value"))

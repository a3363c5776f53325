"""Exact repeats of W consecutive units (words or bytes) over a whole corpus.

Two rounds of the same step, ``_round``. A round hashes chosen places of each document, deals the
hashes out to buckets, sorts one bucket at a time, and returns for each document the places whose
hash also occurs at another place.

* Round 1 looks at short anchors and finds the few windows that can be repeats. For bytes it
  also looks at chunks: a document is cut where its content says so (a cut depends on the 16
  bytes after it), and if the text under all windows of a chunk occurs elsewhere too, all of
  these windows repeat. All but the first of equal chunks need no second round.
* Round 2 looks at all windows that are left, and nothing else.

What travels is packed: for each (bucket, batch of documents) one row with the hashes and
positions as byte planes, which compress well. A hash that occurs several times in a batch
travels once, so no bucket gets more rows of one hash than there are batches; a passage in a
third of all documents does not gather in one task.

Hashes of chunks and windows have 64 bits, and the bucket comes from a second hash, so two
different ones count as equal with a chance of about 2**-(64 + log2 buckets) a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, buckets_for, maybe_broadcast, written
from ._text import byte_table, expand, mask_runs, merge, mix, slices, span_hash, stretch_hash, string_bytes, tidied, window_hash, words

#: Bytes of text in a batch of a round: each batch sends a row to each bucket, so small batches make many rows.
BATCH_BYTES = 4 << 20
#: Input bytes for each bucket of a round.
BUCKET_BYTES = 4 << 20
#: Range tables up to this size are broadcast to the scans of the documents.
RANGE_BYTES = 48 << 20
_FLAG = np.uint64(1 << 39)
_SECOND = 0xD1342543DE82EF95
# kinds of rows: hashes of windows or anchors, a batch's book, hashes of chunks, chunks that repeat within a batch
_PLACE, _BOOK, _CHUNK, _OWN = 0, 1, 2, 3
_FOLLOWS = np.uint64(1 << 47)
_MAX_CHUNK = 4096
_SENT = "bucket int, batch long, kind int, h binary, p binary"
_BACK = "batch long, kind int, p binary"
FOUND = "doc_id long, thash long, ask binary, sure binary"


@dataclass(frozen=True)
class Spec:
    """What is looked for."""

    unit: str  #: "word" or "byte"
    window: int  #: units of a repeat
    anchor: int  #: units of an anchor
    period: int  #: anchors are dealt by position modulo this
    cover: tuple[int, ...] = ()  #: residues that are hashed in round 1; none: all positions, of which residue 0 is the index
    chunk: int = 0  #: mean units of a chunk, a power of two; 0: no chunks

    @property
    def reach(self) -> int:
        return self.window - self.anchor


def units(spec: Spec, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit hashes, the first unit of each row, starts and ends of units in bytes (empty for bytes)."""
    if spec.unit == "byte":
        return byte_table(7)[data], offsets, data[:0], data[:0]
    starts, ends, first = words(data, offsets)
    return span_hash(data, starts, ends), first, starts, ends


def _planes(x: np.ndarray, size: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(x: bytes, size: int) -> np.ndarray:
    n = len(x) // size
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(x, np.uint8).reshape(size, n).T
    return out.view("<u8").ravel()


def _anchors(spec: Spec, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of round 1 and which of them are in the index."""
    room = np.maximum(length - spec.anchor + 1, 0)
    room[length < spec.window] = 0
    at = expand(first[:-1], first[:-1] + room)
    local = at - np.repeat(first[:-1], room)
    if not spec.cover:
        return at, local % spec.period == 0
    chosen = np.zeros(spec.period, bool)
    chosen[list(spec.cover)] = True
    at = at[chosen[local % spec.period]]
    return at, np.ones(len(at), bool)


def _chunks(spec: Spec, unit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (in windows) of the chunks of all rows."""
    room = np.maximum(np.diff(first) - spec.window + 1, 0)
    begin, end = first[:-1][room > 0], (first[:-1] + room)[room > 0]
    if not len(begin):
        return begin, begin
    cut = np.flatnonzero((window_hash(unit, 16) & np.uint64(spec.chunk - 1)) == 0)
    row = np.searchsorted(begin, cut, "right") - 1
    cut = cut[(row >= 0) & (cut < end[row])]
    start = np.union1d(begin, cut)
    stop = np.minimum(np.append(start[1:], end[-1]), end[np.searchsorted(begin, start, "right") - 1])
    parts = -(-(stop - start) // _MAX_CHUNK)
    more = expand(np.zeros_like(parts), parts) * _MAX_CHUNK + np.repeat(start, parts)
    return more, np.minimum(np.repeat(stop, parts) - more, _MAX_CHUNK)


class _Parcel:
    """Rows of one batch for all buckets."""

    def __init__(self, batch: int, buckets: int):
        self.batch, self.buckets, self.rows = batch, buckets, []

    def add(self, kind: int, own: np.ndarray, deal: np.ndarray, index: np.ndarray | None, place: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
        """Deals one of each hash, the first in order of place; gives the places whose hash occurs again, all but the first with _FOLLOWS."""
        bucket = (deal >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.lexsort((own, bucket)) if sizes[0] == 8 else np.argsort(own | (bucket << np.uint64(40)), kind="stable")
        key, where = own[order], bucket[order]
        if not len(key):
            return place[:0]
        new = np.append(True, (key[1:] != key[:-1]) | (where[1:] != where[:-1]))
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(key)))
        own_places = place[order].astype(np.uint64) | np.where(new, np.uint64(0), _FOLLOWS)
        again = own_places[np.repeat(count > 1, count)]
        key, where = key[begin], where[begin]
        if index is not None:
            key = key | np.where(np.logical_or.reduceat(index[order], begin), _FLAG, np.uint64(0))
        rep = place[order[begin]]
        back = np.lexsort((rep, where))
        key, rep, where = key[back], rep[back], where[back]
        edge = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        for a, b in zip(edge, np.append(edge[1:], len(where))):
            self.rows.append((int(where[a]), kind, _planes(key[a:b], sizes[0]), _planes(rep[a:b], sizes[1])))
        return again

    def table(self) -> pa.RecordBatch:
        bucket, kind, h, p = zip(*self.rows)
        n = len(bucket)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array([self.batch] * n, pa.int64()), pa.array(kind, pa.int32()), pa.array(h, pa.binary()), pa.array(p, pa.binary())],
            ["bucket", "batch", "kind", "h", "p"],
        )


def _groups(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = key[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return begin, np.diff(np.append(begin, len(k)))


def _round(docs: DataFrame, spec: Spec, second: bool, buckets: int) -> DataFrame:
    size = 8 if second else 5

    @tidied
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for whole in batches:
            for part in slices(whole, limit=BATCH_BYTES):
                data, offsets = string_bytes(part.column(2))
                unit, first, _, _ = units(spec, data, offsets)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                thash = part.column(1).to_numpy(zero_copy_only=False)
                book = np.concatenate(([len(ids)], ids, null, thash, first)).astype("<i8").tobytes()
                batch = xxhash.xxh64_intdigest(book + f"{task}/{turn}".encode()) >> 1
                turn += 1
                parcel = _Parcel(batch, buckets)
                if second:
                    spans = [_ranges(x) for x in part.column(3).to_pylist()]
                    at = np.concatenate([expand(*r) + f for r, f in zip(spans, first[:-1])])
                    own, deal = window_hash(unit, spec.window, at), window_hash(unit, spec.window, at, base=_SECOND)
                    again = parcel.add(_PLACE, own, deal, None, at, (8, 4))
                else:
                    at, index = _anchors(spec, np.diff(first), first)
                    own = window_hash(unit, spec.anchor, at)
                    again = parcel.add(_PLACE, own & (_FLAG - np.uint64(1)), mix(own), index, at, (5, 4))
                parcel.rows.append((batch % buckets, _BOOK, book, _planes(again, 4)))
                if spec.chunk and not second:
                    start, n = _chunks(spec, unit, first)
                    own = stretch_hash(unit, start, n + spec.window - 1, _MAX_CHUNK + spec.window)
                    deal = stretch_hash(unit, start, n + spec.window - 1, _MAX_CHUNK + spec.window, base=_SECOND)
                    again = parcel.add(_CHUNK, own, deal, None, start.astype(np.uint64) | (n.astype(np.uint64) << np.uint64(32)), (8, 6))
                    parcel.rows.append((batch % buckets, _OWN, b"", _planes(again, 6)))
                yield parcel.table()

    def sort(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        h, p, batch = table["h"].to_pylist(), table["p"].to_pylist(), table["batch"].to_numpy()
        out = [(int(batch[i]), k, x) for i in np.flatnonzero(kind == _BOOK) for k, x in ((_BOOK, h[i]), (_PLACE, p[i]))]
        out += [(int(batch[i]), _CHUNK, p[i]) for i in np.flatnonzero(kind == _OWN)]
        rows = np.flatnonzero(kind == _PLACE)
        if len(rows):
            keys = [_from_planes(h[i], size) for i in rows]
            end = np.cumsum([len(x) for x in keys])
            key = np.concatenate(keys)
            index = np.ones(len(key), bool) if second else (key & _FLAG) != 0
            if not second:
                key &= ~_FLAG
            order = np.argsort(key)
            begin, count = _groups(key, order)
            good = (count > 1) & np.logical_or.reduceat(index[order], begin)
            hit = np.zeros(len(key), bool)
            hit[order[np.repeat(good, count)]] = True
            for i, a, b in zip(rows, np.append(0, end[:-1]), end):
                if hit[a:b].any():
                    out.append((int(batch[i]), _PLACE, _planes(_from_planes(p[i], 4)[hit[a:b]], 4)))
        rows = np.flatnonzero(kind == _CHUNK)
        if len(rows):
            keys, places = [_from_planes(h[i], 8) for i in rows], [_from_planes(p[i], 6) for i in rows]
            n = np.array([len(x) for x in keys])
            key, place = np.concatenate(keys), np.concatenate(places)
            # the first by (batch, position) leads, the others follow
            order = np.lexsort((place & np.uint64(0xFFFFFFFF), np.repeat(batch[rows], n), key))
            begin, count = _groups(key, order)
            follows = np.ones(len(key), bool)
            follows[order[begin]] = False
            place |= np.where(follows, _FOLLOWS, np.uint64(0))
            hit = np.zeros(len(key), bool)
            hit[order[np.repeat(count > 1, count)]] = True
            end = np.cumsum(n)
            for i, a, b in zip(rows, end - n, end):
                if hit[a:b].any():
                    out.append((int(batch[i]), _CHUNK, _planes(place[a:b][hit[a:b]], 6)))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["batch", "kind", "p"])

    def collect(table: pa.Table) -> pa.Table:
        kind, p = table["kind"].to_pylist(), table["p"].to_pylist()
        book = np.frombuffer(p[kind.index(_BOOK)], "<i8")
        n = int(book[0])
        ids, null, thash, first = book[1 : n + 1], book[n + 1 : 2 * n + 1] == 1, book[2 * n + 1 : 3 * n + 1], book[3 * n + 1 :]
        at = np.concatenate([_from_planes(x, 4) for k, x in zip(kind, p) if k == _PLACE]).astype(np.int64)
        if second:
            ask, sure = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
            sure[at] = True
        else:
            row = np.searchsorted(first, at, "right") - 1
            a = np.maximum(at - spec.reach, first[row])
            b = np.maximum(np.minimum(at + 1, first[row + 1] - spec.window + 1), a)
            ask = _mask(a, b, int(first[-1]))
            chunk = [_from_planes(x, 6) for k, x in zip(kind, p) if k == _CHUNK]
            chunk = np.concatenate(chunk) if chunk else np.zeros(0, np.uint64)
            a = (chunk & np.uint64(0xFFFFFFFF)).astype(np.int64)
            b = a + ((chunk >> np.uint64(32)) & np.uint64(0x7FFF)).astype(np.int64)
            sure = _mask(a, b, int(first[-1]))
            follows = (chunk & _FOLLOWS) != 0
            ask &= ~_mask(a[follows], b[follows], int(first[-1]))
        asked, known = _by_row(ask, first), _by_row(sure, first)
        rows = [i for i in range(n) if asked[i] or known[i]]
        return pa.table(
            [pa.array(ids[rows], mask=null[rows]), pa.array(thash[rows]), pa.array([asked[i] for i in rows], pa.binary()), pa.array([known[i] for i in rows], pa.binary())],
            ["doc_id", "thash", "ask", "sure"],
        )

    sent = docs.mapInArrow(send, _SENT)
    back = sent.groupBy("bucket").applyInArrow(sort, _BACK)
    return written(back.groupBy("batch").applyInArrow(collect, FOUND))


def _mask(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the half-open spans."""
    if not len(a):
        return np.zeros(n, bool)
    return np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0


def _by_row(mask: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each row's runs as packed pairs, counted from the row's start."""
    a, b = mask_runs(mask, first)
    cut = np.searchsorted(a, first)
    return [np.stack((a[i:j] - f, b[i:j] - f), 1).astype("<i4").tobytes() if j > i else b"" for i, j, f in zip(cut[:-1].tolist(), cut[1:].tolist(), first[:-1].tolist())]


def _ranges(packed: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """The union of packed pairs."""
    a, b = np.frombuffer(b"".join(packed or []), "<i4").reshape(-1, 2).astype(np.int64).T
    order = np.argsort(a, kind="stable")
    return merge(a[order], b[order])


def keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, thash, text); rows of the same doc_id and text are alike in all results."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("thash"), whole.alias("text"))


def join_found(docs: DataFrame, found: DataFrame, what: str, how: str) -> DataFrame:
    """Documents with the ranges ``what`` found in them: broadcast if their table is small, else shuffled.

    Rows of the same doc_id and text get the union of what was found in any of them.
    """
    rows = found.where(F.octet_length(what) > 0).groupBy(F.col("doc_id").alias("f_id"), F.col("thash").alias("f_hash"))
    small = maybe_broadcast(written(rows.agg(F.collect_set(what).alias("ranges"))), RANGE_BYTES)
    return docs.join(small, docs["thash"].eqNullSafe(small["f_hash"]) & docs["doc_id"].eqNullSafe(small["f_id"]), how).select("doc_id", "thash", "text", "ranges")


def repeated(docs: DataFrame, spec: Spec) -> DataFrame:
    """The documents of ``keyed`` with ``ranges``: packed half-open runs (or null) of positions where a window begins that also begins elsewhere."""
    arrow_rows(docs.sparkSession)
    buckets = buckets_for(docs, BUCKET_BYTES)
    one = _round(docs, spec, False, buckets)
    two = _round(join_found(docs, one, "ask", "inner"), spec, True, buckets)
    return join_found(docs, one.union(two), "sure", "left")


def map_rows(docs: DataFrame, spec: Spec, row: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Gives each document with its covered units to ``row(text bytes, covered runs, unit starts, unit ends)``."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                data, offsets = string_bytes(part.column(2))
                starts = ends = first = None
                if spec.unit == "word":
                    starts, ends, first = words(data, offsets)
                raw, out = data.tobytes(), []
                for i, x in enumerate(part.column(3).to_pylist()):
                    a, b = _ranges(x)
                    cover = merge(a, b + spec.window - 1)
                    text = raw[offsets[i] : offsets[i + 1]]
                    if first is None:
                        out.append(row(text, cover, None, None))
                    else:
                        out.append(row(text, cover, starts[first[i] : first[i + 1]] - offsets[i], ends[first[i] : first[i + 1]] - offsets[i]))
                cols = list(zip(*out))
                arrays = [part.column(0)] + [pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns])

    return docs.mapInArrow(run, schema)

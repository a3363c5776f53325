"""Byte-level BPE encoding and decoding.

Text is cut into pieces as ``public_tokenizers.PATTERN`` does, by rules over runs of
character classes for a whole batch at once. Distinct pieces are put in matrices of rows
of about equal length. In each round every row merges its leftmost pair of the least rank,
found by a hashed pair lookup; the matrix then is compacted by one column, and rows
without a pair leave it. Pieces over ``LONG_PIECE`` bytes are merged by a heap instead,
with the same order of merges, since a round for each merge would take quadratic time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows
from ._text import gather, slices, span_hash, string_bytes, tidied

LONG_PIECE = 256
_NONE = np.int32(2**31 - 1)
_O, _L, _N, _S = 0, 1, 2, 3
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for code, pattern in ((_L, r"\p{L}+"), (_N, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = code
    # fixed values: the characters with the White_Space property
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = _S
    return out


_class_of: np.ndarray | None = None


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each piece begins (bytes); a piece ends where the next one begins."""
    global _class_of
    if _class_of is None:
        _class_of = _classes()
    if not len(data):
        return np.zeros(0, np.int64)
    if data.max() < 128:
        at, cp = None, data
    else:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        b = np.zeros(len(data) + 3, np.uint32)
        b[: len(data)] = data
        cp = b[at]
        for low, n, mask in ((0xC0, 1, 0x1F), (0xE0, 2, 0x0F), (0xF0, 3, 0x07)):
            k = np.flatnonzero((cp >= low) & (cp < (0xE0, 0xF0, 0xF8)[n - 1]) & (b[at] >= low))
            k = k[b[at[k]] == cp[k]] if len(k) else k
            v = cp[k] & mask
            for j in range(1, n + 1):
                v = (v << np.uint32(6)) | (b[at[k] + j] & 0x3F)
            cp[k] = v | np.uint32(0x80000000)  # done
        cp &= np.uint32(0x7FFFFFFF)
    n = len(cp)
    kind = _class_of[cp]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins = begins if at is None else np.searchsorted(at, begins)
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run[begins] = True
    first = np.flatnonzero(run)
    end = np.append(first[1:], n)
    fresh = np.zeros(n + 1, bool)  # a row begins here
    fresh[begins] = True
    fresh[n] = True
    start = run.copy()
    # white space before another character of the row: its last character goes with what follows if it is a space, else it is alone
    k = np.flatnonzero((kind[first] == _S) & ~fresh[end])
    last = end[k] - 1
    start[last] = True
    start[end[k][cp[last] == 32]] = False
    # 's 't 're 've 'm 'll 'd, where an apostrophe begins a piece and letters follow
    k = np.flatnonzero((cp[first] == 39) & (end - first == 1) & ~fresh[end])
    k = k[start[first[k]]]
    k = k[kind[end[k]] == _L]
    a, e = end[k], end[np.minimum(k + 1, len(end) - 1)]
    one, two = cp[a].astype(np.int64), cp[np.minimum(a + 1, n - 1)].astype(np.int64)
    long = (e - a >= 2) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
    cut = np.where(np.isin(one, (115, 116, 109, 100)), 1, np.where(long, 2, 0))
    a, e, cut = a[cut > 0], e[cut > 0], cut[cut > 0]
    start[a] = False
    rest = a + cut
    start[rest[rest < e]] = True
    found = np.flatnonzero(start)
    return found if at is None else at[found]


class Vocabulary:
    """Ranks of a vocabulary file and a hash table of all pairs of tokens that make up a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, k in ranks.items():
            by_id[k] = token
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.lengths = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.data = np.frombuffer(b"".join(by_id), np.uint8)
        pairs = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(pairs, np.int64).T if pairs else np.zeros((3, 0), np.int64)
        self.bits = max(10, int(len(rank) * 4 - 1).bit_length())
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.keys = np.full(1 << self.bits, (1 << 64) - 1, np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == np.uint64((1 << 64) - 1)]
            self.keys[slot[free]] = keys[free]  # of several for a slot, one stays
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make up; the largest int if there is none. Negative ids are padding."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        keys = keys.ravel()
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        more = np.flatnonzero((found != keys) & (found != np.uint64((1 << 64) - 1)))
        for _ in range(self.probes):
            if not len(more):
                break
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found != np.uint64((1 << 64) - 1))]
        out[(left.ravel() < 0) | (right.ravel() < 0)] = _NONE
        return out.reshape(left.shape)

    def merge_matrix(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges each row of a matrix of ids, padded by -1 at the end; gives (rows, matrix) as rows get done."""
        rows, done = np.arange(len(ids)), []
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] < 2:
                done.append((rows, ids))
                break
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
            go = least != _NONE
            if not go.all():
                done.append((rows[~go], ids[~go]))
                rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            ids[r, at] = least
            keep = np.ones(ids.shape, bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            rank = rank[keep[:, 1:]].reshape(len(rows), -1)
            width = ids.shape[1]
            if width < 2:
                continue
            k = np.flatnonzero(at > 0)
            if len(k):
                rank[k, at[k] - 1] = self.pair_rank(ids[k, at[k] - 1], ids[k, at[k]])
            k = np.flatnonzero(at < width - 1)
            if len(k):
                rank[k, at[k]] = self.pair_rank(ids[k, at[k]], ids[k, at[k] + 1])
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges by a heap and a linked list."""
        ids = [int(self.byte_id[b]) for b in piece]
        text = [bytes([b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, i + 1) for i in range(n - 1) if (k := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            if text[i] is None or j >= n or text[j] is None or after[i] != j or self.ranks.get(text[i] + text[j]) != k:
                continue
            text[i], text[j], ids[i] = text[i] + text[j], None, k
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := self.ranks.get(text[a] + text[b])) is not None:
                    heapq.heappush(heap, (k, a, b))
        return [ids[i] for i in range(n) if text[i] is not None]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one row after the other, and where each row's ids begin."""
        starts = pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lengths = ends - starts
        _, first, which = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        # a piece that shares its hash with another one stands for itself
        same = lengths[first[which]] == lengths
        got = gather(data, starts, np.where(same, lengths, 0)) != gather(data, starts[first[which]], np.where(same, lengths, 0))
        if got.any():
            same[np.repeat(np.arange(len(starts)), np.where(same, lengths, 0))[got]] = False
        odd = np.flatnonzero(~same)
        which[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate((first, odd))
        count = np.zeros(len(first), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = lengths[first]
        for k in np.flatnonzero(size > LONG_PIECE):
            ids = np.array(self.merge_long(data[starts[first[k]] : ends[first[k]]].tobytes()), np.int32)
            parts.append((np.array([k]), ids[None, :]))
        width = np.where(size <= 32, size, -(-size // 16) * 16)
        for w in np.unique(width[size <= LONG_PIECE]):
            rows = np.flatnonzero((width == w) & (size <= LONG_PIECE))
            for at in range(0, len(rows), 1 << 15):
                k = rows[at : at + (1 << 15)]
                place = starts[first[k]][:, None] + np.arange(w)
                ids = self.byte_id[data[np.minimum(place, len(data) - 1)]]
                ids[np.arange(w) >= size[k][:, None]] = -1
                parts += [(k[r], m) for r, m in self.merge_matrix(ids)]
        flat, begin, total = [], np.zeros(len(first), np.int64), 0
        for k, m in parts:
            real = m >= 0
            count[k] = real.sum(1)
            begin[k] = total + np.cumsum(count[k]) - count[k]
            flat.append(m[real])
            total += len(flat[-1])
        flat = np.concatenate(flat)
        n = count[which]
        ids = gather(flat, begin[which], n).astype("<u4")
        sums = np.concatenate(([0], np.cumsum(n)))
        return ids, sums[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and where each row's bytes begin."""
        n = self.lengths[ids]
        sums = np.concatenate(([0], np.cumsum(n)))
        return gather(self.data, self.starts[ids], n), sums[offsets]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker and path."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    Gives a row for each input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    ``keep_ids`` also ids (array of ints) and decoded (string). A null text counts as empty
    (no tokens); a null doc_id stays null; repeated rows are kept; no rows give no rows.
    Other columns of the input aren't read. ``path`` is a rank file present on all machines.
    """
    arrow_rows(df.sparkSession)
    schema = SCHEMA + (", ids array<int>, decoded string" if keep_ids else "")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column(1))
                ids, at = voc.encode(data, offsets)
                back, back_at = voc.decode(ids, at)
                raw, raw_back = memoryview(ids).cast("B"), memoryview(np.ascontiguousarray(back)).cast("B")
                n = len(offsets) - 1
                out = [
                    part.column(0),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                    pa.array([hashlib.sha256(raw_back[back_at[i] : back_at[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                ]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    out.append(pa.array([bytes(raw_back[back_at[i] : back_at[i + 1]]).decode("utf-8", "replace") for i in range(n)], pa.string()))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)]
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)

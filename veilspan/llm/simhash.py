"""SimHash near-dedup with a pigeonring filter.

A fingerprint of 64 bits is a ring of four segments of 16 bits. If two fingerprints differ in
three bits at most, then by the pigeonring principle some segment begins a chain whose
cumulative differences stay within the proportional budgets: none in the first segment, one in
the first two, two in the first three, three in all four. So a link must, for one of four
starts, be equal in the first segment, and differ in two of the next four bytes at most; two of
those bytes are equal. That gives 4 x 6 index keys of 32 equal bits for each fingerprint, and
pairs that meet must keep the chain's budgets before the full Hamming check.

Equal fingerprints are one node. A key shared by two nodes gives its pair in the aggregation;
keys of up to ``PAIRED`` nodes give pairs by a join. The nodes of a larger key agree in its bits, so all
their differences are in the other ones: cut into four parts, one part of a link is equal, and each part gives a
narrower key. This goes on until few bits are left open (``WIDTHS``), so what is left of a key holds few
distinct fingerprints; these are cut into blocks, and each pair of blocks gives a spanning
forest of its links, so no group is expanded into all pairs nor held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, components, maybe_broadcast, salted_join, written
from ._text import LOWER, expand, slices, string_bytes, tidied, words

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Keys with more nodes than this are worked on in blocks.
PAIRED = 32
BLOCK = 512
#: Bits that a key leaves open, and those that are left by each round of narrower keys.
WIDTHS = (32, 24, 18, 14)
_CHUNK = 1 << 16
# fixed values: primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(acc + word * _P2, 31) * _P1


def xxh64(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each row of a matrix of bytes."""
    n, size = rows.shape
    whole = np.zeros((n, -(-size // 8) * 8 + 8), np.uint8)
    whole[:, :size] = rows
    word = whole.view("<u8").T
    start, at = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if size >= 32:
            acc = [np.full(n, v, np.uint64) for v in (start + _P1 + _P2, start + _P2, start, start - _P1)]
            while at + 32 <= size:
                acc = [_lane(a, word[at // 8 + k]) for k, a in enumerate(acc)]
                at += 32
            h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                h = (h ^ _lane(np.zeros(n, np.uint64), a)) * _P1 + _P4
        else:
            h = np.full(n, start + _P5, np.uint64)
        h = h + np.uint64(size)
        while at + 8 <= size:
            h = _turn(h ^ _lane(np.zeros(n, np.uint64), word[at // 8]), 27) * _P1 + _P4
            at += 8
        if at + 4 <= size:
            h = _turn(h ^ (word[at // 8] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
            at += 4
        while at < size:
            h = _turn(h ^ whole[:, at].astype(np.uint64) * _P5, 11) * _P1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


#: Shingles of more bytes than this, and lengths with few shingles, are hashed one by one.
_LONG, _FEW = 256, 16


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, those of the same length together."""
    out, size = np.empty(len(starts), np.uint64), ends - starts
    order = np.argsort(size, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(size[order]) > 0)) if len(order) else order
    raw = None
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        n = int(size[order[a]])
        for at in range(a, b, max(1, _CHUNK // max(1, n // 16))):
            k = order[at : min(b, at + max(1, _CHUNK // max(1, n // 16)))]
            if n > _LONG or len(k) < _FEW:
                raw = data.tobytes() if raw is None else raw
                out[k] = [xxhash.xxh64_intdigest(raw[x : x + n], SEED) for x in starts[k].tolist()]
            else:
                out[k] = xxh64(data[starts[k][:, None] + np.arange(n)])
    return out


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with a space after each, and where they begin and end in that."""
    size = ends - starts
    new = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[expand(new, new + size)] = data[expand(starts, ends)]
    return out, new, new + size


def prints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row of lower-cased texts; zero without a word."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    starts, ends, first = words(data, offsets)
    data, starts, ends = _joined(data, starts, ends)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    at = expand(first[:-1], first[:-1] + count)
    last = np.minimum(at + shingle, np.repeat(first[1:], count)) - 1
    h = shingle_hashes(data, starts[at], ends[last])
    row = np.repeat(np.arange(len(n)), count)
    votes = np.zeros((len(n), 64), np.int64)
    for k in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[k : k + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.append(True, np.diff(row[k : k + _CHUNK]) > 0))
        votes[row[k + edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.packbits(votes[some] * 2 > count[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, thash): the fingerprint's bits as a signed long and a hash of the text, for each input row."""
    arrow_rows(df.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column(1))
                out = prints(LOWER[data], offsets, shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out.view(np.int64)), part.column(2)], ["doc_id", "fp", "thash"])

    thash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), thash.alias("thash")).mapInArrow(run, "doc_id long, fp long, thash long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (i % 8)).bitwiseAND(F.lit(255))


def _keys(fp: Column) -> Column:
    """The 24 index keys: chain start and byte pair in the high bits, then the four equal bytes."""
    out = []
    for start in range(4):
        first = 2 * start
        head = _byte(fp, first) * 256 + _byte(fp, first + 1)
        for a, b in combinations(range(first + 2, first + 6), 2):
            out.append(F.lit(len(out) << 32) + head * 65536 + _byte(fp, a) * 256 + _byte(fp, b))
    return F.array(*out)


def _linked(a: Column, b: Column) -> Column:
    """The chain's budgets from some start, then the full check."""
    x = a.bitwiseXOR(b)
    seg = [F.bit_count(F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    chain = F.lit(False)
    for i in range(4):
        s = [seg[(i + j) % 4] for j in range(3)]
        chain = chain | ((s[0] == 0) & (s[1] <= MAX_BITS * 2 // 4) & (s[1] + s[2] <= MAX_BITS * 3 // 4))
    return chain & (F.bit_count(x) <= MAX_BITS)


def _forest(table: pa.Table) -> pa.Table:
    """A star for each component of the links among a group of distinct fingerprints: edges to its least member."""
    fp = np.unique(table["fp"].to_numpy()).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= MAX_BITS
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    k = np.flatnonzero(label != np.arange(len(fp)))
    signed = fp.view(np.int64)
    return pa.table({"a": signed[k], "b": signed[label[k]]})


def _open_bits(fp: Column, key: Column) -> Column:
    """The four bytes that an index key leaves open, as one number."""
    kind, out, k = F.shiftright(key, 32), F.lit(None).cast("long"), 0
    for start in range(4):
        first = 2 * start
        for a, b in combinations(range(first + 2, first + 6), 2):
            left = [i for i in range(first + 2, first + 8) if i not in (a, b)]
            value = F.lit(0).cast("long")
            for i in left:
                value = value * 256 + _byte(fp, i)
            out, k = F.when(kind == k, value).otherwise(out), k + 1
    return out


def _narrower(crowd: DataFrame, width: int) -> DataFrame:
    """(key, fp, open) of the narrower keys of rows whose ``width`` open bits are cut into four parts; an equal part joins the key."""
    parts, low = [], 0
    for i in range(4):
        size = width // 4 + (i < width % 4)
        part = F.shiftright("open", low).bitwiseAND(F.lit((1 << size) - 1))
        rest = F.shiftleft(F.shiftright("open", low + size), low).bitwiseOR(F.col("open").bitwiseAND(F.lit((1 << low) - 1)))
        parts.append(F.struct(F.xxhash64("key", F.lit(i), part).alias("key"), rest.alias("open")))
        low += size
    return crowd.select("fp", F.explode(F.array(*parts)).alias("x")).select("x.key", "fp", "x.open")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: all of them, or for large keys a forest that connects the same nodes."""
    rows = nodes.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    found = []
    for width, following in zip(WIDTHS, [*WIDTHS[1:], 0]):
        shared = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        found.append(shared.where("n = 2").where(_linked(F.col("a"), F.col("b"))).select("a", "b"))
        many = maybe_broadcast(shared.where("n > 2").select("key", "n"))
        crowd = written(rows.join(many, "key"))
        left = crowd.where(F.col("n") <= PAIRED).select("key", F.col("fp").alias("a"))
        right = crowd.where(F.col("n") <= PAIRED).select("key", F.col("fp").alias("b"))
        found.append(left.join(right, "key").where((F.col("a") < F.col("b")) & _linked(F.col("a"), F.col("b"))).select("a", "b"))
        crowd = crowd.where(F.col("n") > PAIRED)
        if not crowd.limit(1).count():
            break
        if following:
            rows = _narrower(crowd.withColumn("open", _open_bits(F.col("fp"), F.col("key"))) if width == WIDTHS[0] else crowd, width)
            continue
        ways = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("fp"), ways).cast("int")
        blocks = (
            crowd.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), ways - 1)).alias("other"), ways.alias("ways"))
            .where("own <> other or ways = 1")
            .select("key", "fp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        )
        found.append(blocks.groupBy("key", "lo", "hi").applyInArrow(_forest, "a long, b long"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _grouped(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written fingerprints: (fp, n, label) for each distinct one, and (label, n, least) for each component.

    ``least`` is the first row (is null, doc_id, thash) of a component, null ids last.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "thash")).alias("least")
    nodes = written(prints.groupBy("fp").agg(first, F.count("*").alias("n")))
    label = components(links(nodes)).select(F.col("node").alias("fp"), "label")
    named = written(nodes.join(label, "fp", "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label")))
    return named, written(named.groupBy("label").agg(F.min("least").alias("least"), F.count("*").alias("n")))


def near_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of each input row: doc_id, fingerprint (16 hex digits), component_id.

    Rows link if their fingerprints differ in three bits or fewer; component_id is the smallest
    doc_id reachable. Texts of fewer words than a shingle have one shingle, the whole sequence; null,
    empty and blank texts have the fingerprint zero and link like any other. A null doc_id stays
    null and never is a component_id, unless all reachable ones are null. Repeated rows are kept,
    one row each; no rows give no rows; other columns aren't read.
    """
    prints = written(fingerprints(df, text, doc_id, shingle))
    named, groups = _grouped(prints)
    # a component of very many fingerprints, and a fingerprint of very many rows, are salted
    part = salted_join(named.select("fp", "label", F.col("n").alias("rows")), groups, "label", "fp")
    part = written(part.select("fp", F.col("least.doc_id").alias("component_id"), F.col("rows").alias("n")))
    out = salted_join(prints, part, "fp", "doc_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(df: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component of ``doc_id`` and ``text``: that of the smallest doc_id.

    Null ids come last; of rows with the same id in a component, that of the smallest text hash stays,
    and of identical (doc_id, text) rows one.
    """
    prints = written(fingerprints(df, "text", "doc_id"))
    keep = maybe_broadcast(written(_grouped(prints)[1].select(F.col("least.doc_id").alias("k_id"), F.col("least.thash").alias("k_hash"))))
    thash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    out = df.join(keep, df["doc_id"].eqNullSafe(keep["k_id"]) & thash.eqNullSafe(keep["k_hash"]), "left_semi")
    if prints.groupBy("doc_id", "thash").count().where("count > 1").limit(1).count():
        out = out.withColumn("__veilspan_hash", thash).dropDuplicates(["doc_id", "__veilspan_hash"]).drop("__veilspan_hash")
    return out

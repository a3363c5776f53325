"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are cut into n-grams of three words (of two, for items of up to ``SHORT`` words). Their seeds are the rare ones,
those of ``COMMON`` items at most: an n-gram that many items share, like the stem of a question, doesn't tell one of them.
(How many documents hold an n-gram doesn't count: it may be common there because it has leaked.) Where the words that no rare
seed covers could reach the threshold alone, the item keeps its rarest common ones until they can't: an
alignment that reaches it then always takes in a word of a seed. Items of equal words are one, with the smallest id. One
seed that a document shares with an item is enough: the item is aligned with the words around it, as
far as an alignment that reaches the threshold can go. Left out are only items of which too few words
are there at all to reach it. The score is the best local alignment (match 2, mismatch and gap -1)
over that of the whole item with itself, so edited and partial copies score in proportion.

A benchmark of up to ``BLOCK_BYTES`` goes to the scan of the documents, which then is the only one.
A larger one is joined with the documents by the seeds' hashes: a scan sends the seeds it may have met (by a
bit filter of fixed size), the join gives (document, item) with the places, and documents with such
pairs meet them, sorted by document, in a second scan. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, arrow_rows, maybe_broadcast, plan_bytes, written
from ._text import mix, slices, string_bytes, tidied, window_hash
from .toxicity import _BITS, look_up, word_hashes

N = 3
#: Items of up to so many words have seeds of two words, as few edits can break all of three; items of fewer than LEAST are never found.
SHORT, SHORT_N, LEAST = 16, 2, 3
THRESHOLD = 0.5
#: A seed of more items than this is common.
COMMON = 32
#: Parts in which the documents that hold a seed meet its items, where the benchmark is joined.
PARTS = 16
#: A benchmark of up to so many items and bytes is broadcast.
BLOCK_ITEMS = 20000
BLOCK_BYTES = 16 << 20
#: Bits of the filter of seeds (a power of two of them) where the benchmark is joined.
FILTER_BITS = 26
#: Pairs of a hit and an item that are looked at together; bounds the working memory.
PAIRS = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
# names that no table of documents has
_ITEM, _SCORE = "__veilspan_item", "__veilspan_score"


@dataclass
class Items:
    """The items of a block: words (hashes) by item, and the distinct n-grams with the items that hold them."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  #: distinct hashes, ascending
    first: np.ndarray  #: where each gram's items begin in ``owner``
    owner: np.ndarray

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        slots, after = np.zeros(1 << _BITS, np.int32), np.zeros(len(self.grams) + 1, np.int32)
        for i, h in enumerate(self.grams.tolist()):
            s = h & ((1 << _BITS) - 1)
            after[i + 1], slots[s] = slots[s], i + 1
        return slots, after


def seeds_of(words: np.ndarray) -> np.ndarray:
    """The distinct seeds of an item."""
    n = SHORT_N if len(words) <= SHORT else N
    return np.unique(window_hash(words, n)) if len(words) >= LEAST else np.zeros(0, np.uint64)


def rare_seeds(words: np.ndarray, items: dict[int, int], threshold: float) -> np.ndarray:
    """An item's seeds: those that aren't in ``items`` (common seed -> its items), and of those as few as keep an
    alignment that reaches the threshold from missing all seeds, the rarest first."""
    n = SHORT_N if len(words) <= SHORT else N
    if len(words) < LEAST:
        return np.zeros(0, np.uint64)
    grams = window_hash(words, n)
    known = np.array([items.get(g, 0) for g in grams.tolist()], np.int64)
    covered, chosen = np.zeros(len(words), bool), known == 0

    def cover() -> None:
        covered[:] = False
        for k in range(n):
            covered[k : k + len(grams)] |= chosen

    cover()
    for k in np.argsort(known, kind="stable"):
        if (~covered).sum() < threshold * len(words):
            break
        if not chosen[k]:
            chosen[k] = True
            cover()
    return np.unique(grams[chosen])


def items_of(rows: list[tuple], threshold: float = THRESHOLD) -> Items:
    """From (item_id, text) rows, in order of item_id, null last."""
    data, offsets = string_bytes(pa.array([r[1] for r in rows], pa.large_string()))
    hashes, first = word_hashes(data, offsets)
    each = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
    own: dict[bytes, int] = {}
    for k, w in enumerate(each):
        own.setdefault(w.tobytes(), k)
    ids, words = [rows[k][0] for k in own.values()], [each[k] for k in own.values()]
    every, n_items = np.unique(np.concatenate([*(seeds_of(w) for w in words), np.zeros(0, np.uint64)]), return_counts=True)
    common = dict(zip(every[n_items > COMMON].tolist(), n_items[n_items > COMMON].tolist()))
    gram = [rare_seeds(w, common, threshold) for w in words]
    owner = np.repeat(np.arange(len(ids)), [len(g) for g in gram])
    every = np.concatenate([*gram, np.zeros(0, np.uint64)])
    order = np.lexsort((owner, every))
    grams, at = np.unique(every[order], return_index=True)
    return Items(ids, words, grams, np.append(at, len(every)), owner[order])


def places(hashes: np.ndarray, first: np.ndarray, known) -> tuple[np.ndarray, np.ndarray]:
    """Words where an n-gram begins (within a row) that ``known`` (hashes -> index + 1, or 0) knows, in order, and its index."""
    at, got = [], []
    for n in (N, SHORT_N):
        if len(hashes) < n:
            continue
        index = known(window_hash(hashes, n))
        k = np.flatnonzero(index)
        k = k[k + n <= first[np.searchsorted(first, k, "right")]]
        at.append(k), got.append(index[k].astype(np.int64) - 1)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, got = np.concatenate(at), np.concatenate(got)
    order = np.argsort(at, kind="stable")
    return at[order], got[order]


def reach(n: int, threshold: float) -> int:
    """How many words an alignment of an item of n words that reaches the threshold can go to either side of a word of it.

    It can't have more insertions than its matches pay for.
    """
    return n + int(np.ceil(MATCH * n * (1 - threshold)))


def align(a: np.ndarray, b: np.ndarray) -> float:
    """Best local alignment of two word sequences, over that of the first with itself."""
    if not len(a) or not len(b):
        return 0.0
    row, best = np.zeros(len(b) + 1), 0.0
    steps = -GAP * np.arange(len(b) + 1)
    for w in a:
        new = np.zeros(len(b) + 1)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        # gaps along the row: the running maximum of what each cell would pass on
        row = np.maximum.accumulate(new + steps) - steps
        best = max(best, float(row.max()))
    return best / (MATCH * len(a))


def near_score(own: np.ndarray, words: np.ndarray, low: int, high: int, threshold: float, least: float = 0.0) -> float:
    """The score of an item with the words around its seeds at ``low`` to ``high``; 0 if it can't reach the threshold, or ``least``."""
    wide = reach(len(own), threshold)
    near = words[max(0, low - wide) : high + N + wide]
    if np.isin(own, near).mean() < max(threshold, least):
        return 0.0  # the score is no more than the share of the item's words that are near
    score = align(own, near)
    return score if score >= threshold else 0.0


class Finder:
    def __init__(self, items: Items, threshold: float = THRESHOLD):
        self.items, self.threshold = items, threshold
        self.slots, self.after = items.table()
        self.sizes = np.array([len(w) for w in items.words], np.int64)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words where a seed begins, and the seed's index."""
        return places(hashes, first, lambda h: look_up(h, self.items.grams, self.slots, self.after))

    def best(self, words: np.ndarray, at: np.ndarray, gram: np.ndarray) -> tuple[float, int]:
        """The best score and item of one row's hits (positions within the row); (0, -1) if nothing was aligned."""
        it = self.items
        begin, end = it.first[gram], it.first[gram + 1]
        parts = max(1, -(-int((end - begin).sum()) // PAIRS))
        best = (0.0, -1)
        for k in range(parts):
            if parts > 1:
                low, high = (len(it.ids) * x // parts for x in (k, k + 1))
                known, which = np.unique(gram, return_inverse=True)
                own = [it.first[g] + np.searchsorted(it.owner[it.first[g] : it.first[g + 1]], (low, high)) for g in known]
                begin, end = np.array(own)[which].T
            n = end - begin
            item = it.owner[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
            best = self._best(words, item, np.repeat(at, n), best)
        return best

    def _best(self, words: np.ndarray, item: np.ndarray, place: np.ndarray, best: tuple[float, int]) -> tuple[float, int]:
        it = self.items
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        edge = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (np.diff(place) > 2 * self.sizes[item[1:]]))) if len(item) else item
        end = np.append(edge[1:], len(item))[: len(edge)]
        most = np.argsort(edge - end, kind="stable")  # likely the best first
        for a, b in zip(edge[most].tolist(), end[most].tolist()):
            score = near_score(it.words[item[a]], words, int(place[a]), int(place[b - 1]), self.threshold, best[0])
            if score > best[0] or score and score == best[0] and self._before(item[a], best[1]):
                best = (score, int(item[a]))
        return best

    def _before(self, a: int, b: int) -> bool:
        """Ties go to the smaller item_id, null last."""
        a, b = self.items.ids[a], self.items.ids[b]
        return a is not None and (b is None or a < b)


def _items(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()


def _score(finder: Finder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and item index (or -1) of each row."""
    hashes, first = word_hashes(data, offsets)
    at, gram = finder.hits(hashes, first)
    score, item = np.zeros(len(offsets) - 1), np.full(len(offsets) - 1, -1)
    row = np.searchsorted(first, at, "right") - 1
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    for a, b in zip(edge, np.append(edge[1:], len(row))):
        r = row[a]
        score[r], item[r] = finder.best(hashes[first[r] : first[r + 1]], at[a:b] - first[r], gram[a:b])
    return score, item


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, contaminated (0/1), item_id (of the best alignment), score, for each row.

    Scores under the threshold count as 0, with a null item_id. Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased. Null and empty texts score 0; items without text or of fewer than
    three words are never found; ties go to the smaller item_id, null last; null ids stay null; repeated
    rows stay; an empty benchmark finds nothing; other columns aren't read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = mark(rows, benchmark, threshold, item_text, item_id)
    return out.select("doc_id", (F.col(_SCORE) >= threshold).cast("int").alias("contaminated"), F.col(_ITEM).alias("item_id"), F.col(_SCORE).alias("score"))


def mark(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows with all their columns, and columns _ITEM and _SCORE of the best alignment."""
    arrow_rows(docs.sparkSession)
    items = written(_items(benchmark, item_text, item_id))
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if size[0] > BLOCK_ITEMS or size[1] > BLOCK_BYTES:
        return _joined(docs, items, threshold)
    ship = docs.sparkSession.sparkContext.broadcast(items_of([(r[0], r[1]) for r in items.orderBy(F.col("item_id").asc_nulls_last(), "text").collect()], threshold))  # BLOCK_BYTES at most
    at = docs.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(ship.value, threshold)
        for batch in batches:
            for part in slices(batch):
                score, item = _score(find, *string_bytes(part.column(at)))
                ids = [find.items.ids[k] if k >= 0 else None for k in item.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.int64()), pa.array(score)], [*part.schema.names, _ITEM, _SCORE])

    return docs.mapInArrow(run, docs.withColumns({_ITEM: F.lit(None).cast("long"), _SCORE: F.lit(0.0)}).schema)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``mark`` by joins, for a benchmark of any size. Rows of the same doc_id and text are alike, so these name a document."""
    spark = docs.sparkSession

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, first = word_hashes(*string_bytes(part.column(1)))
                words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
                n = pa.array([len(w) for w in words], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), n, _longs(words), _longs([seeds_of(w) for w in words])], ["item_id", "n", "words", "seeds"])

    made = items.mapInArrow(cut, "item_id long, n int, words array<long>, seeds array<long>").where(F.size("seeds") > 0)
    made = written(made.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n"), F.first("seeds").alias("seeds")))
    made = written(made.withColumn("item", F.monotonically_increasing_id()))
    every = written(made.select("item", F.explode("seeds").alias("seed")))
    common = maybe_broadcast(written(every.groupBy("seed").agg(F.count("*").alias("items")).where(F.col("items") > COMMON)))
    marked = every.join(common, "seed").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("seed", "items"))).alias("common"))  # an item's own seeds

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, known = b.column(2), b.column(3).to_pylist()
            each = [rare_seeds(words[i].values.to_numpy().view(np.uint64), {k & (1 << 64) - 1: v for k, v in known[i]}, threshold) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _longs(each)], ["item", "n", "seeds"])

    rare = made.join(marked, "item", "left").where("common is not null").select("item", "n", "words", "common").mapInArrow(choose, "item long, n int, seeds array<long>")
    plain = made.join(marked, "item", "left_anti").select("item", "n", "seeds")
    seeds = written(plain.union(rare).select("item", "n", F.explode("seeds").alias("seed")))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], ["bits"])

    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in seeds.select("seed").coalesce(16).mapInArrow(fill, "bits binary").toLocalIterator():  # of fixed size, one at a time
        bits |= np.frombuffer(row[0], np.uint8)
    ship = spark.sparkContext.broadcast(bits)
    thash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    rows = docs.select(own_id.cast("long").alias("doc_id"), thash.alias("thash"), F.col("text").alias("text"))

    @tidied
    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(ship.value)
        for batch in batches:
            for part in slices(batch):
                hashes, first = word_hashes(*string_bytes(part.column(2)))
                seed = {n: window_hash(hashes, n) for n in (N, SHORT_N) if len(hashes) >= n}
                for n, h in seed.items():
                    at = np.flatnonzero(known[mix(h) >> np.uint64(64 - FILTER_BITS)])
                    at = at[at + n <= first[np.searchsorted(first, at, "right")]]
                    row = np.searchsorted(first, at, "right") - 1
                    k = pa.array(row)
                    place = pa.array((at - first[row]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(k), part.column(1).take(k), pa.array(h[at].view(np.int64)), place], ["doc_id", "thash", "seed", "at"])

    hits = rows.mapInArrow(seek, "doc_id long, thash long, seed long, at int")
    cell = F.floor(F.col("at") / (4 * F.col("n")))
    if plan_bytes(seeds) <= BROADCAST_BYTES:
        met = hits.join(F.broadcast(seeds), "seed")
    else:  # a seed that has leaked can be in very many documents
        parted = seeds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        met = hits.withColumn("part", F.pmod(F.xxhash64("doc_id", "thash", "at"), F.lit(PARTS)).cast("int")).join(parted, ["seed", "part"]).drop("part")
    cells = met.groupBy("doc_id", "thash", "item", cell.alias("cell")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    pairs = written(cells.join(maybe_broadcast(made.select("item", "item_id", "words")), "item").select("doc_id", "thash", "item_id", "words", "low", "high"))
    keys = maybe_broadcast(written(pairs.select(F.col("doc_id").alias("f_id"), F.col("thash").alias("f_hash")).distinct()))
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("thash") == F.col("f_hash"))
    texts = rows.join(keys, same, "left_semi").select("doc_id", "thash", "text", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("array<long>").alias("words"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    both = texts.union(pairs.select("doc_id", "thash", F.lit(None).cast("string"), "item_id", "words", "low", "high"))

    @tidied
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names = np.zeros(0, np.uint64), ["doc_id", "thash", "item_id", "score"]
        for b in batches:
            out, low, high = [], b.column(5).to_numpy(), b.column(6).to_numpy()
            for i in range(b.num_rows):
                if low[i] < 0:
                    hashes = word_hashes(*string_bytes(b.column(2).slice(i, 1)))[0]
                    continue
                score = near_score(b.column(4)[i].values.to_numpy().view(np.uint64), hashes, int(low[i]), int(high[i]), threshold)
                if score:
                    out.append((i, score))
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array([x[1] for x in out], pa.float64())], names)

    # a document's text, and after it its pairs
    scored = both.repartition("doc_id", "thash").sortWithinPartitions("doc_id", "thash", "low").mapInArrow(meet, "doc_id long, thash long, item_id long, score double")
    best = F.min(F.struct((-F.col("score")).alias("score"), F.col("item_id").isNull().alias("none"), F.col("item_id").alias("item_id")))
    best = written(scored.groupBy(F.col("doc_id").alias("f_id"), F.col("thash").alias("f_hash")).agg(best.alias("best")))
    whole = docs.withColumns({"__veilspan_id": own_id.cast("long"), "__veilspan_hash": thash})
    small = maybe_broadcast(best)
    out = whole.join(small, whole["__veilspan_id"].eqNullSafe(small["f_id"]) & (whole["__veilspan_hash"] == small["f_hash"]), "left")
    score = F.coalesce(-F.col("best.score"), F.lit(0.0))
    return out.select(*[whole[c] for c in docs.columns], F.col("best.item_id").alias(_ITEM), score.alias(_SCORE))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item.

    Null and empty texts hold none and stay, repeated rows stay or go together, an empty benchmark keeps all rows.
    """
    return mark(docs, benchmark, threshold).where(F.col(_SCORE) < threshold).drop(_ITEM, _SCORE)

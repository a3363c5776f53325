"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct
words; the document's is their leaky noisy-or, 1 - (1 - leak) prod(1 - p). Only documents are
labelled: the gradient of the document's log loss goes through the noisy-or to the sentences, so
training finds out which of them are to blame, and ``locate`` names them. The leak takes up
labels that no sentence explains, and the sentence bias is fixed and low, so that a text
isn't toxic for being long. Words that toxic training documents don't hold far more often than
chance would have it (``MIN_EVIDENCE``) get no weight.

The model learns from all labelled rows and their whole texts, near copies once. Words are counted by tasks; what a
document says of the words that count (which of its sentences hold which of them, and how many hold none) is a pattern, and equal patterns
are one row with a number. The weights are fitted on pieces of up to about ``PIECE`` patterns by tasks and averaged, a word's by its
documents in each piece. Scoring runs over all rows and whole texts, by table look-ups for a batch at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_rows, dropped, maybe_broadcast, written
from ._text import LOWER, mask_runs, slices, span_hash, string_bytes, tidied, window_hash, words

#: Patterns of labelled documents that a task fits the weights on, and toxic documents that a piece has at least.
PIECE, PIECE_TOXIC = 1 << 16, 100
#: Words in fewer training documents than this have no weight.
MIN_DOCS = 3
#: A word counts if its toxic documents are more than chance would give, by this many nats (Chernoff's bound).
MIN_EVIDENCE = 14.0
EPOCHS = 200
RATE = 0.1
L2 = 1e-4
PREFIXES = (4, 5, 6)
SKETCH = 16
#: Logit of a sentence without words that count, and the weights at the start.
BIAS = -12.0
START = 8.0
_BITS = 20

# Bytes of words: digits, letters and everything outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_END = np.zeros(256, bool)
_END[[10, 13, 33, 46, 63]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each sentence begins (bytes), and each row's first sentence; a row has one at least, also an empty one.

    A sentence ends after one of . ! ? or an end of line, if another character follows.
    """
    new = np.zeros(len(data) + 1, bool)
    if len(data):
        new[1:-1] = _END[data[:-1]] & ~_END[data[1:]]
    new[offsets[:-1]] = False
    inner = np.flatnonzero(new)
    inner = inner[inner < len(data)]
    at = np.sort(np.concatenate((offsets[:-1], inner)), kind="stable")
    return at, np.append(np.searchsorted(inner, offsets[:-1], "left") + np.arange(len(offsets) - 1), len(at))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the first word of each row."""
    a, b = mask_runs(_WORD[data], offsets)
    return span_hash(LOWER[data], a, b, seed=3), np.searchsorted(a, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and of their longer beginnings (PREFIXES, in bytes), and where each word begins.

    Beginnings stand for inflected and compounded forms of a word.
    """
    a, b = mask_runs(_WORD[data], offsets)
    low = LOWER[data]
    hashes, at = [span_hash(low, a, b, seed=3)], [a]
    for n in PREFIXES:
        k = a[b - a > n]
        hashes.append(span_hash(low, k, k + n, seed=3 + n))
        at.append(k)
    return np.concatenate(hashes), np.concatenate(at)


@dataclass
class Model:
    """Weights of words (by hash), and the logit of the leak."""

    hashes: np.ndarray
    weights: np.ndarray
    leak: float

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A slot table of indexes + 1 into the words; words that share a slot are chained by ``after``."""
        slots, after = np.zeros(1 << _BITS, np.int32), np.zeros(len(self.hashes) + 1, np.int32)
        for i, h in enumerate(self.hashes.tolist()):
            s = h & ((1 << _BITS) - 1)
            after[i + 1], slots[s] = slots[s], i + 1
        return slots, after, np.append(np.float64(0), self.weights)


def look_up(hashes: np.ndarray, known: np.ndarray, slots: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Index + 1 of each hash among the known ones, 0 if it isn't."""
    at = slots[hashes & np.uint64((1 << _BITS) - 1)]
    k = np.flatnonzero(at)
    out = np.zeros(len(hashes), np.int32)
    at = at[k]
    while len(k):
        hit = known[at - 1] == hashes[k]
        out[k[hit]] = at[hit]
        k, at = k[~hit], after[at[~hit]]
        k, at = k[at > 0], at[at > 0]
    return out


def _distinct(sentence: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(sentence * np.int64(n_words + 1) + word)
    return key // (n_words + 1), key % (n_words + 1)


def noisy_or(z: np.ndarray, first: np.ndarray, leak: float) -> np.ndarray:
    """1 - (1 - sigmoid(leak)) prod(1 - sigmoid(z)) over each row's sentences, by logs: log(1 - p) = -log(1 + e**z)."""
    return -np.expm1(-np.add.reduceat(np.logaddexp(0, z), first[:-1]) - np.logaddexp(0, leak))


class Trained:
    def __init__(self, model: Model):
        self.model = model
        self.slots, self.after, self.weights = model.table()

    def sentence_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """z of each sentence, where sentences begin, and each row's first sentence."""
        at, first = sentences(data, offsets)
        hashes, starts = features(data, offsets)
        known = look_up(hashes, self.model.hashes, self.slots, self.after)
        k = np.flatnonzero(known)
        s, w = _distinct(np.searchsorted(at, starts[k], "right") - 1, known[k].astype(np.int64), len(self.weights))
        z = np.full(len(at), BIAS)
        z += np.bincount(s, self.weights[w], len(at))
        return z, at, first

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z, _, first = self.sentence_scores(data, offsets)
        return np.clip(noisy_or(z, first, self.model.leak), 0, 1) if len(first) > 1 else np.zeros(0)


def independent(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that aren't near copies of an earlier one: those that share fewer than half of their SKETCH least 3-word shingles with it."""
    starts, ends, first = words(data, offsets)
    unit = span_hash(LOWER[data], starts, ends)
    seen: dict[int, list[int]] = {}
    keep = np.ones(len(offsets) - 1, bool)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        sketch = np.unique(window_hash(unit[a:b], min(3, b - a)))[:SKETCH].tolist() if b > a else []
        shared = Counter(k for h in sketch for k in seen.get(h, ()))
        if any(2 * n >= len(sketch) for n in shared.values()):
            keep[i] = False
            continue
        for h in sketch:
            seen.setdefault(h, []).append(i)
    return keep


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, counts: tuple[int, int] | None = None) -> Model:
    """Fits the weights and the leak by full-batch Adam; the same result for the same rows in order.

    ``counts`` are the numbers of rows of label 0 and 1 that the sample stands for, if its classes are
    sampled at different rates; the loss weighs rows accordingly.

    No rows, or rows of one class only, give a model whose score is that class's share (smoothed).
    """
    labels = np.asarray(labels, np.float64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    if not len(labels) or labels.min() == labels.max():
        return flat
    data, offsets = string_bytes(texts)
    keep = independent(data, offsets)  # copies would count as evidence again
    labels = labels[keep]
    if not labels.any() or labels.all():
        return flat
    data, offsets = string_bytes(texts.filter(pa.array(keep)))
    share = labels.mean()
    hashes, starts = features(data, offsets)
    at, first = sentences(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    vocab, which = np.unique(hashes, return_inverse=True)
    pairs = np.unique(which * np.int64(len(labels)) + row)
    docs = np.bincount(pairs // len(labels), minlength=len(vocab))
    toxic = np.bincount(pairs // len(labels), labels[pairs % len(labels)], len(vocab))
    rate = np.clip(toxic / docs, 1e-12, 1 - 1e-12)
    excess = docs * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    often = (docs >= MIN_DOCS) & (rate > share) & (excess >= MIN_EVIDENCE)
    new = np.cumsum(often) - 1
    keep = often[which]
    n = int(often.sum())
    if not n:
        return flat
    s, w = _distinct(np.searchsorted(at, starts[keep], "right") - 1, new[which[keep]], n)
    inside, s = np.unique(s, return_inverse=True)
    sentence_row = np.searchsorted(first, inside, "right") - 1
    empty = np.diff(first) - np.bincount(sentence_row, minlength=len(labels))
    weights, leak = _descended(labels, np.ones(len(labels)), empty, sentence_row, s, w, n, epochs, counts)
    return Model(vocab[often], weights, leak)


def _descended(
    labels: np.ndarray, times: np.ndarray, empty: np.ndarray, sentence_row: np.ndarray, s: np.ndarray, w: np.ndarray, n: int, epochs: int = EPOCHS, counts: tuple[int, int] | None = None
) -> tuple[np.ndarray, float]:
    """Weights of n words and the leak. Rows have a label, a number of copies and one of sentences without words that count;
    each other sentence has its row, and words w are in sentences s."""
    ones, zeros = (labels * times).sum(), ((1 - labels) * times).sum()
    zero_all, one_all = counts or (zeros, ones)
    weight = np.where(labels == 1, one_all / ones, zero_all / zeros) * (ones + zeros) / (one_all + zero_all) * times
    weights, leak = np.full(n, START), float(np.log(one_all / zero_all))
    m1, m2 = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, epochs + 1):
        z = BIAS + np.bincount(s, weights[w], len(sentence_row))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(sentence_row, np.logaddexp(0, z), len(labels)) + empty * np.logaddexp(0, BIAS) + np.logaddexp(0, leak)
        whole = np.clip(-np.expm1(-total), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for a 0, -p (1 - P) / P for a 1; likewise for the leak
        g = np.where(labels == 1, -(1 - whole) / whole, 1.0) * weight
        grad = np.append(np.bincount(w, (g[sentence_row] * p)[s], n), g.sum() / (1 + np.exp(-leak))) / (ones + zeros)
        grad[:-1] += L2 * (weights - START)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        leak -= move[-1]
    return weights, float(leak)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _by_rows(rows: DataFrame, one: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``one`` of each slice of (doc_id, toxic, text)."""
    arrow_rows(rows.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(one(part))

    return rows.select("doc_id", "toxic", "text").mapInArrow(run, schema)


def _sketches(part: pa.RecordBatch) -> dict[str, pa.Array]:
    starts, ends, first = words(*string_bytes(part.column(2)))
    unit = span_hash(LOWER[string_bytes(part.column(2))[0]], starts, ends)
    own = [np.unique(window_hash(unit[a:b], min(3, b - a)))[:SKETCH].view(np.int64) if b > a else np.zeros(0, np.int64) for a, b in zip(first[:-1], first[1:])]
    return {"doc_id": part.column(0), "sketch": pa.array(own, pa.list_(pa.int64()))}


def _copies(rows: DataFrame) -> DataFrame:
    """Ids of documents that share at least half of their sketch with an earlier one: for each of its shingles the first document that has it counts."""
    each = _by_rows(rows, _sketches, "doc_id long, sketch array<long>").select("doc_id", F.size("sketch").alias("n"), F.explode("sketch").alias("h"))
    each = written(each)
    first = each.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    shared = each.join(first, "h").where("first < doc_id").groupBy("doc_id", "first", "n").count()
    out = written(shared.where("2 * count >= n").select("doc_id").distinct())
    dropped(each)
    return out


def _evidence(rows: DataFrame, share: float) -> np.ndarray:
    """Hashes of the words that count, in order; counted over all rows."""

    def one(part: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = string_bytes(part.column(2))
        hashes, at = features(data, offsets)
        vocab, which = np.unique(hashes, return_inverse=True)
        n, labels = part.num_rows, part.column(1).to_numpy()
        pairs = np.unique(which * np.int64(n) + np.searchsorted(offsets, at, "right") - 1)
        docs, toxic = np.bincount(pairs // n, minlength=len(vocab)), np.bincount(pairs // n, labels[pairs % n], len(vocab))
        return {"h": pa.array(vocab.view(np.int64)), "docs": pa.array(docs), "toxic": pa.array(toxic.astype(np.int64))}

    told = _by_rows(rows, one, "h long, docs long, toxic long").groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    rate = F.least(F.greatest(F.col("toxic") / F.col("docs"), F.lit(1e-12)), F.lit(1 - 1e-12))
    excess = F.col("docs") * (rate * F.log(rate / share) + (1 - rate) * F.log((1 - rate) / (1 - share)))
    often = told.where((F.col("docs") >= MIN_DOCS) & (rate > share) & (excess >= MIN_EVIDENCE))
    return np.sort(often.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _patterns(rows: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(toxic, empty, sentences, n): the sentences with words that count, as lists of these words, the number of the others, and how many documents are like this."""
    shipped = rows.sparkSession.sparkContext.broadcast(vocab)

    def one(part: pa.RecordBatch) -> dict[str, pa.Array]:
        known = shipped.value
        data, offsets = string_bytes(part.column(2))
        at, first = sentences(data, offsets)
        hashes, starts = features(data, offsets)
        k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[k] == hashes
        s, w = _distinct(np.searchsorted(at, starts[hit], "right") - 1, k[hit], len(known))
        inside, begin = np.unique(s, return_index=True)
        own: list[list] = [[] for _ in range(part.num_rows)]
        for row, x in zip((np.searchsorted(first, inside, "right") - 1).tolist(), np.split(w, begin[1:]) if len(w) else []):
            own[row].append(x.tolist())
        empty = np.diff(first) - np.array([len(x) for x in own], np.int64)
        return {"toxic": part.column(1), "empty": pa.array(empty), "sentences": pa.array([sorted(x) for x in own], pa.list_(pa.list_(pa.int64())))}

    each = _by_rows(rows, one, "toxic int, empty long, sentences array<array<long>>")
    return each.groupBy("toxic", "empty", "sentences").agg(F.count("*").alias("n"))


_FIXED = 1 << 30


def _fitted(patterns: DataFrame, words_n: int, count: int, counts: tuple[int, int]) -> tuple[np.ndarray, float]:
    """The weights and the leak, as means over the pieces; in fixed point, so that the order doesn't matter."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            piece = b.column(0).to_numpy()
            for k in np.unique(piece).tolist():
                held.setdefault(k, []).append(b.filter(pa.array(piece == k)))
        for k in sorted(held):
            t = pa.Table.from_batches(held.pop(k)).to_pydict()
            labels, times, empty = (np.array(t[c], np.float64) for c in ("toxic", "n", "empty"))
            if labels.min() == labels.max():
                continue
            row = np.repeat(np.arange(len(labels)), [len(x) for x in t["sentences"]])
            each = [x for own in t["sentences"] for x in own]
            s = np.repeat(np.arange(len(each)), [len(x) for x in each])
            w = np.array([i for x in each for i in x], np.int64)
            weights, leak = _descended(labels, times, empty, row, s, w, words_n, EPOCHS, counts)
            seen = np.bincount(w, times[row[s]], words_n)
            by = np.append(seen, times.sum()).astype(np.int64)
            x = np.round(np.append(weights, leak) * _FIXED).astype(np.int64)
            at = np.flatnonzero(by)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "x": pa.array(x[at]), "by": pa.array(by[at])})

    piece = F.pmod(F.xxhash64("toxic", "empty", "sentences"), F.lit(count)).cast("int")
    dealt = patterns.select(piece.alias("piece"), "*").repartition(count, "piece").sortWithinPartitions("piece", "toxic", "empty", "sentences")
    told = dealt.mapInArrow(run, "at long, x long, by long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38)") * F.col("by")).alias("x"), F.sum("by").alias("by")).collect()
    out = np.full(words_n + 1, START)
    for r in told:
        out[r["at"]] = float(r["x"]) / r["by"] / _FIXED
    return out[:-1], float(out[-1])


def train(documents: DataFrame, labels: DataFrame, usable: Column, text: str = "text") -> Model:
    """Fits a model on all labelled documents for which ``usable`` (an expression on doc_id) holds.

    Rows with a null doc_id, text or label take no part; an id with several labels counts as toxic
    if one of them says so; of repeated documents of an id one is taken.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = written(documents.where("text is not null").join(marks.where(usable), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    zeros, ones = total.get(0, 0), total.get(1, 0)
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((ones + 0.5) / (zeros + 0.5))))
    if not zeros or not ones:
        return flat
    copies = _copies(rows)
    kept = written(rows.join(maybe_broadcast(copies), "doc_id", "left_anti"))  # copies would count as evidence again
    dropped(rows, copies)
    n = {r[0]: r[1] for r in kept.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return flat
    vocab = _evidence(kept, n[1] / (n[0] + n[1]))
    if not len(vocab):
        return flat
    patterns = written(_patterns(kept, vocab))
    dropped(kept)
    count = max(1, min(-(-patterns.count() // PIECE), n[1] // PIECE_TOXIC))
    weights, leak = _fitted(patterns, len(vocab), count, (zeros, ones))
    dropped(patterns)
    return Model(vocab, weights, leak)


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) for each row. A null or empty text is one sentence without words, so it gets the leak's score;
    null ids stay null, repeated rows stay, no rows give no rows; other columns aren't read."""
    arrow_rows(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Trained(shipped.value)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ready.scores(*string_bytes(part.column(1))))], ["doc_id", "score"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold; ``text`` is scored.

    Null and empty texts have the leak's score and stay unless that reaches the threshold; repeated rows stay or go together.
    """
    arrow_rows(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Trained(shipped.value)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(ready.scores(*string_bytes(part.column(at))) < threshold))

    return df.mapInArrow(run, df.schema)


def locate(df: DataFrame, model: Model, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The offending sentences: (doc_id, start, end, sentence, score) with offsets in UTF-8 bytes."""
    arrow_rows(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Trained(shipped.value)
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column(1))
                z, at, first = ready.sentence_scores(data, offsets)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                k = np.flatnonzero(p >= threshold)
                row = np.searchsorted(first, k, "right") - 1
                end = np.append(at[1:], len(data))[k]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)),
                        pa.array(at[k] - offsets[row]),
                        pa.array(end - offsets[row]),
                        pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[k], end)], pa.string()),
                        pa.array(p[k]),
                    ],
                    ["doc_id", "start", "end", "sentence", "score"],
                )

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")

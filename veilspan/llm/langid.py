"""Language ID with language-bitmask n-gram filters.

One Bloom filter holds, in each slot, a word of bits, a bit for each language (bit-sliced: the
filters of all languages lie side by side). The and of an n-gram's slots gives all languages
whose training texts contain it. A text's n-grams give a count for each language (a popcount of
its bit plane), which is corrected for that language's rate of false positives; the
language with the largest corrected share is the prediction.

The filters are built on a bounded sample of training rows (``PER_LANGUAGE`` rows of each
language, by a hash of the id, of a longer text than ``MAX_TRAIN_BYTES`` a stretch); an n-gram is taken up if it is in
``MIN_DOCS`` of them. Prediction reads whole texts of all rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_rows, sliced
from ._text import LOWER, byte_table, slices, string_bytes, tidied, window_hash

N = 5
SLOTS_BITS = 21
HASHES = 2
MIN_DOCS = 3
PER_LANGUAGE = 1000
MAX_TRAIN_BYTES = 16384
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    """Languages in order of their bits; planes of 64 bits each, by slot; rates of false positives; shares of rows."""

    langs: list[str]
    planes: list[np.ndarray]
    false_rate: np.ndarray
    prior: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-byte grams of the lower-cased rows (a gram stays within its row and holds a letter or non-ASCII byte), and each one's row."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[data]
    room = np.maximum(np.diff(offsets) - n + 1, 0)
    ok = np.zeros(len(data) + 1, np.int32)
    np.add.at(ok, offsets[:-1][room > 0], 1)
    np.add.at(ok, (offsets[:-1] + room)[room > 0], -1)
    at = np.flatnonzero(np.cumsum(ok)[: len(data)] > 0)
    return window_hash(byte_table(5)[low], n, at), np.repeat(np.arange(len(room)), room)


def _slots(h: np.ndarray, j: int) -> np.ndarray:
    return (h >> np.uint64(j * 32)) & np.uint64((1 << SLOTS_BITS) - 1)


def fit(texts: list[bytes], langs: list[str]) -> Model:
    """Builds the filters; no rows give a model without languages."""
    names = sorted(set(langs))
    planes = [np.zeros(1 << SLOTS_BITS, _width(len(names) - at)) for at in range(0, len(names), 64)]
    prior = np.array([langs.count(x) for x in names], np.float64) / max(1, len(langs))
    rate = np.zeros(len(names))
    for i, name in enumerate(names):
        own = [t for t, x in zip(texts, langs) if x == name]
        found = []
        for t in own:
            found.append(np.unique(grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]))
        h, docs = np.unique(np.concatenate(found), return_counts=True)
        h = h[docs >= min(MIN_DOCS, len(own))]
        plane = planes[i // 64]
        bit = plane.dtype.type(1 << (i % 64))
        for j in range(HASHES):
            slot = np.unique(_slots(h, j)).astype(np.int64)
            plane[slot] |= bit
        rate[i] = (((plane & bit) != 0).mean()) ** HASHES
    return Model(names, planes, rate, prior)


def _width(n: int) -> type:
    return np.uint8 if n <= 8 else np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's language and its score: the language's corrected count over the sum of all."""
    rows = len(offsets) - 1
    h, row = grams(data, offsets)
    total = np.bincount(row, minlength=rows).astype(np.float64)
    shares = np.zeros((rows, len(model.langs)))
    edge = np.searchsorted(row, np.arange(rows + 1))
    full = np.flatnonzero(edge[1:] > edge[:-1])
    for p, plane in enumerate(model.planes):
        mask = plane[_slots(h, 0).astype(np.int64)]
        for j in range(1, HASHES):
            mask &= plane[_slots(h, j).astype(np.int64)]
        for i in range(64 * p, min(64 * p + 64, len(model.langs))):
            bits = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
            if len(full):
                shares[full, i] = np.add.reduceat(bits, edge[full], dtype=np.int64)
    shares = np.maximum(shares - total[:, None] * model.false_rate, 0) / (1 - model.false_rate)
    shares += 0.5 * model.prior  # rows without a known gram go by the training rows' shares
    best = shares.argmax(1) if len(model.langs) else np.zeros(rows, np.int64)
    return best, np.clip(shares[np.arange(rows), best] / np.maximum(shares.sum(1), 1e-12), 0, 1) if len(model.langs) else np.zeros(rows)


def has_letter(text: bytes) -> bool:
    raw = np.frombuffer(text[:64], np.uint8)
    if _LETTER[raw].any():
        return True
    if _LETTER[np.frombuffer(text, np.uint8)].any():
        return True
    return any(unicodedata.category(c)[0] == "L" for c in text.decode("utf-8", "replace") if c > "\x7f" and c != "�")


def train(df: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fits a model on a bounded sample of the rows with text and lang for which ``usable`` holds."""
    rows = df.where(usable & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(text).alias("thash"))
    # about twice as many as are wanted, by the hash, so that no language sends all its rows to one task
    share = F.broadcast(rows.groupBy("lang").agg((2.0 * PER_LANGUAGE / F.count("*")).alias("share")))
    rows = rows.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "thash")
    few = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= PER_LANGUAGE).select("doc_id", "lang", "thash").distinct()
    whole = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null")
    ids = F.broadcast(df.sparkSession.createDataFrame(few.toArrow()))  # PER_LANGUAGE rows of each language at most
    got = whole.withColumn("thash", F.xxhash64("text")).join(ids, ["doc_id", "lang", "thash"]).dropDuplicates(["doc_id", "lang", "thash"])
    got = got.select("doc_id", "thash", "lang", sliced(F.col("text"), MAX_TRAIN_BYTES).alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("thash", "ascending")])
    return fit([t.encode() for t in got["text"].to_pylist()], got["lang"].to_pylist())


def identify(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for each row.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
    learned; ties go to the language first in order; texts too short for an n-gram go by the training rows'
    shares; repeated rows stay; a null doc_id stays null; no rows give no rows; other columns aren't read.
    """
    arrow_rows(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)  # of fixed size by the number of languages

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column(1))
                best, score = predict(m, data, offsets)
                raw = data.tobytes()
                known = [bool(m.langs) and has_letter(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                names = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")

"""Source divergence audit: how the words of each source of a language differ from those of its other sources.

Terms are counted where the texts are, summed by (lang, term), and those of three documents at least kept. The
terms of a language are cut into blocks by hash, of a bounded number of counts each, so neither a source nor a
language has to fit anywhere. In a block, each source's counts become one compressed vector, and its local heap
ranks the terms that the source uses more than the language does.

Pairs of sources meet by a round-robin tournament (circle method: with n seats, an even number, seats i and j < n-1
meet in round (i + j) mod (n - 1), and the last seat meets the one that is left). Vectors stay in the partition that
a bucketed table gave them; in each round one of two that meet travels, compressed, to where the other stays, and the
meeting is evaluated both ways. A step runs ``ROUNDS`` rounds, so it sends at most half as many copies of a vector.

All arithmetic is on whole numbers. A share is found digit by digit, as count * 10^9 need not fit into 64 bits.
"""

from __future__ import annotations

import heapq
import math
import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_rows, maybe_broadcast, shared_dir, written
from ._text import string_bytes, tidied

LEAST_DOCS = 3
TOP = 200
ROUNDS = 8
#: Counts (a term of a source) that a block has, about.
BLOCK_COUNTS = 1 << 18
#: Counts that a task keeps before it passes them on.
KEPT_COUNTS = 400_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 20
#: Digits of a share: parts of 10^9.
DIGITS = 9
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RESULT = "lang string, source string, part string, item string, value long, rank int"


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; no term is cut."""
    at = 0
    plain = data.translate(_TERM_BYTES)
    while at < len(plain):
        end = at + PIECE
        if end < len(plain):
            end = plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents that hold it), of as many documents as memory allows at a time."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in n.items():
            d = docs[lang, source]
            keys = list(terms)
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)]
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        n.clear()
        docs.clear()

    for batch in batches:
        data, offsets = string_bytes(batch.column(2))
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, key in enumerate(zip(langs, sources)):
            terms, d = n.setdefault(key, Counter()), docs.setdefault(key, Counter())
            before, seen = len(terms), set()
            for found in pieces(data[offsets[i] : offsets[i + 1]].tobytes()):
                terms.update(found)
                seen.update(found)
            d.update(seen)
            held += len(terms) - before
            if held > KEPT_COUNTS:
                yield from passed_on()
                held = 0
    yield from passed_on()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, n, total (n of all sources), head (one row of each term), for terms in ``least`` documents of the language."""
    counted = docs.select("lang", "source", "text").mapInArrow(tidied(_counted), "lang string, source string, term string, n long, docs long")
    # one shuffle: sums by source and by term both keep the terms' partitioning
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")
    head = F.col("source") == F.min("source").over(by_term)
    out = summed.withColumns({"of": F.sum("docs").over(by_term), "total": F.sum("n").over(by_term), "head": head})
    return out.where(F.col("of") >= least).drop("of", "docs")


def shares(count: np.ndarray, of: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / of), exact; count + 1 <= of < 9 * 10^17."""
    rest, out = count + 1, np.zeros(len(count), np.int64)
    whole, rest = rest // of, rest % of
    for _ in range(DIGITS):
        rest *= 10
        digit = rest // of
        out = out * 10 + digit
        rest -= digit * of
    return 1 + whole * 10**DIGITS + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def packed(at: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending places and counts above 0, compressed."""
    steps = np.diff(at, prepend=0).astype(np.uint32)
    return struct.pack("<I", len(at)) + zlib.compress(steps.tobytes() + count.astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    raw = zlib.decompress(data[4:])
    return np.cumsum(np.frombuffer(raw, np.uint32, n).astype(np.int64)), np.frombuffer(raw, np.int64, n, 4 * n)


def meeting(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int, a_of: int, b_of: int) -> tuple[int, int]:
    """Sums of the divergences of a from b and of b from a over a block of ``size`` terms; ``_of`` is N + V of either."""
    if not size:
        return 0, 0
    at = np.union1d(a[0], b[0])
    ca, cb = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)  # the last one is for terms that neither has
    ca[np.searchsorted(at, a[0])] = a[1]
    cb[np.searchsorted(at, b[0])] = b[1]
    p, q = shares(ca, a_of), shares(cb, b_of)
    times = np.ones(len(at) + 1, np.int64)
    times[-1] = size - len(at)
    return int((divergence(p, q) * times).sum()), int((divergence(q, p) * times).sum())


def local_heap(terms: list[bytes], value: np.ndarray, top: int) -> list[tuple[int, bytes]]:
    """(value, term) of the largest values; ties to the smaller term."""
    if len(value) > top:
        least = np.partition(value, len(value) - top)[len(value) - top]
        may = np.flatnonzero(value >= least)
    else:
        may = np.arange(len(value))
    return [(-v, t) for v, t in heapq.nsmallest(top, ((-int(value[k]), terms[k]) for k in may))]


def _coded(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """The distinct strings in order of appearance, and which one each row has."""
    found, at = {}, np.empty(len(column), np.int64)
    for k, x in enumerate(column.to_pylist()):
        at[k] = found.setdefault(x, len(found))
    return list(found), at


_VECTOR = "lang string, block long, source string, seat long, seats long, of long, size long, vector binary, item string, value long"


def _block(top: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a block: a vector for each source of the language, and the terms at the top of each source."""
        lang, block = table["lang"][0], table["block"][0]
        groups = table.filter(pc.is_null(table["term"])).to_pylist()
        rows = table.filter(pc.is_valid(table["term"])).sort_by("term").combine_chunks()
        vocabulary, place = _coded(rows["term"])
        sources, source = _coded(rows["source"])
        n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
        order = np.argsort(source, kind="stable")  # of a source, places stay in order
        edges = np.searchsorted(source[order], np.arange(len(sources) + 1))
        own = {s: order[edges[k] : edges[k + 1]] for k, s in enumerate(sources)}
        none = np.zeros(0, np.int64)
        out = {name.split()[0]: [] for name in _VECTOR.split(", ")[2:]}

        def row(**values) -> None:
            for k, v in out.items():
                v.append(values.get(k))

        for g in groups:
            k = own.get(g["source"], none)
            of = (g["n"] or 0) + (g["v"] or 0)
            row(source=g["source"], seat=g["seat"], seats=g["seats"], of=of, size=len(vocabulary), vector=packed(place[k], n[k]))
            if len(k):
                p, q = shares(n[k], of), shares(total[k], g["lang_n"] + g["v"])
                up = np.flatnonzero(p > q)
                for value, term in local_heap([vocabulary[x].encode() for x in place[k[up]]], divergence(p[up], q[up]), top):
                    row(source=g["source"], item=term.decode(), value=value)
        schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _VECTOR.split(", ")])
        k = len(out["source"])
        return pa.Table.from_arrays([pa.array([lang.as_py()] * k, pa.string()), pa.array([block.as_py()] * k, pa.int64()), *(pa.array(v, schema.field(name).type) for name, v in out.items())], schema=schema)

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each meeting in a batch."""
    last, vector = None, None
    for b in batches:
        col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        of, peer_of, size = (col[c].to_pylist() for c in ("of", "peer_of", "size"))
        there, back = [], []
        for i in range(b.num_rows):
            stays = col["vector"][i].as_py()
            if stays != last:
                last, vector = stays, unpacked(stays)
            x, y = meeting(vector, unpacked(col["peer_vector"][i].as_py()), size[i], of[i], peer_of[i])
            there.append(x), back.append(y)
        for a, c, values in (("source", "peer", there), ("peer", "source", back)):
            yield pa.RecordBatch.from_arrays([col["lang"], col[a], col[c], pa.array(values, pa.int64())], ["lang", "source", "item", "value"])


def _tournament(vectors: DataFrame, most_seats: int, rounds: int) -> list[DataFrame]:
    """Tables of (lang, source, item, value): parts of the sums of each ordered pair of sources of a language."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, key = f"veilspan_{uuid.uuid4().hex}", ["lang", "block", "home"]
    path = f"{shared_dir(spark)}/{name}"
    resident = vectors.withColumnRenamed("seat", "home").select(*key, "source", "of", "size", "vector")
    resident.repartition(n, *key).write.bucketBy(n, *key).option("path", path).saveAsTable(name)
    stays = spark.table(name)
    last = F.col("seats") + F.col("seats") % 2 - 1  # the number of rounds, and the last seat
    met = F.pmod(F.col("round") - F.col("seat"), last)
    # the one left over meets the last seat; round / 2 is that one's seat, modulo the (odd) number of rounds
    alone = F.pmod(F.col("round") * F.expr("(seats + seats % 2) div 2"), last)
    peer = F.when(F.col("seat") == last, alone).when(met == F.col("seat"), last).otherwise(met)
    # of two that meet, each stays in about half of the meetings
    home = F.when((F.col("seat") + F.col("home")) % 2 == 0, F.least("seat", "home")).otherwise(F.greatest("seat", "home"))
    out = []
    for begin in range(0, most_seats + most_seats % 2 - 1, rounds):
        turn = F.explode(F.sequence(F.lit(begin), F.least(F.lit(begin + rounds), last) - 1))
        travels = vectors.where(last > begin).select("lang", "block", "seat", "seats", F.col("source").alias("peer"), F.col("of").alias("peer_of"), F.col("vector").alias("peer_vector"), turn.alias("round"))
        travels = travels.withColumn("home", peer).where((F.col("home") < F.col("seats")) & (home == F.col("home")))
        both = travels.join(stays, key).select("lang", "source", "of", "size", "vector", "peer", "peer_of", "peer_vector")
        sums = both.mapInArrow(tidied(_meetings), "lang string, source string, item string, value long")
        out.append(written(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    spark.sql(f"DROP TABLE {name}")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files, True)
    return out


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, rounds: int = ROUNDS, block_counts: int = BLOCK_COUNTS) -> DataFrame:
    """lang, source, part, item, value, rank; ``docs`` has lang, source and text.

    Part ``pair``: the divergence of the source from each other source of its language, all ranks. Part ``term``: the
    ``top`` terms that the source uses more than the language. Nulls are read as ''; a group whose texts have no terms
    takes part; repeated rows count as documents of their own; ties go to the smaller item by its UTF-8 bytes; without
    rows there is no result, and a language of one source has no pairs. Other columns aren't read.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(kept_terms(docs, least))
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("v"), F.sum("n").alias("lang_n"), F.ceil(F.count("*") / block_counts).alias("blocks"))
    by_lang = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumns({"seat": F.row_number().over(by_lang.orderBy("source")).cast("long") - 1, "seats": F.count("*").over(by_lang), "blocks": F.coalesce("blocks", F.lit(1)).cast("long")})
    groups = written(groups)
    blocks = maybe_broadcast(written(groups.where("seat = 0").select("lang", "blocks")))
    none = {c: F.lit(None).cast("long").alias(c) for c in ("n", "total", "v", "lang_n", "seat", "seats")}
    rows = kept.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "source", "n", "total", none["v"], none["lang_n"], none["seat"], none["seats"])
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), "source", "n", none["total"], "v", "lang_n", "seat", "seats")
    cut = written(rows.union(heads).groupBy("lang", "block").applyInArrow(_block(top), _VECTOR))
    most = groups.agg(F.max("seats")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = cut.where("item is not null").select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
    pairs = None
    for sums in _tournament(cut.where("vector is not null"), most, rounds):
        pairs = sums if pairs is None else pairs.union(sums)
    if pairs is None:
        return terms
    return terms.union(pairs.select("lang", "source", F.lit("pair"), "item", "value", rank))


ORACLE_SQL = r"""
with t as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
kept as (select lang, term from t group by lang, term having count(distinct row) >= 3),
counts as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
groups as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
v as (select lang, count(*) as v from kept group by lang),
whole as (select lang, term, sum(n) as n from counts group by all),
lang_n as (select lang, sum(n) as n from whole group by lang),
group_n as (select lang, source, sum(n) as n from counts group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (1000000000 * cast(coalesce(c.n, 0) + 1 as hugeint)) // cast(coalesce(gn.n, 0) + v.v as hugeint) as p
  from groups g join kept k on g.lang = k.lang join v on g.lang = v.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
  left join group_n gn on gn.lang = g.lang and gn.source = g.source),
q as (
  select w.lang, w.term, 1 + (1000000000 * cast(w.n + 1 as hugeint)) // cast(l.n + v.v as hugeint) as q
  from whole w join lang_n l on l.lang = w.lang join v on v.lang = w.lang),
pairs as (
  select a.lang, a.source, b.source as item,
         sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by all),
terms as (
  select p.lang, p.source, p.term as item, ((p.p - q.q) * (p.p - q.q)) // q.q as value
  from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
ranked as (
  select lang, source, 'pair' as part, item, value from (
    select a.lang, a.source, b.source as item, coalesce(pairs.value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source)
  union all
  select lang, source, 'term', item, value from terms)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from ranked)
where part = 'pair' or rank <= 200
"""

"""Suffix-array dedup by difference-cover blockwise construction.

Only suffixes at the residues of a difference cover modulo v are hashed first, not ranked: for any two
positions there is a shift under v that takes both to cover positions. So if the 200 bytes at
two places are equal, the suffixes at a pair of cover positions within them are equal over
200 - (v - 1) bytes. The cover sample is dealt to buckets and sorted one bucket at a time; a
sample suffix that ties with another over that length marks the places where a long tie
can be. Content-defined chunks that occur more than once are ties too, and only one of them
goes on. Then the suffixes around the ties that are left, and no others, are dealt to suffix
buckets by their first 200 bytes and sorted one bucket at a time. Memory is bounded by a bucket; the whole
suffix array is never held, nor written.

Suffixes are only compared over their first 200 bytes, as the result depends on no more. Keys
are 64-bit fingerprints of those bytes, so the order within a bucket is not alphabetical; ties
are what counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Spec, keyed, map_rows, repeated

LENGTH = 200
#: Mean bytes of a content-defined chunk.
CHUNK = 64


def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """A perfect difference set of q + 1 residues modulo q*q + q + 1, for a prime q, by Singer's rule.

    Powers of a generator of GF(q**3) whose first coordinate is zero, taken modulo the plane's size.
    """
    v = q * q + q + 1
    for c in range(q**3):
        poly = (c % q, c // q % q, c // (q * q))  # x**3 = p0 + p1 x + p2 x**2
        x, line = (1, 0, 0), []
        for k in range(v):
            if x[2] == 0:
                line.append(k)
            a, b, d = x
            x = (d * poly[0] % q, (a + d * poly[1]) % q, (b + d * poly[2]) % q)
        if len(line) == q + 1 and len({(a - b) % v for a in line for b in line}) == v:
            return v, tuple(line)
    raise ValueError("q must be prime")


def spec(length: int = LENGTH) -> Spec:
    """Covers of at most two thirds of the length, so that a tie of the sample is still long."""
    q = max(q for q in (1, 2, 3, 5, 7, 11, 13, 17, 19, 23) if q == 1 or q * q + q + 1 <= 2 * length // 3)
    v, cover = (1, (0,)) if q == 1 else difference_cover(q)
    return Spec("byte", length, length - v + 1, v, cover, CHUNK if length >= 32 else 0)


def dedup(df: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", keep_bytes: bool = False) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Gives a row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``keep_bytes`` the kept bytes. Matches never cross documents. Null and empty texts have no bytes
    and the hash of an empty string; a null doc_id stays null; repeated rows are copies of each
    other, so their strings repeat; no rows give no rows; other columns aren't read.
    """
    the = spec(length)

    def row(text: bytes, cover, _, __):
        at, kept = 0, []
        for a, b in zip(cover[0].tolist(), cover[1].tolist()):
            kept.append(text[at:a])
            at = b
        kept = b"".join([*kept, text[at:]])
        out = len(text), len(text) - len(kept), len(cover[0]), hashlib.sha256(kept).hexdigest()
        return (*out, kept) if keep_bytes else out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes
    return map_rows(repeated(keyed(df, text, doc_id), the), the, row, schema, columns)


#: The same result in SQL, by counting whole strings.
ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
windows AS (SELECT rid, i, md5(substr(hx, 2 * i + 1, 400)) AS h FROM (SELECT rid, hx, unnest(range(0, length(hx) // 2 - 199)) AS i FROM docs)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
marked AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM again),
islands AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM marked) GROUP BY rid, k),
cuts AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS back FROM islands),
heads AS (SELECT rid, string_agg(substr(hx, 2 * back + 1, 2 * (a - back)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS gone, count(*) AS n FROM cuts JOIN docs USING (rid) GROUP BY rid)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN heads USING (rid)
"""

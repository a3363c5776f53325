"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of 18 words, which make up the
index. Every rolling window of 18 words of every document probes it. A 35-word window always
holds a whole block of its own document, so two equal 35-word windows give a hit at least
once; hits are extended on both sides to all 35-word windows that contain them, and those
whose words also begin elsewhere are the repeats. Their union is the maximal exact repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Spec, keyed, map_rows, repeated

WINDOW = 35


def spec(window: int = WINDOW) -> Spec:
    block = (window + 1) // 2
    return Spec("word", window, block, block)


def dedup(df: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of words that also starts anywhere else.

    Gives a row for each input row: doc_id, n_words, n_removed, kept_sha256, and with ``keep_text``
    the kept words joined by a space. Words are runs of bytes other than the space and x09-x0D.
    Null and empty texts have no words and the hash of an empty string; a null doc_id stays null;
    repeated rows are copies of each other, so their windows repeat; no rows give no rows; other
    columns aren't read.
    """
    the = spec(window)

    def row(text: bytes, cover, starts, ends):
        n = len(starts)
        gone = int((cover[1] - cover[0]).sum())
        if not gone:
            kept = b" ".join(text.split())
        else:
            step = np.zeros(n + 1, np.int64)
            step[cover[0]] = 1  # the covered runs are apart from each other
            step[cover[1]] -= 1
            keep = np.cumsum(step)[:n] == 0
            kept = b" ".join([text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])
        out = n, gone, hashlib.sha256(kept).hexdigest()
        return (*out, kept.decode("utf-8", "replace")) if keep_text else out

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    columns = ["n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    return map_rows(repeated(keyed(df, text, doc_id), the), the, row, schema, columns)


#: The same result in SQL, by counting whole windows.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM docs)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM again),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)
"""

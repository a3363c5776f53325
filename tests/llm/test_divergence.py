import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspan.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least=3, top=200):
    """By dictionaries and Python's whole numbers."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df, count = Counter(), defaultdict(Counter)
        for _, source, text in (d for d in docs if d[0] == lang):
            found = TERM.findall(text.translate(LOWER))
            count[source].update(found)
            df.update(set(found))
        kept = [t for t, n in df.items() if n >= least]
        whole = Counter()
        for c in count.values():
            whole.update({t: c[t] for t in kept})

        def p(c):
            of = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // of for t in kept}

        shares, q = {s: p(c) for s, c in count.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = sorted(((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in count if o != s))
            terms = sorted((-f(shares[s][t], q[t]), t.encode()) for t in kept if count[s][t] and shares[s][t] > q[t])
            for part, rows in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(rows, 1)]
    return sorted(out)


def corpus(seed, sources, n=120):
    r = random.Random(seed)
    words = ["The", "tHe", "und", "é", "Éa", "x1y", "a_b", " ", "ß9", "日本", "퟿", "\U0001f600"] + [f"w{chr(97 + k)}" for k in range(20)]
    lang = lambda: r.choice(["en", "en", "de", None, ""])
    docs = [(lang(), r.choice(sources), " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for _ in range(n)]
    return docs + [("en", "only", None), ("fr", "a", "never kept"), ("fr", "b", ""), ("fr", "c", "123"), ("es", "one", "uno uno"), ("en", sources[0], "long " * 3000)] + docs[:5]


@pytest.mark.parametrize(("sources", "rounds", "block_counts"), [(["a", "b", None, ""], 1, 1 << 18), ([f"s{k}" for k in range(7)], 2, 20), ([f"s{k}" for k in range(12)], 8, 5), (["x"], 8, 100)])
def test_like_brute_force(spark, sources, rounds, block_counts):
    docs = corpus(len(sources), sources)
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "lang string, source string, text string, block int, term string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, 3, 5, rounds, block_counts).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(docs, 3, 5)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact():
    r = random.Random(1)
    for of in (1, 3, 7, 10**9 + 1, 8 * 10**17):
        count = [0, of - 1, *(r.randrange(of) for _ in range(50))]
        assert divergence.shares(np.array(count, np.int64), of).tolist() == [1 + 10**9 * (c + 1) // of for c in count]


def test_pieces_cut_no_term(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    text = "abcdefghij Kl mno-pqr é" * 3
    assert [t.decode() for part in divergence.pieces(text.encode()) for t in part] == TERM.findall(text.translate(LOWER))


def test_counts_passed_on_early_add_up(spark, monkeypatch):
    docs = corpus(3, ["a", "b"])
    rows = [(d[0] or "", d[1] or "", d[2] or "") for d in docs]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"])
    total = []
    for kept in (1, 10**6):
        monkeypatch.setattr(divergence, "KEPT_COUNTS", kept)
        n = Counter()
        for b in divergence._counted(iter([batch])):
            for x in b.to_pylist():
                n[x["lang"], x["source"], x["term"]] += 1000 * x["n"] + x["docs"]
        total.append(n)
    assert total[0] == total[1]

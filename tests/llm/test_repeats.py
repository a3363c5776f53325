import hashlib
import random
from collections import Counter

import pytest

from veilspan.llm import substring, suffix


def corpus(seed, word=("ab", "cd", "ef"), n=14, longest=60):
    r = random.Random(seed)
    base = [r.choice(word) for _ in range(longest)]
    out = []
    for i in range(n):
        a, b = sorted(r.sample(range(longest), 2))
        own = [r.choice(word) + str(r.randint(0, 99)) for _ in range(r.randint(0, 20))]
        out.append((i, " ".join(own[:5] + base[a:b] + own[5:])))
    same = out[0][1]
    return out + [(100, same), (100, same), (101, ""), (102, None), (None, out[1][1]), (103, "x " * 400)]


def words_brute(rows, n):
    each = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + n]) for _, w in each for k in range(len(w) - n + 1))
    out = []
    for i, w in each:
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                keep[k : k + n] = [False] * n
        out.append((i, len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest()))
    return sorted(out, key=repr)


def bytes_brute(rows, n):
    each = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + n] for _, b in each for k in range(len(b) - n + 1))
    out = []
    for i, b in each:
        keep = [True] * len(b)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                keep[k : k + n] = [False] * n
        spans = sum(1 for k in range(len(b)) if not keep[k] and (k == 0 or keep[k - 1]))
        out.append((i, len(b), keep.count(False), spans, hashlib.sha256(bytes(x for x, y in zip(b, keep) if y)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 2, 7, 35])
def test_words_like_brute_force(spark, window):
    rows = corpus(window)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ranges string").repartition(3)
    out = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(df, window).collect()]
    assert sorted(out, key=repr) == words_brute(rows, window)


@pytest.mark.parametrize("length", [2, 9, 40, 64, 200])
def test_bytes_like_brute_force(spark, length):
    rows = corpus(length, ("äb", "cd ", "e"), longest=200)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int").repartition(3)
    out = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df, length).collect()]
    assert sorted(out, key=repr) == bytes_brute(rows, length)


def test_a_passage_that_comes_in_parts_of_others(spark):
    """A window repeats only if it is whole elsewhere, not if its halves are."""
    a, b, c = ("w%d " % i for i in range(3))
    left, right = "".join("l%d " % i for i in range(20)), "".join("r%d " % i for i in range(20))
    rows = [(1, left + right), (2, left + a * 3), (3, b + right), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(df, 15).collect()]
    assert sorted(out, key=repr) == words_brute(rows, 15)
    assert [(r.doc_id, r.n_removed) for r in substring.dedup(df, 35).collect() if r.n_removed] == []


def test_kept_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "x b c d y")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substring.dedup(df, 3, keep_text=True).collect()} == {1: "a", 2: "x y"}
    assert substring.dedup(df.limit(0), 3).count() == 0
    assert suffix.dedup(df.limit(0), 3).count() == 0


def test_difference_cover():
    for q in (2, 3, 5, 7, 11):
        v, cover = suffix.difference_cover(q)
        assert v == q * q + q + 1 and len(cover) == q + 1
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))

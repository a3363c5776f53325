import random

import numpy as np
import pytest
import xxhash

from veilspan.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def brute(prints):
    """Smallest id reachable for each fingerprint."""
    nodes = sorted({f for _, f in prints})
    up = {f: f for f in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                up[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {f: least.get(root(f)) for f in nodes}


def test_like_brute_force(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 500)}" for _ in range(300)]
    rows = [(i, " ".join(base)) for i in range(5, 9)]
    for i in range(10, 60):  # near copies
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"z{r.randint(0, 9)}" for _ in range(r.randint(0, 6)))) for i in range(100, 160)]
    rows += [(200, None), (201, ""), (202, " \n"), (5, rows[0][1]), (None, "only here and nowhere else"), (None, rows[0][1]), (300, "A B"), (301, "a b")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    out = simhash.near_dedup(df).collect()
    expected = brute([(i, plain(t)) for i, t in rows])
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in out), key=repr)
    assert got == sorted(((i, f"{plain(t):016x}", expected[plain(t)]) for i, t in rows), key=repr)
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_hashes_like_the_library():
    r = np.random.default_rng(0)
    for n in range(1, 100):
        rows = r.integers(0, 256, (20, n)).astype(np.uint8)
        assert simhash.xxh64(rows).tolist() == [xxhash.xxh64_intdigest(x.tobytes(), 42) for x in rows]
    data = r.integers(0, 256, 3000).astype(np.uint8)
    a = r.integers(0, 1500, 500)
    b = a + np.where(np.arange(500) % 50, r.integers(1, 60, 500), 1400)
    assert simhash.shingle_hashes(data, a, b).tolist() == [xxhash.xxh64_intdigest(data[x:y].tobytes(), 42) for x, y in zip(a, b)]


@pytest.mark.parametrize(("paired", "widths"), [(2, (32, 24, 18, 14)), (32, (32, 24, 18, 14)), (2, (32,))])
def test_large_group_goes_through_blocks(spark, monkeypatch, paired, widths):
    """All fingerprints within a ball share keys; no link may get lost."""
    r = random.Random(1)
    centre = r.getrandbits(64)
    nodes = {centre}
    while len(nodes) < 400:
        x = r.choice(sorted(nodes)) if len(nodes) < 50 else centre
        nodes.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    nodes |= {r.getrandbits(64) for _ in range(50)}
    monkeypatch.setattr(simhash, "BLOCK", 60)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "WIDTHS", widths)
    signed = [int(np.array(n, np.uint64).view(np.int64)) for n in sorted(nodes)]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    up = {s: s for s in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in found:
        up[root(e.a)] = root(e.b)
    expected = brute([(i, s & (2**64 - 1)) for i, s in enumerate(signed)])
    pairs = {(root(s), expected[s & (2**64 - 1)]) for s in signed}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 40


def test_long_chain_is_one_component(spark):
    from veilspan.llm._shared import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    label = {r.node: r.label for r in components(edges).collect()}
    assert {label[i] for i in range(201)} == {0} and label[501] == 500
    assert components(edges.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(2, "one two three four", "a"), (1, "one two three four", "b"), (1, "one two three four", "b"), (None, "one two three four", "c"), (None, "alone in the world", "d"), (7, None, "e"), (8, "", "f")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(((r.doc_id, r.text, r.lang) for r in out), key=repr) == sorted([(1, "one two three four", "b"), (None, "alone in the world", "d"), (7, None, "e")], key=repr)

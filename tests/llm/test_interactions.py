import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from veilspan.llm import interactions


def brute(docs, labels):
    """Each order is played through, document by document."""
    good, toxic = {l[0] for l in labels if l[1] == 1}, {l[0] for l in labels if l[2] == 1}
    parts = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(o[0] is not None and i is not None and o[0] < i and (o[1] or "") == t for o in docs)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        parts[lang or ""].append((i, {k for k, v in fails.items() if v}))
    out = []
    for part, rows in parts.items():
        total = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                kept = [r for r in left if f not in r[1]]
                gone = [r for r in left if f in r[1]]
                failing = [r for r in rows if f in r[1]]
                total[f] += len(gone)
                sum_in = lambda ids: sum(r[0] is not None and r[0] in ids for r in gone)  # noqa: E731, B023
                found.append((part, "".join(order), step, len(kept), len(gone), len(failing) - len(gone), sum(len(r[1]) == 1 for r in failing), sum_in(good), sum_in(toxic), f))
                left = kept
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "ünd", "the", "X#", "of"]) + str(r.randint(0, 30))
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 1, 99, 100, 130]))), r.choice(["en", "de", None, ""])) for i in range(40)]
    docs += [(r.choice([i, i + 40, None]), t, r.choice(["en", lang])) for i, t, lang in docs[:20]]
    docs += [(200, None, "en"), (201, "", None), (7, docs[3][1], "en"), (None, None, "de"), (300, "  ", "xx"), (301, "w%d " * 5000, "xx")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_like_brute_force(spark):
    for seed in range(2):
        docs, labels = corpus(seed)
        d = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, lang string, mask int, sha string").repartition(3)
        lab = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, lang int").repartition(2)
        got = sorted(tuple(r) for r in interactions.audit(d, lab).collect())
        assert got == brute(docs, labels)


def test_empty_and_sums(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = interactions.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert {(r.filter_order[r.step - 1], r.shapley) for r in rows} == {("A", 120), ("B", 0), ("C", 0), ("D", 0), ("E", 0)}


def test_corners_and_integrals_of_random_counts():
    r = random.Random(5)
    for _ in range(20):
        counts = {m: r.randint(0, 9) for m in r.sample(range(32), r.randint(0, 32))}
        terms = interactions.polynomial(counts)
        for chosen in range(32):
            assert interactions.corner(terms, chosen) == sum(n for m, n in counts.items() if m & chosen)
        # all filters that a document fails share it equally
        for i in range(5):
            assert interactions.shapley(terms, i) * 60 == sum(n * 60 // m.bit_count() for m, n in counts.items() if m >> i & 1)


def test_hot_text_meets_as_few_rows(spark):
    text = spark.range(5000).selectExpr("id doc_id", "'same words' text", "'en' lang")
    labels = spark.range(0).selectExpr("id doc_id", "1 quality", "1 toxic")
    rows = {(r.mask, r.n) for r in interactions.mask_counts(text, labels).collect()}
    assert rows == {(1, 1), (1 + 16, 4999)}

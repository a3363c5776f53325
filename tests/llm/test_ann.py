import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import ann


def brute(rows, k, step):
    """rows: usable (id, vector); the k nearest of every id that step divides."""
    out = []
    each = sorted({(i, tuple(v)) for i, v in rows})
    for q, a in each:
        if q % step:
            continue
        d = sorted((float(np.sqrt(((np.array(a, np.float64) - np.array(b, np.float64)) ** 2).sum())), i) for i, b in each if i != q)
        out += [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(d[:k])]
    return sorted(out)


def run(df, k=10, step=5, **more):
    got = ann.nearest(df, F.col("vec_id") % step == 0, k, **more).collect()
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 3).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    fine = [r for r in rows if any(r[1])]
    odd = [(300, None), (305, [0.0, 0.0, 0.0]), (310, [1.0, None, 2.0]), (315, [float("nan"), 1.0, 1.0]), (320, [float("inf"), 1.0, 1.0]), (325, [1.0, 2.0]), (None, [1.0, 1.0, 2.0])]
    again = [fine[0], fine[3]]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows + odd + again], "vec_id long, embedding array<float>, rank string")
    assert run(df) == brute(fine, 10, 5)


def test_fewer_candidates_than_k_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert run(df) == brute([(0, (1, 0)), (5, (0, 1)), (6, (1, 1))], 10, 5)
    assert run(df.where("vec_id = 0")) == []
    assert run(df.limit(0)) == []


def test_doubles_keep_their_precision(spark):
    """Vectors that are equal as floats are told apart, with exact distances."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=4)
    rows = [(i, (base + 1e-10 * rng.normal(size=4)).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0, [1]) for i, v in rows], "vec_id long, embedding array<double>, bucket int, leaf string, score double, leaves array<int>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 5 == 0).collect()}
    for q, n, i, _ in brute(rows, 10, 5):
        d = 0.0
        for a, b in zip(rows[q][1], rows[i][1]):
            d += (a - b) ** 2
        assert got[q, n] == (i, d**0.5)


@pytest.mark.parametrize("bucket", [40, 8192])
def test_every_row_a_query_and_leaves_over_a_bucket(spark, monkeypatch, bucket):
    """More queries than rows in a bucket, and leaves that are cut into parts, lose nothing when all leaves are taken."""
    monkeypatch.setattr(ann, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(ann, "SAMPLE", 64)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(df, k=4, step=1, trees=3) == brute(rows, 4, 1)
    forest = ann.Forest(np.array([v for _, v in rows[:64]]), 3)
    leaves = [t.leaves(np.array([v for _, v in rows], np.float32)) for t in forest.trees]
    forest.place({(k, int(i)): int(n) for k, x in enumerate(leaves) for i, n in zip(*np.unique(x, return_counts=True))})
    for k, x in enumerate(leaves):
        size = np.bincount(forest.first[k][x], forest.parts[k][x] ** -1.0)
        assert size.max() <= bucket and sum(int(t.counts.sum()) for t in forest.trees) == 2100


def test_recall_of_a_bounded_search(spark):
    """Where vectors have neighbourhoods, a query that looks at a twentieth of the table finds nine in ten."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 6000)] + 0.2 * rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, share=0.05, least=0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & got[q])
    assert hit / 600 >= 0.9


def test_recall(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hit, total = hit + len(best & got[q]), total + 10
    assert hit / total >= 0.9

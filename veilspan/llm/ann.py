"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a bounded sample of the vectors by hyperplanes, along the direction between two
random vectors and at the median, down to small leaves; every vector of the table then falls
into one leaf of each tree. A query searches all trees through one priority queue, most
promising branch first, until the leaves it has taken hold enough vectors. The vectors of these
leaves are the candidates, and are reranked by their exact distances in double precision.

Equal vectors are one class: of a class only the k + 1 least ids can be among k neighbours, so
only these are kept, and equal queries are searched once.

Every vector is sent once a tree, however many queries there are. Leaves are grouped to buckets of up to
``BUCKET_ROWS`` vectors by their sizes in the whole table; a larger leaf is cut into parts of that
size by the vectors' hashes, and a query that takes the leaf goes to all of them. A task reads a bucket's
vectors first and then its queries as they come, so it holds a bucket and a batch of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import tidied
from ._shared import arrow_rows, salted_join, written

TREES = 10
LEAF = 32
#: Rows of the sample that the trees are built on; every row is indexed.
SAMPLE = 65536
#: Vectors that a query looks at in all trees together: this many, or this share of all if more.
SEARCH_ROWS = 5000
SEARCH_SHARE = 0.65
BUCKET_ROWS = 8192
_BLOCK = 256


class Tree:
    """Arrays over nodes: hyperplane, offset, children; children under 0 are leaves, -1 - leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        normals, offsets, children, counts = [], [], [], []

        def build(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(8):
                    a, b = sample[rng.choice(rows, 2, replace=False)].astype(np.float64)
                    w = a - b
                    size = np.sqrt(w @ w)
                    if not size:
                        continue
                    w = (w / size).astype(np.float32)
                    at = sample[rows] @ w
                    cut = np.float32(np.median(at))
                    low = at < cut
                    if low.any() and not low.all():
                        k = len(normals)
                        normals.append(w), offsets.append(cut), children.append(None)
                        children[k] = (build(rows[low]), build(rows[~low]))
                        return k
            counts.append(len(rows))
            return -len(counts)

        self.root = build(np.arange(len(sample)))
        d = sample.shape[1]
        self.normals = np.array(normals, np.float32).reshape(-1, d)
        self.offsets = np.array(offsets, np.float32)
        self.children = np.array(children, np.int64).reshape(-1, 2)
        self.counts = np.array(counts, np.float64)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while True:
            k = np.flatnonzero(node >= 0)
            if not len(k):
                return -1 - node
            at = node[k]
            right = np.einsum("ij,ij->i", x[k], self.normals[at]) >= self.offsets[at]
            node[k] = self.children[at, right.astype(np.int64)]


class Forest:
    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(sample.astype(np.float32), leaf, rng) for _ in range(trees)]

    def place(self, counts: dict[tuple[int, int], int]) -> None:
        """Deals the leaves to buckets by how many vectors of the table they hold: ``first`` is a leaf's bucket, or the first of its ``parts``."""
        self.first, self.parts, base = [], [], 0
        for k, t in enumerate(self.trees):
            t.counts = np.array([counts.get((k, leaf), 0) for leaf in range(len(t.counts))], np.float64)
            first, parts, room = np.zeros(len(t.counts), np.int64), np.ones(len(t.counts), np.int64), 0.0
            for leaf, n in enumerate(t.counts.tolist()):
                if n > room:
                    base += 1
                    parts[leaf] = max(1, -(-int(n) // BUCKET_ROWS))
                    first[leaf], room = base, max(0.0, BUCKET_ROWS - n)
                    base += int(parts[leaf]) - 1
                else:
                    first[leaf], room = base, room - n
            self.first.append(first), self.parts.append(parts)

    def search(self, queries: np.ndarray, enough: float) -> Iterator[list[tuple[int, int]]]:
        """The (tree, leaf) pairs that each query takes."""
        sides = [queries.astype(np.float32) @ t.normals.T - t.offsets for t in self.trees]
        for i in range(len(queries)):
            rows = [s[i].tolist() for s in sides]
            heap = [(float("-inf"), k, t.root) for k, t in enumerate(self.trees)]
            found, got = 0.0, []
            while heap and found < enough:
                m, k, node = heapq.heappop(heap)
                if node < 0:
                    got.append((k, -1 - node))
                    found += self.trees[k].counts[-1 - node]
                    continue
                d = rows[k][node]
                left, right = self.trees[k].children[node].tolist()
                heapq.heappush(heap, (max(m, -d), k, right))
                heapq.heappush(heap, (max(m, d), k, left))
            yield got


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


class Bucket:
    """The vectors of a bucket, and the ``keep`` nearest of them to queries, with exact distances."""

    def __init__(self, rows: list[pa.RecordBatch], dim: int, keep: int):
        v = pa.Table.from_batches(rows).combine_chunks()
        self.k1, self.k2, self.keep, self.dim = v["k1"].combine_chunks(), v["k2"].combine_chunks(), keep, dim
        self.x = _matrix(v["embedding"].combine_chunks(), dim).astype(np.float64)
        leaf = v["leaf"].to_numpy()
        self.low, self.high = int(leaf.min()), int(leaf.max()) + 1
        self.leaf, self.norm = leaf - self.low, (self.x * self.x).sum(1)

    def nearest(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y = _matrix(queries.column("embedding"), self.dim).astype(np.float64)
        taken = [np.frombuffer(b, "<i4") for b in queries.column("leaves").to_pylist()]
        for at in range(0, len(y), _BLOCK):
            block = y[at : at + _BLOCK]
            seen = np.zeros((len(block), self.high - self.low), bool)
            for i, t in enumerate(taken[at : at + _BLOCK]):
                seen[i, t[(t >= self.low) & (t < self.high)] - self.low] = True
            own = (block * block).sum(1)
            d = own[:, None] + self.norm - 2 * (block @ self.x.T)
            d[~seen[:, self.leaf]] = np.inf
            limit = np.partition(d, self.keep - 1, 1)[:, self.keep - 1] if d.shape[1] > self.keep else np.full(len(d), np.inf)
            # the products above have rounding errors; the exact distances decide
            i, j = np.nonzero((d <= (limit + 1e-9 * (own + self.norm.max()))[:, None]) & (d < np.inf))
            exact = np.sqrt(np.add.accumulate((block[i] - self.x[j]) ** 2, axis=1)[:, -1])
            q, v = pa.array(i + at), pa.array(j)
            yield pa.RecordBatch.from_arrays([queries.column("k1").take(q), queries.column("k2").take(q), self.k1.take(v), self.k2.take(v), pa.array(exact)], ["q1", "q2", "k1", "k2", "dist"])


def usable(df: DataFrame, vec: str, vec_id: str) -> DataFrame:
    """(vec_id, embedding, k1, k2) of rows that take part; k1 and k2 name the class of equal vectors.

    Components keep their precision: floats stay floats, all other numbers are doubles.
    """
    kind = "float" if df.select(vec).schema[0].dataType.simpleString() == "array<float>" else "double"
    e = F.col(vec).cast(f"array<{kind}>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    # adding zero makes -0.0 equal to 0.0
    same = F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))
    return rows.withColumns({"k1": F.xxhash64(same), "k2": F.xxhash64(F.lit(7), same)})


def nearest(df: DataFrame, is_query: Column, k: int = 10, vec: str = "embedding", vec_id: str = "vec_id", share: float = SEARCH_SHARE, trees: int = TREES, least: int = SEARCH_ROWS) -> DataFrame:
    """The k nearest found for each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    ``is_query`` is an expression on ``vec_id``. Candidates are all rows but those of the query's own id;
    repeated rows of an id and vector count once. Vectors that are null or zero, that hold null or
    non-finite components, or that haven't the most common dimension take no part, nor do null
    ids. Nearest first, ties to the smaller vec_id; with fewer than k candidates all that are found
    are returned. A table without usable rows gives no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    rows = usable(df, vec, vec_id)
    kind = rows.schema["embedding"].dataType.simpleString()
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = sizes[0] if sizes else 1
    rows = rows.where(F.size("embedding") == dim)
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    members = rows.dropDuplicates(["vec_id", "k1", "k2"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    members = written(members)
    classes = members.where("place = 1").select("k1", "k2", "embedding")
    sample = classes.orderBy("k1", "k2").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()  # keys are hashes, so this is a random sample
    if isinstance(sample, pa.ChunkedArray):
        sample = sample.combine_chunks()
    forest = Forest(_matrix(sample, dim), trees if len(sample) else 0)
    grown = spark.sparkContext.broadcast(forest)  # its size is bounded by SAMPLE

    @tidied
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), dim).astype(np.float32)
            leaves = np.stack([t.leaves(x) for t in grown.value.trees], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(leaves), pa.list_(pa.int32()))], ["k1", "k2", "embedding", "leaves"])

    placed = written(classes.mapInArrow(assign, f"k1 long, k2 long, embedding {kind}, leaves array<int>"))
    sizes = placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()  # a number for each leaf of the forest
    forest.place({(r[0], r[1]): r[2] for r in sizes})
    n = sum(r[2] for r in sizes if r[0] == 0)
    ship = spark.sparkContext.broadcast(forest)
    asked = rows.withColumn("is_query", is_query).where("is_query").select(F.col("vec_id").alias("query_id"), "k1", "k2", "embedding").dropDuplicates(["query_id", "k1", "k2"])
    queries = written(asked.select("k1", "k2", "embedding").dropDuplicates(["k1", "k2"]))
    enough = max(least, share * n)
    schema = f"bucket long, leaf int, leaves binary, k1 long, k2 long, embedding {kind}"
    names = ["bucket", "leaf", "leaves", "k1", "k2", "embedding"]

    @tidied
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = ship.value
        for b in batches:
            leaves = _matrix(b.column(3), len(f.trees))
            part = b.column(0).to_numpy().view(np.uint64)
            for k in range(len(f.trees)):
                leaf = leaves[:, k]
                bucket = f.first[k][leaf] + (part % f.parts[k][leaf].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(leaf), pa.nulls(len(leaf), pa.binary()), *b.columns[:3]], names)

    @tidied
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = ship.value
        for b in batches:
            row, bucket, leaves = [], [], []
            for i, got in enumerate(f.search(_matrix(b.column(2), dim), enough)):
                by: dict[int, list[int]] = {}
                for k, leaf in got:
                    for g in range(f.first[k][leaf], f.first[k][leaf] + f.parts[k][leaf]):
                        by.setdefault(g, []).append(leaf)
                for g, some in by.items():
                    row.append(i), bucket.append(g), leaves.append(np.array(some, "<i4").tobytes())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.nulls(len(row), pa.int32()), pa.array(leaves, pa.binary()), *[c.take(at) for c in b.columns]], names)

    @tidied
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, ready = None, [], None
        for b in batches:
            bucket, query = b.column(0).to_numpy(), b.column(2).is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (query[1:] != query[:-1]))).tolist() if len(bucket) else []
            for at, end in zip(edge, [*edge[1:], len(bucket)]):
                part = b.slice(at, end - at)
                if bucket[at] != now:
                    now, rows, ready = bucket[at], [], None
                if not query[at]:
                    rows.append(part)
                elif rows:
                    ready = ready or Bucket(rows, dim, k + 1)
                    yield from ready.nearest(part)

    both = placed.mapInArrow(index, schema).union(queries.mapInArrow(probe, schema))
    # a bucket's vectors, and after them its queries
    ranked = both.repartition("bucket").sortWithinPartitions("bucket", F.col("leaves").isNotNull()).mapInArrow(rerank, "q1 long, q2 long, k1 long, k2 long, dist double")
    # a candidate can come from several trees; of the classes only the nearest k + 1 matter, with all ties
    best = ranked.dropDuplicates(["q1", "q2", "k1", "k2"]).withColumn("r", F.rank().over(Window.partitionBy("q1", "q2").orderBy("dist"))).where(F.col("r") <= k + 1)
    ids = members.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    found = best.join(ids, ["k1", "k2"]).select("q1", "q2", "dist", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q1", "q2").orderBy("dist", "vec_id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = found.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("dist", "vec_id"))).alias("near"))
    key = F.struct("k1", "k2")
    sizes = asked.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    table = written(lists.withColumnsRenamed({"q1": "k1", "q2": "k2"}).join(sizes, ["k1", "k2"]).select(key.alias("key"), "near", "n"))
    out = salted_join(asked.select("query_id", key.alias("key")), table, "key", "query_id")
    out = out.select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    out = out.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.dist").alias("score"))


#: The same result in SQL: the exact neighbours, which the search also finds where SEARCH_ROWS covers the table.
ORACLE_SQL = """
WITH fine AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum([(q.e[i] - v.e[i]) * (q.e[i] - v.e[i]) FOR i IN range(1, len(q.e) + 1)])) AS score
  FROM fine q JOIN fine v ON q.vec_id <> v.vec_id AND q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

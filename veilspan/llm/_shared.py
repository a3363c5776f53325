"""What the operators share on the Spark side: shared-folder tables, guarded broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import dropped, shared_dir, written

__all__ = ["dropped", "shared_dir", "written"]

#: A side is broadcast only if its written table has no more bytes than this.
BROADCAST_BYTES = 16 << 20
#: A key is hot if it has more than this share of the rows; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.001
SALTS = 64
_ARROW_ROWS = "1000"


def arrow_rows(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as rows can be long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _ARROW_ROWS)


def sliced(text: Column, most: int) -> Column:
    """A text of up to ``most`` bytes as it is; of a longer one a stretch of about ``most`` bytes, at a place given by its hash."""
    length = F.length(text)
    take = F.floor(length.cast("long") * most / F.octet_length(text)).cast("int")
    start = F.pmod(F.xxhash64(text), F.greatest(length - take, F.lit(1))).cast("int")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, start + 1, take))


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size; for a scan, its files' bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def maybe_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its files are small enough; else as it is, for a shuffled join."""
    return F.broadcast(table) if plan_bytes(table) <= limit else table


def buckets_for(df: DataFrame, per_bucket: int) -> int:
    """As many buckets as keep each near ``per_bucket`` bytes of input, and four a shuffle partition at least.

    Where Spark knows no size (frames that aren't files), the texts are measured.
    """
    spark, size = df.sparkSession, plan_bytes(df)
    if size >= 1 << 50:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_bucket))


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than HOT_SHARE of the rows: 1 / HOT_SHARE rows at most, whatever the input's size.

    ``df`` has columns ``key`` and ``n`` (rows of the key) and is a written table.
    """
    total = df.agg(F.sum("n")).first()[0] or 0
    return df.where(F.col("n") > F.lit(total * HOT_SHARE)).select(F.col(key), F.lit(True).alias("hot"))


def salted_join(rows: DataFrame, table: DataFrame, key: str, salt_by: str, how: str = "inner") -> DataFrame:
    """``rows`` join ``table`` on ``key``. The table is written, has one row for each key, and in column ``n``
    how many rows the key has. Rows of hot keys are dealt to SALTS tasks, the table's few hot rows are copied to them."""
    hot = F.broadcast(hot_keys(table, key))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(salt_by, key), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(hot, key, "left").withColumn("salt", salt).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    table = table.drop("n").join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return rows.join(table, [key, "salt"], how).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) as rows (node, label), label the smallest node reachable.

    Labels go along links and are shortened by pointer jumping, so a long chain takes about
    log(length) rounds. Each round is a table in the shared folder. Nothing is collected but a
    count. Both sides of each join are plain scans, so AQE can split a hub's rows.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(None).cast("long").alias("was")))
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = written(labels.drop("was").join(up, "label").select("node", F.least("label", "up").alias("label"), F.col("label").alias("was")))
        near = both.join(jumped.select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        new = written(
            near.union(jumped.select("node", "label", "was"))
            .groupBy("node")
            .agg(F.min("label").alias("label"), F.max("was").alias("was"))
        )
        dropped(labels, jumped)
        if new.where(F.col("label") != F.col("was")).limit(1).count() == 0:
            dropped(both)
            return new.select("node", "label")
        labels = new

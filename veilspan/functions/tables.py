"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and everything runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def parts(spark: SparkSession) -> int:
    """Partitions for work that costs more than its rows' bytes tell: as many as a shuffle has, each core with one at least.

    A number that is asked for isn't lowered by adaptive execution, which goes by bytes.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Few bytes that much work comes from (a table's keys, say, which a file may hold in one piece) dealt to ``parts`` partitions."""
    return rows.repartition(parts(rows.sparkSession), *by)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession) -> str:
    """An empty folder in the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/veilspan-{uuid.uuid4().hex}"
    files, p = _files(spark, path)
    files.mkdirs(p)
    files.deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The table is removed when the driver's JVM ends, or by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, p = _files(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        files, p = _files(t.sparkSession, t.written_to)
        files.delete(p, True)

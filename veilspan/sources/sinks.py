"""A sink for restored streams that a restart doesn't repeat: format ``veilspan_stream``.

Each task writes its rows to a file of its own name; a micro-batch counts when a list of its files stands under the
micro-batch's number. One that runs again after a failure finds the list of its first run and leaves that as it is; files that no list
names (of tasks that failed or ran twice) are never read. Every reader therefore sees each micro-batch once and whole.
The folder is reached through Arrow's file systems, so it can be local or shared (file, HDFS, object stores).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "veilspan_stream"
_ROWS, _LISTS = "rows", "lists"


@dataclass
class Part(WriterCommitMessage):
    """A task's file; none if it had no rows."""

    name: str | None
    rows: int


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str, schema: StructType):
        self._uri, self._names = path, schema.fieldNames()

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        files, path = pafs.FileSystem.from_uri(self._uri)
        return files, path.rstrip("/")

    def write(self, iterator: Iterator) -> Part:
        """On an executor: a line of JSON for each row."""
        files, path = self._folder()
        name, rows, out = f"{uuid.uuid4().hex}.json", 0, None
        try:
            for row in iterator:
                if out is None:
                    files.create_dir(f"{path}/{_ROWS}", recursive=True)
                    out = files.open_output_stream(f"{path}/{_ROWS}/{name}")
                out.write((json.dumps(dict(zip(self._names, row)), ensure_ascii=False) + "\n").encode())
                rows += 1
        finally:
            if out is not None:
                out.close()
        return Part(name if rows else None, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        files, path = self._folder()
        target = f"{path}/{_LISTS}/{batchId:020d}.json"
        if files.get_file_info(target).type != pafs.FileType.NotFound:
            self.abort(messages, batchId)  # it has been committed before
            return
        files.create_dir(f"{path}/{_LISTS}", recursive=True)
        # a list with a point before its name isn't read
        own = f"{path}/{_LISTS}/.{uuid.uuid4().hex}"
        with files.open_output_stream(own) as out:
            for m in messages:
                if m is not None and m.name:
                    out.write((json.dumps({"epoch": batchId, "file": m.name, "rows": m.rows}) + "\n").encode())
        files.move(own, target)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        files, path = self._folder()
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{path}/{_ROWS}/{m.name}")


class StreamSink(DataSource):
    """Option ``path``: the folder, as a path or a URI."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], schema)


def write_stream(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a query that writes a stream's rows (simple columns) to the folder."""
    rows.sparkSession.dataSource.register(StreamSink)
    return rows.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed micro-batches, and the number of each (epoch)."""
    lists = spark.read.schema("epoch long, file string, rows long").json(f"{path}/{_LISTS}")
    rows = spark.read.schema(schema).json(f"{path}/{_ROWS}").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(lists.select(F.col("file").alias("_file"), "epoch"), "_file").drop("_file")


def bodies(rows: DataFrame, between: str = "") -> DataFrame:
    """Each request's body: its rows (request_id, seq, part, text) in order. ``between`` is "\\n" for the lines of an event stream."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "part", "text")))  # of a response, which is bounded
    return rows.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), between).alias("body"))

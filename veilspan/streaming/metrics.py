"""Operational metrics of a session stream: observed in each micro-batch, added up by a listener, written as metric text.

Counters begin at 0 with the listener, as a process's do. Gauges of the store (sessions, tombstones, bytes, waiting
requests) are absolute: they begin with what the state store of a checkpoint holds (``stored``), and go on by the changes that
answers carry, so no state is read while the stream runs. A micro-batch that is reported twice counts once.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.masking import CONSUMER_DEFAULT, Policy
from .keyed import METERS, answer_stream
from .sessions import SESSION_OVERHEAD

#: Outcomes of requests that a counter counts.
OUTCOMES = {
    "process_mask_total": ("mask",),
    "process_demask_total": ("demask",),
    "process_retry_total": ("retry",),
    "process_rate_limited_total": ("full",),
    "process_conflict_total": ("conflict",),
    "process_error_total": ("error",),
}
#: Further metrics, and the meter that each is the sum of.
SUMS = {
    "process_new_id_total": "new_ids",
    "store_evictions_total": "evicted",
    "store_sessions": "sessions",
    "store_pending": "pending",
    "store_tombstones": "tombstones",
    "store_bytes": "bytes",
}
#: All metrics in the order in which they are written, with their type.
KINDS = {
    "uptime_seconds": "gauge",
    **{name: "counter" for name in OUTCOMES},
    **{name: "counter" if name.endswith("_total") else "gauge" for name in SUMS},
    "trigger_delay_ms": "gauge",
}


def measures() -> list:
    """The aggregates of METERED rows that make up the metrics."""
    counts = [F.count_if(F.col("outcome").isin(*names)).alias(name) for name, names in OUTCOMES.items()]
    return counts + [F.coalesce(F.sum(meter), F.lit(0)).alias(name) for name, meter in SUMS.items()]


def recount(answers: DataFrame) -> DataFrame:
    """The counters and changes of gauges of METERED rows, as one row: what the listener comes to."""
    return answers.agg(*measures())


def process_stream(events: DataFrame, name: str, policy: Policy = CONSUMER_DEFAULT, late: str = "1 minute", wait: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """``keyed.process_stream`` under observation ``name``, which a ``Metrics`` of the same name listens to."""
    first, *others = measures()
    out = answer_stream(events, policy, late, wait, initial).observe(name, first, *others)
    return out.where("status is not null").drop(*METERS)


def stored(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """The gauges of the store, counted from the state of a stopped stream's checkpoint; a value for each gauge."""
    read = spark.read.format("statestore").option("path", checkpoint)
    session = read.option("stateVarName", "session").load().select("key.payload_id", "value.*")
    size = F.octet_length("original") + F.octet_length("masked") + F.octet_length("payload_id") + SESSION_OVERHEAD
    kept = session.agg(F.count_if(~F.col("gone")).alias("store_sessions"), F.count_if("gone").alias("store_tombstones"), F.coalesce(F.sum(F.when(~F.col("gone"), size)), F.lit(0)).alias("store_bytes")).first()
    waiting = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "inbox").load()
    return kept.asDict() | {"store_pending": waiting.count()}


class Metrics(StreamingQueryListener):
    """Adds up what the streams under one observation report.

    Add it to a session with ``spark.streams.addListener``. ``interval`` is the trigger's, in seconds: the delay is by how much
    the latest micro-batch took longer than that. ``begin`` are gauges to begin with.
    """

    def __init__(self, name: str, begin: dict[str, int] | None = None, interval: float = 0.0, clock: Callable[[], float] = time.monotonic):
        self._name, self._interval, self._clock, self._began = name, interval, clock, clock()
        self._totals = dict.fromkeys([*OUTCOMES, *SUMS], 0) | (begin or {})
        self._seen: dict[str, int] = {}
        self._delay, self._lock = 0.0, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self._name)
        if row is None:
            return
        self.add(str(progress.id), progress.batchId, row.asDict(), float(progress.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def add(self, query: str, batch: int, changes: dict[str, int], took_ms: float) -> None:
        """One micro-batch's report; of a query, batches come in order, and an idle trigger repeats the last one's number."""
        with self._lock:
            if batch <= self._seen.get(query, -1):
                return
            self._seen[query] = batch
            for name, n in changes.items():
                self._totals[name] += n or 0
            self._delay = max(0.0, took_ms - self._interval * 1000)

    def values(self) -> dict[str, float]:
        with self._lock:
            return {"uptime_seconds": round(self._clock() - self._began, 3), **self._totals, "trigger_delay_ms": self._delay}

    def text(self, prefix: str = "veilspan") -> str:
        """All metrics as metric text, each with its type."""
        values = self.values()
        return "".join(f"# TYPE {prefix}_{name} {kind}\n{prefix}_{name} {values[name]}\n" for name, kind in KINDS.items())

    def write(self, spark: SparkSession, path: str, prefix: str = "veilspan") -> None:
        """Replaces the file at ``path`` as a whole, for collectors that read text files: readers see the old or the new one."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target, own = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
        out = files.create(own, flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
        out.write(bytearray(self.text(prefix).encode()))
        out.close()
        renames = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        renames[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        files.rename(own, target, renames)

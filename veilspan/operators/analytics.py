"""Analytics over load results, profiles and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_report(results: DataFrame, by: tuple[str, ...] = ("op",), latency: str = "latency") -> DataFrame:
    """Count, failures, mean and exact percentiles (linear between ranks) for each group and in total (nulls)."""
    failed = F.sum(F.when(F.col("success"), 0).otherwise(1)) if "success" in results.columns else F.lit(0)
    marks = [F.percentile(latency, q).alias(name) for name, q in QUANTILES.items()]
    return results.rollup(*by).agg(F.count("*").alias("n"), failed.alias("failed"), F.avg(latency).alias("mean"), *marks)


def throughput(results: DataFrame, by: str = "phase", seconds: str = "seconds") -> DataFrame:
    """Requests a second by phase, from the phase's span."""
    rows = results.groupBy(by).agg(F.count("*").alias("n"), F.max(seconds).alias("last"), F.min(seconds).alias("first"))
    return rows.select(by, "n", F.try_divide(F.col("n"), F.col("last") - F.col("first")).alias("rps"))


def windowed_counts(events: DataFrame, ts: str = "ts", every: str = "1 minute", by: str = "event_type", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts in tumbling (or, with ``slide``, sliding) windows; ``late`` sets a watermark for streams."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    return rows.groupBy(w.alias("w"), by).count().select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, F.col("count").alias("n"))


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "15 minutes") -> DataFrame:
    """Sessions of a key: neighbouring events less than a gap apart."""
    rows = events.groupBy(F.session_window(ts, gap).alias("w"), key).count()
    return rows.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), F.col("count").alias("n"))


def categorise(frames: Column, rules: list[tuple[str, list[str]]], idle_if: str | None = None, busy: tuple[str, ...] = ()) -> Column:
    """The category of a stack (frames from root to leaf): of the first frame from the leaf up that a rule fits.

    A stack with a frame of ``idle_if`` and none of ``busy`` is Idle; one that no rule fits is Other.
    """

    def has(frame: Column, words) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | frame.contains(w)
        return hit

    def of(frame: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(rules):
            out = F.when(has(frame, words), name).otherwise(out)
        return out

    found = F.filter(F.transform(F.reverse(frames), of), lambda c: c.isNotNull())
    out = F.coalesce(F.get(found, F.lit(0)), F.lit("Other"))
    if idle_if:
        idle = F.exists(frames, lambda f: f.contains(idle_if)) & ~F.exists(frames, lambda f: has(f, busy))
        out = F.when(idle, "Idle").otherwise(out)
    return out


def profile_shares(stacks: DataFrame, category: Column) -> DataFrame:
    """Samples and share of each category."""
    total = F.sum("samples").over(Window.partitionBy(F.lit(1)))  # a row for each category
    return stacks.groupBy(category.alias("category")).agg(F.sum("count").alias("samples")).withColumn("share", F.col("samples") / total)


def top_functions(stacks: DataFrame, category: Column, n: int = 25) -> DataFrame:
    """The n functions (leaf frames) with the most samples."""
    leaf = F.try_element_at("frames", F.lit(-1))
    return stacks.groupBy(category.alias("category"), leaf.alias("function")).agg(F.sum("count").alias("samples")).orderBy(F.desc("samples"), "category", "function").limit(n)


def merge_intervals(spans: DataFrame, by: str = "doc_id", gap: int = 2) -> DataFrame:
    """Spans (start, end) of a key merged where the gap is ``gap`` at most."""
    order = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reach + gap, 0).otherwise(1)
    island = F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # equal spans are of one island, whichever comes first
    return spans.withColumn("_new", new).withColumn("_k", island).groupBy(by, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")


def exporter(counters: DataFrame, prefix: str = "veilspan") -> DataFrame:
    """Lines of metric text from rows (name, value)."""
    return counters.orderBy("name").select(F.concat(F.lit(f"{prefix}_"), "name", F.lit(" "), F.col("value").cast("string")).alias("value"))


def echo_report(texts: DataFrame, text: str = "text") -> DataFrame:
    """What a back end that only echoes would see: placeholders, and raw e-mails left in the text."""
    from ..functions import spans as S

    t = F.col(text)
    return texts.withColumns({"placeholders": F.size(F.regexp_extract_all(t, F.lit(S.PLACEHOLDER), F.lit(0))), "raw_emails": F.size(S.email(t))})

"""Strict span quality: detected against annotated entities, and ratios over them."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "span_errors", "type_errors", "partial_leaks", "overmasking")
_ROW = "array<struct<pii_type:string," + ",".join(f"{c}:int" for c in COUNTS) + ">>"


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_join(a: DataFrame, b: DataFrame, by: str = "doc_id", width: int = 64) -> DataFrame:
    """All pairs of spans of ``a`` and ``b`` in the same document that overlap, with the length ``common`` of what they share.

    Both have columns ``by``, start and end (not empty); other columns stay, and must differ. Spans meet in cells of
    ``width`` characters, so a document with very many spans is cut into as many join keys as it is long; a
    pair that shares several cells counts in the first.
    """

    def cells(rows: DataFrame, side: str) -> DataFrame:
        low, high = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
        rows = rows.where(F.col("start") < F.col("end")).withColumns({"_cell": F.explode(F.sequence(low, high)), f"_from_{side}": low})
        return rows.withColumnsRenamed({"start": f"_start_{side}", "end": f"_end_{side}"})

    both = cells(a, "a").join(cells(b, "b"), [by, "_cell"])
    common = overlap(F.col("_start_a"), F.col("_end_a"), F.col("_start_b"), F.col("_end_b"))
    both = both.withColumn("common", common).where((F.col("common") > 0) & (F.col("_cell") == F.greatest("_from_a", "_from_b")))
    return both.drop("_cell", "_from_a", "_from_b", "_start_a", "_end_a", "_start_b", "_end_b")


def _common(a: tuple, b: tuple) -> int:
    return max(0, min(a[2], b[2]) - max(a[1], b[1]))


def match_case(expected: Iterable[tuple[str, int, int]], actual: Iterable[tuple[str, int, int]]) -> dict[str, dict[str, int]]:
    """Counts by entity type for one case; entities are (type, start, end).

    Expected entities choose in order among the actual ones that are left: the exact one if there
    is one, else the one with the largest overlap, the first of equals. Wrong span, wrong type, a miss
    and an extra one are told apart; errors count for the expected entity's type, extras for their own.
    """
    want, have = list(expected), list(actual)
    out: dict[str, dict[str, int]] = {}
    used: set[int] = set()

    def add(kind: str, what: str) -> None:
        out.setdefault(kind, dict.fromkeys(COUNTS, 0))[what] += 1

    for e in want:
        free = [i for i in range(len(have)) if i not in used]
        exact = next((i for i in free if have[i] == e), None)
        best = exact if exact is not None else max((i for i in free if _common(e, have[i])), key=lambda i: _common(e, have[i]), default=None)
        if best is None:
            add(e[0], "fn")
        else:
            used.add(best)
            a = have[best]
            add(e[0], "tp" if a == e else "span_errors" if a[0] == e[0] else "type_errors")
        # what stays readable, and what is hidden beyond need, by text rather than by match
        if sum(_common(e, a) for a in have) < e[2] - e[1]:
            add(e[0], "partial_leaks")
    for i, a in enumerate(have):
        if i not in used:
            add(a[0], "fp")
        first = next((e for e in want if _common(e, a)), None)
        if first and (a[1] < first[1] or a[2] > first[2]):
            add(first[0], "overmasking")
    return out


def case_counts(expected: Column, actual: Column) -> Column:
    """``match_case`` for arrays of structs (type or pii_type, start, end); an array with a row for each type.

    The matching is sequential within a case, so it runs as one Arrow function of a row.
    """

    @F.pandas_udf(_ROW)
    def run(want: pd.Series, have: pd.Series) -> pd.Series:
        def one(e, a):
            got = match_case([tuple(x.values()) for x in (e if e is not None else [])], [tuple(x.values()) for x in (a if a is not None else [])])
            return [{"pii_type": k, **v} for k, v in got.items()]

        return pd.Series([one(e, a) for e, a in zip(want, have)], dtype=object)

    def plain(c: Column, kind: str) -> Column:
        return F.transform(c, lambda x: F.struct(x[kind].alias("kind"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))

    return run(plain(expected, "type"), plain(actual, "pii_type"))


def ratios(rows: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and exact_span; span and type errors count against both, empty sums give 0."""
    wrong = F.col("span_errors") + F.col("type_errors")
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp") + wrong), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn") + wrong), F.lit(0.0))
    exact = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + wrong), F.lit(0.0))
    return rows.withColumns({"precision": p, "recall": r, "exact_span": exact}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def quality(cases: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """From rows with ``expected`` and ``actual``: counts and ratios by dataset and type, with totals (null type)."""
    each = cases.select(*by, F.inline(case_counts(F.col("expected"), F.col("actual"))))
    return rollup(each, by)


def rollup(each: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    sums = each.rollup(*by, "pii_type").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return ratios(sums)


def quality_metrics():
    """precision, recall, exact_span and f1 of a group's counts, as a grouped aggregate function over (tp, fp, fn, wrong).

    A group comes to one task whole, so sum long tables first (``quality_table`` does); in SQL it is quality_metrics(...) after ``sql.register``.
    """

    @F.pandas_udf("array<double>")
    def metrics(tp: pd.Series, fp: pd.Series, fn: pd.Series, wrong: pd.Series) -> list:
        hit, false, missed, near = (int(x.sum()) for x in (tp, fp, fn, wrong))

        def share(part: float, of: float) -> float:
            return part / of if of else 0.0

        p, r = share(hit, hit + false + near), share(hit, hit + missed + near)
        return [p, r, share(hit, hit + near), share(2 * p * r, p + r)]

    return metrics


def quality_table(each: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """``rollup`` by the aggregate function: what each task has of a group is summed before, so the function sees as many rows as there were tasks at most."""
    wrong = F.sum(F.col("span_errors") + F.col("type_errors")).alias("wrong")
    parts = each.withColumn("_part", F.spark_partition_id()).groupBy(*by, "pii_type", "_part").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], wrong)
    out = None
    keys = [*by, "pii_type"]
    for n in range(len(keys), -1, -1):  # the aggregate function can't be used with ROLLUP
        have = [F.col(c) if c in keys[:n] else F.lit(None).cast("string").alias(c) for c in keys]
        one = parts.groupBy(*keys[:n]).agg(quality_metrics()("tp", "fp", "fn", "wrong").alias("m")).select(*have, "m")
        out = one if out is None else out.union(one)
    return out.select(*keys, *[F.get("m", F.lit(i)).alias(c) for i, c in enumerate(("precision", "recall", "exact_span", "f1"))])


def macro_micro(table: DataFrame) -> DataFrame:
    """macro_f1: the mean over types; micro_f1: of the totals, from the rows of ``quality``."""
    rows = table.where("dataset is not null")
    return rows.groupBy("dataset").agg(F.avg(F.when(F.col("pii_type").isNotNull(), F.col("f1"))).alias("macro_f1"), F.max(F.when(F.col("pii_type").isNull(), F.col("f1"))).alias("micro_f1"))


def organiser_score(should_mask: Column, masked: Column, original: Column, expected: Column) -> Column:
    """An approximation: 0 if nothing was masked, 0.5 if a case without entities was, else one less the edit distance over the longer length."""
    longest = F.greatest(F.length(masked), F.length(expected))
    near = F.lit(1.0) - F.levenshtein(masked, expected) / longest
    return F.when(masked == original, 0.0).when(~should_mask, 0.5).when(longest == 0, 1.0).otherwise(near)


def ratchet(table: DataFrame, baseline: DataFrame, slack: float = 0.01, least_recall: float = 0.50, least_exact: float = 0.70) -> DataFrame:
    """Totals by dataset that fall under their baseline (columns dataset, f1) by more than the slack, or under the floors."""
    now = table.where("dataset is not null and pii_type is null").join(baseline.select("dataset", F.col("f1").alias("baseline")), "dataset")
    return now.where((F.col("f1") < F.col("baseline") - slack) | (F.col("recall") < least_recall) | (F.col("exact_span") < least_exact))

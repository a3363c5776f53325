"""Filter interaction audit: what five quality filters remove in each of their 120 orders, and what each is worth.

A document is reduced to the mask of the filters that it fails, so all that is kept of the corpus are counts by
part and mask (32 at most for a part). For a part, R(x) = sum over masks m of count(m) * (1 - product over i in
m of (1 - x_i)) is how many documents go if filter i is applied to the share x_i: the multilinear extension of
"removed by a set of filters". Its value at a corner of the cube is the removal of a set, which gives all steps of
all orders; the integral of its derivative in x_i along the diagonal is filter i's Shapley value.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Documents without doc_id have no labels; they are dealt to so many groups in the join with them.
SALTS = 1024
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for the conditions A to D, which depend on the text only."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, with those of quality 1 and toxic 1.

    Equal texts are told by SHA-256 and length; texts themselves aren't shuffled. Copies of a text are counted before
    they meet, and meet as one row for each part and label, so a text with any share of the rows makes no hot task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        F.octet_length(text).alias("bytes"),
        text_mask(text).alias("mask"),
    )
    rows = rows.groupBy("doc_id", "part", "sha", "bytes", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("sha"), F.lit(SALTS))).otherwise(F.lit(0))
    rows = rows.withColumn("salt", salt).join(marks.withColumn("l_salt", F.lit(0)), (F.col("doc_id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left")
    flag = {c: F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")}
    # of the copies in a part: how many, and the smallest doc_id with its rows
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = rows.groupBy("sha", "bytes", "part", "mask", flag["good"], flag["toxic"], F.col("doc_id").isNull().alias("no_id")).agg(F.sum("n").alias("n"), first.alias("first"))
    # a text has a bounded number of rows by now
    copies = copies.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("sha", "bytes")))
    own = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(F.lit(0))
    later = F.when(F.col("no_id"), F.lit(0)).otherwise(F.col("n") - own)
    e = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - later).alias("n")), F.struct((F.col("mask") + e).alias("mask"), later.alias("n"))))
    out = copies.select("part", "good", "toxic", both.alias("m")).select("part", "good", "toxic", "m.mask", "m.n").where("n > 0")
    return out.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def polynomial(counts: dict[int, int], filters: int = len(FILTERS)) -> list[int]:
    """The coefficient of each product of x_i (i in the set given by the index's bits) of R, by the expansion of the products."""
    out = [0] * (1 << filters)
    for term in range(1, 1 << filters):
        holding = sum(n for mask, n in counts.items() if mask & term == term)
        out[term] = -holding if term.bit_count() % 2 == 0 else holding
    return out


def corner(terms: list[int], chosen: int) -> int:
    """R where the chosen filters are 1 and the others 0."""
    return sum(a for term, a in enumerate(terms) if term & ~chosen == 0)


def shapley(terms: list[int], i: int) -> Fraction:
    """The integral over t in [0, 1] of the derivative of R in x_i at (t, ..., t): each term t^(k-1) gives 1 / k."""
    return sum((Fraction(a, term.bit_count()) for term, a in enumerate(terms) if term >> i & 1), Fraction(0))


def part_rows(part: str, n: dict[int, int], good: dict[int, int], toxic: dict[int, int]) -> list[tuple]:
    """The rows of a part, 5 for each of the 120 orders."""
    total, full = sum(n.values()), (1 << len(FILTERS)) - 1
    gone = {name: [corner(polynomial(c), s) for s in range(full + 1)] for name, c in (("n", n), ("good", good), ("toxic", toxic))}
    worth = []
    for i in range(len(FILTERS)):
        exact = 120 * shapley(polynomial(n), i)
        assert exact.denominator == 1, "120 orders of whole documents"
        worth.append(int(exact))
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            took = {name: g[after] - g[before] for name, g in gone.items()}
            fails = gone["n"][1 << i]
            name = "".join(FILTERS[k] for k in order)
            out.append((part, name, step, total - gone["n"][after], took["n"], fails - took["n"], gone["n"][full] - gone["n"][full ^ 1 << i], took["good"], took["toxic"], worth[i]))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA for each part (lang; null: empty), order and step; ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic.

    A null text is the empty one. A row without doc_id has no labels, and neither is a copy of a smaller doc_id nor
    has one. Repeated rows count each; rows of one doc_id aren't copies of each other. A document with several rows
    of labels is good (toxic) if one of them says so. Without documents there are no rows. Other columns aren't read.
    """

    def orders(pdf: pd.DataFrame) -> pd.DataFrame:
        c = {k: dict(zip(pdf["mask"].tolist(), pdf[k].tolist())) for k in ("n", "good", "toxic")}
        return pd.DataFrame(part_rows(pdf["part"].iloc[0], c["n"], c["good"], c["toxic"]), columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return mask_counts(docs, labels).groupBy("part").applyInPandas(orders, SCHEMA)  # 32 rows a part


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
f as (
  select d.part, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
         [len(w) < 100,
          100 * len(list_distinct(w)) < 80 * len(w),
          100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) over (partition by text), false)] as fails
  from d left join l on d.doc_id = l.doc_id),
letters as (select unnest([1, 2, 3, 4, 5]) as i),
orders as (
  select [a.i, b.i, c.i, x.i, e.i] as o
  from letters a, letters b, letters c, letters x, letters e
  where len(list_distinct([a.i, b.i, c.i, x.i, e.i])) = 5),
masks as (select part, good, toxic, fails, count(*) as n from f group by all),
steps as (
  select part, o, step, o[step] as i, n, good, toxic, fails,
         len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 as gone
  from masks, orders, (select unnest([1, 2, 3, 4, 5]) as step) s),
sums as (
  select part, o, step, i,
         cast(sum(n) filter (where not gone and not fails[i]) as bigint) as kept,
         cast(sum(n) filter (where not gone and fails[i]) as bigint) as removed,
         cast(sum(n) filter (where gone and fails[i]) as bigint) as redundant,
         cast(sum(n) filter (where fails[i] and len(list_filter(fails, lambda v: v)) = 1) as bigint) as unique_fails,
         cast(sum(n) filter (where not gone and fails[i] and good) as bigint) as good_lost,
         cast(sum(n) filter (where not gone and fails[i] and toxic) as bigint) as toxic_lost
  from steps group by part, o, step, i)
select part, list_aggregate(list_transform(o, lambda k: substr('ABCDE', k, 1)), 'string_agg', '') as filter_order,
       cast(step as int) as step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed,
       coalesce(redundant, 0) as redundant, coalesce(unique_fails, 0) as unique_fails,
       coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost,
       cast(sum(coalesce(removed, 0)) over (partition by part, i) as bigint) as shapley
from sums
"""

"""Sources over whole tables: a table is written in a source's format to the shared folder, and read back by it.

The SQL of a query only states what the table holds and knows nothing of formats.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import new_folder
from ..operators import policy
from ..sources import readers
from .registry import query, ran, table


@query("SELECT CAST(doc_id AS VARCHAR) AS payload_id, text AS payload FROM documents")
def source_payloads(spark, sf_dir):
    """Requests as JSON, with quotes, line ends and all scripts in them."""
    path = f"{new_folder(spark)}/in"
    table(spark, sf_dir, "documents").select(F.col("text").alias("payload"), F.col("doc_id").cast("string").alias("payload_id"), "lang").write.json(path)
    return readers.payloads(spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS payload_id, length(text) AS chars FROM documents")
def source_payload_stream(spark, sf_dir):
    """The same requests as a stream of files."""
    path = f"{new_folder(spark)}/in"
    table(spark, sf_dir, "documents").select(F.col("text").alias("payload"), F.col("doc_id").cast("string").alias("payload_id")).write.json(path)
    return ran(readers.payloads(spark, path, stream=True)).select("payload_id", F.length("payload").cast("long").alias("chars"))


@query(
    """SELECT c_custkey AS id, 'EMAIL' AS type, 5 AS start, 5 + length('u' || c_custkey || '@mail.example.com') AS "end", 'u' || c_custkey || '@mail.example.com' AS value FROM customer WHERE c_custkey % 3 > 0
    UNION ALL SELECT c_custkey, 'EMAIL', 28 + 2 * length(CAST(c_custkey AS VARCHAR)), 28 + 2 * length(CAST(c_custkey AS VARCHAR)) + length('v' || c_custkey || '@mail.example.com'), 'v' || c_custkey || '@mail.example.com' FROM customer WHERE c_custkey % 3 = 2"""
)
def source_cases(spark, sf_dir):
    """Annotated cases in a CSV file with quotes and line ends; the offsets of none, one or two spans are worked out and read back."""
    k = F.col("c_custkey").cast("string")
    one, two = F.concat(F.lit("u"), k, F.lit("@mail.example.com")), F.concat(F.lit("v"), k, F.lit("@mail.example.com"))
    text = F.concat(F.lit('say "'), one, F.lit('",\n'), k, F.lit(": "), two, F.lit(', "ok"'))
    spans = F.when(F.col("c_custkey") % 3 == 1, one).when(F.col("c_custkey") % 3 == 2, F.concat(one, F.lit("; "), two)).otherwise("")
    fill = {"id": k, "category": F.lit("EMAIL"), "kind": F.lit("positive"), "text": text, "expected_masked": F.lit("true"), "expected_span": spans, "note": F.lit("a, b"), "expected_entities": F.lit("")}
    path = f"{new_folder(spark)}/in"
    table(spark, sf_dir, "customer").select(*[c.alias(n) for n, c in fill.items()]).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    rows = readers.annotated(readers.cases(spark, path, "own"))
    found = rows.select(F.col("id").cast("long").alias("id"), F.explode(readers.entities(F.col("expected_entities"))).alias("e"))
    return found.select("id", "e.type", "e.start", "e.end", "e.value")


@query("SELECT DISTINCT lower(trim(p_name)) AS value FROM part WHERE trim(p_name) <> ''")
def source_word_list(spark, sf_dir):
    """Lines in any case with blanks around them, repeated, and empty ones."""
    path, name = f"{new_folder(spark)}/in", F.col("p_name")
    table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit("  "), F.upper(name), F.lit(" ")), name, F.lit(""), F.lit("   "))).alias("value")).write.text(path)
    return readers.word_list(spark, path)


@query("SELECT DISTINCT lower(c_name) AS value FROM customer")
def source_json_lines(spark, sf_dir):
    """One field of JSON lines, among lines that aren't JSON."""
    path, name = f"{new_folder(spark)}/in", F.col("c_name")
    good = F.to_json(F.struct(F.concat(F.lit(" "), name).alias("text"), F.col("c_custkey").alias("n")))
    table(spark, sf_dir, "customer").select(F.explode(F.array(good, F.concat(F.lit('{"text": "'), name), F.lit(""))).alias("value")).write.text(path)
    return readers.json_lines_field(spark, path)


@query("SELECT DISTINCT lower(c_name) AS value FROM customer")
def source_first_field(spark, sf_dir):
    """What stands before the first comma, with and without a byte order mark."""
    path, name = f"{new_folder(spark)}/in", F.col("c_name")
    mark = F.when(F.col("c_custkey") % 2 == 0, F.lit("﻿")).otherwise("")
    table(spark, sf_dir, "customer").select(F.concat(mark, name, F.lit(",1,"), F.col("c_mktsegment")).alias("value")).write.text(path)
    return readers.csv_first_field(spark, path)


@query(
    """SELECT s_name AS consumer_id, s_suppkey % 2 = 0 AS enabled, CASE s_suppkey % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'CARD,EMAIL' ELSE 'EMAIL' END AS types, s_suppkey % 5 AS keys FROM supplier"""
)
def source_policy_file(spark, sf_dir):
    """A configuration file with a policy for each supplier, with fields left out and types excluded, and one entry without a name."""
    key, path = F.col("s_suppkey"), f"{new_folder(spark)}/in"
    types = F.when(key % 3 == 0, F.array(F.lit("CARD"))).otherwise(F.array(F.lit("EMAIL"), F.lit("CARD")))
    excluded = F.when(key % 3 == 2, F.array(F.lit("CARD")))
    keys = F.transform(F.filter(F.array(*[F.lit(i) for i in range(5)]), lambda i: i < key % 5), lambda i: F.concat(F.lit("k"), i))
    each = F.to_json(F.struct(F.col("s_name").alias("consumer_id"), F.when(key % 2 == 1, F.lit(False)).alias("enabled"), types.alias("enabled_pii_types"), excluded.alias("excluded_pii_types"), keys.alias("api_keys")))
    # a configuration file is one text
    file = table(spark, sf_dir, "supplier").agg(F.concat(F.lit('{"consumers": [\n'), F.array_join(F.collect_list(each), ",\n"), F.lit(', {"enabled": true}]}')).alias("value"))
    file.write.text(path)
    rows = policy.load_policies(spark, path)
    return rows.select("consumer_id", "enabled", F.array_join("effective_types", ",").alias("types"), F.size("api_keys").cast("long").alias("keys"))

"""Sources: payloads, annotated cases, configurations, word lists, metric and profile texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "payload string, payload_id string"
CASE_COLUMNS = ("id", "category", "kind", "text", "expected_masked", "expected_span", "note", "expected_entities")
ENTITY = "array<struct<type:string,start:int,end:int,value:string>>"


def payloads(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """JSON requests {payload, payload_id}, as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).schema(PAYLOAD)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def synthetic_payloads(spark: SparkSession, n: int) -> DataFrame:
    """n short payloads with one e-mail and one phone each, for load tests."""
    no = F.lpad(F.pmod(F.col("id") * 7919, F.lit(10_000_000)).cast("string"), 7, "0")
    text = F.concat(F.lit("Клиент "), F.col("id"), F.lit(", почта user"), F.col("id"), F.lit("@mail.example.com, телефон +7 912 "), F.substring(no, 1, 3), F.lit("-"), F.substring(no, 4, 2), F.lit("-"), F.substring(no, 6, 2))
    return spark.range(n).select(text.alias("payload"), F.concat(F.lit("load-"), F.col("id")).alias("payload_id"))


def chat_messages(requests: DataFrame, messages: str = "messages") -> DataFrame:
    """One row for each message of a chat request, with its place; extra fields of the request stay."""
    out = requests.select("*", F.posexplode(messages).alias("turn", "_m")).drop(messages)
    return out.select(*[c for c in out.columns if c != "_m"], F.col("_m.role").alias("role"), F.col("_m.content").alias("text"))


def cases(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Annotated cases of a CSV file with quoted fields; (dataset, id) is the key."""
    schema = ", ".join(f"{c} string" for c in CASE_COLUMNS)
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')
    return rows.withColumn("dataset", F.lit(dataset))


def entities(json: Column) -> Column:
    """The entities of a JSON column. Fails on anything but an array of objects with all fields, 0 <= start <= end.

    A null or blank text has no entities.
    """
    parsed = F.from_json(json, ENTITY)
    blank = json.isNull() | (F.trim(json) == "")
    bad = F.exists(parsed, lambda e: e["type"].isNull() | e["value"].isNull() | e["start"].isNull() | e["end"].isNull() | (e["start"] < 0) | (e["end"] < e["start"]))
    fail = F.raise_error(F.concat(F.lit("malformed entities: "), json)).cast(ENTITY)
    return F.when(blank, F.array().cast(ENTITY)).when(parsed.isNull() | bad | ~F.ltrim(json).startswith("["), fail).otherwise(parsed)


def entity_errors(text: Column, found: Column) -> Column:
    """Entities whose value isn't what the text has at their offsets."""
    return F.filter(found, lambda e: F.substring(text, e["start"] + 1, e["end"] - e["start"]) != e["value"])


def annotated(rows: DataFrame) -> DataFrame:
    """Cases with expected_entities worked out from expected_span (spans with ; between them) and the case's category.

    Fails on a span that isn't in the text exactly once, as its place would be a guess.
    """
    parts = F.filter(F.transform(F.split(F.coalesce("expected_span", F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")
    times = lambda s: (F.length("text") - F.length(F.replace(F.col("text"), s, F.lit("")))) / F.length(s)
    start = lambda s: F.position(s, F.col("text")) - 1

    def entity(s: Column) -> Column:
        made = F.struct(F.col("category").alias("type"), start(s).alias("start"), (start(s) + F.length(s)).alias("end"), s.alias("value"))
        fail = F.raise_error(F.concat(F.lit("span is not in the text exactly once, case "), F.col("id"))).cast(ENTITY[6:-1])
        return F.when(times(s) == 1, made).otherwise(fail)

    return rows.withColumn("expected_entities", F.to_json(F.transform(parts, entity)))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lower-case lines of a text file, as column ``value``; a missing file is an empty list."""
    try:
        rows = spark.read.text(path)
    except Exception as e:  # only a path that isn't there counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], "value string")
    return rows.select(F.lower(F.trim("value")).alias("value")).where("value <> ''").distinct()


def json_lines_field(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """One field of a file of JSON lines; malformed lines are skipped."""
    rows = spark.read.schema(f"{field} string").option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.lower(F.trim(field)).alias("value")).where("value <> ''").distinct()


def csv_first_field(spark: SparkSession, path: str) -> DataFrame:
    """What stands before the first comma of each line, without a byte order mark."""
    value = F.lower(F.trim(F.regexp_replace(F.split_part("value", F.lit(","), F.lit(1)), "^﻿", "")))
    return spark.read.text(path).select(value.alias("value")).where("value <> ''").distinct()


# Lengths and endings that names of each kind can have.
_LENGTHS = {"first": (2, 15), "surname": (2, 20), "patronymic": (3, 20)}
_PATRONYMIC = "(вич|вна|чна|шна|ич)$"


def lexicon_filter(words: DataFrame, kind: str) -> DataFrame:
    """Words that can be names of a kind: Cyrillic only, of sane length, patronymics with their endings."""
    low, high = _LENGTHS[kind]
    ok = F.col("value").rlike("^[а-яё]+$") & F.length("value").between(low, high)
    return words.where(ok & F.col("value").rlike(_PATRONYMIC) if kind == "patronymic" else ok)


def prometheus(lines: DataFrame) -> DataFrame:
    """(name, value) of metric lines in column ``value``; comments, blanks and unreadable lines are skipped."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = lines.where((line != "") & ~line.startswith("#")).select(F.get(parts, F.lit(0)).alias("name"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) AS DOUBLE)").alias("value"))
    return rows.where("value is not null")


def folded_stacks(lines: DataFrame) -> DataFrame:
    """(frames, count) of lines ``frame;frame;... count`` in column ``value``; other lines are skipped."""
    rows = lines.select(F.split(F.regexp_extract("value", r"^(.*)\s+([0-9]+)\s*$", 1), ";").alias("frames"), F.expr(r"try_cast(regexp_extract(value, '^(.*)\\s+([0-9]+)\\s*$', 2) AS BIGINT)").alias("count"))
    return rows.where("count is not null")

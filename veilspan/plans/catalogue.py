"""Registered queries: each applies an operator to whole tables, with an equivalent SQL text where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import spans as S
from ..functions.lexicon import Lexicon
from ..functions.tables import spread
from ..operators import analytics, detectors, evaluation, masking, ner, policy
from ..sources import readers
from ..streaming import keyed, sessions
from . import detector_queries, source_queries  # register their queries
from .registry import ORACLES, QUERIES, digits, exploded, in_turn, pick, query, ran, small, streamed, table

__all__ = ["ORACLES", "QUERIES", "detector_queries", "source_queries"]

NATIVE = masking.Policy(types=("EMAIL", "CARD"))

# Equivalent SQL of the e-mail and card rules, for an engine without look-around.
_L = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_EMAIL_SQL = r"(?:^|[^\p{L}\p{N}_.+\-])([A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@" + _L + r"(?:\." + _L + ")+)"
_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
# A card ends where no digit follows, and a letter may. \b alone would ask for a word's end, so a mark comes between a digit and a letter.
_CUT = r"regexp_replace(text, '([0-9])([A-Za-z_])', '\1|\2', 'g')"


def _luhn_sql(d: str) -> str:
    digit = f"CAST(substr({d}, CAST(length({d}) - i AS INT), 1) AS INT)"
    return f"(list_sum([CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END FOR i IN range(0, length({d}))]) % 10 = 0)"


_FOUND_SQL = f"""
found AS (
  SELECT doc_id, lang, 'EMAIL' AS pii_type, unnest(regexp_extract_all(text, '{_EMAIL_SQL}', 1)) AS value FROM documents
  UNION ALL
  SELECT doc_id, lang, 'CARD', value FROM (SELECT doc_id, lang, unnest(regexp_extract_all({_CUT}, '(?:^|[^0-9])((?:[0-9][ -]?){{12,18}}[0-9])\\b', 1)) AS value FROM documents)
  WHERE length({_DIGITS.format('value')}) BETWEEN 13 AND 19 AND {_luhn_sql(_DIGITS.format('value'))})"""


@query(f"WITH {_FOUND_SQL} SELECT lang, pii_type, count(DISTINCT doc_id) AS n_docs, count(*) AS n_spans FROM found GROUP BY lang, pii_type")
def flagship_mask_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    masked = masking.mask(docs, policy=NATIVE, native=True)
    each = exploded(masked, "matches.pii_type", "doc_id", "lang").groupBy("doc_id", "lang", F.col("m").alias("pii_type")).count()
    return each.groupBy("lang", "pii_type").agg(F.count("*").alias("n_docs"), F.sum("count").alias("n_spans"))


@query(f"WITH {_FOUND_SQL} SELECT doc_id, value, count(*) AS n FROM found WHERE pii_type = 'EMAIL' GROUP BY doc_id, value")
def email_spans(spark, sf_dir):
    rows = exploded(table(spark, sf_dir, "documents"), S.email(F.col("text")), "doc_id")
    return rows.groupBy("doc_id", F.col("m.value").alias("value")).agg(F.count("*").alias("n"))


@query(f"WITH {_FOUND_SQL} SELECT doc_id, value, count(*) AS n FROM found WHERE pii_type = 'CARD' GROUP BY doc_id, value")
def card_spans(spark, sf_dir):
    rows = exploded(table(spark, sf_dir, "documents"), S.card_luhn(F.col("text")), "doc_id")
    return rows.groupBy("doc_id", F.col("m.value").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, true AS same FROM documents")
def native_equals_python(spark, sf_dir):
    """The column expressions and the Arrow function find the same e-mails and checked cards, offsets included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = detectors.detect(F.col("text"), ("EMAIL", "CARD"))
    sure = F.filter(own, lambda m: m["confidence"] == 1.0)
    return docs.select("doc_id", (S.in_order(F.concat(S.email(F.col("text")), S.card_luhn(F.col("text")))) == sure).alias("same"))


@query("SELECT doc_id, true AS restored FROM documents")
def demask_roundtrip(spark, sf_dir):
    masked = masking.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), policy=NATIVE, native=True)
    return masking.demask(masked, to="back").select("doc_id", (F.col("back") == F.col("text")).alias("restored"))


# Texts with known findings, made from key columns.
_CARD_NO = "lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0')"
_TEXT_SQL = f"'Client ' || c_custkey || ', mail user' || c_custkey || '@mail.example.com; card 4111 1111 11' || substr({_CARD_NO}, 1, 2) || ' ' || substr({_CARD_NO}, 3, 4)"


def _client_texts(spark, sf_dir):
    no = F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Client "), key, F.lit(", mail user"), key, F.lit("@mail.example.com; card 4111 1111 11"), F.substring(no, 1, 2), F.lit(" "), F.substring(no, 3, 4))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


def _masked_sql(email: str, card: str) -> str:
    value = f"'4111 1111 11' || substr({_CARD_NO}, 1, 2) || ' ' || substr({_CARD_NO}, 3, 4)"
    digits = f"('4111111111' || {_CARD_NO})"
    return f"""SELECT c_custkey, 'Client ' || c_custkey || ', mail ' || {email} || '; card ' || CASE WHEN {_luhn_sql(digits)} THEN {card} ELSE {value} END AS masked FROM customer"""


@query(_masked_sql("'__PII_EMAIL_1__'", "'__PII_CARD_1__'"))
def mask_typed(spark, sf_dir):
    return masking.mask(_client_texts(spark, sf_dir), policy=NATIVE, native=True).select("c_custkey", "masked")


@query(_masked_sql("'user@example.com_1'", "'4000 0000 0000 0000_1'"))
def mask_synthetic(spark, sf_dir):
    return masking.mask(_client_texts(spark, sf_dir), policy=masking.Policy(("EMAIL", "CARD"), mode="synthetic"), native=True).select("c_custkey", "masked")


@query(_masked_sql("repeat('*', length('user' || c_custkey || '@mail.example.com'))", "'**** **** **** ****'"))
def mask_format_preserving(spark, sf_dir):
    return masking.mask(_client_texts(spark, sf_dir), policy=masking.Policy(("EMAIL", "CARD"), mode="format_preserving"), native=True).select("c_custkey", "masked")


@query(
    f"""SELECT c_custkey, unnest(CASE WHEN {_luhn_sql(f"('4111111111' || {_CARD_NO})")} THEN ['EMAIL:masked', 'CARD:masked'] ELSE ['EMAIL:masked'] END) AS decision FROM customer"""
)
def mask_decisions(spark, sf_dir):
    masked = masking.mask(_client_texts(spark, sf_dir), policy=NATIVE, native=True)
    return exploded(masked, "decisions", "c_custkey").select("c_custkey", F.concat("m.pii_type", F.lit(":"), "m.action").alias("decision"))


@query(
    """SELECT conv_id, turn, 'turn mail __PII_EMAIL_' || (2 * n - 1) || '__ and __PII_EMAIL_' || (2 * n) || '__' AS masked
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"""
)
def chat_numbering(spark, sf_dir):
    """Placeholder numbers go on over the messages of a conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    mail = F.concat(F.lit("u"), F.col("turn").cast("string"), F.lit("@mail.example.com"))
    rows = rows.withColumn("text", F.concat(F.lit("turn mail a"), mail, F.lit(" and b"), mail))
    return masking.mask_chat(rows, masking.Policy(("EMAIL",)), native=True).select("conv_id", "turn", "masked")


def _weights_sql(d: str, weights) -> str:
    return " + ".join(f"{w} * CAST(substr({d}, {i + 1}, 1) AS INT)" for i, w in enumerate(weights))


_SNILS_D = "lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')"


@query(f"SELECT o_orderkey, ({_weights_sql('d', range(9, 0, -1))}) % 101 % 100 = CAST(substr(d, 10, 2) AS INT) AS valid FROM (SELECT o_orderkey, {_SNILS_D} AS d FROM orders)")
def snils_checksum(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.concat(F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0"), F.lpad((k % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.snils_col(d).alias("valid"))


@query(
    f"""SELECT o_orderkey, ({_weights_sql('d', C.INN10)}) % 11 % 10 = CAST(substr(d, 10, 1) AS INT) AS valid
    FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 1000003 % 10000000000 AS VARCHAR), 10, '0') AS d FROM orders)"""
)
def inn_checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.inn_col(F.lpad((F.col("o_orderkey") * 1000003 % 10000000000).cast("string"), 10, "0")).alias("valid"))


@query(f"""SELECT o_orderkey, {_luhn_sql("d")} AS valid FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 104729 AS VARCHAR), 14, '0') AS d FROM orders)""")
def luhn_checksum(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.luhn_col(F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 104729).cast("string"), 14, "0"))).alias("valid"))


@query(
    """SELECT l_orderkey, l_linenumber, year BETWEEN 1900 AND 2100 AND try_cast(printf('%04d-%02d-%02d', year, month, day) AS DATE) IS NOT NULL AS valid
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 33 AS INT) AS day, CAST(l_suppkey % 14 AS INT) AS month, CAST(1890 + l_orderkey % 230 AS INT) AS year FROM lineitem)"""
)
def calendar_validate(spark, sf_dir):
    day, month, year = (F.col("l_partkey") % 33).cast("int"), (F.col("l_suppkey") % 14).cast("int"), (1890 + F.col("l_orderkey") % 230).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.date_col(day, month, year).alias("valid"))


@query(
    """SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END::INT AS tokens,
    CASE WHEN strlen(text) > 400000 OR (length(text) + 3) // 4 > 100000 THEN 413 ELSE 200 END::INT AS status FROM documents"""
)
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sessions.tokens(F.col("text")).alias("tokens"), sessions.admission(F.col("text")).alias("status"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::INT AS bytes FROM documents")
def payload_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sessions.fingerprint(F.col("text")).alias("f")).select("doc_id", "f.*")


_SPANS_SQL = """SELECT l_orderkey AS doc, CAST(l_partkey % 40 AS INT) AS s, CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INT) AS e, 0.5 + CAST(l_linenumber % 3 AS DOUBLE) / 10 AS c,
  l_returnflag AS kind FROM lineitem"""


@query(
    f"""WITH RECURSIVE spans AS ({_SPANS_SQL}),
    ranked AS (SELECT DISTINCT doc, s, e, c, kind FROM spans),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY c DESC, e - s DESC, s, kind) AS k FROM ranked),
    walk AS (
      SELECT doc, k, [{{'s': s, 'e': e, 'kind': kind}}] AS acc FROM numbered WHERE k = 1
      UNION ALL
      SELECT n.doc, n.k, CASE WHEN len(list_filter(acc, lambda x: n.e > x.s AND n.s < x.e)) > 0 THEN acc ELSE list_append(acc, {{'s': n.s, 'e': n.e, 'kind': n.kind}}) END
      FROM walk w JOIN numbered n ON n.doc = w.doc AND n.k = w.k + 1),
    done AS (SELECT doc, unnest(arg_max(acc, k)) AS x FROM walk GROUP BY doc)
    SELECT doc, x.s AS start, x.e AS "end", x.kind AS kind FROM done"""
)
def overlap_resolution(spark, sf_dir):
    """Greedy resolution of the spans that the lines of an order make up."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    m = F.struct(
        F.col("l_returnflag").alias("pii_type"),
        F.lit("").alias("value"),
        (p % 40).cast("int").alias("start"),
        (p % 40 + 1 + s % 12).cast("int").alias("end"),
        (0.5 + (F.col("l_linenumber") % 3).cast("double") / 10).alias("confidence"),
    )
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(m).alias("found"))
    return exploded(docs, S.resolve(F.col("found")), "doc").select("doc", "m.start", "m.end", F.col("m.pii_type").alias("kind"))


@query(
    f"""WITH spans AS ({_SPANS_SQL}),
    marked AS (SELECT doc, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS new FROM spans),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS k FROM marked)
    SELECT doc, min(s) AS start, max(e) AS "end" FROM islands GROUP BY doc, k"""
)
def interval_merge(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (p % 40).cast("int").alias("start"), (p % 40 + 1 + s % 12).cast("int").alias("end"))
    return analytics.merge_intervals(rows, "doc")


_TYPES = ("EMAIL", "PHONE", "CARD", "PERSON")


@query(
    """SELECT k, list_aggregate(list_sort(list_filter(enabled, lambda x: NOT list_contains(excluded, x))), 'string_agg', ',') AS types
    FROM (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ['EMAIL', 'PHONE', 'CARD'] WHEN 1 THEN ['PERSON', 'EMAIL'] ELSE ['CARD', 'SNILS'] END AS enabled,
      CASE c_custkey % 4 WHEN 0 THEN ['PHONE'] WHEN 1 THEN [] WHEN 2 THEN ['EMAIL', 'SNILS'] ELSE ['OTHER'] END AS excluded FROM customer)"""
)
def policy_effective_types(spark, sf_dir):
    k, names = F.col("k"), policy.strings
    enabled = F.when(k % 3 == 0, names(("EMAIL", "PHONE", "CARD"))).when(k % 3 == 1, names(("PERSON", "EMAIL"))).otherwise(names(("CARD", "SNILS")))
    excluded = F.when(k % 4 == 0, names(("PHONE",))).when(k % 4 == 1, names(())).when(k % 4 == 2, names(("EMAIL", "SNILS"))).otherwise(names(("OTHER",)))
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").select("k", F.array_join(policy.effective_types(enabled, excluded), ",").alias("types"))


def _policies(spark):
    rows = [("open", True, None), ("keyed", True, ["k1", "k2"]), ("off", False, None), ("default", True, None)]
    names = {f.split(" ")[0]: f for f in policy._CONSUMER.split(", ")}
    base = small(spark, rows, "consumer_id string, enabled boolean, api_keys array<string>")
    have = base.columns
    return policy.policies_of(base.select(*have, *[F.lit(None).cast(t.split(" ")[1]).alias(n) for n, t in names.items() if n not in have]))


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN c_custkey % 2 = 0 ELSE false END AS allowed FROM customer"""
)
def policy_allow(spark, sf_dir):
    k = F.col("c_custkey")
    who = F.element_at(F.array(*[F.lit(x) for x in ("open", "keyed", "off", "nobody")], F.lit(None)), (k % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", who.alias("consumer_id"), F.when(k % 2 == 0, "k1").otherwise("zz").alias("api_key"))
    return policy.check_access(rows, _policies(spark)).select("c_custkey", "allowed")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'keyed' WHEN 2 THEN 'off' ELSE 'default' END AS used FROM customer")
def policy_resolve(spark, sf_dir):
    """Unknown and missing consumers get the default policy."""
    k = F.col("c_custkey")
    who = F.element_at(F.array(*[F.lit(x) for x in ("open", "keyed", "off", "nobody")], F.lit(None)), (k % 5 + 1).cast("int"))
    return policy.with_policy(table(spark, sf_dir, "customer").select("c_custkey", who.alias("consumer_id")), _policies(spark)).select("c_custkey", F.col("policy.consumer_id").alias("used"))


@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'http://a/v1' WHEN 1 THEN 'http://b' END AS api_base, CASE c_custkey % 3 WHEN 0 THEN 'm-1' WHEN 1 THEN 'beta' END AS upstream,
    CASE WHEN c_custkey % 3 = 2 THEN 404 ELSE 200 END::INT AS status FROM customer"""
)
def model_route(spark, sf_dir):
    models = policy.models_of(small(spark, [("alpha", "http://a/v1/", "m-1"), ("beta", "http://b", None), ("", "http://c", None), ("d", None, "x")], "name string, api_base string, model string"))
    name = F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("d")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return policy.route(table(spark, sf_dir, "customer").select("c_custkey", name.alias("model")), models).select("c_custkey", "api_base", "upstream", "status")


@query("SELECT o_orderkey, coalesce(o_totalprice > 100000, false) AS over FROM orders")
def token_quota(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.over_quota(F.col("o_totalprice"), F.lit(100000)).alias("over"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) % 3 AS backend FROM customer")
def round_robin(spark, sf_dir):
    return policy.round_robin(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 3).select("c_custkey", F.col("backend").cast("long").alias("backend"))


@query("SELECT k, (row_number() OVER (ORDER BY k) - 1) % 7 AS backend FROM (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem)")
def round_robin_parts(spark, sf_dir):
    """The same over all lines of orders, dealt to many partitions."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_shipdate")
    return policy.round_robin(rows, "k", 7, partitions=13).select("k", F.col("backend").cast("long").alias("backend"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'tok' || c_custkey WHEN 1 THEN 'key' || c_custkey END AS key FROM customer")
def api_key(spark, sf_dir):
    k = F.col("c_custkey")
    auth = F.when(k % 3 == 0, F.concat(F.lit("bEARER tok"), k)).when(k % 3 == 1, F.lit("Basic zzz"))
    return table(spark, sf_dir, "customer").select("c_custkey", policy.api_key(auth, F.when(k % 3 == 1, F.concat(F.lit("key"), k))).alias("key"))


@query(
    """SELECT c_custkey AS id, unnest([0, 1, 2, 3, 4, 5, 6]) AS seq, unnest([200, 200, 200, 409, 410, 200, 413]) AS status,
    unnest(['mask', 'retry', 'demask', 'conflict', 'expired', 'mask', 'too_large']) AS outcome FROM customer"""
)
def session_batch(spark, sf_dir):
    """Seven requests for each customer's id: mask, retry, restore, conflict, expiry, a new session, too large."""
    out = sessions.process_batch(_story(table(spark, sf_dir, "customer")), masking.Policy(("EMAIL",)))
    return out.select(F.col("payload_id").cast("long").alias("id"), F.col("seq").cast("int").alias("seq"), "status", "outcome")


def _story(customers):
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("mail user"), key, F.lit("@mail.example.com"))
    other = F.concat(F.lit("other "), key)
    steps = [(0, 0, text), (1, 10, text), (2, 20, F.lit("mail __PII_EMAIL_1__")), (3, 30, other), (4, 150, text), (5, 400, other), (6, 410, F.repeat(F.lit("x"), 400001))]
    events = F.array(*[F.struct(F.lit(n).alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000 + t)).alias("ts"), p.alias("payload")) for n, t, p in steps])
    return customers.select("c_custkey", key.alias("payload_id"), F.inline(events))


@query(
    """SELECT c_custkey AS id, unnest([0, 1, 2, 3, 4, 5, 6]) AS seq, unnest([200, 200, 200, 409, 410, 200, 413]) AS status,
    unnest(['mask', 'retry', 'demask', 'conflict', 'expired', 'mask', 'too_large']) AS outcome FROM customer"""
)
def session_stream(spark, sf_dir):
    """The same requests as a stream with keyed state, run until the table is used up."""
    out = keyed.process_stream(_story(streamed(spark, sf_dir, "customer")), masking.Policy(("EMAIL",)))
    return ran(out).select(F.col("payload_id").cast("long").alias("id"), F.col("seq").cast("int").alias("seq"), "status", "outcome")


@query("SELECT doc_id, text AS restored FROM documents")
def chunk_stream(spark, sf_dir):
    """Masked documents come back as a stream of chunks, put in order and restored by keyed state; joined again, they are the documents."""
    masked = masking.mask(streamed(spark, sf_dir, "documents").select("doc_id", "text"), policy=NATIVE, native=True)
    chunks = sessions.echo_chunks(masked.select(F.col("doc_id").cast("string").alias("request_id"), "masked", "mapping"), 997)
    chunks = chunks.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64("request_id"), F.lit(60))))
    out = ran(keyed.restore_stream(chunks)).where("state = 'ok'")
    whole = out.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("restored"))
    return whole.select(F.col("request_id").cast("long").alias("doc_id"), "restored")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey < 100 OR c_custkey BETWEEN 110 AND 209 THEN 200 ELSE 429 END AS status FROM customer")
def session_limits(spark, sf_dir):
    """A service that holds a hundred sessions: ids come one after the other; after 110 of them all sessions have expired."""
    k = F.col("c_custkey")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.when(k < 110, 0).otherwise(2000) + k * 0.001)
    rows = table(spark, sf_dir, "customer").select(k.alias("seq"), ts.alias("ts"), k.cast("string").alias("payload_id"), F.concat(F.lit("text "), k.cast("string")).alias("payload"))
    out = sessions.process_batch(rows, masking.Policy(("EMAIL",)), sessions.Limits(entries=100))
    return out.select(F.col("payload_id").cast("long").alias("id"), "status")


@query("SELECT doc_id, text AS restored FROM documents")
def chunk_demask(spark, sf_dir):
    """Masked documents come back in chunks and are restored; joined again, they are the documents."""
    masked = masking.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), policy=NATIVE, native=True)
    chunks = sessions.echo_chunks(masked.select(F.col("doc_id").cast("string").alias("request_id"), "masked", "mapping"), 997)
    out = sessions.demask_batch(chunks)
    whole = out.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("restored"))
    return whole.select(F.col("request_id").cast("long").alias("doc_id"), "restored")


_EACH_SQL = """SELECT 'd' || (l_suppkey % 3) AS dataset, l_returnflag || l_linestatus AS pii_type, (l_partkey % 5 > 0)::INT AS tp, (l_partkey % 7 = 0)::INT AS fp,
  (l_partkey % 11 = 0)::INT AS fn, (l_partkey % 13 = 0)::INT AS span_errors, (l_partkey % 17 = 0)::INT AS type_errors FROM lineitem"""


def _each(spark, sf_dir):
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")).alias("dataset"),
        F.concat("l_returnflag", "l_linestatus").alias("pii_type"),
        (p % 5 > 0).cast("int").alias("tp"),
        (p % 7 == 0).cast("int").alias("fp"),
        (p % 11 == 0).cast("int").alias("fn"),
        (p % 13 == 0).cast("int").alias("span_errors"),
        (p % 17 == 0).cast("int").alias("type_errors"),
        F.lit(0).alias("partial_leaks"),
        F.lit(0).alias("overmasking"),
    )


@query(
    f"""WITH each AS ({_EACH_SQL}),
    sums AS (SELECT dataset, pii_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(span_errors + type_errors)::BIGINT AS wrong FROM each GROUP BY ROLLUP (dataset, pii_type)),
    rates AS (SELECT *, tp::DOUBLE / (tp + fp + wrong) AS p, tp::DOUBLE / (tp + fn + wrong) AS r FROM sums)
    SELECT dataset, pii_type, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM rates"""
)
def quality_rollup(spark, sf_dir):
    out = evaluation.rollup(_each(spark, sf_dir))
    return out.select("dataset", "pii_type", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH each AS ({_EACH_SQL}),
    sums AS (SELECT dataset, pii_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(span_errors + type_errors)::BIGINT AS wrong FROM each GROUP BY ROLLUP (dataset, pii_type)),
    rates AS (SELECT *, tp::DOUBLE / (tp + fp + wrong) AS p, tp::DOUBLE / (tp + fn + wrong) AS r FROM sums)
    SELECT dataset, pii_type, round(p, 9) AS precision, round(r, 9) AS recall, round(tp::DOUBLE / (tp + wrong), 9) AS exact_span, round(2 * p * r / (p + r), 9) AS f1 FROM rates"""
)
def quality_aggregate(spark, sf_dir):
    """The same ratios by a grouped aggregate function."""
    out = evaluation.quality_table(_each(spark, sf_dir))
    return out.select("dataset", "pii_type", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "exact_span", "f1")])


@query(
    """SELECT p_partkey, CASE WHEN p_name = p_type THEN 0.0 WHEN p_partkey % 4 = 0 THEN 0.5 ELSE round(1.0::DOUBLE - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 9) END::DOUBLE AS score
    FROM part"""
)
def levenshtein_score(spark, sf_dir):
    score = evaluation.organiser_score(F.col("p_partkey") % 4 != 0, F.col("p_name"), F.col("p_type"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 9).alias("score"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY ROLLUP (event_type)"""
)
def latency_percentiles(spark, sf_dir):
    out = analytics.latency_report(table(spark, sf_dir, "events"), ("event_type",), "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return analytics.windowed_counts(table(spark, sf_dir, "events")).select("window_start", "event_type", "n")


@query(
    """SELECT window_start, event_type, count(*) AS n FROM (
      SELECT event_type, unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes']) AS window_start FROM events) GROUP BY ALL"""
)
def events_sliding(spark, sf_dir):
    return analytics.windowed_counts(table(spark, sf_dir, "events"), every="10 minutes", slide="5 minutes").select("window_start", "event_type", "n")


@query(
    """WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '15 minutes' THEN 0 ELSE 1 END AS new FROM events),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k"""
)
def events_sessions(spark, sf_dir):
    return analytics.sessions(table(spark, sf_dir, "events")).select("user_id", "session_start", "n")


_STACKS = ("main.py:run;store.py:get;heap", "main.py:run;pii.py:detect;re", "pool.py:_worker;wait", "main.py:run;json", "x;y", "pool.py:_worker;pii.py:detect")
_RULES = [("Store", ["store.py"]), ("Detectors", ["pii.py", "detect"]), ("HTTP", ["main.py"])]
_LINES = f"SELECT CASE WHEN p_partkey % 50 = 49 THEN 'broken line' ELSE {pick(*_STACKS, key='p_partkey')} || ' ' || p_size END AS value FROM part"
_KINDS = f"SELECT {pick('Store', 'Detectors', 'Idle', 'HTTP', 'Other', 'Detectors', key='p_partkey')} AS category, {pick('heap', 're', 'wait', 'json', 'y', 'pii.py:detect', key='p_partkey')} AS function, p_size FROM part WHERE p_partkey % 50 <> 49"


def _stacks(spark, sf_dir):
    value = F.expr(_LINES[7 : _LINES.index(" AS value")].replace("|| p_size", "|| CAST(p_size AS STRING)"))
    return readers.folded_stacks(table(spark, sf_dir, "part").select(value.alias("value")))


def _category():
    return analytics.categorise(F.col("frames"), _RULES, "_worker", ("pii.py", "main.py", "store.py"))


@query(f"WITH s AS ({_KINDS}) SELECT category, sum(p_size)::BIGINT AS samples, round(sum(p_size)::DOUBLE / (SELECT sum(p_size) FROM s), 9) AS share FROM s GROUP BY category")
def profile_shares(spark, sf_dir):
    """Folded stacks made from all parts, by category."""
    return analytics.profile_shares(_stacks(spark, sf_dir), _category()).withColumn("share", F.round("share", 9))


@query(f"SELECT category, function, sum(p_size)::BIGINT AS samples FROM ({_KINDS}) GROUP BY ALL ORDER BY samples DESC, category, function LIMIT 4")
def profile_top_functions(spark, sf_dir):
    return analytics.top_functions(_stacks(spark, sf_dir), _category(), 4)


@query("SELECT 'm' || c_custkey AS name, c_nationkey + 0.5::DOUBLE AS value FROM customer WHERE c_custkey % 4 = 0")
def prometheus_scan(spark, sf_dir):
    """Metric lines made from all customers, with comments, blanks and unreadable ones."""
    line = in_turn(["'m' || CAST(k AS STRING) || '  ' || CAST(n + 0.5 AS STRING)", "'# HELP m' || CAST(k AS STRING)", "'   '", "'m' || CAST(k AS STRING) || ' none'"])
    return readers.prometheus(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_nationkey AS n").selectExpr(f"{line} AS value"))


@query("SELECT 'veilspan_' || event_type || ' ' || count(*) AS value FROM events GROUP BY event_type")
def metric_lines(spark, sf_dir):
    """Counters of all events as lines of metric text."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return analytics.exporter(counts)


@query("SELECT doc_id, text AS restored FROM documents")
def byte_chunk_demask(spark, sf_dir):
    """Masked documents come back in chunks of 61 bytes, which cut characters and placeholders anywhere; restored and joined again, they are the documents."""
    masked = masking.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), policy=NATIVE, native=True)
    chunks = sessions.echo_bytes(masked.select(F.col("doc_id").cast("string").alias("request_id"), "masked", "mapping"), 61)
    out = keyed.restore_batch(chunks, "bytes").where("state = 'ok'")
    whole = out.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("restored"))
    return whole.select(F.col("request_id").cast("long").alias("doc_id"), "restored")


@query(
    r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), lambda x: regexp_matches(x, '^[A-ZА-ЯЁ][\p{L}\p{N}_]')) AS capital FROM documents)
    SELECT doc_id, len(list_filter(capital, lambda x: x))::INT AS tokens,
      len(list_filter(range(1, len(capital) + 1), lambda i: capital[i] AND (i = 1 OR NOT capital[i - 1])))::INT AS names FROM t"""
)
def ner_windows(spark, sf_dir):
    """A model that sees 32 tokens at a time, over whole documents of any length: capitalised words, and the names that they make up."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ner.with_predictions(rows, "text", ner.CapitalisedWindows, 34, 8)
    return found.select("doc_id", F.size("ner.entities").alias("tokens"), F.size("ner.matches").alias("names"))


@query("SELECT 'requests_' || event_type AS name, count(*) AS value FROM events GROUP BY event_type")
def outcome_counters(spark, sf_dir):
    return sessions.outcome_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")))


@query(f"WITH {_FOUND_SQL} SELECT d.doc_id, count(value)::INT AS placeholders, 0 AS raw_emails FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id")
def echo_report(spark, sf_dir):
    """What a back end that only echoes would see of all documents once they are masked."""
    masked = masking.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), policy=NATIVE, native=True)
    return analytics.echo_report(masked.select("doc_id", F.col("masked").alias("text"))).select("doc_id", "placeholders", "raw_emails")


@query(
    """SELECT 'Клиент ' || i || ', почта user' || i || '@mail.example.com, телефон +7 912 ' || substr(n, 1, 3) || '-' || substr(n, 4, 2) || '-' || substr(n, 6, 2) AS payload, 'load-' || i AS payload_id
    FROM (SELECT i, lpad(CAST(i * 7919 % 10000000 AS VARCHAR), 7, '0') AS n FROM (SELECT unnest(range(count(*))) AS i FROM customer))"""
)
def payload_generator(spark, sf_dir):
    """As many made-up payloads as there are customers."""
    return readers.synthetic_payloads(spark, table(spark, sf_dir, "customer").count())


_LEXICON = ("the", "and", "que", "der", "les")


@query(
    """SELECT lang, w AS word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS w FROM documents) WHERE w IN ('the', 'and', 'que', 'der', 'les') GROUP BY ALL"""
)
def lexicon_semi_join(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))  # counted before the join, so little meets the dictionary
    return counted.join(small(spark, [(w,) for w in _LEXICON], "word string"), "word", "left_semi").select("lang", "word", "n")


@query("SELECT c_custkey, 'смирнова анна' AS name FROM customer WHERE c_custkey % 3 <> 0")
def known_person_anti_join(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, "лев толстой").otherwise("смирнова анна")
    known = small(spark, [(n,) for n in sorted(Lexicon().known)], "name string")
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).join(known, "name", "left_anti").select("c_custkey", "name")


@query("SELECT c_custkey, '__PII_INN_1__' AS shown FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '__PII_CUSTOM_TERM_1__' FROM customer WHERE c_custkey % 2 = 1")
def custom_terms_and_context(spark, sf_dir):
    """A number after its label, and a consumer's own term."""
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("ИНН "), F.lpad(k.cast("string"), 10, "9"))).otherwise(F.lit("Проект ВЕГА"))
    masked = masking.mask(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), policy=masking.Policy(("INN",), custom_terms=("вега",)))
    return masked.select("c_custkey", F.regexp_extract("masked", "(__PII_[A-Z_]+_[0-9]+__)", 1).alias("shown"))


@query()
def mask_documents(spark, sf_dir):
    """All detectors over all documents: findings by language and type, with their mean confidence."""
    masked = masking.mask(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    each = exploded(masked, "matches", "lang")
    return each.groupBy("lang", F.col("m.pii_type").alias("pii_type")).agg(F.count("*").alias("n"), F.round(F.avg("m.confidence"), 9).alias("confidence"))


_CITY, _STREET = pick("Тверь", "Казань", "Омск", "Пермь"), pick("Садовая", "Лесная", "Полевая")


def _spans(spark, sf_dir, text, types):
    rows = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), "k").selectExpr("k", f"{text} AS text")
    return exploded(masking.mask(rows, policy=masking.Policy(types)), "matches", "k").select("k", "m.pii_type", "m.start", "m.value")


def _spans_sql(*found: tuple[str, str, str]) -> str:
    """(type, SQL of the start, SQL of the value) of the findings in each customer's text."""
    each = ", ".join(f"{{'t': '{t}', 's': CAST({a} AS INT), 'v': {v}}}" for t, a, v in found)
    return f"SELECT k, x.t AS pii_type, x.s AS start, x.v AS value FROM (SELECT k, unnest([{each}]) AS x FROM (SELECT c_custkey AS k FROM customer))"


_AT_CITY, _AT_STREET = "21 + 6 + 5", f"21 + 6 + 5 + length({_CITY}) + 6"


@query(
    _spans_sql(("ADDRESS", "21", digits(6, 104729)), ("ADDRESS", _AT_CITY, _CITY), ("ADDRESS", _AT_STREET, _STREET), ("ADDRESS", f"{_AT_STREET} + length({_STREET}) + 5", "CAST(1 + k % 90 AS VARCHAR)"))
)
def address_spans(spark, sf_dir):
    """The parts of each customer's address, with offsets."""
    text = f"'Проживает по адресу: ' || {digits(6, 104729)} || ', г. ' || {_CITY} || ', ул. ' || {_STREET} || ', д. ' || CAST(1 + k % 90 AS STRING) || '. Звонить вечером'"
    return _spans(spark, sf_dir, text, ("ADDRESS",))


_COUNTRY, _OFFICE = pick("Армения", "Грузия"), pick("ОВД Северный", "ОВД Южный")


@query(
    _spans_sql(("BIRTH_PLACE", "18", _CITY), ("CITIZENSHIP", f"18 + length({_CITY}) + 15", _COUNTRY), ("PASSPORT_AUTHORITY", f"18 + length({_CITY}) + 15 + length({_COUNTRY}) + 12", _OFFICE))
)
def marker_values(spark, sf_dir):
    """Values that follow a marker, with offsets."""
    text = f"'место рождения г. ' || {_CITY} || ', гражданство: ' || {_COUNTRY} || ', кем выдан ' || {_OFFICE} || ', ниже'"
    return _spans(spark, sf_dir, text, ("PASSPORT_AUTHORITY", "BIRTH_PLACE", "CITIZENSHIP"))


_HOLDER = pick("OLGA BELOVA", "PAVEL SOKOLOV")


@query(_spans_sql(("CARD", "6", "'4111 1111 1111 1111'"), ("CVV", "31", digits(3)), ("PIN", "40", digits(4, 31)), ("CARD_HOLDER", "62", _HOLDER)))
def context_values(spark, sf_dir):
    """Values that only their context makes out, with offsets."""
    text = f"'Карта 4111 1111 1111 1111, cvv ' || {digits(3)} || ', пин ' || {digits(4, 31)} || '. держатель карты ' || {_HOLDER}"
    return _spans(spark, sf_dir, text, ("CARD", "CVV", "PIN", "CARD_HOLDER"))


@query(
    """SELECT c_custkey AS k, round(CASE c_custkey % 4 WHEN 0 THEN 0.55 + 0.35 * (1 - n / 49.0) WHEN 1 THEN 0.55 + 0.35 * (1 - n / 49.0) * 0.75 WHEN 2 THEN 0.55
      ELSE CASE WHEN n > 48 THEN 0.55 ELSE 0.55 - 0.55 * (1 - n / 49.0) END END, 9)::DOUBLE AS confidence
    FROM (SELECT c_custkey, 1 + CASE WHEN c_custkey % 4 = 3 THEN c_custkey % 60 ELSE c_custkey % 40 END AS n FROM customer)"""
)
def context_scores(spark, sf_dir):
    """How the score of a number falls with its distance to a phrase, over a soft and a hard boundary, and for a phrase against it."""
    n, number = "(1 + CASE WHEN k % 4 = 3 THEN k % 60 ELSE k % 40 END)", f"'9' || {digits(9)}"
    text = in_turn([f"'телефон' || repeat(' ', {n}) || {number}", f"'телефон:' || repeat(' ', {n} - 1) || {number}", f"'телефон;' || repeat(' ', {n} - 1) || {number}", f"'договор' || repeat(' ', {n}) || {number}"])
    rows = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), "k").selectExpr("k", f"{text} AS text")
    return exploded(rows, detectors.detect(F.col("text"), ("PHONE",)), "k").select("k", F.round("m.confidence", 9).alias("confidence"))


def _shaky(text: str):
    """A plug-in that fails for some texts."""
    if "1" in text:
        raise ValueError("not these")
    return [("NUMBER", 0, len(text), 0.9)]


@query("SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT LIKE '%1%'")
def plugin_failures(spark, sf_dir):
    """With rule_only a plug-in that fails is left out for that text."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("text"))
    return exploded(rows, detectors.detect(F.col("text"), (), plugins={"shaky": _shaky}, degradation="rule_only"), "k").select("k", "m.value")


_FIRST, _SECOND = pick("Белова Ольга", "Соколов Павел", "Ким Анна"), pick("Орлов Пётр", "Ли Вера")


@query(
    f"""SELECT k, x.s AS start, x.v AS value, x.c AS confidence FROM (SELECT k, unnest([{{'s': 0, 'v': {_FIRST}, 'c': 0.85::DOUBLE}}, {{'s': CAST(length({_FIRST}) + 3 AS INT), 'v': {_SECOND}, 'c': 0.9::DOUBLE}}]) AS x
    FROM (SELECT c_custkey AS k FROM customer)) WHERE NOT (k % 7 = 0 AND x.s = 0)"""
)
def ner_names(spark, sf_dir):
    """Token predictions of each customer's text to names: cut at conjunctions, as sure as the least sure token, other labels and doubtful names left out."""
    rows = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"), "k").selectExpr("k", f"{_FIRST} AS a", f"{_SECOND} AS b")
    text = F.concat("a", F.lit(" и "), "b", F.lit(", ООО Вега"))
    n, first, second = F.length("a"), F.position(F.lit(" "), F.col("a")), F.position(F.lit(" "), F.col("b"))

    def token(label: str, start, end, sure):
        return F.struct(F.lit(label).alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), sure.cast("double").alias("confidence"))

    at = n + 3
    tokens = F.array(
        token("B-PER", F.lit(0), first - 1, F.when(F.col("k") % 7 == 0, 0.5).otherwise(0.95)),
        token("I-PER", first, n, F.lit(0.85)),
        token("I-PER", n + 1, n + 2, F.lit(0.9)),
        token("I-PER", at, at + second - 1, F.lit(0.9)),
        token("I-PER", at + second, at + F.length("b"), F.lit(0.9)),
        token("B-ORG", at + F.length("b") + 6, at + F.length("b") + 10, F.lit(0.99)),
    )
    rows = rows.select("k", text.alias("text"), tokens.alias("tokens"))
    return exploded(rows, ner.from_predictions(F.col("text"), F.col("tokens")), "k").select("k", "m.start", "m.value", "m.confidence")


@query()
def ner_backend(spark, sf_dir):
    """A pluggable model over all conversations (here a stand-in): names by role."""
    rows = table(spark, sf_dir, "conversations").select("role", "text")
    tokens = rows.withColumn("tokens", ner.predict(F.col("text"), ner.CapitalisedBackend))
    return exploded(tokens, ner.from_predictions(F.col("text"), F.col("tokens")), "role").groupBy("role").agg(F.count("*").alias("n"))


@query(
    """WITH each AS (SELECT 'd' || c_custkey % 2 AS dataset, unnest(CASE c_custkey % 6 WHEN 0 THEN [{'t': 'EMAIL', 'tp': 1, 'fp': 0, 'fn': 0, 's': 0, 'y': 0, 'l': 0, 'o': 0}]
        WHEN 1 THEN [{'t': 'PHONE', 'tp': 0, 'fp': 0, 'fn': 0, 's': 1, 'y': 0, 'l': 1, 'o': 0}] WHEN 2 THEN [{'t': 'PHONE', 'tp': 0, 'fp': 0, 'fn': 0, 's': 0, 'y': 1, 'l': 0, 'o': 0}]
        WHEN 3 THEN [{'t': 'CARD', 'tp': 0, 'fp': 0, 'fn': 1, 's': 0, 'y': 0, 'l': 1, 'o': 0}] WHEN 4 THEN [{'t': 'EMAIL', 'tp': 0, 'fp': 1, 'fn': 0, 's': 0, 'y': 0, 'l': 0, 'o': 0}]
        ELSE [{'t': 'CARD', 'tp': 1, 'fp': 0, 'fn': 0, 's': 0, 'y': 0, 'l': 0, 'o': 0}, {'t': 'EMAIL', 'tp': 0, 'fp': 0, 'fn': 0, 's': 1, 'y': 0, 'l': 0, 'o': 1}] END) AS x FROM customer)
    SELECT dataset, x.t AS pii_type, sum(x.tp)::INT AS tp, sum(x.fp)::INT AS fp, sum(x.fn)::INT AS fn, sum(x.s)::INT AS span_errors, sum(x.y)::INT AS type_errors, sum(x.l)::INT AS partial_leaks, sum(x.o)::INT AS overmasking
    FROM each GROUP BY ALL"""
)
def quality_cases(spark, sf_dir):
    """One case of a kind of error for each customer: found, too short, of another type, missed, invented, and two entities of which one is too wide."""
    k, start = F.col("k"), (F.col("k") % 9).cast("int")

    def want(kind: str, a: int, b: int):
        return F.struct(F.lit(kind).alias("type"), (start + a).alias("start"), (start + b).alias("end"), F.lit("").alias("value"))

    def have(kind: str, a: int, b: int):
        return F.struct(F.lit(kind).alias("pii_type"), F.lit("").alias("value"), (start + a).alias("start"), (start + b).alias("end"), F.lit(1.0).alias("confidence"))

    none_want, none_have = F.array().cast(readers.ENTITY), F.array().cast(S.MATCHES)
    steps = [
        ([want("EMAIL", 0, 5)], [have("EMAIL", 0, 5)]),
        ([want("PHONE", 0, 5)], [have("PHONE", 1, 5)]),
        ([want("PHONE", 0, 5)], [have("INN", 0, 5)]),
        ([want("CARD", 0, 5)], []),
        ([], [have("EMAIL", 3, 9)]),
        ([want("CARD", 0, 5), want("EMAIL", 7, 12)], [have("EMAIL", 6, 12), have("CARD", 0, 5)]),
    ]
    expected, actual = none_want, none_have
    for i, (e, a) in enumerate(steps):
        expected = F.when(k % 6 == i, F.array(*e) if e else none_want).otherwise(expected)
        actual = F.when(k % 6 == i, F.array(*a) if a else none_have).otherwise(actual)
    cases = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").select(F.concat(F.lit("d"), (k % 2).cast("string")).alias("dataset"), expected.alias("expected"), actual.alias("actual"))
    return evaluation.quality(cases).where("pii_type is not null").select("dataset", "pii_type", *[F.col(c).cast("int").alias(c) for c in evaluation.COUNTS])


_RATES_SQL = f"""WITH each AS ({_EACH_SQL}),
    sums AS (SELECT dataset, pii_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(span_errors + type_errors)::BIGINT AS wrong FROM each GROUP BY ROLLUP (dataset, pii_type)),
    rates AS (SELECT *, tp::DOUBLE / (tp + fp + wrong) AS p, tp::DOUBLE / (tp + fn + wrong) AS r, tp::DOUBLE / (tp + wrong) AS e, 2 * p * r / (p + r) AS f1 FROM sums WHERE dataset IS NOT NULL)"""


@query(f"{_RATES_SQL} SELECT dataset, round(avg(f1) FILTER (pii_type IS NOT NULL), 9) AS macro_f1, round(max(f1) FILTER (pii_type IS NULL), 9) AS micro_f1 FROM rates GROUP BY dataset")
def quality_macro(spark, sf_dir):
    out = evaluation.macro_micro(evaluation.rollup(_each(spark, sf_dir)))
    return out.select("dataset", F.round("macro_f1", 9).alias("macro_f1"), F.round("micro_f1", 9).alias("micro_f1"))


@query(f"{_RATES_SQL} SELECT dataset, round(e, 9) AS exact_span, round(f1, 9) AS f1 FROM rates WHERE pii_type IS NULL AND (f1 < CASE dataset WHEN 'd0' THEN 0.99 ELSE 0.1 END - 0.01 OR r < 0.5 OR e < 0.7)")
def quality_ratchet(spark, sf_dir):
    """Datasets under their baselines or the floors."""
    baseline = _each(spark, sf_dir).select("dataset").distinct().select("dataset", F.when(F.col("dataset") == "d0", 0.99).otherwise(0.1).alias("f1"))
    out = evaluation.ratchet(evaluation.rollup(_each(spark, sf_dir)), baseline)
    return out.select("dataset", F.round("exact_span", 9).alias("exact_span"), F.round("f1", 9).alias("f1"))


_PAIR_SQL = "SELECT l_orderkey AS doc, l_linenumber AS n, CAST(l_partkey % 400 AS INT) AS a, CAST(l_partkey % 400 + 1 + l_suppkey % 90 AS INT) AS b, CAST(l_suppkey % 400 AS INT) AS c, CAST(l_suppkey % 400 + 1 + l_partkey % 70 AS INT) AS d FROM lineitem"


@query(f"WITH s AS ({_PAIR_SQL}) SELECT x.doc, x.n, y.n AS m, least(x.b, y.d) - greatest(x.a, y.c) AS common FROM s x JOIN s y ON x.doc = y.doc AND x.a < y.d AND y.c < x.b")
def span_overlaps(spark, sf_dir):
    """Every pair of overlapping spans of two sets in the same document, by a range join."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS n", "CAST(l_partkey % 400 AS INT) AS a", "CAST(l_suppkey % 90 AS INT) AS u", "CAST(l_suppkey % 400 AS INT) AS c", "CAST(l_partkey % 70 AS INT) AS v")
    left = rows.select("doc", "n", F.col("a").alias("start"), (F.col("a") + 1 + F.col("u")).alias("end"))
    right = rows.select("doc", F.col("n").alias("m"), F.col("c").alias("start"), (F.col("c") + 1 + F.col("v")).alias("end"))
    return evaluation.overlap_join(left, right, "doc").select("doc", "n", "m", "common")


@query(
    """SELECT l_orderkey AS doc, l_linenumber AS n, 'T' || l_linenumber AS type, CAST(l_partkey % 50 AS INT) AS start, CAST(l_partkey % 50 + 3 AS INT) AS "end" FROM lineitem WHERE l_linenumber % 3 > 0"""
)
def entities_parse(spark, sf_dir):
    """Annotations in a JSON column, null and blank ones among them."""
    json = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_partkey") % 2 == 0, " ")).otherwise(
        F.format_string('[{"type": "T%d", "start": %d, "end": %d, "value": "abc"}]', "l_linenumber", F.col("l_partkey") % 50, F.col("l_partkey") % 50 + 3)
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), readers.entities(json).alias("e"))
    return exploded(rows, "e", "doc", "n").select("doc", "n", "m.type", "m.start", "m.end")


@query("""SELECT k, x.s AS start, x.e AS "end", x.v AS value FROM (SELECT k, unnest([{'s': 5, 'e': 6 + length(k::VARCHAR), 'v': 'N' || k}, {'s': 9 + length(k::VARCHAR), 'e': 10 + 2 * length(k::VARCHAR), 'v': 'M' || k}]) AS x FROM (SELECT c_custkey AS k FROM customer))""")
def annotate_cases(spark, sf_dir):
    """Expected spans to entities with offsets."""
    k = F.col("k").cast("string")
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").select("k", k.alias("id"), F.lit("NAME").alias("category"), F.concat(F.lit("name N"), k, F.lit(" + M"), k, F.lit(" end")).alias("text"), F.concat(F.lit("N"), k, F.lit("; M"), k).alias("expected_span"))
    out = readers.annotated(rows)
    return exploded(out, readers.entities(F.col("expected_entities")), "k").select("k", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.value")


@query("SELECT DISTINCT value FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'анна' WHEN 1 THEN 'ivan' WHEN 2 THEN 'петровна' WHEN 3 THEN 'о' ELSE 'ильич' END AS value FROM customer) WHERE value IN ('петровна', 'ильич')")
def lexicon_patronymics(spark, sf_dir):
    words = table(spark, sf_dir, "customer").selectExpr(f"{pick('анна', 'ivan', 'петровна', 'о', 'ильич', key='c_custkey')} AS value").distinct()
    return readers.lexicon_filter(words, "patronymic")


@query("SELECT conv_id, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def chat_explode(spark, sf_dir):
    """Conversations folded to chat requests and unfolded again."""
    m = F.struct(F.col("turn").alias("t"), F.col("role"), F.col("text").alias("content"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))
    return readers.chat_messages(chats).groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))

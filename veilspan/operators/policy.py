"""Consumers' policies and model endpoints as tables: loading, joining, and what they allow."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.tables import written

_CONSUMER = (
    "consumer_id string, enabled boolean, enabled_pii_types array<string>, excluded_pii_types array<string>, allow_demasking boolean, min_confidence double, "
    "masking_mode string, degradation string, require_card_for_pin boolean, custom_terms array<string>, max_tokens_per_request int, api_keys array<string>"
)
POLICY_FILE = "consumers array<struct<" + _CONSUMER.replace(" ", ":").replace(",:", ",") + ">>"
MODEL_FILE = "models array<struct<name:string,api_base:string,model:string>>"
DEFAULT = "default"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def policies_of(consumers: DataFrame) -> DataFrame:
    """Rows with every policy field filled in; entries without consumer_id are dropped."""
    fill = {
        "enabled": F.lit(True),
        "enabled_pii_types": strings(P.MANDATORY),
        "excluded_pii_types": strings(()),
        "allow_demasking": F.lit(True),
        "min_confidence": F.lit(P.MIN_CONFIDENCE),
        "masking_mode": F.lit("typed_placeholder"),
        "degradation": F.lit("fail_closed"),
        "require_card_for_pin": F.lit(True),
        "custom_terms": strings(()),
        "api_keys": strings(()),
    }
    rows = consumers.where("consumer_id is not null").withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})
    return rows.withColumn("effective_types", effective_types(F.col("enabled_pii_types"), F.col("excluded_pii_types")))


def effective_types(enabled: Column, excluded: Column) -> Column:
    return F.array_sort(F.array_except(enabled, excluded))


def load_policies(spark: SparkSession, path: str) -> DataFrame:
    return policies_of(spark.read.schema(POLICY_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("consumers")))


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """(name, api_base, model): entries without name or api_base are dropped, model defaults to the name, trailing slashes go."""
    return models_of(spark.read.schema(MODEL_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("models")))


def models_of(rows: DataFrame) -> DataFrame:
    rows = rows.where("coalesce(name, '') <> '' and coalesce(api_base, '') <> ''")
    return rows.select("name", F.regexp_replace("api_base", "/+$", "").alias("api_base"), F.coalesce(F.nullif(F.col("model"), F.lit("")), "name").alias("model"))


class Reloading:
    """A small table that is read again after a while; a failed read keeps the last good one and waits as long again."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self._load, self._ttl, self._clock, self._at, self._rows, self._schema = load, ttl, clock, None, None, None

    def get(self, spark: SparkSession) -> DataFrame:
        now = self._clock()
        if self._at is None or now - self._at >= self._ttl:
            self._at = now
            try:
                table = self._load()
                self._rows, self._schema = table.collect(), table.schema  # a configuration file's rows
            except Exception:
                if self._rows is None:
                    raise
        return spark.createDataFrame(self._rows, self._schema)


def with_policy(rows: DataFrame, policies: DataFrame, consumer: str = "consumer_id") -> DataFrame:
    """Joins each row with its consumer's policy, or the default one if it is unknown or null; the policy is struct ``policy``.

    Policies are a configuration file's rows; they are broadcast only if Spark's own size limit allows.
    """
    known = policies.select(F.col("consumer_id").alias("_id"), F.struct(*policies.columns).alias("_own"))
    base = policies.where(F.col("consumer_id") == DEFAULT).limit(1).collect()
    out = rows.join(known, F.col(consumer) == F.col("_id"), "left").drop("_id")
    if base:
        fallback = F.struct(*[F.lit(base[0][f.name]).cast(f.dataType).alias(f.name) for f in policies.schema])
        return out.withColumn("policy", F.coalesce("_own", fallback)).drop("_own")
    return out.withColumnRenamed("_own", "policy")


def allowed(policy: Column, key: Column) -> Column:
    """Whether a request passes: a known enabled consumer, and one of its keys if it has any."""
    return F.coalesce(policy["enabled"] & ((F.size(policy["api_keys"]) == 0) | F.array_contains(policy["api_keys"], key)), F.lit(False))


def check_access(requests: DataFrame, policies: DataFrame, consumer: str = "consumer_id", key: str = "api_key") -> DataFrame:
    """Adds ``allowed``: null, unknown and disabled consumers are denied (no default profile here)."""
    known = policies.select(F.col("consumer_id").alias("_id"), F.struct("enabled", "api_keys").alias("_p"))
    return requests.join(known, F.col(consumer) == F.col("_id"), "left").withColumn("allowed", allowed(F.col("_p"), F.coalesce(F.col(key), F.lit("")))).drop("_id", "_p")


def api_key(authorization: Column, x_api_key: Column) -> Column:
    """The bearer token (the scheme in any case), else the X-API-Key header."""
    bearer = F.nullif(F.regexp_extract(F.coalesce(authorization, F.lit("")), r"(?i)^bearer\s+(.*)$", 1), F.lit(""))
    return F.coalesce(F.trim(bearer), x_api_key)


def route(requests: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """Adds api_base and upstream of the requested model, and status 200 or 404."""
    table = models.select(F.col("name").alias("_name"), "api_base", F.col("model").alias("upstream"))
    return requests.join(table, F.col(model) == F.col("_name"), "left").withColumn("status", F.when(F.col("_name").isNull(), 404).otherwise(200)).drop("_name")


def over_quota(max_tokens: Column, quota: Column) -> Column:
    """Whether a request asks for more tokens than its consumer may."""
    return F.coalesce(F.coalesce(max_tokens, F.lit(0)) > quota, F.lit(False))


def round_robin(rows: DataFrame, order: str, backends: int, partitions: int | None = None) -> DataFrame:
    """Deals rows to backends in turn, in order of ``order``, without one task seeing all rows.

    Each partition of a range partitioning numbers its own rows; the partitions' sizes give the offsets. The numbered
    rows are written once, and sizes and rows are both read from there: a range partitioning that runs again
    can cut elsewhere. Columns of the input can't be named _p or _i.
    """
    ranged = rows.repartitionByRange(partitions, order) if partitions else rows.repartitionByRange(order)
    numbered = ranged.sortWithinPartitions(order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    kept = written(numbered)
    sizes = {r[0]: r[1] for r in kept.groupBy("_p").count().collect()}  # a number for each partition
    first, total = {}, 0
    for p in sorted(sizes):
        first[p], total = total, total + sizes[p]
    offsets = F.create_map(*[F.lit(x) for p in first.items() for x in p]) if first else F.create_map().cast("map<int,int>")
    place = F.try_element_at(offsets, F.col("_p")) + F.col("_i")
    return kept.withColumn("backend", F.pmod(place, F.lit(backends)).cast("int")).drop("_p", "_i")

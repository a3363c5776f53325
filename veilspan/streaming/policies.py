"""Masking under consumers' policies that can change while a stream runs.

Before each micro-batch the policies' file is looked at; a changed one is read as a whole and checked, and acts on that
micro-batch. One that can't be read, or holds a policy that can't act, changes nothing: the last good policies stay.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.detectors import TYPES
from ..operators.masking import Policy
from ..operators.policy import allowed, load_policies, with_policy
from ..operators.restore import Masker

_log = logging.getLogger(__name__)
MODES = ("typed_placeholder", "synthetic", "format_preserving")
_OWN = ("effective_types", "min_confidence", "masking_mode", "require_card_for_pin", "custom_terms")
MASKED = "struct<masked:string,mapping:array<struct<placeholder:string,value:string>>,pii_types:array<string>>"


def masked_by(text: Column, policy: Column) -> Column:
    """Each text masked by the policy in its own row (a struct of a policies' table), as MASKED; nulls give null.

    Policies repeat, so the detectors of each are made once a worker.
    """

    @F.pandas_udf(MASKED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[str, Policy] = {}
        for texts, own in batches:
            out = []
            for t, p in zip(texts, own):
                if t is None or p is None:
                    out.append((None, None, None))
                    continue
                if p not in known:
                    d = json.loads(p)
                    known[p] = Policy(tuple(d["effective_types"]), (), d["min_confidence"], d["masking_mode"], "fail_closed", d["require_card_for_pin"], tuple(d["custom_terms"]))
                m = Masker(known[p])
                text = m.mask(t)
                out.append((text, [{"placeholder": k, "value": v} for k, v in m.mapping.items()], m.pii_types))
            yield pd.DataFrame(out, columns=["masked", "mapping", "pii_types"])

    return run(text, F.to_json(F.when(policy.isNotNull(), F.struct(*[policy[c].alias(c) for c in _OWN]))))


def mask_requests(requests: DataFrame, policies: DataFrame, key: str = "api_key") -> DataFrame:
    """Adds consumer, status, masked, mapping and pii_types to requests (consumer_id, text[, api_key]).

    An unknown or null consumer has the policy named default; 403 without any, for a disabled consumer, or for a
    wrong key where the policy has keys: such texts aren't masked and don't go on. A null text has nulls.
    """
    out = with_policy(requests, policies)
    given = F.coalesce(F.col(key), F.lit("")) if key in requests.columns else F.lit("")
    status = F.when(allowed(F.col("policy"), given), 200).otherwise(403)
    out = out.withColumns({"consumer": F.col("policy.consumer_id"), "status": status})
    out = out.withColumn("_m", masked_by(F.when(F.col("status") == 200, F.col("text")), F.col("policy")))
    return out.withColumns({c: F.col(f"_m.{c}") for c in ("masked", "mapping", "pii_types")}).drop("_m", "policy")


def checked(policies: DataFrame) -> DataFrame:
    """The policies, read now; an error if one of them can't act: an unknown type or mode, a confidence beyond 0 to 1, a name twice."""
    rows = policies.collect()  # a configuration file's rows
    names = [r.consumer_id for r in rows]
    for r in rows:
        unknown = (set(r.enabled_pii_types) | set(r.excluded_pii_types)) - set(TYPES) - set(P.MANDATORY)
        if unknown or r.masking_mode not in MODES or not 0 <= r.min_confidence <= 1:
            raise ValueError(f"policy {r.consumer_id}: {sorted(unknown) or r.masking_mode if unknown or r.masking_mode not in MODES else r.min_confidence}")
    if len(set(names)) < len(names):
        raise ValueError("a consumer has two policies")
    return policies.sparkSession.createDataFrame(rows, policies.schema)


class PolicyFile:
    """The policies in a file, read again when the file has changed (by its time of change and length)."""

    def __init__(self, path: str, load: Callable[[SparkSession, str], DataFrame] = load_policies):
        self._path, self._load, self._seen, self._good = path, load, None, None
        self.error: Exception | None = None  #: why the latest change doesn't act

    def _mark(self, spark: SparkSession) -> tuple[int, int]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path)
        status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        return status.getModificationTime(), status.getLen()

    def get(self, spark: SparkSession) -> DataFrame:
        """The last good policies; an error only if there never were any."""
        try:
            mark = self._mark(spark)
            if mark != self._seen:
                self._seen = mark
                self._good, self.error = checked(self._load(spark, self._path)), None
        except Exception as e:
            self.error = e
            if self._good is None:
                self._seen = None
                raise
            _log.warning("the policies in %s don't act: %s", self._path, e)
        return self._good


def write_masked(requests: DataFrame, policies: PolicyFile, path: str, checkpoint: str, **trigger):
    """Starts a query that masks requests by the policies of their time and writes them to Parquet, a folder ``batch=N`` for each
    micro-batch. A micro-batch that runs again after a failure replaces its folder, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        mask_requests(batch, policies.get(batch.sparkSession)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()

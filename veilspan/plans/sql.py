"""SQL surface: functions and a table function to register with a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.evaluation import quality_metrics
from ..operators.masking import Policy
from ..operators.restore import Masker, detectors_of, resolve
from ..operators.detectors import find

SPAN = "pii_type string, value string, start int, end int, confidence double"


def register(spark: SparkSession, policy: Policy = Policy()) -> None:
    """Registers detect_spans(text), a table function, and pii_mask(text), both of a policy; and quality_metrics(tp, fp, fn, wrong), an aggregate.

    detect_spans gives the resolved findings of a text, a row each: SELECT ... FROM t, LATERAL detect_spans(t.text).
    Detectors are made once a task.
    """

    class DetectSpans:
        def __init__(self):
            self._detectors = detectors_of(policy)

        def eval(self, text: str) -> Iterator[tuple]:
            if text is not None:
                for kind, a, b, sure in resolve(f for f in find(text, self._detectors) if f[3] >= policy.min_confidence):
                    yield kind, text[a:b], a, b, float(sure)

    @F.pandas_udf("string")
    def pii_mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else Masker(policy).mask(t))

    spark.udtf.register("detect_spans", udtf(DetectSpans, returnType=SPAN))
    spark.udf.register("pii_mask", pii_mask)
    spark.udf.register("quality_metrics", quality_metrics())

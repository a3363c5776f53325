"""Masking of a column of texts under a policy, and of whole conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions.lexicon import Lexicon
from ..functions.native_context import NATIVE_CONTEXT, pin
from ..functions.tables import written
from .detectors import TYPES, detect


@dataclass(frozen=True)
class Policy:
    """What a consumer wants masked, and how. ``types`` None enables every detector, as the library's default does."""

    types: tuple[str, ...] | None = None
    excluded: tuple[str, ...] = ()
    min_confidence: float = P.MIN_CONFIDENCE
    mode: str = "typed_placeholder"
    degradation: str = "fail_closed"
    require_card_for_pin: bool = True
    custom_terms: tuple[str, ...] = ()
    allow_demasking: bool = True

    def effective(self) -> tuple[str, ...]:
        return tuple(t for t in (TYPES if self.types is None else self.types) if t not in self.excluded)


#: A consumer's policy unless it says otherwise: the 17 mandatory types.
CONSUMER_DEFAULT = Policy(P.MANDATORY)


def candidates(text: Column, policy: Policy = Policy(), lexicon: Lexicon | None = None) -> Column:
    return detect(text, policy.effective(), policy.require_card_for_pin, policy.custom_terms, lexicon, degradation=policy.degradation)


def native_candidates(text: Column, policy: Policy, native: bool | str = "context") -> Column:
    """``candidates`` by column expressions, for types that have one. ``native`` True: cards and INNs by their checksums only."""
    known = S.NATIVE | (NATIVE_CONTEXT | {"PIN": lambda t: pin(t, policy.require_card_for_pin)} if native == "context" else {})
    missing = set(policy.effective()) - set(known)
    if missing or policy.custom_terms:
        raise ValueError(f"no native detector for {sorted(missing) or 'custom terms'}")
    return F.concat(*[known[k](text) for k in policy.effective()])


def mask(df: DataFrame, text: str = "text", policy: Policy = Policy(), lexicon: Lexicon | None = None, native: bool | str = False, keep_candidates: bool = False) -> DataFrame:
    """Adds matches (resolved), masked, mapping, pii_types and decisions to each row; a null text has nulls.

    ``native`` uses column expressions and no Python; the policy may then name no type that has none. "context" gives the same
    matches as Python for the types in ``native_context``, e-mails and SNILS; True knows e-mails and checked numbers only (a
    card or INN whose checksum fails isn't found by its context). All other columns pass through untouched; one that is named like a column
    that is added is refused.
    """
    _refuse(df, ["matches", "masked", "mapping", "pii_types", "decisions", *(["candidates"] if keep_candidates else [])])
    t = F.col(text)
    if native:
        found = native_candidates(t, policy, native)
    else:
        found = candidates(t, policy, lexicon)
    out = df.withColumn("__veilspan_found", found).withColumn("__veilspan_ok", S.eligible(F.col("__veilspan_found"), policy.min_confidence)).withColumn("matches", S.resolve(F.col("__veilspan_ok")))
    out = out.withColumn("__veilspan_masked", S.mask_struct(t, F.col("matches"), policy.mode))
    out = out.withColumns(
        {
            "masked": F.col("__veilspan_masked.masked"),
            "mapping": F.col("__veilspan_masked.mapping"),
            "pii_types": S.kinds_present(F.col("matches")),
            "decisions": S.decisions(F.col("__veilspan_found"), F.col("__veilspan_ok"), F.col("matches")),
        }
    )
    return out.withColumnRenamed("__veilspan_found", "candidates").drop("__veilspan_ok", "__veilspan_masked") if keep_candidates else out.drop("__veilspan_found", "__veilspan_ok", "__veilspan_masked")


def demask(df: DataFrame, masked: str = "masked", mapping: str = "mapping", to: str = "restored", policy: Policy = Policy()) -> DataFrame:
    """Restores masked texts exactly, unless the policy forbids it: then they stay as they are."""
    return df.withColumn(to, S.demask(F.col(masked), F.col(mapping)) if policy.allow_demasking else F.col(masked))


def mask_chat(df: DataFrame, policy: Policy = Policy(), conv: str = "conv_id", turn: str = "turn", text: str = "text", native: bool | str = False) -> DataFrame:
    """Masks the messages of conversations with placeholder numbers that go on from message to message.

    The counts of each type before a message are sums over the conversation's earlier messages, so a
    long conversation only sends small counts through its window, not its texts. Rows must be unique by
    (conversation, turn), as the order within a turn is undefined. Columns named like one that is added are refused.
    """
    _refuse(df, ["matches", "masked", "mapping"])
    t = F.col(text)
    found = native_candidates(t, policy, native) if native else candidates(t, policy)
    # read twice, so written: detectors run once a text
    marked = written(df.withColumn("matches", S.resolve(S.eligible(found, policy.min_confidence))))
    counts = marked.select(F.col(conv).alias("__veilspan_conv"), F.col(turn).alias("__veilspan_turn"), F.explode("matches.pii_type").alias("kind"))
    by_turn = ["__veilspan_conv", "__veilspan_turn"]
    counts = counts.groupBy(*by_turn, "kind").agg(F.count("*").cast("int").alias("n"))
    before = Window.partitionBy("__veilspan_conv", "kind").orderBy("__veilspan_turn").rowsBetween(Window.unboundedPreceding, -1)
    used = counts.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    used = used.groupBy(*by_turn).agg(F.map_from_entries(F.collect_list(F.struct("kind", "used"))).alias("__veilspan_used"))  # an entry for each type
    same = F.col(conv).eqNullSafe(F.col("__veilspan_conv")) & F.col(turn).eqNullSafe(F.col("__veilspan_turn"))
    none = F.create_map().cast("map<string,int>")
    out = marked.join(used, same, "left").drop(*by_turn)
    out = out.withColumn("__veilspan_m", S.mask_struct(t, F.col("matches"), policy.mode, F.coalesce(F.col("__veilspan_used"), none)))
    return out.withColumns({"masked": F.col("__veilspan_m.masked"), "mapping": F.col("__veilspan_m.mapping")}).drop("__veilspan_m", "__veilspan_used")


def _refuse(df: DataFrame, added: list[str]) -> None:
    clash = set(added) & set(df.columns)
    if clash:
        raise ValueError(f"rename the input's columns {sorted(clash)}: masking adds columns of these names")

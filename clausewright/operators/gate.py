"""Descriptions that assert more than their quote, and the merge of enriched fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Markers of obligation, governing verbs with their inflections, nouns with an infinitive.
MODALS = ("shall", "must", "will", "are to", "is to", "is responsible for", "required to", "required", "requires", "require")
VERBS = {
    "implement": ("implement", "implements", "implemented", "implementing"),
    "establish": ("establish", "establishes", "established", "establishing"),
    "maintain": ("maintain", "maintains", "maintained", "maintaining"),
    "enforce": ("enforce", "enforces", "enforced", "enforcing"),
    "ensure": ("ensure", "ensures", "ensured", "ensuring"),
}
NOUNS = ("responsibility", "duty", "obligation", "requirement")


def has_modal(x: Column, modals: tuple[str, ...] = MODALS) -> Column:
    return T.normalize_text(x).rlike(rf"\b(?:{'|'.join(modals)})\b")


def governs(x: Column, forms: tuple[str, ...], modals: tuple[str, ...] = MODALS) -> Column:
    """A form of the verb that is no infinitive of purpose: not after "to", unless that
    "to" ends a marker or follows a noun of obligation."""
    tied = "|".join([m for m in modals if m.endswith(" to")] + [f"{n} to" for n in NOUNS])
    verb = "|".join(forms)
    return T.normalize_text(x).rlike(rf"(?:(?<!\bto )\b(?:{verb})\b)|(?:\b(?:{tied}) (?:{verb})\b)")


def has_obligation(x: Column) -> Column:
    out = has_modal(x)
    for forms in VERBS.values():
        out = out | governs(x, forms)
    return out


def fabricated(quote: Column, description: Column) -> Column:
    q, d = F.coalesce(quote, F.lit("")), F.coalesce(description, F.lit(""))
    return (q != "") & (d != "") & ~has_obligation(q) & has_obligation(d)


def gated(df: DataFrame, support: Column | None = None, least: float = 0.85) -> DataFrame:
    """``gate_errors`` and the description, cleared where rejected; no row is dropped.
    A description equal to its quote passes; without a score only the rule counts."""
    q, d = F.col("source_quote"), F.coalesce("description", F.lit(""))
    checked = (d != "") & (T.normalize_text(d) != T.normalize_text(F.coalesce(q, F.lit(""))))
    low = F.coalesce(support < least, F.lit(False)) if support is not None else F.lit(False)
    errors = F.array_compact(F.array(F.when(low, "low_support"), F.when(fabricated(q, d), "fabricated_obligation")))
    df = df.withColumn("gate_errors", F.when(checked, errors).otherwise(F.array().cast("array<string>")))
    return df.withColumn("rejected_description", F.when(F.size("gate_errors") > 0, F.col("description"))).withColumn("description", F.when(F.size("gate_errors") > 0, "").otherwise(F.col("description")))


def with_support(df: DataFrame, scorer, name: str = "support") -> DataFrame:
    """``support`` of each description by its quote, from a provider with
    ``score(quotes, descriptions)`` for a batch; only descriptions that are there and not
    a copy of the quote are scored, and a failing batch has no scores, so that then the
    rule alone decides."""
    q, d = F.coalesce("source_quote", F.lit("")), F.coalesce("description", F.lit(""))
    asked = (d != "") & (T.normalize_text(d) != T.normalize_text(q))

    @F.pandas_udf("double")
    def score(quote: pd.Series, description: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(quote), dtype="float64")
        at = description.notna()
        if at.any():
            try:
                out[at] = [float(x) for x in scorer.score(list(quote[at]), list(description[at]))]
            except Exception:
                pass
        return out

    return df.withColumn(name, score(q, F.when(asked, d)))

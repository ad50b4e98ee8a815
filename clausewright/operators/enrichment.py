"""Descriptions, tags and types added to requirements by a model, with a cache.

A row whose cached fields are of the same model is not asked for again. The others go to
the provider in batches; an answer that is no list of the batch's length is asked for
row by row, and rows whose answer fails stay as they are. The answers are stored raw
before they are parsed, so that parsing can run again without the model.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.model_json import recover_json_array, recover_json_object
from .pick import greatest_row

FIELDS = ("description", "domain_tags", "requirement_type")


def filled() -> Column:
    """Whether any of the enriched fields holds something."""
    return (F.coalesce("description", F.lit("")) != "") | (F.size(F.coalesce("domain_tags", F.array().cast("array<string>"))) > 0) | (F.coalesce("requirement_type", F.lit("")) != "")


def usable_cache(cache: DataFrame, model: str, order: list[str], key: str = "requirement_id", default_profile: bool = True) -> DataFrame:
    """(key, _cached): of each id the last row that is filled and of the same model.
    Under another profile than the default nothing is, as rows do not tell theirs."""
    c = cache.where(filled() & (F.col("enrichment_model") == model) & F.col(key).isNotNull())
    if not default_profile:
        c = c.limit(0)
    return greatest_row(c.select(key, *FIELDS, *(o for o in order if o not in (key, *FIELDS))), [key], [F.col(o) for o in order]).select(key, F.struct(*FIELDS).alias("_cached"))


def merged(fresh: DataFrame, cached: DataFrame, key: str = "requirement_id") -> DataFrame:
    """Fresh rows with the cached fields where there are any (``enriched``); all that is
    not a model's work stays that of the fresh row."""
    d = fresh.join(cached, key, "left").withColumn("enriched", F.col("_cached").isNotNull())
    return d.withColumns({f: F.when(F.col("enriched"), F.col(f"_cached.{f}")).otherwise(F.col(f)) for f in FIELDS}).drop("_cached")


def prompt_line(n: Column, ref: Column, quote: Column) -> Column:
    """One requirement in a batch's prompt."""
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.when(F.coalesce(ref, F.lit("")) != "", F.concat(F.lit("Ref: "), ref, F.lit(" | "))).otherwise(""), F.to_json(F.struct(F.coalesce(quote, F.lit("")).alias("quote"))))


def raw_answers(rows: DataFrame, provider, key: str = "requirement_id", batch: int = 10) -> DataFrame:
    """(key, raw): for each row the JSON object the model gave, null where it failed.

    ``provider`` has ``enrich_batch(list of (ref, quote))``, which answers with a JSON
    list, and ``enrich_one(ref, quote)``, which answers with an object."""

    def one(ref: str, quote: str) -> str | None:
        try:
            got = recover_json_object(provider.enrich_one(ref, quote))
        except Exception:
            return None
        return None if got is None else json.dumps(got, ensure_ascii=False)

    def many(pairs: list[tuple[str, str]]) -> list[str | None]:
        try:
            got, _ = recover_json_array(provider.enrich_batch(pairs))
        except Exception:
            got = None
        if got is None or len(got) != len(pairs):
            return [one(*p) for p in pairs]
        return [json.dumps(x if isinstance(x, dict) else {}, ensure_ascii=False) for x in got]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = list(zip(f["source_ref"].fillna(""), f["source_quote"].fillna("")))
            raw = [a for i in range(0, len(pairs), batch) for a in many(pairs[i : i + batch])]
            yield pd.DataFrame({key: f[key], "raw": pd.Series(raw, dtype=object)})

    return rows.select(key, "source_ref", "source_quote").mapInPandas(run, f"{key} string, raw string")


def parsed_answers(raw: DataFrame, tags: list[str], types: list[str], key: str = "requirement_id") -> DataFrame:
    """(key, _cached) of the answers: the description stripped, tags in lower case and
    known (a single word is a list of one), an unknown type emptied. Failed answers give
    no row."""
    d = raw.where("raw is not null").withColumn("o", F.from_json("raw", "description string, domain_tags string, requirement_type string"))
    listed = F.coalesce(F.from_json("o.domain_tags", "array<string>"), F.when(F.coalesce("o.domain_tags", F.lit("")) != "", F.array("o.domain_tags")), F.array().cast("array<string>"))
    known = F.filter(F.transform(F.filter(listed, lambda t: t.isNotNull()), lambda t: F.lower(T.stripped(t))), lambda t: t.isin(*tags) if tags else F.lit(False))
    kind = F.lower(T.stripped(F.coalesce("o.requirement_type", F.lit(""))))
    out = F.struct(T.stripped(F.coalesce("o.description", F.lit(""))).alias("description"), known.alias("domain_tags"), F.when(kind.isin(*types), kind).otherwise("").alias("requirement_type"))
    return d.select(key, out.alias("_cached"))


def enriched(fresh: DataFrame, provider, model: str, tags: list[str], types: list[str], cache: DataFrame | None = None, order: tuple[str, ...] = ("enriched_at",), key: str = "requirement_id", default_profile: bool = True, most: int | None = None) -> DataFrame:
    """``fresh`` with the cache merged in and the rest answered by the model: of each id
    once, at most ``most`` ids in order. ``enriched`` and ``enrichment_model`` tell what
    was filled."""
    cached = usable_cache(cache, model, list(order), key, default_profile) if cache is not None else None
    todo = fresh.where(F.col(key).isNotNull())
    if cached is not None:
        todo = todo.join(cached.select(key), key, "left_anti")
    todo = greatest_row(todo.select(key, "source_ref", "source_quote"), [key], [F.coalesce("source_quote", F.lit(""))])
    if most is not None:
        todo = todo.orderBy(key).limit(most)
    answers = parsed_answers(raw_answers(todo, provider, key), tags, types, key)
    got = answers if cached is None else cached.unionByName(answers)
    d = merged(fresh, got, key)
    return d.withColumn("enrichment_model", F.when(F.col("enriched"), F.lit(model)))

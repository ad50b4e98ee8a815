"""The ingest plan: chunks to validated requirements with their side outputs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..operators import chunks as C
from ..operators import enrichment, gate, requirements, stems


class Ingested(NamedTuple):
    requirements: DataFrame
    failures: DataFrame
    parse_failures: DataFrame
    raw: DataFrame
    stats: DataFrame


def ingest(chunks: DataFrame, provider, profile: dict, model: str = "offline", cache: DataFrame | None = None, enricher=None, scorer=None, enrichment_cache: DataFrame | None = None, most_chunks: int | None = None, first_chunk: int = 0) -> Ingested:
    """Kept chunks are prompted, answers parsed, quotes validated and de-duplicated by
    both keys, stems attached, descriptions enriched and gated. Without an enricher the
    extractor's fields stay; without a scorer the rule alone gates. ``raw`` should be
    stored before it is used again, as it calls the model. ``first_chunk`` and
    ``most_chunks`` take a part of each document's kept chunks, in order."""
    kept = C.prompts(C.kept(C.latest_delivery(chunks), profile["skip_sections"]))
    if first_chunk or most_chunks is not None:
        kept = C.numbered(kept).where(F.col("chunk_no") >= first_chunk)
        kept = (kept.where(F.col("chunk_no") < first_chunk + most_chunks) if most_chunks is not None else kept).drop("chunk_no")
    raw = providers.raw_responses(kept, provider, model, cache)
    good, bad = providers.parsed_responses(raw)
    tags, types = profile["domain_tags"], profile["requirement_types"]
    good = requirements.pass1(good, tags, types).withColumn("confidence", requirements.confidence())
    joined = requirements.with_chunks(good, kept).join(kept.select("document_id", "chunk_id", "section_ref_path", "section_title_path"), ["document_id", "chunk_id"], "left")
    checked = requirements.validated(joined)
    valid = requirements.deduplicated_all(checked.where("error is null"))
    valid = stems.with_stems(requirements.fresh_ids(valid).drop("parent_header_text"), kept)
    if enricher is not None:
        default = profile.get("name", "cybersecurity") == "cybersecurity"
        valid = enrichment.enriched(valid.drop("requirement_id").withColumnRenamed("stable_id", "requirement_id"), enricher, model, tags, types, enrichment_cache, default_profile=default).withColumn("stable_id", F.col("requirement_id"))
    if scorer is not None:
        valid = gate.with_support(valid, scorer)
    valid = gate.gated(valid, F.col("support") if scorer is not None else None)
    return Ingested(valid, checked.where("error is not null"), bad, raw, requirements.stats(valid, checked.where("error is not null"), kept))

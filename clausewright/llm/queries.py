"""Queries of the text operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import format_duplicates, lookalikes, mixing, near_duplicates, packing, personal_data, scan_noise, splitting, truncation
from .base import staged, table
from .sizes import token_sizes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.found(table(spark, sf_dir, "sample_normalized_reqs"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the collapsed table by copy count."""
    one = format_duplicates.collapsed(table(spark, sf_dir, "sample_normalized_reqs").select("req_seq", "source_quote", "source_ref"))
    return one.select("req_seq", "n_copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.found(table(spark, sf_dir, "sample_normalized_reqs"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.document_links(table(spark, sf_dir, "sample_normalized_reqs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.found(table(spark, sf_dir, "sample_chunks"), table(spark, sf_dir, "sample_normalized_reqs"))


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text and quote in its consistent form."""
    values = lookalikes.values_of(table(spark, sf_dir, "sample_chunks"), "chunk_seq", "text")
    values = values.unionByName(lookalikes.values_of(table(spark, sf_dir, "sample_normalized_reqs"), "req_seq", "source_quote"))
    return lookalikes.consistent_column(values).select("field_name", "row_seq", "consistent")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found(table(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return personal_data.redacted(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.found(*(table(spark, sf_dir, t) for t in ("sample_chunks", "sample_normalized_reqs", "source_manifest")))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value as continuous paragraphs."""
    values = scan_noise.scanned_values(table(spark, sf_dir, "sample_chunks"), table(spark, sf_dir, "sample_normalized_reqs"))
    return scan_noise.repaired(values, table(spark, sf_dir, "source_manifest")).withColumn("kinds", F.array_join("kinds", ","))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found(table(spark, sf_dir, "sample_chunks"), table(spark, sf_dir, "size_limits"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, overlap = splitting.limits(table(spark, sf_dir, "size_limits"), "chunk_text")
    d = splitting.pieces(table(spark, sf_dir, "sample_chunks"), limit, overlap)
    return d.withColumn("section_ref_path", F.array_join("section_ref_path", " > "))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(table(spark, sf_dir, "labeled_failures"), table(spark, sf_dir, "sample_normalized_reqs"))


def p3_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.share_by_source(table(spark, sf_dir, "labeled_failures"), table(spark, sf_dir, "sample_normalized_reqs"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in containers of either capacity; no text and no token twice."""
    sizes = staged(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    out = None
    for kind in ("pack_small", "pack_large"):
        capacity, _ = splitting.limits(table(spark, sf_dir, "size_limits"), kind)
        d = packing.packed(sizes, capacity).select(F.lit(kind).alias("item_kind"), "container", F.col("row_key").alias("doc_id"), "piece_no", "first_token", "n_tokens")
        out = d if out is None else out.unionByName(d)
    return out


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well either rule fills either kind of container, against the fewest containers
    that each capacity allows."""
    sizes = staged(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    out = None
    for kind in ("pack_small", "pack_large"):
        capacity, _ = splitting.limits(table(spark, sf_dir, "size_limits"), kind)
        for rule in ("norm", "dot"):
            d = packing.report(packing.packed(sizes, capacity, rule=rule), capacity).select(F.lit(kind).alias("item_kind"), F.lit(rule).alias("rule"), "*")
            out = d if out is None else out.unionByName(d)
    return out


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixing.mixed(sizes, table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(staged(p8_mixed(spark, sf_dir), "mix"), table(spark, sf_dir, "mix_targets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    p1_found, p1_repaired, p2_found, p2_pieces, p3_found, p3_share_by_source, p4_found, p4_collapsed, p5_found, p5_links, p6_found, p6_consistent, p7_packed, p7_fill, p8_mixed, p8_shares, p9_found, p9_redacted,
)}

ORACLES: dict[str, str] = {}

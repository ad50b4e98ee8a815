"""Chunks: what is kept, how it is numbered and what its prompt is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .pick import greatest_row


def latest_delivery(chunks: DataFrame) -> DataFrame:
    """One row for each (document_id, chunk_id): the last ingested, then the largest key."""
    return greatest_row(chunks, ["document_id", "chunk_id"], [F.col("ingested_at"), F.col("chunk_seq")])


def kept(chunks: DataFrame, skips: list[str], leader: str = T.TOC_LEADER) -> DataFrame:
    """Without tables of contents, blank bodies and skipped sections, in that order."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return chunks.where(~T.is_toc_text(body, leader)).where(T.stripped(body) != "").where(~T.in_skipped_section(F.col("section_title_path"), skips))


def numbered(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """``chunk_no`` from 0 in each document, after filtering."""
    return chunks.withColumn("chunk_no", F.row_number().over(W.partitionBy("document_id").orderBy(order)) - 1)


def prompts(chunks: DataFrame) -> DataFrame:
    crumb = T.breadcrumb(F.col("section_title_path"), F.col("parent_header_text"))
    return chunks.withColumn("breadcrumb", crumb).withColumn("prompt", T.prompt_text(F.col("breadcrumb"), F.coalesce("text", F.lit(""))))


def page_range(items: DataFrame, by: list[str], page: str) -> DataFrame:
    """Smallest and largest known page of each group, 1 where none is known."""
    p = F.when(F.col(page) > 0, F.col(page))
    return items.groupBy(*by).agg(F.coalesce(F.min(p), F.lit(1)).alias("page_start"), F.coalesce(F.max(p), F.lit(1)).alias("page_end"))


def emit_once(items: DataFrame, doc: str, ref: str, order: str, body: str) -> DataFrame:
    """A table's text at its first place in the document, empty at the others."""
    first = F.row_number().over(W.partitionBy(doc, ref).orderBy(order)) == 1
    return items.withColumn("emitted", F.when(F.col(ref).isNull() | first, F.col(body)).otherwise(""))


def size_stats(chunks: DataFrame) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    crumbs = F.size(F.coalesce("section_title_path", F.array())) > 0
    return chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(n), 1).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(100 * F.avg(crumbs.cast("int")), 1).alias("breadcrumb_pct"))


def skipped_by_items(items: DataFrame, skips: list[str], doc: str = "document_id", chunk: str = "chunk_id") -> DataFrame:
    """(doc, chunk) of the chunks whose every body item is under a skipped heading. An
    item whose ``section_title_path`` is null has no known ancestry and keeps its chunk;
    a chunk without items is not among them."""
    under = F.col("section_title_path").isNotNull() & T.in_skipped_section(F.col("section_title_path"), skips)
    return items.groupBy(doc, chunk).agg(F.bool_and(under).alias("_all")).where("_all").drop("_all")

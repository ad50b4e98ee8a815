"""Search points of requirements and chunks, and their all-or-nothing publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..sources import files
from .pick import greatest_row

#: What a point carries of its requirement, with the value that stands for a missing one.
PAYLOAD = {
    "requirement_id": None, "document_id": "", "source_pdf": "", "source_ref": "", "domain_tags": [], "requirement_type": "", "source_quote": "", "parent_stem": "", "embedding_text": "",
    "description": "", "page_start": None, "page_end": None, "confidence": 0.0, "chunk_id": None, "section_ref_path": [], "section_title_path": [], "parent_section_ref": None,
    "parent_context": None, "child_section_refs": [], "domain_profile": "cybersecurity", "schema_version": "", "pipeline_version": "", "extraction_model": "", "run_timestamp": "",
}
_TYPES = {"page_start": "int", "page_end": "int", "chunk_id": "int", "requirement_id": "string", "parent_section_ref": "string", "parent_context": "string"}


def payload(reqs: DataFrame, model: str, dim: Column) -> list[Column]:
    """The columns of a requirement's point; a column the table lacks gets its default."""

    def column(name: str, default) -> Column:
        if isinstance(default, list):
            empty = F.array().cast("array<string>")
            return (F.coalesce(F.col(name), empty) if name in reqs.columns else empty).alias(name)
        if name not in reqs.columns:
            return F.lit(default).cast(_TYPES.get(name, "string" if isinstance(default, str) else "double")).alias(name)
        return (F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))).alias(name)

    return [*(column(n, d) for n, d in PAYLOAD.items()), F.lit(model).alias("embedding_model"), dim.cast("int").alias("embedding_dim")]


def requirement_points(reqs: DataFrame, namespace: str, embed, model: str, order: list[str]) -> DataFrame:
    """(point_id, dense, payload columns): of each requirement the last write. Rows with
    a blank quote are skipped, and rows whose text could not be embedded (null vector).
    ``embed`` makes a vector column of a text column."""
    stemmed = F.col("embedding_text") if "embedding_text" in reqs.columns else F.lit("")
    quote = T.stripped(F.coalesce("source_quote", F.lit("")))
    text = T.embedding_text(T.stripped(F.coalesce(stemmed, F.lit(""))), quote, T.stripped(F.coalesce("source_ref", F.lit(""))))
    d = greatest_row(reqs.where((quote != "") & F.col("requirement_id").isNotNull()), ["requirement_id"], [F.col(c) for c in order])
    d = d.withColumn("_dense", embed(text)).where("_dense is not null")
    return d.select(I.uuid5(F.col("requirement_id"), namespace).alias("point_id"), F.col("_dense").alias("dense"), *payload(d, model, F.size("_dense")))


def context_points(chunks: DataFrame, embed, model: str, order: list[str], longest: int = 1500) -> DataFrame:
    """(point_id, dense, document_id, source_pdf, chunk_id, pages, text, model, dim): of
    each chunk the last write. Only what is embedded is cut to ``longest`` characters; the
    text is kept whole. A chunk without document takes its file's name without
    ``_chunks``; rows without either, or without number, are skipped."""
    stem = files.without_suffix(F.regexp_replace(F.col("source_pdf"), r"\.[A-Za-z]+$", ""), ("_chunks",))
    d = chunks.withColumn("document_id", F.coalesce(F.nullif("document_id", F.lit("")), stem)).where("document_id is not null and chunk_id is not null")
    d = greatest_row(d, ["document_id", "chunk_id"], [F.col(c) for c in order])
    d = d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_dense", embed(F.substring("text", 1, longest))).where("_dense is not null")
    ident = I.uuid5(F.concat_ws(":", "document_id", F.col("chunk_id").cast("string")))
    return d.select(ident.alias("point_id"), F.col("_dense").alias("dense"), "document_id", "source_pdf", "chunk_id", "page_start", "page_end", "text", F.lit(model).alias("embedding_model"), F.size("_dense").alias("embedding_dim"))


def _refused(points: DataFrame) -> str | None:
    """Why an index must not go live: empty, vectors of several lengths, or a point twice."""
    r = points.agg(F.count("*").alias("n"), F.min("embedding_dim").alias("lo"), F.max("embedding_dim").alias("hi"), F.count_distinct("point_id").alias("ids")).first()
    if not r["n"]:
        return "no point was made"
    if r["lo"] != r["hi"]:
        return f"vectors have {r['lo']} to {r['hi']} dimensions"
    return None if r["ids"] == r["n"] else "points repeat"


def publish_index(points: DataFrame, root: str, version: str) -> str:
    """All or nothing: the index is built aside and goes live by one rename; a failure
    of any document, an empty result or vectors of unequal length leave the live one
    untouched. The version before is then deleted."""
    return files.publish_if(points, root, version, _refused, drop_old=True)


def upserted(live: DataFrame, fresh: DataFrame) -> DataFrame:
    """The live index with fresh points added; the fresh one of an id replaces the live."""
    return live.join(fresh.select("point_id"), "point_id", "left_anti").unionByName(fresh)


def status(spark: SparkSession, root: str, indexes: list[str], providers: dict[str, object]) -> dict:
    """What is ready: each index with its live version and points (None where there is
    none), and each provider, asked with ``ready()``; one that fails is not ready."""

    def points(name: str) -> dict:
        version = files.current_version(spark, f"{root}/{name}")
        return {"version": version, "points": files.read_current(spark, f"{root}/{name}").count() if version else None}

    def ready(p: object) -> bool:
        try:
            return bool(p.ready())
        except Exception:
            return False

    return {"indexes": {n: points(n) for n in indexes}, "providers": {n: ready(p) for n, p in providers.items()}}

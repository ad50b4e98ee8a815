"""Audits of a corpus and its labels: snapshots, verdicts, misses, review tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def snapshot(files: DataFrame, lines: str = "n_lines") -> DataFrame:
    """(doc_key, requirements): the fullest file of each document, its run suffix
    stripped, and a grand total in the row without document."""
    d = files.withColumn("doc_key", F.regexp_replace("run_dir", r"_\d{8}_\d{6}$", "")).groupBy("doc_key").agg(F.max(lines).alias("requirements"))
    return d.rollup("doc_key").agg(F.sum("requirements").alias("requirements"))


def layout_mode(first_line: Column, recorded: Column | None = None) -> Column:
    """The recorded mode, else that told by the first line of a chunk file."""
    told = F.when(first_line.contains("TABLE_START"), "pdfplumber").when(first_line.contains('"section_ref_path"'), "docling").otherwise("pymupdf")
    return F.coalesce(recorded, told) if recorded is not None else told


def splits_mid_paragraph(x: Column) -> Column:
    """The last character ends no sentence."""
    t = T.stripped(F.coalesce(x, F.lit("")))
    return (t != "") & ~t.rlike("[.!?:\"']$")


def label_conflicts(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    return labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels")).where(F.size("labels") > 1)


def merged_labels(one: DataFrame, two: DataFrame, key: str, label: str) -> DataFrame:
    """A full outer join with what is wrong with each key: on one side only or different."""
    a, b = one.select(key, F.col(label).alias("a")), two.select(key, F.col(label).alias("b"))
    return a.join(b, key, "full").withColumn("problem", F.when(F.col("a").isNull(), "only_second").when(F.col("b").isNull(), "only_first").when(F.col("a") != F.col("b"), "conflict"))


def parent_groups(df: DataFrame, *by: str) -> DataFrame:
    """Parents with two or more distinct children."""
    from .sections import children

    return children(df, "section_ref_path", *by).withColumn("n_children", F.size("child_section_refs")).where("n_children >= 2")


def depth_histogram(df: DataFrame) -> DataFrame:
    depth = F.greatest(F.size(F.coalesce("section_ref_path", F.array().cast("array<string>"))) - 1, F.lit(0))
    return df.groupBy(F.when(depth >= 2, "2+").otherwise(depth.cast("string")).alias("depth")).agg(F.count("*").alias("n"))


def verdicts(chunks: DataFrame, by: str = "source_pdf") -> DataFrame:
    """Structure of each document: pass with nested headings, most chunks under a heading
    and some parent context; partial with any of these, else fail."""
    size = F.size(F.coalesce("section_ref_path", F.array().cast("array<string>")))
    g = chunks.groupBy(by).agg(F.max(size).alias("depth"), F.avg((size > 0).cast("int")).alias("under"), F.count_if(F.coalesce("parent_context", F.lit("")) != "").alias("context"))
    ok = [F.col("depth") >= 2, F.col("under") >= 0.5, F.col("context") > 0]
    n = sum((c.cast("int") for c in ok), F.lit(0))
    return g.select(by, "depth", "context", F.when(n == 3, "pass").when(n > 0, "partial").otherwise("fail").alias("verdict"))


def review_table(chunks: DataFrame, seeded: DataFrame, curated: DataFrame) -> DataFrame:
    """Chunks with what was seeded and curated for them, the curated first."""
    key = ["source_pdf", "chunk_id"]
    d = chunks.join(seeded.withColumnRenamed("gold", "_seeded"), key, "left").join(curated.withColumnRenamed("gold", "_curated"), key, "left")
    return d.withColumn("gold", F.coalesce("_curated", "_seeded")).withColumn("review_status", F.when(F.col("_curated").isNotNull(), "done").when(F.col("_seeded").isNotNull(), "seeded").otherwise("open")).drop("_seeded", "_curated")


def imported_reviews(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors) of reviewed rows: only those marked done; a chunk id written as
    a float must be whole, the list must be JSON. Nothing should be taken while errors are left."""
    d = rows.where(F.col("review_status") == "done").withColumn("_id", F.col("chunk_id").cast("string").try_cast("double")).withColumn("_gold", F.from_json("gold", "array<struct<source_quote:string,source_ref:string>>"))
    error = F.when(F.col("_id").isNull() | (F.col("_id") != F.floor("_id")), "chunk_id is not whole").when(F.col("_gold").isNull(), "gold is no list")
    d = d.withColumn("error", error)
    return d.where("error is null").select("source_pdf", F.col("_id").cast("int").alias("chunk_id"), F.col("_gold").alias("gold")), d.where("error is not null").select("source_pdf", "chunk_id", "error")


def tag_rule(profiles: DataFrame, vocabulary: dict[str, list[str]], generic: str = "general", show: int = 3) -> DataFrame:
    """With exactly one distinct profile its first tags, else a generic word."""
    one = profiles.agg(F.count_distinct("domain_profile").alias("n"), F.max("domain_profile").alias("p"))
    pick = F.coalesce(*(F.when(F.col("p") == k, ", ".join(v[:show])) for k, v in vocabulary.items()), F.lit(generic))
    return one.select(F.when(F.col("n") == 1, pick).otherwise(generic).alias("tags"))

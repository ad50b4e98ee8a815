"""Hybrid retrieval: lexical and dense legs, rank fusion, pre-rank filters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical
from .lexical import greatest
from .pick import greatest_row


def query_filter(tags: list[str] | None = None, types: list[str] | None = None, sources: list[str] | None = None, normalize: bool = True) -> Column:
    """AND of: any tag shared, type in, source file in. Applied before any ranking."""
    clean = (lambda v: [x.strip().lower().replace(" ", "-").replace("_", "-") for x in v]) if normalize else list
    out = F.lit(True)
    if tags:
        out = out & F.arrays_overlap("domain_tags", F.array(*map(F.lit, clean(tags))))
    if types:
        out = out & F.col("requirement_type").isin(*clean(types))
    if sources:
        out = out & F.col("source_pdf").isin(*sources)
    return F.coalesce(out, F.lit(False))


def resolve_sources(names: list[str], catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unknown): each name as it is, else with .pdf, else with .PDF."""
    spark = catalogue.sparkSession
    rows = [(n, n + e, i) for n in names for i, e in enumerate(("", ".pdf", ".PDF")) if not (i and n.lower().endswith(".pdf"))]
    cand = spark.createDataFrame(rows, "name string, source_pdf string, rank int")
    known = catalogue.select("source_pdf").distinct()
    hit = cand.join(known, "source_pdf").groupBy("name").agg(F.min_by("source_pdf", "rank").alias("source_pdf"))
    return hit, cand.select("name").distinct().join(hit, "name", "left_anti")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl) of every document."""
    d = docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return d.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def lexical_scores(docs: DataFrame, queries: DataFrame, key: str, text: str, use_idf: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) for every document with a query term. ``queries`` is
    (query_id, query); its terms filter the documents before they are counted, lengths
    and document frequencies cover all of them. Joins are by term, and broadcast only
    where the optimizer knows the side to be small."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    terms = q.select("term").distinct()
    tok = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    size = tok.agg(F.avg("dl").alias("avgdl"), F.count("*").alias("n_docs"))
    tf = tok.select(key, "dl", F.explode("t").alias("term")).join(terms, "term").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weight = F.lit(1.0)
    if use_idf:
        tf = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term")
        weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    d = tf.crossJoin(F.broadcast(size)).withColumn("s", s).join(q, "term")
    return d.groupBy("query_id", key).agg(F.round(F.sum("s"), 9).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """In double; 0 where either has no length."""
    as_d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(as_d(x), as_d(y), lambda p, r: p * r), F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def dense_scores(vectors: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """(query_id, key, score) of every vector for (query_id, query_vector), one question
    or a few; ``dense_top`` is for many."""
    return queries.join(vectors).select("query_id", key, F.round(cosine(F.col("query_vector"), F.col(vector)), 9).alias("score"))


def top(scores: DataFrame, n: int, key: str, by: str = "query_id") -> DataFrame:
    """``rank`` from 1 by score, ties by key; the first ``n`` of each query."""
    w = W.partitionBy(by).orderBy(F.col("score").desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _grid(rows: DataFrame, queries: DataFrame, key: str, rows_a_block: int, queries_a_block: int) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with the number of the cell they meet in: every block of rows with
    every block of queries. Blocks are of constant size, so a task's work and memory do
    not grow with either table."""
    count = lambda d, c, size: max(1, -(-d.agg(F.approx_count_distinct(c)).first()[0] // size))
    a, b = count(rows, key, rows_a_block), count(queries, "query_id", queries_a_block)
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    r = rows.withColumn("cell", F.explode(F.sequence(at(key, a) * b, at(key, a) * b + (b - 1))))
    q = queries.withColumn("cell", F.explode(F.sequence(at("query_id", b), F.lit((a - 1) * b) + at("query_id", b), F.lit(b))))
    return r, q


def lexical_top(docs: DataFrame, queries: DataFrame, key: str, text: str, n: int, use_idf: bool = True, k1: float = 1.2, b: float = 0.75, rows_a_block: int = 65536, queries_a_block: int = 2048) -> DataFrame:
    """(query_id, key, score): the ``n`` best documents of each query, as ``lexical_scores``
    would rank them, ties by key. The postings are staged once and read by every task, which
    holds a block of queries and one of documents, so nothing is copied for either; only
    documents that can't be among the best are left unscored. ``key`` is a long."""
    d = docs.select(F.col(key).cast("long").alias("k"), tokens(F.col(text)).alias("t"))
    q = queries.select(F.col("query_id").cast("long"), tokens(F.col("query")).alias("t"))
    return lexical.search(d, q, n, use_idf, k1, b, rows_a_block, queries_a_block).withColumnRenamed("k", key)


def dense_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, n: int, rows_a_block: int = 16384, queries_a_block: int = 1024) -> DataFrame:
    """(query_id, key, score): the ``n`` nearest vectors of each of (query_id,
    query_vector) by cosine, ties by key: matrix products of blocks. Null vectors, and
    those without length, score 0 against all. ``key`` is a long."""
    v = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.select(F.col("query_id").cast("long"), F.col("query_vector").cast("array<double>").alias("v"))
    r, q = _grid(v, q, "k", rows_a_block, queries_a_block)

    def unit(x: pd.Series, size: int) -> np.ndarray:
        m = np.array([np.zeros(size) if e is None else e for e in x], float).reshape(len(x), size)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def cell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        size = next((len(e) for x in (rows["v"], asked["v"]) for e in x if e is not None), 1)
        keys, m = rows["k"].to_numpy(), unit(rows["v"], size).T
        out, ids = [], asked["query_id"].to_numpy()
        for i in range(0, len(asked), 256):
            scores = np.round(unit(asked["v"].iloc[i : i + 256], size) @ m, 9)
            for j, score in enumerate(scores, i):
                best = greatest(score, keys, n)
                out.append(pd.DataFrame({"query_id": ids[j], "k": keys[best], "score": score[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "k": [], "score": []})

    got = r.groupBy("cell").cogroup(q.groupBy("cell")).applyInPandas(cell, "query_id long, k long, score double")
    return top(got.withColumnRenamed("k", key), n, key).drop("rank")


def fused(legs: list[DataFrame], n: int, key: str, rrf_k: int = 2, rank_base: int = 0, min_score: float = 0.0, prefetch: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum over legs of 1 / (k + rank); a leg without the
    point adds nothing. The score floor applies after fusion, before the cut."""
    pre = prefetch or max(100, 5 * n)
    ranked = [top(s, pre, key).select("query_id", key, (1.0 / (F.col("rank") - 1 + rank_base + rrf_k)).alias("s")) for s in legs]
    d = reduce(DataFrame.unionByName, ranked).groupBy("query_id", key).agg(F.round(F.sum("s"), 9).alias("score"))
    return top(d.where(F.col("score") >= min_score), n, key)


def with_context(hits: DataFrame, chunks: DataFrame, window: int = 300) -> DataFrame:
    """Hits with the text around their quote; without a chunk null. Of a chunk given
    twice the greatest text counts."""
    c = greatest_row(chunks.select("document_id", "chunk_id", F.col("text").alias("_t")), ["document_id", "chunk_id"], [F.col("_t")])
    return hits.join(c, ["document_id", "chunk_id"], "left").withColumn("context_text", T.context_window(F.col("_t"), F.col("source_quote"), window)).drop("_t")


def latest_points(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Idempotent upsert: the last write of each point."""
    return greatest_row(writes, [key], [F.col(c) for c in order])


def warning_texts(models: list[str | None], expected: str, default: str = "nomic-embed-text") -> list[str]:
    """One message if some shown results were indexed with another model, else none."""
    other = [m or default for m in models if (m or default) != expected]
    names = ", ".join(sorted(set(other)))
    return [f"{len(other)} of {len(models)} results were indexed with another embedding model ({names}) than the configured one ({expected}) and may be unreliable; index again to refresh them"] if other else []


def model_warnings(points: DataFrame, expected: str, default: str = "nomic-embed-text") -> DataFrame:
    """One row with the number of points of other models and those models."""
    m = F.coalesce("embedding_model", F.lit(default))
    return points.where(m != expected).agg(F.count("*").alias("mismatched"), F.array_join(F.array_sort(F.collect_set(m)), ", ").alias("models"))

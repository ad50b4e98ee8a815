"""The answer plans: a question to ranked requirements, with context and a synthesis."""

from __future__ import annotations

import json
import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import services as V

FEWEST, MOST, USUAL = 1, 100, 20


class Answer(NamedTuple):
    results: DataFrame
    expanded_query: str
    total: int
    warnings: list[str]
    synthesis: str | None


def clamped_top_k(value: float | str | None) -> int:
    """A wanted number of results within bounds; what is no finite number is the usual."""
    try:
        v = float(str(value).strip())
    except ValueError:
        return USUAL
    return min(MOST, max(FEWEST, math.floor(v + 0.5))) if math.isfinite(v) else USUAL


def rewritten(question: str, rewriter, tags: list[str]) -> tuple[str, str, list[str]]:
    """(dense query, sparse query, detected tags). The expansion serves both, the control
    ids only the sparse one; the tags are told and never filter. Any failure, and an
    empty expansion, leave the question as it is."""
    try:
        text = rewriter.rewrite(question).strip()
        text = re.sub(r"^```(?:json)?|```.*$", "", text, flags=re.S).strip() if text.startswith("```") else text
        got = json.loads(text)
        expanded = got.get("expanded_query", "").strip()
    except Exception:
        return question, question, []
    if not expanded:
        return question, question, []
    ids = [str(c).strip() for c in got.get("control_ids") or [] if c]
    return expanded, " ".join([expanded, *ids]), [t for t in got.get("domain_tags") or [] if t in tags]


def _attempt(call, *args):
    """What a provider answers, None where it fails or says nothing."""
    try:
        return call(*args) or None
    except Exception:
        return None


def ask(question: str, reqs: DataFrame, vectors: DataFrame, embed, chunks: DataFrame | None = None, where: Column | None = None, hypothesis: str | None = None, top_k: int = 20, min_score: float = 0.02, key: str = "req_seq", sparse: str | None = None) -> DataFrame:
    """Filter first, then the lexical and dense legs (and one of a hypothetical answer),
    fused; with chunks also the text around each quote. Under a score floor the fusion
    keeps three times as many, fifty at least, before the cut to ``top_k``."""
    spark = reqs.sparkSession
    if not FEWEST <= top_k <= MOST:
        raise ValueError("top_k must be between 1 and 100")
    pool = reqs.where(where) if where is not None else reqs
    vecs = vectors.join(pool.select(key), key, "left_semi") if where is not None else vectors
    q = spark.createDataFrame([(0, sparse or question)], "query_id int, query string")
    legs = [R.lexical_scores(pool, q, key, "source_quote")]
    for text in (question, hypothesis):
        if text:
            legs.append(R.dense_scores(vecs, spark.createDataFrame([(0, embed(text))], "query_id int, query_vector array<double>"), key, "dense"))
    limit = max(3 * top_k, 50) if min_score > 0 else top_k
    fused = R.fused(legs, limit, key, prefetch=max(100, 5 * top_k))
    hits = fused.where((F.col("score") >= min_score) & (F.col("rank") <= limit)).where(F.col("rank") <= top_k)
    hits = hits.drop("query_id").join(pool, key)
    return (R.with_context(hits, chunks) if chunks is not None else hits).orderBy("rank")


def retrieve(question: str, reqs: DataFrame, vectors: DataFrame, embed, *, chunks: DataFrame | None = None, tags: list[str] | None = None, types: list[str] | None = None, document_ids: list[str] | None = None, rewriter=None, hypothesizer=None, synthesizer=None, known_tags: list[str] | None = None, embedding_model: str = "nomic-embed-text", top_k: int = 20, min_score: float = 0.02, key: str = "req_seq") -> Answer:
    """The whole of a question's way. Named documents must be known, else a ValueError
    names those that are not; they filter by file. A failing rewriter, hypothesis or
    synthesis is done without. At most ``top_k`` rows come to the driver."""
    sources = None
    if document_ids:
        hit, unknown = R.resolve_sources(document_ids, reqs)
        if missing := sorted(r["name"] for r in unknown.collect()):
            raise ValueError("no indexed document is called " + ", ".join(missing))
        sources = [r["source_pdf"] for r in hit.collect()]
    dense, sparse = question, question
    if rewriter is not None:
        dense, sparse, _ = rewritten(question, rewriter, known_tags or [])
    hypothesis = _attempt(hypothesizer.hypothesize, question) if hypothesizer is not None else None
    where = R.query_filter(tags, types, sources) if tags or types or sources else None
    hits = ask(dense, reqs, vectors, embed, chunks, where, hypothesis, top_k, min_score, key, sparse)
    rows = hits.collect()
    shown = reqs.sparkSession.createDataFrame(rows, hits.schema)
    model = "embedding_model" in shown.columns
    warnings = R.warning_texts([r["embedding_model"] if model else None for r in rows], embedding_model)
    synthesis = None
    if synthesizer is not None and rows:
        lines = [r["entry"] for r in V.evidence_entries(shown).orderBy("rank").collect()]
        synthesis = _attempt(synthesizer.synthesize, question, "\n\n".join(lines))
    return Answer(shown, dense, len(rows), warnings, synthesis)


def compare(query: str, reqs: DataFrame, vectors: DataFrame, embed, *, doc_keys: list[str] | None = None, document_ids: list[str] | None = None, top_k: int = 10, key: str = "req_seq") -> tuple[str, DataFrame]:
    """(mode, rows). A control id is matched exactly, each document's most confident
    requirement; other text goes by the two legs, each document's first hit for each
    reference. ``doc_keys`` name files, ``document_ids`` are hashes and count only
    without them; nothing found is a ValueError."""
    pool = reqs
    if doc_keys:
        pool = reqs.where(F.col("source_pdf").isin(*(V.with_pdf(k) for k in doc_keys)))
    elif document_ids:
        pool = reqs.where(F.col("document_id").isin(*document_ids))
    if V.CONTROL_ID.match(query.strip()):
        mode, out = "exact", V.compare_exact(pool, query, key)
    else:
        vecs = vectors.join(pool.select(key), key, "left_semi") if pool is not reqs else vectors
        mode, out = "semantic", V.compare_ranked(ask(query, pool, vecs, embed, top_k=top_k, min_score=0.0, key=key), key)
    if out.isEmpty():
        raise ValueError(f"nothing is found for {query.strip()}")
    return mode, out


def trace(requirement_id: str, reqs: DataFrame, chunks: DataFrame | None = None, key: str = "req_seq", most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(requirement, cross matches): the first row of the id, with its context where
    chunks are given, and the first requirement of every other document with its
    reference, among the first ``most`` by key. An unknown id is a ValueError."""
    target = reqs.where(F.col("requirement_id") == requirement_id).orderBy(key).limit(1)
    if target.isEmpty():
        raise ValueError(f"there is no requirement {requirement_id}")
    other = reqs.where(F.coalesce("requirement_id", F.lit("")) != requirement_id)
    matches = V.cross_matches(other, target, key, most=most)
    found = target.withColumn("domain_profile", F.coalesce(F.nullif("domain_profile", F.lit("")), F.lit("cybersecurity"))) if "domain_profile" in reqs.columns else target
    return (R.with_context(found, chunks) if chunks is not None else found), matches


class Evidence(NamedTuple):
    groups: DataFrame
    total_sources: int
    prompt: str
    synthesis: str | None
    warnings: list[str]


def evidence(query: str, reqs: DataFrame, vectors: DataFrame, embed, *, chunks: DataFrame | None = None, document_ids: list[str] | None = None, tags: list[str] | None = None, types: list[str] | None = None, synthesizer=None, embedding_model: str = "nomic-embed-text", top_k: int = 20, key: str = "req_seq") -> Evidence:
    """Groups of hits of the two legs, with the context of their representatives, and
    the prompt that lists them for a summary; a failing synthesis leaves the groups."""
    got = retrieve(query, reqs, vectors, embed, tags=tags, types=types, document_ids=document_ids, embedding_model=embedding_model, top_k=top_k, min_score=0.0, key=key)
    if not got.total:
        raise ValueError(f"nothing is found for {query}")
    groups = V.evidence_groups(got.results, key)
    about = got.results.select(F.col(key).alias("representative"), "requirement_id", "document_id", "chunk_id", "source_quote", "description")
    groups = groups.join(about, "representative")
    if chunks is not None:
        groups = R.with_context(groups, chunks)
    listed = groups.orderBy("first_rank").withColumn("n", F.size("sources")).collect()
    prompt = "\n\n".join(f"[{i}] Control: {g['label']}  |  Sources: {g['n']}\n    {g['description'] or g['source_quote'] or '(no text)'}" for i, g in enumerate(listed, 1))
    synthesis = _attempt(synthesizer.synthesize, query, prompt) if synthesizer is not None else None
    return Evidence(groups, sum(g["n"] for g in listed), prompt, synthesis, got.warnings)

"""Requirements: validation, side outputs, joins to chunks, de-duplication, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import fuzzy
from ..functions import ids as I
from ..functions import text as T
from .pick import greatest_row

# Connectors of citations and copulas that open a dangling clause.
CONNECTORS = ("and", "or", "the", "of", "for", "in", "a", "an", "at", "to", "within", "per")
COPULAS = ("is", "are", "was", "were")
_EDGE = r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$"


def _words(x: Column) -> Column:
    return F.filter(F.split(x, f"{T.SPACE}+"), lambda w: w != "")


def is_fragment(quote: Column) -> Column:
    return T.stripped(quote).endswith(":")


def is_citation_only(quote: Column) -> Column:
    """"term, as defined in" and then nothing but words shaped like a citation."""
    rest = F.regexp_extract(T.stripped(quote), r"^(?is)[^,]{1,80},\s*as defined in\b(.*)$", 1)
    words = F.filter(F.transform(_words(rest), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != "")
    content = F.filter(words, lambda w: ~F.lower(w).isin(*CONNECTORS))
    run = F.aggregate(
        F.filter(content, lambda w: ~w.rlike(r"\d")),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda acc, w: F.struct(
            F.when(w.rlike(r"^\p{L}+$") & (w == F.upper(w)), acc["run"] + 1).otherwise(0).alias("run"),
            F.greatest(acc["most"], F.when(w.rlike(r"^\p{L}+$") & (w == F.upper(w)), acc["run"] + 1).otherwise(0)).alias("most"),
        ),
        lambda acc: acc["most"],
    )
    shaped = F.forall(content, lambda w: ~F.substring(w, 1, 1).rlike(r"\p{Ll}"))
    return T.stripped(quote).rlike(r"^(?is)[^,]{1,80},\s*as defined in\b") & (run < 2) & shaped


def is_dangling(quote: Column) -> Column:
    t = T.stripped(quote)
    first = F.lower(F.regexp_replace(F.try_element_at(_words(t), F.lit(1)), _EDGE, ""))
    return (t != "") & ~t.contains("?") & F.coalesce(first.isin(*COPULAS), F.lit(False))


def first_error(grounding: Column | None = None, echo: Column | None = None) -> Column:
    """The first failing rule in fixed order, null for a valid row. ``grounding`` is the
    score against the chunk (null where the chunk is unknown), ``echo`` the best score
    against a heading; without them those rules do not apply."""
    q, d = F.coalesce("source_quote", F.lit("")), T.normalize_text(F.coalesce("description", F.lit("")))
    rescued = T.stripped(F.coalesce("parent_header_text", F.lit(""))) != ""
    never = F.lit(False)
    return F.coalesce(
        F.when(T.stripped(q) == "", "empty_source_quote"),
        F.when(F.coalesce(grounding < 60, never) if grounding is not None else never, "quote_not_grounded_in_chunk"),
        F.when(F.coalesce(echo >= 90, never) if echo is not None else never, "heading_echo"),
        F.when(is_fragment(q), "unrepairable_fragment"),
        F.when(is_citation_only(q), "orphaned_list_item"),
        F.when(is_dangling(q) & ~rescued, "dangling_clause"),
        F.when(d.startswith("not explicitly stated"), "not_actionable"),
        F.when(d.startswith("change ") & (d.contains(" to ") | d.contains(" from ")) & (F.length(d) < 100), "errata_change_entry"),
    )


def with_chunks(reqs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requirements with their chunk's pages, text and header; unknown chunks stay null
    and ``chunk_known`` tells them from chunks with empty text."""
    c = chunks.select("document_id", "chunk_id", F.coalesce("text", F.lit("")).alias("chunk_text"), F.col("page_start").alias("chunk_page_start"), F.col("page_end").alias("chunk_page_end"), "parent_header_text")
    return reqs.join(c, ["document_id", "chunk_id"], "left").withColumn("chunk_known", F.col("chunk_text").isNotNull())


def validated(reqs: DataFrame) -> DataFrame:
    """The whole cascade on rows of ``with_chunks``: ``error`` and ``grounding_score``."""
    q, t = T.normalize_text(F.coalesce("source_quote", F.lit(""))), T.normalize_text("chunk_text")
    exact = F.position(q, t) > 0
    d = reqs.withColumn("_q", q).withColumn("_t", F.when(F.col("chunk_known") & ~exact & (q != ""), t)).withColumn("_in", F.when(F.col("chunk_known") & exact, F.lit(100.0)))
    d = d.withColumn("grounding_score", F.coalesce("_in", fuzzy.partial_ratio_udf("_q", "_t")))
    headings = F.filter(F.transform(F.coalesce("section_title_path", F.array().cast("array<string>")), T.normalize_heading), lambda h: h != "")
    d = d.withColumn("_echo", heading_echo_udf(T.normalize_heading(F.coalesce("source_quote", F.lit(""))), headings))
    return d.withColumn("error", first_error(F.col("grounding_score"), F.col("_echo"))).drop("_q", "_t", "_in", "_echo")


@F.pandas_udf(DoubleType())
def heading_echo_udf(quote: pd.Series, headings: pd.Series) -> pd.Series:
    """The best ratio of a quote with one of its headings, both in the form of
    ``normalize_heading``; lengths too far apart for 90 are passed over."""
    out = []
    for q, hs in zip(quote, headings):
        near = [h for h in hs if q and h and min(len(q), len(h)) * 11 >= max(len(q), len(h)) * 9]
        out.append(max((fuzzy.indel_ratio(q, h) for h in near), default=0.0))
    return pd.Series(out)


def confidence() -> Column:
    blank = lambda c: T.stripped(F.coalesce(F.col(c), F.lit(""))) == ""
    less = (
        F.when(F.size(F.coalesce("domain_tags", F.array())) == 0, 20).otherwise(0)
        + F.when(blank("source_quote"), 20).otherwise(0)
        + F.when(F.length(F.coalesce("description", F.lit(""))) < 20, 10).otherwise(0)
        + F.when(blank("source_ref"), 10).otherwise(0)
    )
    return (F.lit(100) - less) / F.lit(100.0)


def pass1(df: DataFrame, tags: list[str], types: list[str]) -> DataFrame:
    """Rows with a quote; tags lower-cased and in the vocabulary (order and repeats
    kept), types outside theirs emptied."""
    known = F.filter(F.transform(F.coalesce("domain_tags", F.array().cast("array<string>")), lambda t: F.lower(T.stripped(t))), lambda t: t.isin(*tags))
    kind = F.lower(T.stripped(F.coalesce("requirement_type", F.lit(""))))
    return df.where(T.stripped(F.coalesce("source_quote", F.lit(""))) != "").withColumns({"domain_tags": known, "requirement_type": F.when(kind.isin(*types), kind).otherwise("")})


def deduplicated(df: DataFrame, doc: str = "document_id", seq: str = "req_seq") -> DataFrame:
    """Records without descriptions (those of the first pass): one row for each
    (document, reference, normalised quote), the most confident, then the shortest
    quote, then the first. Blank quotes are no key and are out. Where descriptions are
    filled, ``deduplicated_all`` goes by both keys."""
    quote = T.normalize_text(F.col("source_quote"))
    score = F.coalesce("confidence", F.lit(0.0)) * 1000 - F.length("source_quote")
    return greatest_row(df.where(quote != ""), [doc, F.coalesce("source_ref", F.lit("")), quote], [score, -F.col(seq)])


def fold_duplicates(df: DataFrame, doc: str = "document_id", seq: str = "req_seq") -> DataFrame:
    """(doc, source_ref, seq): the rows that survive the order-dependent fold in which a
    description key or else a quote key finds the earlier record. A match by
    description leaves the new quote unregistered, and a replaced record stays under
    its other key, so two of a kind can survive. Empty descriptions and quotes are no
    keys (a row with neither is held under nothing and does not survive); keys never
    cross (document, reference), and a null reference is an empty one.

    A row that shares neither key with another meets no earlier record and survives as
    it is; only rows with a shared key are replayed in order, each (document,
    reference) as a stream of rows in one task.
    """
    norm = lambda c: T.normalize_text(F.coalesce(c, F.lit("")))
    score = F.coalesce("confidence", F.lit(0.0)) * 1000 - F.length(F.coalesce("source_quote", F.lit("")))
    d = df.select(doc, F.coalesce("source_ref", F.lit("")).alias("ref"), F.col(seq).cast("long").alias("seq"), F.md5(F.nullif(norm("source_quote"), F.lit(""))).alias("q"), F.md5(F.nullif(norm("description"), F.lit(""))).alias("d"), score.alias("score"))
    d = d.where("q is not null or d is not null")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.count("*").over(W.partitionBy(doc, "ref", c)))
    d = d.withColumns({"n_q": n("q"), "n_d": n("d")})
    alone = (F.col("n_q") <= 1) & (F.col("n_d") <= 1)
    out = d.where(alone).select(doc, "ref", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def survivors(group: tuple, held: dict) -> pa.RecordBatch:
            seqs = list(dict.fromkeys(s for s, _ in held.values()))
            n = len(seqs)
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * n, pa.string()), pa.array([group[1]] * n, pa.string()), pa.array(seqs, pa.int64())], [doc, "ref", "seq"])

        group, held = None, {}
        for b in batches:
            for x, ref, s, q, de, v in zip(*(b.column(c).to_pylist() for c in (doc, "ref", "seq", "q", "d", "score"))):
                if (x, ref) != group:
                    if held:
                        yield survivors(group, held)
                    group, held = (x, ref), {}
                key = ("d", de) if de and ("d", de) in held else ("q", q) if q and ("q", q) in held else None
                if key is None:
                    for k in (("d", de), ("q", q)):
                        if k[1]:
                            held[k] = (s, v)
                elif v > held[key][1]:
                    held[key] = (s, v)
        if held:
            yield survivors(group, held)

    shared = d.where(~alone).select(doc, "ref", "seq", "q", "d", "score").repartition(doc, "ref").sortWithinPartitions(doc, "ref", "seq")
    return out.unionByName(shared.mapInArrow(fold, f"{doc} string, ref string, seq long"))


def deduplicated_all(df: DataFrame, doc: str = "document_id", seq: str = "req_seq") -> DataFrame:
    """The whole rows that ``fold_duplicates`` keeps, by both keys; ``seq`` is unique in
    each document."""
    kept = fold_duplicates(df, doc, seq).select(F.col(doc).alias("_doc"), F.col("seq").alias("_seq")).distinct()
    return df.join(kept, F.equal_null(F.col(doc), F.col("_doc")) & (F.col(seq) == F.col("_seq")), "left_semi")


def stats(valid: DataFrame, failures: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of corpus statistics; divisions by nothing give 0."""
    v = valid.agg(F.count("*").alias("requirements"), F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"), F.countDistinct(F.nullif(T.stripped("source_ref"), F.lit(""))).alias("distinct_refs"), F.countDistinct("document_id", "chunk_id").alias("chunks_covered"))
    f = failures.agg(F.count("*").alias("failures"))
    c = chunks.agg(F.count("*").alias("chunks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    per = lambda a, b, k, n: F.coalesce(F.round(F.try_divide(F.col(a) * F.lit(float(k)), F.col(b)), n), F.lit(0.0))
    d = v.crossJoin(f).crossJoin(c).withColumn("requirements_before", F.col("requirements") + F.col("failures"))
    return d.select("requirements", "failures", "requirements_before", "chunks", "avg_confidence", "distinct_refs", per("chunks_covered", "chunks", 100, 1).alias("coverage_pct"), per("requirements", "chars", 1000, 3).alias("per_1000_chars"), per("requirements", "requirements_before", 100, 1).alias("success_pct"))


def tag_histogram(df: DataFrame) -> DataFrame:
    return df.select(F.explode("domain_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def type_histogram(df: DataFrame) -> DataFrame:
    """A missing type is unknown, an empty one stays empty."""
    return df.groupBy(F.coalesce("requirement_type", F.lit("unknown")).alias("requirement_type")).agg(F.count("*").alias("n"))


def fresh_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("stable_id", I.stable_id(*(F.col(c) for c in ("document_id", "source_ref", "source_quote", "chunk_id", "requirement_type", "description"))))

"""What users ask for: trace, compare, evidence, checklist."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from .pick import greatest_row


#: What a control id looks like.
CONTROL_ID = re.compile(r"[A-Z]{1,4}-\d+(?:\([0-9a-z]+\))*$", re.I)


def cross_matches(reqs: DataFrame, targets: DataFrame, key: str = "req_seq", most: int | None = None) -> DataFrame:
    """For each target (key, source_ref, source_pdf): the first requirement of every
    other document with the same reference; rows without document are all kept. Only the
    first row of each (reference, document) meets the targets, whatever number of rows
    share them; with ``most``, only the first so many of a reference by key."""
    t = targets.select(F.col(key).alias("target"), "source_ref", F.col("source_pdf").alias("_own")).where("source_ref <> ''")
    cols = reqs.columns
    row = F.struct(*(F.col(c) for c in cols))
    if most is not None:
        w = W.partitionBy("source_ref").orderBy(key)
        reqs = reqs.join(t.select("source_ref").distinct(), "source_ref", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    named = reqs.where("source_ref <> '' and source_pdf is not null").groupBy("source_ref", "source_pdf").agg(F.min_by(row, key).alias("_r")).select("_r.*")
    m = named.join(t, "source_ref").where((F.col(key) != F.col("target")) & ~F.equal_null(F.col("source_pdf"), F.col("_own")))
    free = reqs.where("source_ref <> '' and source_pdf is null").join(t, "source_ref").where(F.col(key) != F.col("target"))
    return m.unionByName(free).drop("_own")


def is_control_id(x: Column) -> Column:
    return T.stripped(x).rlike(r"^(?i)[A-Z]{1,4}-\d+(\([0-9a-z]+\))*$")


def with_pdf(name: str) -> str:
    return name if name.lower().endswith(".pdf") else name + ".pdf"


def canonical_source(doc_key: Column, resolved: Column) -> Column:
    """The resolved file, else the name itself if it is one, else the name with .pdf."""
    return F.coalesce(F.nullif(resolved, F.lit("")), F.when(F.lower(doc_key).endswith(".pdf"), doc_key).otherwise(F.concat(doc_key, F.lit(".pdf"))))


def source_of_keys(keys: DataFrame, reqs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_key, source_pdf): of each key the file its current run's first record names,
    empty where there is none. ``runs`` is (doc_key, run_dir), ``reqs`` has run_dir and req_seq."""
    first = reqs.join(runs.select("doc_key", "run_dir"), ["doc_key", "run_dir"]).groupBy("doc_key").agg(F.min_by("source_pdf", "req_seq").alias("source_pdf"))
    return keys.select("doc_key").distinct().join(first, "doc_key", "left").select("doc_key", F.coalesce("source_pdf", F.lit("")).alias("source_pdf"))


def shown_name(source_pdf: Column, doc_key: Column) -> Column:
    return F.coalesce(F.nullif(F.when(T.stripped(source_pdf) != "", source_pdf), F.lit("")), doc_key)


def shown_path(path: Column) -> Column:
    """A section path for a reader, a dash for none."""
    return F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, F.array_join(path, " › ")).otherwise("—")


def filtered_names(docs: DataFrame, text: str) -> DataFrame:
    """Documents whose file or key holds the text, whatever its case; all without text."""
    return docs.where(F.lower(F.concat_ws(" ", F.coalesce("source_pdf", F.lit("")), "doc_key")).contains(text.strip().lower()))


def sorted_documents(docs: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """By name, count or date, ties by name."""
    c = {"name": F.lower(shown_name(F.col("source_pdf"), F.col("doc_key"))), "count": F.col("n_reqs"), "date": F.col("run_date")}[by]
    return docs.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "doc_key")


def public_group_keys(groups: DataFrame) -> DataFrame:
    """Made-up keys of groups of one replaced by their representative's id; the labels
    of such groups can repeat, so they would not do."""
    made = F.col("group_key").startswith("__no_ref__") | F.col("group_key").startswith("__bare_fragment__")
    return groups.withColumn("group_key", F.when(made, F.coalesce(F.nullif("requirement_id", F.lit("")), "group_key")).otherwise(F.col("group_key")))


def compare_exact(reqs: DataFrame, ref: str, key: str = "req_seq") -> DataFrame:
    """Each document's most confident requirement with the reference, the first of equals."""
    return greatest_row(reqs.where(F.upper("source_ref") == ref.strip().upper()), ["source_pdf"], [F.col("confidence"), -F.col(key)])


def compare_ranked(hits: DataFrame, key: str = "req_seq", by: tuple[str, ...] = ()) -> DataFrame:
    """Of ranked hits the first for each reference and document, references by rank;
    each query by itself where ``by`` names its column."""
    w = W.partitionBy(*by, "source_ref", "source_pdf").orderBy("rank", key)
    d = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return d.withColumn("ref_rank", F.min("rank").over(W.partitionBy(*by, "source_ref")))


def compare_split(reqs: DataFrame, one: Column, two: Column) -> DataFrame:
    """Every reference of either document: both, only the first or only the second."""
    d = reqs.where((one | two) & (F.coalesce("source_ref", F.lit("")) != "")).groupBy("source_ref").agg(F.bool_or(one).alias("a"), F.bool_or(two).alias("b"))
    return d.select("source_ref", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_first").otherwise("only_second").alias("side"))


def evidence_key(key: Column) -> tuple[Column, Column]:
    """(group key, label): the reference; a bare "(x)" with its section before it; no
    reference, or a bare one without section, is a group of its own."""
    ref = T.stripped(F.coalesce("source_ref", F.lit("")))
    above = F.coalesce(F.nullif(F.try_element_at("section_ref_path", F.lit(-1)), F.lit("")), F.nullif("parent_section_ref", F.lit("")))
    bare = ref.rlike(r"^\([0-9a-zA-Z]{1,4}\)$")
    group = F.when(ref == "", F.concat(F.lit("__no_ref__"), key.cast("string"))).when(bare & above.isNull(), F.concat(F.lit("__bare_fragment__"), key.cast("string"))).when(bare, F.concat(above, ref)).otherwise(ref)
    return group, F.when(ref == "", "(no ref)").when(bare & above.isNotNull(), F.concat(above, ref)).otherwise(ref)


def evidence_groups(hits: DataFrame, key: str = "req_seq", by: tuple[str, ...] = ()) -> DataFrame:
    """Groups by key in order of their first hit; the most confident hit represents,
    the first of equals; all hits are sources. ``by``: as in ``compare_ranked``."""
    group, label = evidence_key(F.col(key))
    d = hits.withColumns({"group_key": group, "label": label})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key])
    return d.groupBy(*by, "group_key").agg(F.min("rank").alias("first_rank"), F.min_by("label", "rank").alias("label"), F.max_by(key, F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("rank"))).alias("representative"), ordered.alias("sources"))


def checklist(reqs: DataFrame, profile: str, threshold: float = 0.8) -> DataFrame:
    """Items with their reasons for review in fixed order; rows without id or quote are out."""
    d = reqs.where((F.coalesce("requirement_id", F.lit("")) != "") & (T.stripped(F.coalesce("source_quote", F.lit(""))) != ""))
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    d = d.withColumn("pages", T.page_refs(F.col("page_start"), F.col("page_end")))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("source_ref", F.lit("")) == "", "missing-source-ref"),
            F.when(size("section_title_path") == 0, "missing-section-title-path"),
            F.when(F.size("pages") == 0, "missing-page-refs"),
            F.when(size("domain_tags") == 0, "missing-domain-tags"),
            F.when(F.coalesce("confidence", F.lit(0.0)) < threshold, "low-confidence"),
            F.when(F.coalesce("domain_profile", F.lit("cybersecurity")) != profile, "profile-mismatch"),
        )
    )
    return d.withColumns({"item_id": I.checklist_item_id(F.array("requirement_id")), "review_reasons": reasons}).withColumn("requires_human_review", F.size("review_reasons") > 0)


def checklist_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.count_if("requires_human_review").alias("needing_review"))


def evidence_lines(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each hit as a numbered line for a prompt: description, else quote."""
    body = F.coalesce(F.nullif("description", F.lit("")), F.col("source_quote"))
    return hits.select(*by, "rank", F.format_string("[%d] %s (%s): %s", "rank", F.coalesce("source_ref", F.lit("-")), F.coalesce("source_pdf", F.lit("-")), body).alias("line"))


def evidence_entries(hits: DataFrame) -> DataFrame:
    """(rank, entry): each hit as a numbered block for a prompt, with what is known of its
    place, the clause that governs it and the text around it."""
    have = lambda c: F.col(c) if c in hits.columns else F.lit(None)
    text = lambda c: F.coalesce(have(c).cast("string"), F.lit(""))
    a, b = have("page_start").cast("int"), have("page_end").cast("int")
    pages = F.when(F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0)) == 0, "").when(a == b, F.format_string("p.%d", a)).otherwise(F.format_string("pp.%d-%d", a, b))
    cite = F.array_join(F.filter(F.array(text("source_pdf"), text("source_ref"), pages), lambda x: x != ""), ", ")
    tags = F.array_join(F.coalesce(have("domain_tags").cast("array<string>"), F.array().cast("array<string>")), ", ")
    more = [F.when(text(c) != "", F.concat(F.lit(f"\n    {label}: "), text(c))).otherwise("") for c, label in (("parent_stem", "Governing clause"), ("context_text", "Context"))]
    body = F.coalesce(F.nullif(text("description"), F.lit("")), text("source_quote"))
    kind = F.coalesce(have("requirement_type").cast("string"), F.lit("unknown"))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), cite, F.lit(")\n    Type: "), kind, F.lit("\n    Tags: "), tags)
    return hits.select("rank", F.concat(head, F.lit("\n    Requirement: "), body, F.lit("\n    Quote: "), text("source_quote"), *more).alias("entry"))

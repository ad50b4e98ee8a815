"""Section trees from headings in reading order, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def ancestry(items: DataFrame, doc: str = "document_id", seq: str = "item_seq", heading: str = "heading", max_depth: int | None = None) -> DataFrame:
    """The headings above every item: ``section_ref_path`` (without those that have no
    reference), ``section_title_path``, ``parent_header_text`` (the nearest) and
    ``parent_seq``, its place.

    ``heading`` is null for body items. A heading of depth d closes all open ones of
    depth d or more; it does not see itself. Table-of-contents lines are no headings
    and get no row. Level k is open where its latest heading came after those of every
    lower level. Depths are not limited: without ``max_depth`` the deepest heading is
    looked up first; with it, the caller states that none is deeper.
    """
    d = items.where(F.col(heading).isNull() | ~F.col(heading).rlike(T.TOC_LEADER))
    d = d.withColumn("depth", T.heading_depth(F.col(heading)))
    if max_depth is None:
        max_depth = d.agg(F.max("depth")).first()[0] or 1
    before = W.partitionBy(doc).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    node = F.struct(F.col(seq).alias("at"), T.stripped(F.col(heading)).alias("title"), T.section_ref(F.col(heading)).alias("ref"))
    levels = [F.last(F.when(F.col("depth") == k, node), ignorenulls=True).over(before) for k in range(1, max_depth + 1)]
    d = d.withColumns({f"_l{k}": c for k, c in enumerate(levels, 1)})
    opened, lower = [], None
    for k in range(1, max_depth + 1):
        at = F.col(f"_l{k}.at")
        keep = at.isNotNull() & (F.col("depth").isNull() | (F.col("depth") > k))
        if lower is not None:
            keep = keep & (lower.isNull() | (lower < at))
        opened.append(F.when(keep, F.col(f"_l{k}")))
        lower = at if lower is None else F.greatest(lower, at)
    path = F.filter(F.array(*opened), lambda n: n.isNotNull())
    d = d.withColumn("_path", path).drop(*(f"_l{k}" for k in range(1, max_depth + 1)))
    last = F.try_element_at("_path", F.lit(-1))
    return d.select(
        "*",
        F.filter(F.transform("_path", lambda n: n["ref"]), lambda r: r != "").alias("section_ref_path"),
        F.transform("_path", lambda n: n["title"]).alias("section_title_path"),
        last["title"].alias("parent_header_text"),
        last["at"].alias("parent_seq"),
    ).drop("_path")


def with_parent_context(items: DataFrame, doc: str = "document_id", seq: str = "item_seq", heading: str = "heading", body: str = "text", paragraphs: int = 5, chars: int = 600) -> DataFrame:
    """Items of ``ancestry`` with ``parent_context``: the first paragraphs under the
    nearest heading in one text, else that heading; null above the first heading."""
    under = items.where(F.col(heading).isNull() & F.col("parent_seq").isNotNull())
    b = bodies(under.select(doc, F.col("parent_seq"), F.col(seq).alias("_seq"), T.stripped(F.col(body)).alias("_body")), [doc, "parent_seq"], "_seq", "_body", paragraphs, chars)
    d = items.join(b, [doc, "parent_seq"], "left")
    return d.withColumn("parent_context", F.coalesce("body_preview", "parent_header_text")).drop("body_preview")


def children(df: DataFrame, path: str = "section_ref_path", *by: str) -> DataFrame:
    """(*by, parent, child_section_refs): the distinct refs directly below each, sorted."""
    p = F.col(path)
    pairs = F.arrays_zip(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("parent"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("child"))
    d = df.where(F.size(p) > 1).select(*by, F.explode(pairs).alias("x")).select(*by, "x.*").where("parent <> '' and child <> ''").distinct()
    return d.groupBy(*by, "parent").agg(F.array_sort(F.collect_set("child")).alias("child_section_refs"))


def bodies(df: DataFrame, section: list[str], seq: str, body: str, paragraphs: int = 5, chars: int = 600) -> DataFrame:
    """The first paragraphs of each section in one preview."""
    w = W.partitionBy(*section).orderBy(seq)
    top = df.where(T.stripped(F.coalesce(F.col(body), F.lit(""))) != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= paragraphs)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", body))), lambda x: x[body]), " ")
    return top.groupBy(*section).agg(F.substring(joined, 1, chars).alias("body_preview"))


def deepest(items: DataFrame, chunk: list[str], seq: str, path: str) -> DataFrame:
    """Of a chunk's items, the ancestry that is deepest; the last of equals."""
    return items.groupBy(*chunk).agg(F.max_by(path, F.struct(F.size(path), F.col(seq))).alias(path))

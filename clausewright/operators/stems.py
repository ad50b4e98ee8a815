"""Governing clauses for list fragments: the nearest text above that introduces them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .requirements import is_dangling

# First markers of a list, most words of a fragment.
FIRST_MARKERS, FRAGMENT_WORDS = ("1", "a", "A", "i", "I"), 20


def stem_of(x: Column) -> Column:
    """Through the first real colon; else nothing for list lines and text that ends a
    sentence or item; else the whole."""
    t = T.stripped(F.coalesce(x, F.lit("")))
    at = T.first_real_colon(t)
    return (
        F.when(t == "", None)
        .when(at > 0, T.stripped(F.substring(t, F.lit(1), at)))
        .when(t.rlike(T.LIST_MARKER) | t.rlike(r"^-\s*"), None)
        .when(~t.rlike(r"[.!?,;]$"), t)
    )


def is_candidate(quote: Column, most_words: int = FRAGMENT_WORDS) -> Column:
    t = T.stripped(F.coalesce(quote, F.lit("")))
    return (t != "") & (t.rlike(T.LIST_MARKER) | (T.word_count(t) <= most_words) | is_dangling(t))


def opens_list(quote: Column) -> Column:
    """The marker is a sequence's first, which continues nothing above."""
    return F.regexp_extract(T.stripped(quote), r"^\(?([a-zA-Z0-9]{1,3})[.)]\s", 1).isin(*FIRST_MARKERS)


def with_stems(reqs: DataFrame, chunks: DataFrame, seq: str = "req_seq") -> DataFrame:
    """``parent_stem`` and ``embedding_text``. A candidate takes the nearest stem above
    in its chunk; else, unless it opens a list, the last stem of the chunk before, of its
    records or else of its lines; else, where dangling, the chunk's header."""
    quote = F.col("source_quote")
    own = W.partitionBy("document_id", "chunk_id").orderBy(seq)
    d = reqs.withColumn("_stem", stem_of(quote)).withColumn("_same", F.last("_stem", True).over(own.rowsBetween(W.unboundedPreceding, -1)))
    last = reqs.where("chunk_id is not null").withColumn("s", stem_of(quote)).where("s is not null").groupBy("document_id", (F.col("chunk_id") + 1).alias("chunk_id")).agg(F.max_by("s", seq).alias("_before"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), stem_of), lambda s: s.isNotNull())
    c = chunks.select("document_id", "chunk_id", "parent_header_text", F.try_element_at(lines, F.lit(-1)).alias("line"))
    prev = c.select("document_id", (F.col("chunk_id") + 1).alias("chunk_id"), F.col("line").alias("_line"))
    d = d.join(last, ["document_id", "chunk_id"], "left").join(prev, ["document_id", "chunk_id"], "left").join(c.select("document_id", "chunk_id", F.col("parent_header_text").alias("_header")), ["document_id", "chunk_id"], "left")
    across = F.when(~opens_list(F.coalesce(quote, F.lit(""))), F.coalesce("_before", "_line"))
    header = F.when(is_dangling(F.coalesce(quote, F.lit(""))), F.nullif("_header", F.lit("")))
    found = F.when(is_candidate(quote), F.coalesce("_same", across, header))
    d = d.withColumn("parent_stem", F.when(found != T.stripped(quote), found))
    return d.withColumn("embedding_text", F.when(F.col("parent_stem").isNotNull(), F.concat_ws(" ", "parent_stem", quote))).drop("_stem", "_same", "_before", "_line", "_header")

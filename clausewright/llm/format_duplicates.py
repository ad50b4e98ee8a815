"""Records that differ only in how they are written, collapsed with their copy counts.

Canonical bytes come from built-in expressions. Their buckets are radix prefixes: a
bucket with more rows than fit is split by further bytes, again and again, and every
bucket that fits is counted in a trie with terminal counters inside one task. A bucket
whose rows have no further byte holds copies of one value only; it is counted by a
combining aggregate and never gathered. What fits is the same at every size; the
oversized buckets of a level are a table that is joined, not a list on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import keyed, staged

#: A capitalised word before a sign, as the labels of a table row stand.
_LABELLED = r"(?<![\p{L}\p{N}])(\p{Lu}\p{L}+)\s*(?:[:=]|\p{Pd}\s)"
#: All but letters, digits and marks goes; . , - stay directly between two digits.
_NOISE = r"(?:(?<!\p{Nd})[.,\-]|[.,\-](?!\p{Nd})|[^\p{L}\p{N}\p{M}\p{Co}.,\-])+"
_STRIDE = 16


def _folded(x: Column) -> Column:
    return F.translate(F.lower(F.upper(F.coalesce(x, F.lit("")))), "ς", "σ")


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, _NOISE, "")


def _sorted_parts(x: Column, pattern: str) -> Column:
    parts = F.filter(F.transform(F.split(x, pattern), _bare), lambda p: p != "")
    return F.array_join(F.array_sort(parts), "\x1f")


def field_labels(df: DataFrame, quote: str = "source_quote", share: float = 0.005) -> tuple[str, ...]:
    """The labels of table rows, learnt: the words before a sign in quotes with three or
    more such words, that at least ``share`` of all quotes hold. That bounds their number
    by the mean number of labels a quote divided by ``share``."""
    d = df.where(F.col(quote) != "").select(F.array_distinct(F.transform(F.regexp_extract_all(F.col(quote), F.lit(_LABELLED), 1), _folded)).alias("labels"))
    total = F.count("*")
    n = d.agg(total.alias("n")).first()[0]
    each = d.where(F.size("labels") >= 3).select(F.explode("labels").alias("label")).groupBy("label").agg(total.alias("n"))
    return tuple(sorted(r["label"] for r in each.where(F.col("n") >= max(1, n * share)).collect()))


def canonical_quote(quote: Column, labels: tuple[str, ...] = ()) -> Column:
    """Case, white space, punctuation and symbols gone; the parts of a table row (four or
    more, each begun by a label before a sign, text before the first label being one
    too) in one order."""
    q = _folded(quote)
    if not labels:
        return _bare(q)
    label = rf"(?<![\p{{L}}\p{{N}}])(?=(?:{'|'.join(labels)})\s*[:=\p{{Pd}}])"
    return F.when(F.size(F.split(q, label)) > 3, _sorted_parts(q, label)).otherwise(_bare(q))


def canonical_ref(ref: Column) -> Column:
    """As the quote, with the listed references in one order; null equals empty."""
    return _sorted_parts(_folded(ref), r";|(?<!\p{Nd}),|,(?!\p{Nd})")


def canonical_records(df: DataFrame, key: str, quote: str, ref: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """(seq, ckey): rows without key or without a letter or digit in the quote are out."""
    d = keyed(df, key).select(F.col(key).cast("long").alias("seq"), canonical_quote(F.col(quote), labels).alias("q"), F.col(ref).alias("r"))
    return d.where("q <> ''").select("seq", F.encode(F.concat("q", F.lit("\x1e"), canonical_ref(F.col("r"))), "UTF-8").alias("ckey"))


def _bucket(depth: int) -> list[Column]:
    """The radix digits used at this depth and whether the value ends within them."""
    return [F.md5(F.expr(f"substring(ckey, 1, {depth})")).alias("digits"), (F.length("ckey") <= depth).alias("ended")]


def radix_buckets(canon: DataFrame, fits: int = 50_000, first_bytes: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets that fit, as (seq, ckey, bucket), and rows of buckets of one
    value, as (seq, keep_seq, copies). Each level twice as many bytes deep sees only the
    rows of the oversized buckets of the level before."""
    spark, depth = canon.sparkSession, first_bytes
    rest, fit, ones = canon, None, spark.createDataFrame([], "seq long, keep_seq long, copies long")
    while True:
        at = rest.select("seq", "ckey", *_bucket(depth))
        sizes = at.groupBy("digits", "ended").agg(F.count("*").alias("copies"), F.min("seq").alias("keep_seq"))
        large = staged(sizes.where(F.col("copies") > fits), "radix")
        small = at.join(large, ["digits", "ended"], "left_anti").select("seq", "ckey", F.xxhash64(F.lit(depth), "digits", "ended").alias("bucket"))
        fit = small if fit is None else fit.unionByName(small)
        kinds = {r["ended"] for r in large.select("ended").distinct().collect()}
        inside = at.join(large, ["digits", "ended"])
        if True in kinds:  # a key given twice is one row
            one = inside.where("ended").select("seq", "keep_seq", "digits").distinct()
            ones = ones.unionByName(one.join(one.groupBy("digits").agg(F.count("*").alias("copies")), "digits").select("seq", "keep_seq", "copies"))
        if False not in kinds:
            return fit, ones
        rest, depth = inside.where("not ended").select("seq", "ckey"), depth * 2


def _count_in_trie(root: dict, key: bytes, seq: int) -> None:
    for i in range(0, len(key), _STRIDE):
        edge = key[i : i + _STRIDE]
        if (child := root.get(edge)) is None:
            child = root[edge] = {}
        root = child
    root.setdefault(None, set()).add(seq)


def _terminals(root: dict) -> Iterator[set[int]]:
    todo = [root]
    while todo:
        node = todo.pop()
        if None in node:
            yield node[None]
        todo.extend(v for k, v in node.items() if k is not None)


def _trie_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(root: dict) -> pa.RecordBatch:
        seq, keep, n = [], [], []
        for members in _terminals(root):
            if len(members) > 1:
                first = min(members)
                seq.extend(members)
                keep.extend([first] * len(members))
                n.extend([len(members)] * len(members))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (seq, keep, n)], ["seq", "keep_seq", "copies"])

    bucket, root = None, {}
    for batch in batches:
        for s, k, b in zip(*(batch.column(c).to_pylist() for c in ("seq", "ckey", "bucket"))):
            if b != bucket:
                if root:
                    yield flush(root)
                bucket, root = b, {}
            _count_in_trie(root, k, s)
    if root:
        yield flush(root)


def copy_groups(df: DataFrame, key: str = "req_seq", quote: str = "source_quote", ref: str = "source_ref", **limits: int) -> DataFrame:
    """(seq, keep_seq, copies): every row that has at least one copy, with the smallest
    key of its group and the group's size.

    Null or blank quotes, quotes without any letter or digit and rows without key form
    no group; a null reference equals an empty one; rows given twice under one key are
    one row; an empty table gives an empty result; other columns are not looked at.
    """
    labels = field_labels(df, quote)
    fit, ones = radix_buckets(staged(canonical_records(df, key, quote, ref, labels), "canonical"), **limits)
    tries = fit.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_trie_counts, "seq long, keep_seq long, copies long")
    return tries.unionByName(ones)


def found(df: DataFrame, **limits: int) -> DataFrame:
    """(keep_seq, copy_seq): one row for each copy but the first of its group."""
    return copy_groups(df, **limits).where("seq <> keep_seq").select("keep_seq", F.col("seq").alias("copy_seq"))


def collapsed(df: DataFrame, key: str = "req_seq", quote: str = "source_quote", ref: str = "source_ref", **limits: int) -> DataFrame:
    """One row per record, the first of each group, with the number of its copies.
    Rows in no group (also null and blank quotes) stay with a count of 1; the count is
    added as ``n_copies``, or ``n_copies_`` and so on where the table has that name."""
    name = "n_copies"
    while name in df.columns:
        name += "_"
    groups = copy_groups(df, key, quote, ref, **limits)
    g = groups.select(F.col("seq").alias("__seq"), F.col("keep_seq").alias("__keep"), F.col("copies").alias("__n"))
    return df.join(g, F.col(key) == F.col("__seq"), "left").where("__seq is null or __seq = __keep").withColumn(name, F.coalesce("__n", F.lit(1))).drop("__seq", "__keep", "__n")

"""Near copies among records, by an exact metric-space join that is never pairwise.

The metric is the Jaccard distance of word sets, and the pivots are the singleton sets
of words: a set is nearest to the pivot of its rarest word, which is its Voronoi region.
By the triangle inequality of the symmetric difference, a set within the distance can
miss at most ``n - ceil(t n)`` of another's words, so it is replicated to the regions of
that many further words (the window) and to no others. The rarest word two such sets
share is then a region both are in. A region with more sets than fit is not compared:
each of its sets goes on to regions of word pairs (then triples and so on) within a
window one word wider, which keeps the join exact at every level; sets so short that a
pair need share no further word are compared where they are. Region sizes come from a
combining aggregate, so the rows of a region that does not fit are never brought
together. Pivots drawn from the documents themselves prune nothing at this distance
(README).

Equal sets are one class throughout, and records that no comparison can tell apart
(one set, one group of copies, one set of words in the description) one unit; units are
linked, and expanded to records only where pairs of records are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .base import keyed, staged
from .format_duplicates import canonical_quote, canonical_ref, field_labels

_U64 = (1 << 64) - 1
#: Sets of a region that one task compares with one another.
FITS = 16_000
_SKETCH_BITS = 256
_SKETCH = ("s0", "s1", "s2", "s3")
_REGION = "region long, cid long, n int, s0 long, s1 long, s2 long, s3 long, pos int, depth int"


def word_set(x: Column) -> Column:
    """Distinct runs of letters or digits in lower case, sorted; empty for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def frequent_words(classes: DataFrame, share: float = 1 / 5000) -> dict[str, int]:
    """Counts of the words that at least ``share`` of the sets hold: at most the mean
    set size divided by ``share`` words, however large the table. All rarer words come
    before them in the order, by hash."""
    total = classes.count()
    counts = classes.select(F.explode(F.split("words", " ")).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in counts.where(F.col("count") >= max(2, int(total * share))).collect()}


def _regions(frequent, num: int, den: int):
    """From (cid, words, region, pos, depth) to the regions one level further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = frequent.value, {}

        def entry(w: str) -> tuple[int, int, int]:
            if (e := cache.get(w)) is None:
                if len(cache) > 1_000_000:
                    cache.clear()
                h = xxh64_intdigest(w)
                e = cache[w] = ((known.get(w, 0) << 64) | h, h, 1 << (h % _SKETCH_BITS))
            return e

        for batch in batches:
            out = [[] for _ in range(9)]
            for cid, words, region, pos, depth in zip(*(batch.column(c).to_pylist() for c in ("cid", "words", "region", "pos", "depth"))):
                es = [entry(w) for w in words.split(" ")]
                sketch = 0
                for e in es:
                    sketch ^= e[2]
                bits = [_signed(sketch >> 64 * i & _U64) for i in range(4)]
                es.sort()
                n = len(es)
                for j in range(pos + 1, min(n, n + (-num * n) // den + depth + 1)):
                    h = es[j][1]
                    if depth:
                        h = xxh64_intdigest(h.to_bytes(8, "big"), region & _U64)
                    for o, v in zip(out, (_signed(h), cid, n, *bits, j, depth + 1)):
                        o.append(v)
            small = (2, 7, 8)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32() if i in small else pa.int64()) for i, o in enumerate(out)], ["region", "cid", "n", *_SKETCH, "pos", "depth"])

    return run


def _join_regions(num: int, den: int):
    """Candidates (a, b) within each region of rows sorted by region."""

    def pairs(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those whose sketches differ by no more than the sets may. Two words a sketch
        apart can hide each other, so it never shows more than there is; the sketch
        folded to half its bits is a sketch too, and the first test."""
        x = x[:, np.argsort(x[1], kind="stable")]
        cid, n, s = x[0], x[1], x[2:6].view(np.uint64)
        f0, f1 = s[0] ^ s[2], s[1] ^ s[3]
        for i in range(0, len(cid), 512):
            top = min(i + 512, len(cid))
            upto = int(np.searchsorted(n, n[top - 1] * den // num, "right"))
            d = np.bitwise_count(f0[i:top, None] ^ f0[None, i:upto]).astype(np.int16)
            d += np.bitwise_count(f1[i:top, None] ^ f1[None, i:upto])
            ok = d * (num + den) <= (n[i:top, None] + n[None, i:upto]) * (den - num)
            p, q = np.nonzero(ok)
            keep = q > p
            p, q = i + p[keep], i + q[keep]
            d = np.bitwise_count(s[:, p] ^ s[:, q]).sum(axis=0, dtype=np.int64)
            keep = d * (num + den) <= (n[p] + n[q]) * (den - num)
            yield cid[p[keep]], cid[q[keep]]

    def close(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(parts, axis=1) if len(parts) > 1 else parts[0]
        if x.shape[1] > 1:
            for a, b in pairs(x[1:7]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_region, held = None, []
        for batch in batches:
            x = np.vstack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "cid", "n", *_SKETCH)])
            if not x.shape[1]:
                continue
            for part in np.split(x, np.flatnonzero(np.diff(x[0])) + 1, axis=1):
                if part[0, 0] != open_region:
                    if held:
                        yield from close(held)
                    open_region, held = part[0, 0], []
                held.append(part)
        if held:
            yield from close(held)

    return run


def class_pairs(classes: DataFrame, num: int = 4, den: int = 5, fits: int = FITS) -> DataFrame:
    """(a, b), a < b: every two of the sets (cid, words; no two alike) whose Jaccard
    similarity is ``num / den`` or more; ``words`` is a set's words in order with a space
    between, as a string is half the size of an array in an exchange. Regions of more
    than ``fits`` rows go down a level; of their rows only those are compared here that
    need share no further word."""
    spark = classes.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_words(classes))
    todo, found = classes.selectExpr("cid", "words", "0L region", "-1 pos", "0 depth"), []
    ripe = f"ceil({num} * n / {den}) <= depth"
    while True:
        regions = staged(todo.mapInArrow(_regions(frequent, num, den), _REGION), "regions")
        large = staged(regions.groupBy("region").agg(F.count("*").alias("rows")).where(F.col("rows") > fits).select("region", F.lit(True).alias("large")), "large")
        more = not large.isEmpty()
        here = regions
        if more:
            marked = regions.join(large, "region", "left")
            here = marked.where(f"large is null or {ripe}")
        here = here.select("region", "cid", "n", *_SKETCH)
        found.append(here.repartition("region").sortWithinPartitions("region").mapInArrow(_join_regions(num, den), "a long, b long"))
        if not more:
            break
        todo = marked.where("large").select("cid", "region", "pos", "depth").join(classes, "cid").select("cid", "words", "region", "pos", "depth")
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionByName(x)
    pairs = staged(pairs.distinct(), "candidates")
    # only sets with a candidate take part in the check
    either = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    of = classes.select("cid", "words").join(either, "cid", "left_semi")
    a, b = (of.selectExpr(f"cid {x}", f"words w{x}") for x in "ab")
    wa, wb = F.split("wa", " "), F.split("wb", " ")
    both = F.size(F.array_intersect(wa, wb))
    return pairs.join(a, "a").join(b, "b").where(both * (num + den) >= num * (F.size(wa) + F.size(wb))).select("a", "b")


def unit_links(df: DataFrame, key: str = "req_seq", quote: str = "source_quote", ref: str = "source_ref", description: str = "description", least_words: int = 24, fits: int = FITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (seq, unit) of the records that can have a near copy, units (unit, cid,
    n_members), and links (ua, ub), ua < ub, between units.

    Two units are linked where their quotes share 80 % of their words, they are not
    copies under ``format_duplicates`` and, where both have a description, half of the
    words in those are shared. Null, empty or short quotes are in no unit; a description
    without words counts as none; rows without key are out, rows given twice under one
    key are one row.
    """
    labels = field_labels(df, quote)
    d = keyed(df, key).select(F.col(key).cast("long").alias("seq"), word_set(F.col(quote)).alias("words"), F.col(quote).alias("q"), F.col(ref).alias("r"), F.col(description).alias("d"))
    d = d.where(F.size("words") >= least_words).withColumn("words", F.array_join("words", " "))
    d = staged(d.withColumn("set_key", F.md5(F.col("words").cast("binary"))), "sets")
    classes = staged(d.groupBy("set_key").agg(F.min("seq").alias("cid"), F.any_value("words").alias("words"), (F.min("seq") != F.max("seq")).alias("several")), "classes")
    links = staged(class_pairs(classes.select("cid", "words"), fits=fits), "links")
    linked = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid"))).distinct().withColumn("linked", F.lit(True))
    live = staged(classes.select("set_key", "cid", "several").join(linked, "cid", "left").where("several or linked").select("set_key", "cid"), "live")
    rows = d.select("seq", "set_key", "q", "r", "d").join(live, "set_key")
    group = F.xxhash64(canonical_quote(F.col("q"), labels), canonical_ref(F.col("r")))
    rows = rows.select("seq", "cid", group.alias("copy_group"), word_set(F.col("d")).alias("dwords"))
    rows = staged(rows.withColumn("dkey", F.md5(F.array_join("dwords", " ").cast("binary"))), "rows")
    same = ["cid", "copy_group", "dkey"]
    units = staged(rows.groupBy(*same).agg(F.min("seq").alias("unit"), F.countDistinct("seq").alias("n_members"), F.any_value("dwords").alias("dwords")), "units")
    members = rows.select("seq", *same).join(units.select("unit", *same), same).select("seq", "unit").distinct()
    a, b = (units.selectExpr(f"cid {x}", f"unit u{x}", f"copy_group g{x}", f"dwords d{x}") for x in "ab")
    within = units.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").selectExpr("cid a", "cid b")
    shared = F.size(F.array_intersect("da", "db"))
    near = (F.size("da") == 0) | (F.size("db") == 0) | (3 * shared >= F.size("da") + F.size("db"))
    pairs = links.unionByName(within).join(a, "a").join(b, "b").where("ga <> gb and (a <> b or ua < ub)").where(near)
    pairs = pairs.select(F.least("ua", "ub").alias("ua"), F.greatest("ua", "ub").alias("ub"))
    return members, units.select("unit", "cid", "n_members"), pairs


def found(df: DataFrame, **columns: object) -> DataFrame:
    """(seq_a, seq_b), seq_a < seq_b: the pairs of records in linked units."""
    members, _, links = unit_links(df, **columns)
    a, b = (members.selectExpr(f"seq s{x}", f"unit u{x}") for x in "ab")
    pairs = links.join(a, "ua").join(b, "ub")
    return pairs.select(F.least("sa", "sb").alias("seq_a"), F.greatest("sa", "sb").alias("seq_b"))


def document_links(df: DataFrame, least_words: int = 1, **columns: object) -> DataFrame:
    """(seq, class_id, n_links): each record with a near copy, the class of equal word
    sets it is in and the number of its near copies, from links of units; no pair of
    records is made. By default over every quote with a word, however short."""
    members, units, links = unit_links(df, least_words=least_words, **columns)
    links = staged(links, "unit_links")
    ends = links.selectExpr("ua unit", "ub other").unionByName(links.selectExpr("ub unit", "ua other"))
    n = ends.join(units.selectExpr("unit other", "n_members"), "other").groupBy("unit").agg(F.sum("n_members").alias("n_links"))
    return members.join(n, "unit").join(units.select("unit", "cid"), "unit").select("seq", F.col("cid").alias("class_id"), "n_links")

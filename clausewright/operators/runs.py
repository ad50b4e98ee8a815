"""Run catalogue: which run and tier of a document is current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIERS = ("normalized", "enriched", "gated")


def current_runs(files: DataFrame) -> DataFrame:
    """Of (doc_key, run_dir, tier, mtime): each document's run with the latest file, and
    its highest tier not older than any lower tier present; else the lowest present."""
    wide = files.groupBy("doc_key", "run_dir").pivot("tier", list(TIERS)).agg(F.max("mtime"))
    newest = F.greatest(*(F.col(t) for t in TIERS))
    w = W.partitionBy("doc_key").orderBy(newest.desc(), F.col("run_dir").desc())
    d = wide.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    n, e, g = (F.col(t) for t in TIERS)
    ok = lambda t, *low: t.isNotNull() & ~F.coalesce(t < F.greatest(*low, F.lit(None).cast("timestamp_ntz")), F.lit(False))
    tier = F.when(ok(g, n, e), "gated").when(ok(e, n), "enriched").when(n.isNotNull(), "normalized").when(e.isNotNull(), "enriched").otherwise("gated")
    return d.select("doc_key", "run_dir", tier.alias("tier"))


def run_date(run_dir: str = "run_dir"):
    d = F.regexp_extract(run_dir, r"_(\d{4}\d{2}\d{2})_\d{6}$", 1)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise("unknown")


def containment_match(docs: DataFrame, registry: DataFrame, stem: str, key: str, order: str) -> DataFrame:
    """Each stem's first registry entry that contains it or is in it. The registry is a
    fixed, small table, so this is a broadcast loop over it."""
    r = F.broadcast(registry.select(F.lower(key).alias("_k"), F.col(key).alias("registry_key"), F.col(order).alias("_o")))
    s = F.lower(stem)
    d = docs.join(r, s.contains(F.col("_k")) | F.col("_k").contains(s), "left")
    return d.groupBy(stem).agg(F.min_by("registry_key", F.struct("_o", "registry_key")).alias("registry_key"))

"""Measures of extraction and retrieval, sweeps, samples and audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, key: str, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """recall@k and reciprocal rank of each query of ``relevant`` (query_id, key); a
    query with judgements but no hit scores 0."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hit = ranked.join(relevant, ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in cuts))
    d = n.join(hit, "query_id", "left")
    recall = [F.round(F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.col("n_relevant"), 4).alias(f"recall_{k}") for k in cuts]
    return d.select("query_id", "n_relevant", *recall, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"))


def aggregate_metrics(metrics: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    return metrics.agg(F.count("*").alias("queries"), *(F.round(F.avg(f"recall_{k}"), 4).alias(f"mean_recall_{k}") for k in cuts), F.round(F.avg("mrr"), 4).alias("mean_mrr"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``scored`` is (faithful, score); below the threshold a row is rejected. False
    positive rate of the faithful and catch rate of the others, null without any."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    d = scored.select("faithful", "score", t).groupBy("threshold")
    low = F.col("score") < F.col("threshold")
    rate = lambda c: F.round(F.try_divide(F.count_if(c & low), F.count_if(c)), 4)
    return d.agg(rate(F.col("faithful")).alias("fp_rate"), rate(~F.col("faithful")).alias("catch_rate"))


def select_threshold(sweep: DataFrame, most_fp: float = 0.10) -> DataFrame:
    """Within the allowed false positives the best catch, then the lowest threshold;
    where none is within, of all."""
    d = sweep.withColumn("ok", F.col("fp_rate") <= most_fp).withColumn("any", F.max("ok").over(W.partitionBy()))
    return d.where("ok or not any").orderBy(F.col("catch_rate").desc_nulls_last(), "threshold").limit(1).drop("ok", "any")


def margins(scored: DataFrame, threshold: float) -> DataFrame:
    """The nearest score on either side of the threshold."""
    s = F.col("score")
    return scored.agg(F.max(F.when(s < threshold, s)).alias("below"), F.min(F.when(s >= threshold, s)).alias("above"))


def floor_sweep(ranked: DataFrame, relevant: DataFrame, floors: list[float], key: str, k: int = 5) -> DataFrame:
    """(floor, queries, mean_recall, empty): recall@k when hits under the floor fall away."""
    rel = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    f = rel.select("query_id", "n", F.explode(F.array(*(F.lit(float(x)) for x in floors))).alias("floor"))
    hits = ranked.join(relevant.withColumn("rel", F.lit(1)), ["query_id", key], "left")
    d = f.join(hits, "query_id", "left").groupBy("floor", "query_id", "n").agg(F.count_if((F.col("score") >= F.col("floor")) & (F.col("rank") <= k) & (F.col("rel") == 1)).alias("got"), F.count_if(F.col("score") >= F.col("floor")).alias("kept"))
    return d.groupBy("floor").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("got") / F.col("n")), 4).alias("mean_recall"), F.count_if(F.col("kept") == 0).alias("empty"))


def weighted_prevalence(df: DataFrame, stratum: str, flagged: Column) -> DataFrame:
    """The share flagged of all rows, and that with each stratum weighted by its population."""
    d = df.groupBy(stratum).agg(F.count("*").alias("pop"), F.count_if(flagged.isNotNull()).alias("n"), F.count_if(flagged).alias("hit"))
    return d.agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("unweighted"), F.round(F.sum(F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)) * F.col("pop")) / F.sum("pop"), 6).alias("weighted"))


def category_counts(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Counts over all given categories, also those without rows."""
    dim = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    got = df.groupBy(column).agg(F.count("*").alias("n"))
    return dim.join(got, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def extraction_scores(matches: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of (tp, fp, fn) rows: overall and for each of ``by``."""
    d = matches.groupingSets([[]] + [[F.col(b)] for b in by], *(F.col(b) for b in by)).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.select(*by, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(zero(F.try_divide(2 * p * r, p + r)), 4).alias("f1"))


def hash_order(*columns: str, seed: str = "") -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def stratified_sample(df: DataFrame, classes: str, tier: str, key: str, per_class: int, weights: dict[str, float], seed: str = "") -> DataFrame:
    """For each class and tier the first rows in hash order, each tier its share of
    ``per_class`` and at least one."""
    w = W.partitionBy(classes, tier).orderBy(hash_order(key, seed=seed), key)
    alloc = F.coalesce(*(F.when(F.col(tier) == t, max(1, round(per_class * x))) for t, x in weights.items()))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= alloc).drop("_n")


def proportional_sample(df: DataFrame, stratum: str, key: str, total: int, floor: int = 15, seed: str = "") -> DataFrame:
    """Each stratum its share of ``total``, at least ``floor``, at most all it has."""
    n = df.groupBy(stratum).agg(F.count("*").alias("_pop"))
    d = df.join(n, stratum).crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))
    w = W.partitionBy(stratum).orderBy(hash_order(key, seed=seed), key)
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.greatest(F.lit(floor), F.round(F.lit(float(total)) * F.col("_pop") / F.col("_all")))).drop("_n", "_pop", "_all")


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row in a least-cost assignment (rows no more than columns)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, p, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        best, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < best[j]:
                        best[j], way[j] = c, j0
                    if best[j] < delta:
                        delta, j1 = best[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    best[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def bipartite_match(gold: DataFrame, predicted: DataFrame, by: str, key: str, text: str, least: float = 0.80) -> DataFrame:
    """(by, gold_key, predicted_key, similarity): within each group the assignment of
    greatest total token-sorted similarity, of which pairs under ``least`` are dropped."""

    def match(k: tuple, g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        g, p = g.sort_values(key, ignore_index=True), p.sort_values(key, ignore_index=True)
        swap = len(g) > len(p)
        a, b = (p, g) if swap else (g, p)
        sim = [[fuzzy.token_sort_ratio(x, y) / 100 for y in b[text]] for x in a[text]]
        rows = [(i, j) for i, j in enumerate(assignment([[-s for s in r] for r in sim])) if j >= 0 and sim[i][j] >= least] if len(a) else []
        side = lambda i, j: (b[key][j], a[key][i]) if swap else (a[key][i], b[key][j])
        return pd.DataFrame([(k[0], *side(i, j), round(sim[i][j], 6)) for i, j in rows], columns=[by, "gold_key", "predicted_key", "similarity"])

    d = [x.select(by, key, text).where(F.col(text).isNotNull()) for x in (gold, predicted)]
    return d[0].groupBy(by).cogroup(d[1].groupBy(by)).applyInPandas(match, f"{by} string, gold_key long, predicted_key long, similarity double")


def manifest_diff(expected: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys missing on either side or with a different value."""
    e, a = expected.select(key, F.struct(*columns).alias("e")), live.select(key, F.struct(*columns).alias("a"))
    d = e.join(a, key, "full")
    return d.select(key, F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed").alias("state")).where("state is not null")


def quarantined(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def discovery_signals(text: Column) -> Column:
    """What makes a text look like no requirement: short, open, all capitals or title case, an opener of definitions."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    caps = (n <= 10) & (text == F.upper(text)) & text.rlike("[A-Z]")
    title = (n <= 6) & F.forall(words, lambda w: w.rlike("^[^a-z]"))
    opener = F.lower(F.substring(text, 1, 40)).rlike(r"\b(?:means|refers to|is defined as|definition)\b")
    return F.array_compact(F.array(F.when(n <= 8, "short"), F.when(~text.rlike(r"[.!?;]\s*$"), "open"), F.when(caps, "all-caps"), F.when(title & ~caps, "title-case"), F.when(opener, "definition")))

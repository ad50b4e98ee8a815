"""Sources mixed to target shares by pivotal dependent rounding.

Every text of a source starts with the same expected number of copies, that which gives
the source its share of the largest mix the repeat limits allow. The fractional parts
are rounded in pairs: tokens' worth of probability moves from one text to the other, in
a random direction with the odds that keep every expectation, until one of the two is
integral. The source's token mass never changes, so a block of texts ends with one
fractional text; those are combined block by block up a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def pivotal(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities rounded to 0 or 1 but for at most one, with ``sum(p * size)`` and
    every expectation kept."""
    p, rng = p.astype(float).copy(), np.random.default_rng(seed)
    u = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        j = held
        up = min((1 - p[i]) * size[i], p[j] * size[j])
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if u[i] * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        held = -1
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
            else:
                held = k
    return p


def _round_blocks(d: DataFrame, seed: int, fan_in: int) -> DataFrame:
    """One level of the tree: p integral but for one text a block."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # the longest first, so that what stays fractional is short
        pdf = pdf.sort_values(["n_tokens", "row_key"], ascending=[False, True], ignore_index=True)
        s = seed + int(pdf["row_key"].min()) % 1_000_003
        return pdf.assign(p=pivotal(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(float), s), block=pdf["block"] // fan_in)[["source", "row_key", "n_tokens", "whole", "p", "block"]]

    return d.groupBy("source", "block").applyInPandas(run, "source string, row_key long, n_tokens long, whole long, p double, block long")


def mixed(sizes: DataFrame, targets: DataFrame, block: int = 20_000, fan_in: int = 256, seed: int = 11) -> DataFrame:
    """(source, doc_id, n_tokens, copies): the texts of the mix with their copies.

    Equal texts count as one, that of the smallest key, so no text is used more than
    its source's ``max_repeats``. Texts without tokens, and texts of null or untargeted
    sources, are in no mix; a target whose source has no text gets nothing and does not
    bound the mix. The last fractional text of a source is drawn by its probability.
    """
    texts = sizes.where("n_tokens > 0").groupBy("text_key").agg(F.min_by(F.struct("row_key", "n_tokens", "source"), "row_key").alias("x")).select("x.*")
    t = F.broadcast(targets.where("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats"))
    texts = staged(texts.join(t, "source"), "texts")
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.first("target_share").alias("share"), F.first("max_repeats").alias("most"))
    rows = have.collect()  # one row per target
    if not rows:
        return texts.selectExpr("source", "row_key doc_id", "n_tokens", "0L copies")
    total = min(r["most"] * r["tokens"] / r["share"] for r in rows)
    rates = F.broadcast(texts.sparkSession.createDataFrame([(r["source"], min(float(r["most"]), r["share"] * total / r["tokens"]), -(-r["n"] // block)) for r in rows], "source string, rate double, blocks long"))
    d = texts.join(rates, "source").withColumn("whole", F.floor(F.col("rate") + 1e-9))
    d = d.select("source", "row_key", "n_tokens", "whole", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")).alias("p"), F.pmod(F.xxhash64("row_key"), "blocks").alias("block"))
    done, level, blocks = [], 0, max(-(-r["n"] // block) for r in rows)
    while True:
        d = staged(_round_blocks(d, seed + level, fan_in), "mix")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(d.where(~open_))
        d, level = d.where(open_), level + 1
        if blocks <= 1:
            break
        blocks = -(-blocks // fan_in)
    drawn = d.withColumn("p", F.when(F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1_000_003)) < F.col("p") * 1_000_003, 1.0).otherwise(0.0))
    for x in done:
        drawn = drawn.unionByName(x)
    out = drawn.withColumn("copies", F.col("whole") + F.round("p").cast("long"))
    return out.where("copies > 0").select("source", F.col("row_key").alias("doc_id"), "n_tokens", "copies")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, most_copies) of every target."""
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    all_ = got.agg(F.sum("tokens").alias("total"))
    d = targets.select("source", "target_share").join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(all_))
    return d.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))

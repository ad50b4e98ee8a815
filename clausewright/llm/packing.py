"""Texts packed into containers of fixed capacity by vector best-fit.

Every container has three capacities: tokens, texts and attention cost (the sum of
squared lengths, as texts do not attend to one another). Items go, largest first, into
the open container that fits them under every constraint and is best by rule: the least
weighted norm of what would remain, or the largest weighted dot product of the item with
what remains. Items are dealt by hash into blocks of bounded size that are packed
independently; the poorly filled containers of all blocks are then dealt again, so that
little room is left over the whole table.

The capacities for texts and cost are below what the tokens alone would allow, so all
three bind: a container holds at most ``MOST_ITEMS`` texts, and its attention costs at
most ``COST_SHARE`` of what one text of full length would. A text that is over the cost
capacity by itself (longer than 0.87 of the container) gets a container of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged

MOST_ITEMS, COST_SHARE = 128, 0.75


def best_fit(sizes: np.ndarray, capacity: int, most_items: int, most_cost: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> np.ndarray:
    """The container number of each item. An item is within every capacity by itself:
    its cost counts at most as the whole cost capacity."""
    n = len(sizes)
    room = np.zeros((3, max(n, 1)))
    full = np.array([capacity, most_items, most_cost], float)
    w = np.array(weights)[:, None]
    out, used, live = np.zeros(n, np.int64), 0, np.zeros(max(n, 1), np.int64)
    n_live, least = 0, float(sizes.min()) if n else 0.0
    for i in np.argsort(-sizes, kind="stable"):
        item = np.array([sizes[i], 1.0, min(float(sizes[i]) ** 2, most_cost)])
        at = live[:n_live]
        r = room[:, at]
        ok = (r >= item[:, None]).all(axis=0)
        if ok.any():
            cand = at[ok]
            left = (r[:, ok] - item[:, None]) / full[:, None]
            if rule == "norm":
                best = cand[np.argmin((w * left * left).sum(axis=0))]
            else:
                best = cand[np.argmin(-(w * (item / full)[:, None] * r[:, ok] / full[:, None]).sum(axis=0))]
        else:
            best, used = used, used + 1
            room[:, best] = full
            live[n_live] = best
            n_live += 1
        room[:, best] -= item
        out[i] = best
        if room[0, best] < least or room[1, best] < 1:
            k = int(np.flatnonzero(live[:n_live] == best)[0])
            live[k] = live[n_live - 1]
            n_live -= 1
    return out


def items_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """(row_key, piece_no, first_token, n_tokens): one row for each text, or for each
    capacity-sized piece of a text larger than a container. Empty texts are no items."""
    d = sizes.where("n_tokens > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))))
    first = F.col("piece_no") * F.lit(capacity).cast("long")
    return d.select("row_key", "piece_no", first.alias("first_token"), F.least(F.col("n_tokens") - first, F.lit(capacity).cast("long")).alias("n_tokens"))


def packed(sizes: DataFrame, capacity: int, most_items: int = MOST_ITEMS, most_cost: float | None = None, rule: str = "norm", block: int = 8192, good: float = 0.98) -> DataFrame:
    """(container, row_key, piece_no, first_token, n_tokens): every item in exactly one
    container. Ties go by row and piece; the result is the same for any partitioning.
    Blocks are spread over as many partitions as there are blocks."""
    cost = float(most_cost or COST_SHARE * capacity * capacity)
    schema = "container string, row_key long, piece_no int, first_token long, n_tokens long, fill double"

    def one(tag: str):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["n_tokens", "row_key", "piece_no"], ascending=[False, True, True], ignore_index=True)
            c = best_fit(pdf["n_tokens"].to_numpy(), capacity, most_items, cost, rule)
            fill = np.bincount(c, pdf["n_tokens"]) / capacity
            names = np.array([f"{tag}{key[0]}-{j}" for j in range(len(fill))], dtype=object)
            return pdf.assign(container=names[c], fill=fill[c])[["container", "row_key", "piece_no", "first_token", "n_tokens", "fill"]]

        return run

    items = items_of(sizes, capacity)

    def deal(d: DataFrame, tag: str) -> DataFrame:
        blocks = max(1, -(-d.count() // block))
        at = d.withColumn("b", F.pmod(F.xxhash64("row_key", "piece_no", F.lit(tag)), F.lit(blocks)))
        return at.repartition(blocks, "b").groupBy("b").applyInPandas(one(tag), schema)

    first = staged(deal(items, "a"), "packed")
    again = first.where(F.col("fill") < good).select("row_key", "piece_no", "first_token", "n_tokens")
    return first.where(F.col("fill") >= good).unionByName(deal(again, "b")).drop("fill")


def report(packs: DataFrame, capacity: int, most_items: int = MOST_ITEMS, most_cost: float | None = None) -> DataFrame:
    """One row on containers: how many, their fill, the fewest that each capacity alone
    allows, the most texts in one, and how many are at the limit of texts or within a
    fiftieth of that of cost with more than one text."""
    cost = float(most_cost or COST_SHARE * capacity * capacity)
    n2 = F.col("n_tokens").cast("double") * F.col("n_tokens")
    c = packs.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"), F.sum(F.least(n2, F.lit(cost))).alias("cost"))
    least = lambda x, most: F.ceil(F.sum(x) / F.lit(float(most)))
    return c.agg(
        F.count("*").alias("containers"), F.round(F.sum("tokens") / F.count("*") / F.lit(float(capacity)), 4).alias("fill"),
        least("tokens", capacity).alias("least_by_tokens"), least("items", most_items).alias("least_by_items"), least("cost", cost).alias("least_by_cost"), F.max("items").alias("most_items"),
        F.count_if(F.col("items") >= most_items).alias("full_of_items"), F.count_if((F.col("items") > 1) & (F.col("cost") >= 0.98 * cost)).alias("full_of_cost"),
    )

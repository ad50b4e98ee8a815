"""One row of each group by a combining aggregate.

A window would sort every row of a group in one task; this keeps one row per group and
partition before the shuffle, so a group of any size costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greatest_row(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The row with the greatest ``order`` (nulls least) in each group; end the order
    with a unique column to settle ties."""
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = df.select(*keys, F.struct(*(F.col(c) for c in df.columns)).alias("_row"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_order"))
    return rows.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")

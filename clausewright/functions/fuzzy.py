"""Fuzzy string ratios (normalised indel similarity, 0 to 100) as Arrow-batched UDFs.

The common subsequence is computed bit-parallel in Python integers: one step for each
character of the longer string whatever the length of the shorter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs_length(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of its length in the
    longer, windows cut short at the edges included.

    All windows are lanes of one big integer, so a step of the bit-parallel recurrence
    advances every window at once; a guard bit keeps carries within a lane.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m, n = len(a), len(b)
    lanes, width = n + m - 1, (m + 8) // 8
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    none = bytes(width)
    coded = {c: v.to_bytes(width, "little") for c, v in masks.items()}
    pad = none * (m - 1)
    steps = int.from_bytes(pad + b"".join(coded.get(c, none) for c in b) + pad, "little")
    full = int.from_bytes(((1 << m) - 1).to_bytes(width, "little") * lanes, "little")
    s = full
    for _ in range(m):
        u = s & steps
        s = ((s + u) | (s ^ u)) & full
        steps >>= 8 * width
    left = np.bitwise_count(np.frombuffer(s.to_bytes(width * lanes, "little"), np.uint8)).reshape(lanes, width).sum(axis=1, dtype=np.int64)
    start = np.arange(1 - m, n)
    size = np.minimum(n, start + m) - np.maximum(0, start)
    return float((200.0 * (m - left) / (m + size)).max())


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _udf(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, DoubleType())


indel_ratio_udf, partial_ratio_udf, token_sort_ratio_udf = map(_udf, (indel_ratio, partial_ratio, token_sort_ratio))

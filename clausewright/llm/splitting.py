"""Oversized texts cut at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary in its middle half (of equals,
the one nearest the midpoint); halves still over the limit less the overlap are cut
again. Then each piece but the first gets the last ``overlap`` characters before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keyed

#: Boundaries, strongest first; a cut falls at the end of the match.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t\r]*\n+(?=\S)",
        r"\r?\n(?=\s*(?:\(?\w{1,3}[.)]|[•*-]) )",
        r"(?<=[.!?:])\r?\n",
        r"(?<=[a-z0-9)][.!?]) +(?=[\"'(]?[A-Z0-9À-Þ])",
        r"(?<=[;|])\s+",
        r"\n",
        r"(?<=,)\s+",
        r"\s+",
    )
)


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Offsets at which the pieces after the first begin."""
    most, points = limit - overlap, []
    if most < 1:
        raise ValueError("the overlap must be smaller than the limit")
    todo = [(0, len(text))] if len(text) > limit else []
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            continue
        mid, low, high = (a + b) // 2, a + (b - a) // 4, b - (b - a) // 4
        for boundary in BOUNDARIES:
            ends = [m.end() for m in boundary.finditer(text, low, high + 1) if a < m.end() < b]
            if ends:
                cut = min(ends, key=lambda e: abs(e - mid))
                break
        else:
            cut = mid
            while cut > a + 1 and unicodedata.combining(text[cut]):
                cut -= 1
        points.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(points)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """(offset where the piece's own part begins, piece): pieces of at most ``limit``
    characters; dropping ``overlap`` characters from all but the first and joining them
    gives the text back. A text within the limit is one piece."""
    starts = [0, *cut_points(text, limit, overlap)]
    ends = [*starts[1:], len(text)]
    return [(s, text[max(0, s - overlap) if i else 0 : e]) for i, (s, e) in enumerate(zip(starts, ends))]


def pieces(df: DataFrame, limit: int, overlap: int, key: str = "chunk_seq", text: str = "text", page_start: str = "page_start", page_end: str = "page_end", path: str = "section_ref_path") -> DataFrame:
    """(row_key, piece_no, n_pieces, piece, start_char, page, section path): the pieces
    of the texts over the limit, in order.

    The page a piece starts on is told from its place in the text between the row's
    first and last page; without an end, or with one before the start, it is the first
    page, without a start null. Null texts and texts within the limit give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            paths = []
            for i, (k, t, p, q) in enumerate(zip(*(b.column(c).to_pylist() for c in ("row_key", "text", "p", "q")))):
                got = split_text(t, limit, overlap)
                for no, (start, piece) in enumerate(got):
                    page = None if p is None else p if q is None or q <= p else p + start * (q - p + 1) // len(t)
                    for o, v in zip(out, (k, no, len(got), piece, start, page)):
                        o.append(v)
                    paths.append(i)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(o, t) for o, t in zip(out, types)), b.column("path").take(pa.array(paths, pa.int64()))], ["row_key", "piece_no", "n_pieces", "piece", "start_char", "page", "path"])

    d = keyed(df, key).where(F.length(text) > limit)
    d = d.select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text"), F.col(page_start).cast("int").alias("p"), F.col(page_end).cast("int").alias("q"), F.col(path).cast("array<string>").alias("path"))
    return d.mapInArrow(run, "row_key long, piece_no int, n_pieces int, piece string, start_char long, page int, path array<string>").withColumnRenamed("path", "section_ref_path")


def limits(size_limits: DataFrame, kind: str) -> tuple[int, int]:
    """(max_size, overlap) of one kind of item; the overlap is 0 where none is stated.
    A kind without a row or without a size is an error."""
    row = size_limits.where((F.col("item_kind") == kind) & F.col("max_size").isNotNull()).first()
    if row is None:
        raise ValueError(f"no size limit is given for {kind}")
    return row["max_size"], row["overlap"] or 0


def found(chunks: DataFrame, size_limits: DataFrame) -> DataFrame:
    """(chunk_seq): the rows that had to be cut."""
    return pieces(chunks, *limits(size_limits, "chunk_text")).where("piece_no = 0 and n_pieces > 1").select(F.col("row_key").alias("chunk_seq")).distinct()

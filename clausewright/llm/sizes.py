"""Sizes of texts in tokens of a public tokenizer, whose file stays where it is."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file, unless a caller names another.
TOKENIZER = os.environ.get("CLAUSEWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, key: str, text: str, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """(row_key, text_key, n_tokens, *keep): one row for each row with a key; null and
    empty texts have no tokens. ``text_key`` tells equal texts."""
    d = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    d = d.withColumn("text_key", F.md5(F.col("text").cast("binary")))
    kept = [f for f in d.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            names = ["row_key", "text_key", "n_tokens", *(f.name for f in kept)]
            yield pa.RecordBatch.from_arrays([b.column("row_key"), b.column("text_key"), pa.array(n, pa.int64()), *(b.column(f.name) for f in kept)], names)

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("text_key", T.StringType()), T.StructField("n_tokens", T.LongType()), *kept])
    return d.mapInArrow(run, schema)

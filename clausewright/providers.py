"""Model providers: what extraction, enrichment and synthesis call, with offline stand-ins.

A provider is any object with the method used; results are stored raw before they are
parsed, so parsing can run again without the model.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import ids as I
from .functions import model_json


class OfflineExtractor:
    """The sentences of a chunk that hold one of the verbs, as a model would list them."""

    def __init__(self, verbs: list[str]):
        self.pattern = re.compile(rf"\b(?:{'|'.join(map(re.escape, verbs))})\b", re.I)

    def complete(self, prompt: str) -> str:
        body = prompt.split("\n\n", 1)[-1]
        found = [s.strip() for s in re.split(r"(?<=[.;:])\s+", body) if self.pattern.search(s)]
        return json.dumps([{"source_quote": s, "source_ref": "", "description": "", "domain_tags": [], "requirement_type": ""} for s in found])


class OfflineEnricher:
    """Descriptions, tags and types told by words, as a model would: a tag where one of
    its words is in the quote, a type by the first verb of duty."""

    def __init__(self, words: dict[str, str], types: tuple[tuple[str, str], ...] = (("shall", "policy"), ("must", "technical-control"))):
        self.words, self.types = words, types

    def _fields(self, ref: str, quote: str) -> dict:
        low = quote.lower()
        tags = [t for w, t in self.words.items() if w in low]
        return {"description": f"Asks: {quote[:60]}", "domain_tags": tags, "requirement_type": next((t for w, t in self.types if w in low), "")}

    def enrich_batch(self, pairs: list[tuple[str, str]]) -> str:
        return json.dumps([self._fields(*p) for p in pairs])

    def enrich_one(self, ref: str, quote: str) -> str:
        return json.dumps(self._fields(ref, quote))

    def ready(self) -> bool:
        return True


class OfflineScorer:
    """Share of a description's words that its quote holds, in place of entailment."""

    def score(self, quotes: list[str], descriptions: list[str]) -> list[float]:
        words = lambda x: re.findall(r"\w+", x.lower())
        return [sum(w in set(words(q)) for w in words(d)) / max(1, len(words(d))) for q, d in zip(quotes, descriptions)]


class OfflineSynthesizer:
    """The question and the first line of each piece of evidence."""

    def rewrite(self, question: str) -> str:
        return json.dumps({"expanded_query": question.strip(), "control_ids": re.findall(r"\b[A-Z]{1,4}-\d+\b", question), "domain_tags": []})

    def hypothesize(self, question: str) -> str:
        return f"The organization shall address: {question.rstrip('?').strip()}."

    def synthesize(self, question: str, evidence: str) -> str:
        return "\n".join([question, *(b.split("\n", 1)[0] for b in evidence.split("\n\n"))])


class OfflineEmbedder:
    """Hashed bag of words, normalised; the same text always has the same vector."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.size
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.size] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]


def with_retries(call: Callable[[str], str], prompt: str, waits: tuple[float, ...] = (2, 4, 8), sleep=time.sleep) -> str:
    for wait in waits:
        try:
            return call(prompt)
        except Exception:
            sleep(wait)
    return call(prompt)


def raw_responses(prompts: DataFrame, provider, model: str, cache: DataFrame | None = None) -> DataFrame:
    """(document_id, chunk_id, model, prompt_hash, raw_response) of the prompts the cache
    of the same model does not hold; a failing call gives a null response."""
    d = prompts.select("document_id", "chunk_id", "prompt", F.lit(model).alias("model"), I.prompt_hash(F.col("prompt")).alias("prompt_hash"))
    if cache is not None:
        d = d.join(cache.select("model", "prompt_hash").distinct(), ["model", "prompt_hash"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append(with_retries(provider.complete, p))
                except Exception:
                    out.append(None)
            yield b.assign(raw_response=out)[["document_id", "chunk_id", "model", "prompt_hash", "raw_response"]]

    return d.select("document_id", "chunk_id", "model", "prompt_hash", "prompt").mapInPandas(run, "document_id string, chunk_id int, model string, prompt_hash string, raw_response string")


def parsed_responses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requirements, failures) of raw responses: ids R-{chunk}-{n} in order of answer.
    ``req_seq`` rises in the order of a document's answers and is unique in the document,
    as long as a chunk has under a million answers."""
    d = raw.withColumn("x", model_json.recover_json_array_udf("raw_response"))
    item = "struct<source_quote:string,source_ref:string,description:string,domain_tags:array<string>,requirement_type:string>"
    rows = d.where("x.items is not null").select("document_id", "chunk_id", F.col("x.recovered").alias("recovered_truncated"), F.posexplode("x.items").alias("n", "item"))
    rows = rows.withColumn("r", F.from_json("item", item))
    good = rows.select("document_id", "chunk_id", "recovered_truncated", F.format_string("R-%d-%d", "chunk_id", "n").alias("requirement_id"), (F.shiftleft(F.col("chunk_id").cast("long"), 20) + F.col("n")).alias("req_seq"), "r.*")
    bad = d.where("x.items is null").select("document_id", "chunk_id", F.when(F.col("raw_response").isNull(), "call_failed").otherwise("no_json_array").alias("error"), F.substring("raw_response", 1, 500).alias("raw_response_preview"))
    return good, bad


def embedding_column(provider):
    """A function from a text column to a vector column, for ``indexing``. A batch that
    fails is tried text by text; a text that fails has no vector."""

    def one(text: str):
        try:
            return [float(x) for x in provider.embed(text)]
        except Exception:
            return None

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if hasattr(provider, "embed_batch"):
            try:
                return pd.Series([None if v is None else [float(y) for y in v] for v in provider.embed_batch(list(x.fillna("")))], dtype=object)
            except Exception:
                pass
        return x.map(lambda t: None if t is None else one(t))

    return run


def embedded(df: DataFrame, provider, text: str) -> DataFrame:
    """``dense`` of a text column; rows without text, or whose text failed, are skipped."""
    d = df.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("dense", embedding_column(provider)(F.col(text)))
    return d.where("dense is not null")

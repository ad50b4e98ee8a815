"""The lexical search of many queries: postings staged once, each task reads all of them.

Nothing is copied for a query: the postings of the documents are written once, and a task
with some queries goes through them block by block, keeping the best of each query. What
moves is the queries and their results, however many rows and queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Scores are rounded to nine digits, so a bound this much under the least kept one is safe.
_SLACK = 1e-6
_POSTINGS = 4_000_000
#: The most frequent terms of a block, so many, have a value for each document, and are
#: added for so many queries at once. Postings added one by one are cheaper from there on.
_WIDE, _AT_ONCE = 40, 64


def _place(df: DataFrame) -> str:
    """The folder of a staged table, with its scheme."""
    return df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else ""


def _read(place: str) -> ds.Dataset | None:
    if not place:
        return None
    if place.startswith("file:"):
        return ds.dataset("/" + unquote(place[5:]).lstrip("/"), format="parquet")
    fs, path = FileSystem.from_uri(place)
    return ds.dataset(path, filesystem=fs, format="parquet")


def _vocabulary(place: str) -> tuple[pa.Array, np.ndarray]:
    """(terms in order, number of documents of each); a term's number is its place."""
    d = _read(place)
    t = d.to_table(columns=["term", "df"]).sort_by("term") if d else pa.table({"term": pa.array([], "string"), "df": pa.array([], "int64")})
    return t["term"].combine_chunks(), t["df"].to_numpy()


def _numbers(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term's number, occurrences) of the known terms of each row, in that order."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    at = pc.index_in(lists.flatten(), value_set=terms)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    code, n = np.unique(row[known] * max(1, len(terms)) + at.drop_null().to_numpy(), return_counts=True)
    return code // max(1, len(terms)), code % max(1, len(terms)), n


def _counted(place: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, _ = _vocabulary(place)
        for b in batches:
            row, term, n = _numbers(b["t"], terms)
            ends = np.searchsorted(row, np.arange(len(b) + 1))
            lists = [pa.Array.from_buffers(pa.binary(), len(b), [None, pa.array(ends * 4, "int32").buffers()[1], pa.py_buffer(x.astype("int32"))]) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([b["k"], b["dl"], *lists], ["k", "dl", "terms", "tfs"])

    return f


def _ints(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(how many in each row, all of them) of numbers kept as bytes."""
    at = np.frombuffer(x.buffers()[1], "int32", len(x) + 1, x.offset * 4)
    return np.diff(at) // 4, np.frombuffer(x.buffers()[2], "int32", (at[-1] - at[0]) // 4, at[0])


class _Block:
    """Postings of some documents, by document and by term; of the most frequent terms
    a value for each document, so that a matrix product adds them for many queries."""

    def __init__(self, parts: list[pa.RecordBatch], weight: np.ndarray, avgdl: float, k1: float, b: float):
        col = lambda c: pa.chunked_array([p[c] for p in parts]).combine_chunks()
        size, self.term = _ints(col("terms"))
        self.keys, self.first = col("k").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
        tf, dl = _ints(col("tfs"))[1], np.repeat(k1 * (1 - b + b * col("dl").to_numpy() / avgdl), size)
        self.s = weight[self.term] * tf * (k1 + 1) / (tf + dl)
        order = np.argsort(self.term.astype("uint16") if len(weight) < 1 << 16 else self.term, kind="stable")
        self.doc, self.by_term = np.repeat(np.arange(len(size)), size)[order], self.s.astype("float32")[order]  # places as numpy indexes: else each use converts them
        self.n = np.bincount(self.term, minlength=len(weight))
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.most = np.zeros(len(weight))
        used = np.flatnonzero(self.n)
        if len(used):
            self.most[used] = np.maximum.reduceat(self.by_term, self.at[used])
        wide = np.flatnonzero(self.n > len(size) // 32)
        wide = wide[np.argsort(-self.n[wide], kind="stable")][:_WIDE]
        self.column, self.wide = np.full(len(weight), -1), np.zeros((len(wide), len(size)), "float32")
        self.column[wide] = np.arange(len(wide))
        for x, t in zip(self.wide, wide):
            x[self.doc[self.at[t] : self.at[t + 1]]] = self.by_term[self.at[t] : self.at[t + 1]]

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Of some documents, with the terms always added in their order."""
        size = self.first[docs + 1] - self.first[docs]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.first[docs] - end + size, size)
        return np.round(np.bincount(np.repeat(np.arange(len(docs)), size), self.s[at] * asked[self.term[at]], len(docs)), 9)

    def begun(self, asked: list[np.ndarray]) -> np.ndarray:
        """What the frequent terms of each query add to each document."""
        some = np.zeros((len(asked), len(self.wide)), "float32")
        for x, terms in zip(some, asked):
            at = self.column[terms]
            x[at[at >= 0]] = 1
        return some @ self.wide

    def candidates(self, acc: np.ndarray, terms: np.ndarray, n: int, floor: float) -> np.ndarray:
        """Documents that may score ``floor`` or be among the ``n`` best, ``acc`` being what
        ``begun`` has of the query."""
        slack = _SLACK + 1.2e-7 * (len(terms) + 2) * self.most[terms].sum()  # with what sums of floats of 32 bits can be off, twice
        for t in terms[self.column[terms] < 0].tolist():
            x, y = self.at[t], self.at[t + 1]
            if x < y:
                np.add.at(acc, self.doc[x:y], self.by_term[x:y])
        docs = np.flatnonzero(acc >= max(floor - slack, 1e-37))
        if len(docs) > n:
            part = acc[docs]
            docs = docs[part >= float(np.partition(part, len(part) - n)[len(part) - n]) - slack]
        return docs


def _blocks(place: str, rows: int, *how) -> Iterator[_Block]:
    """Blocks of at most so many rows and about ``_POSTINGS`` postings, so that memory does
    not grow with the table; the first ones are small, as they set the floors."""
    d, parts, n, size, most = _read(place), [], 0, 0, min(rows, 4096)
    for b in d.to_batches(batch_size=most, use_threads=False, batch_readahead=1, fragment_readahead=1) if d else ():
        if parts and (n + len(b) > most or size > _POSTINGS):
            yield _Block(parts, *how)
            parts, n, size, most = [], 0, 0, min(rows, most * 4)
        if len(b):
            parts, n, size = [*parts, b], n + len(b), size + len(_ints(b["terms"])[1])
    if parts:
        yield _Block(parts, *how)


def greatest(score: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest rounded scores, ties by key."""
    if len(score) > n:
        at = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((keys[at], -score[at]))][:n]


def _searched(words: str, posts: str, n: int, use_idf: bool, n_docs: int, avgdl: float, k1: float, b: float, rows: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df = _vocabulary(words)
        weight = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) if use_idf else np.ones(len(df))
        asked: dict[int, np.ndarray] = {}
        for x in batches:
            row, term, _ = _numbers(x["t"], terms)
            for q, i, j in zip(x["query_id"].to_pylist(), *(np.searchsorted(row, np.arange(len(x)) + e) for e in (0, 1))):
                if i < j:
                    asked[q] = np.union1d(asked[q], term[i:j]) if q in asked else term[i:j]
        none = (np.zeros(0), np.zeros(0, "int64"))
        best = dict.fromkeys(asked, none)
        mask, order = np.zeros(len(terms)), list(asked)
        for block in _blocks(posts, rows, weight, avgdl, k1, b) if asked else ():
            for i in range(0, len(asked), _AT_ONCE):
                some = order[i : i + _AT_ONCE]
                for q, acc in zip(some, block.begun([asked[q] for q in some])):
                    (score, keys), t = best[q], asked[q]
                    docs = block.candidates(acc, t, n, score[-1] if len(score) == n else 0.0)
                    if not len(docs):
                        continue
                    mask[t] = 1
                    score, keys = np.concatenate([score, block.scores(docs, mask)]), np.concatenate([keys, block.keys[docs]])
                    mask[t] = 0
                    at = greatest(score, keys, n)
                    best[q] = score[at], keys[at]
        for q, (score, keys) in best.items():
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(keys), "int64"), pa.array(keys, "int64", from_pandas=True), pa.array(score)], ["query_id", "k", "score"])

    return f


def search(docs: DataFrame, queries: DataFrame, n: int, use_idf: bool, k1: float, b: float, rows_a_block: int, queries_a_block: int) -> DataFrame:
    """(query_id, k, score) of the ``n`` best of (k, t) for (query_id, t), t being words."""
    docs = docs.withColumn("dl", F.size("t"))
    size = docs.agg(F.avg("dl").alias("a"), F.count("*").alias("n")).first()
    twice = docs.groupBy("k").count().where("count > 1").select("k")
    if not twice.isEmpty():  # rows with one key are one document
        one = docs.join(twice, "k", "left_semi").groupBy("k").agg(F.flatten(F.collect_list("t")).alias("t"), F.first("dl").alias("dl"))
        docs = docs.join(twice, "k", "left_anti").unionByName(one)
    # counted before the join, so that what moves is a row a word and task
    df = docs.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    words = _place(staged(df.join(queries.select(F.explode("t").alias("term")).distinct(), "term", "left_semi"), "words"))
    posts = docs.select("k", "dl", "t").mapInArrow(_counted(words), "k long, dl int, terms binary, tfs binary").where(F.length("terms") > 0)
    posts = _place(staged(posts, "posts"))
    asked, cores = queries.count(), docs.sparkSession.sparkContext.defaultParallelism
    few = min(cores, -(-asked * 4 // queries_a_block))  # smaller blocks only while cores are idle: each task reads all postings
    q = queries.repartition(max(1, few, -(-asked // queries_a_block)), "query_id")
    return q.mapInArrow(_searched(words, posts, n, use_idf, size["n"], size["a"] or 1.0, k1, b, rows_a_block), "query_id long, k long, score double")

"""What the searches move and hold when rows and queries meet in many blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewright import catalogue
from clausewright.operators import lexical
from clausewright.operators import retrieval as R

#: Queries that rank all rows by the lexical search.
SEARCHES = ["bm25_tf_topk", "evidence_groups", "hybrid_rrf_hyde", "evidence_prompt", "hybrid_rrf", "bm25_idf_topk", "compare_semantic"]


def _shuffled(spark):
    return sum(x.totalShuffleWrite() for x in (lambda e: [e.apply(i) for i in range(e.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """3,000 rows, every second one divisible by 50, so that many queries meet many rows."""
    at, r = tmp_path_factory.mktemp("rows"), np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(i * 25, " ".join(r.choice(words, 20)), f"R-{i % 9}", f"{i % 5}.pdf", "", 0.5) for i in range(3000)]
    d = spark.createDataFrame(rows, "req_seq long, source_quote string, source_ref string, source_pdf string, description string, confidence double")
    d.withColumns({"section_ref_path": F.array(F.lit("1")), "parent_section_ref": F.lit("1")}).repartition(3).write.parquet(f"{at}/sample_normalized_reqs.parquet")
    v = [(i * 25, [float(x) for x in r.integers(-3, 4, 4)]) for i in range(600)]
    spark.createDataFrame(v, "vec_id long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", SEARCHES)
def test_blocks_of_a_search_are_not_copied(spark, folder, name, monkeypatch):
    search = R.lexical_top
    monkeypatch.setattr(catalogue.R, "lexical_top", lambda *a: search(*a, rows_a_block=100, queries_a_block=50))
    began = _shuffled(spark)
    got = catalogue.QUERIES[name](spark, folder).collect()
    moved, began = _shuffled(spark) - began, _shuffled(spark)
    monkeypatch.setattr(catalogue.R, "lexical_top", search)
    want = catalogue.QUERIES[name](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert moved < 1.5 * (_shuffled(spark) - began)


def test_a_task_reads_the_postings_for_many_queries(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(20)], "k long, text string")
    asked = spark.range(20000).select(F.col("id").alias("query_id"), F.lit("w1 w2").alias("query"))
    assert R.lexical_top(docs, asked, "k", "text", 3).rdd.getNumPartitions() == 10


@pytest.mark.parametrize("use_idf", [True, False])
def test_frequent_terms_rank_as_if_all_were_scored(spark, use_idf):
    """Words in nearly all rows, in some and in few; many ties; blocks of every size."""
    r = np.random.default_rng(3)
    words, p = [f"w{i}" for i in range(200)], 1 / np.arange(1, 201)
    rows = [(i, " ".join(r.choice(words, r.integers(1, 30), p=p / p.sum()))) for i in range(2500)]
    docs = spark.createDataFrame(rows + rows[:5] + [(9000, ""), (9001, None)], "k long, text string").repartition(2)
    asked = docs.where("k % 25 = 0 or k > 8000").dropDuplicates(["k"]).select(F.col("k").alias("query_id"), F.col("text").alias("query"))
    want = R.top(R.lexical_scores(docs, asked, "k", "text", use_idf), 20, "k").collect()
    near = lambda got: [(x["query_id"], x["rank"], round(x["score"], 6)) for x in sorted(got, key=lambda x: (x["query_id"], x["rank"]))]
    for size in (65536, 700):
        got = R.top(R.lexical_top(docs, asked, "k", "text", 20, use_idf, rows_a_block=size), 20, "k").collect()
        assert near(got) == near(want)
        assert len({(x["query_id"], x["k"]) for x in got} ^ {(x["query_id"], x["k"]) for x in want}) == 0


def test_adding_postings_converts_no_places():
    """A place of another width would be copied at each use, which took half the time of a search at size."""
    r = np.random.default_rng(5)
    terms = [np.unique(r.integers(0, 300, 25)).astype("int32") for _ in range(500)]
    numbers = lambda xs: pa.array([x.tobytes() for x in xs], "binary")
    rows = [pa.array(range(500), "int64"), pa.array([len(x) for x in terms], "int32"), numbers(terms), numbers([np.ones_like(x) for x in terms])]
    block = lexical._Block([pa.RecordBatch.from_arrays(rows, ["k", "dl", "terms", "tfs"])], np.ones(300), 25.0, 1.2, 0.75)
    assert block.doc.dtype == np.intp
    asked, mask = terms[:20], np.zeros(300)
    for acc, x in zip(block.begun(asked), asked):
        mask[:] = 0
        mask[x] = 1
        want = block.scores(np.arange(500), mask)
        block.candidates(acc, x, 10, 0.0)
        assert np.allclose(acc, want, rtol=1e-5)

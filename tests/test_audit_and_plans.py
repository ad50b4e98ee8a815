"""Audit helpers and what the physical plans must look like."""

from pyspark.sql import functions as F

from clausewright import catalogue
from clausewright.operators import audit as A
from clausewright.operators import retrieval as R
from clausewright.operators.pick import greatest_row

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imported_reviews(spark):
    rows = [("a", "1.0", '[{"source_quote": "q"}]', "done"), ("a", "1.5", "[]", "done"), ("a", "2", "no list", "done"), ("a", "x", "[]", "open"), ("a", None, "[]", "done")]
    good, bad = A.imported_reviews(spark.createDataFrame(rows, "source_pdf string, chunk_id string, gold string, review_status string"))
    assert [(r.chunk_id, len(r.gold)) for r in good.collect()] == [(1, 1)]
    assert sorted(r.error for r in bad.collect()) == ["chunk_id is not whole", "chunk_id is not whole", "gold is no list"]


def test_greatest_row(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5.0), (3, "a", 5.0), (4, None, None), (5, None, None)], "k long, g string, v double")
    assert sorted(r.k for r in greatest_row(df, ["g"], [F.col("v"), -F.col("k")]).collect()) == [2, 4]
    assert greatest_row(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_top_limits_before_the_shuffle(spark):
    s = spark.range(1000).selectExpr("id % 3 query_id", "id", "(id * 7 % 13) * 1.0D score")
    assert plan(R.top(s, 10, "id")).count("WindowGroupLimit") == 2


def test_columns_and_filters_reach_the_scan(spark):
    df = catalogue.QUERIES["compare_exact"](spark, DATA)
    p = plan(catalogue.reqs(spark, DATA).where("source_ref = 'x'").select("req_seq"))
    assert "PushedFilters: [IsNotNull(source_ref), EqualTo(source_ref,x)]" in p and "source_quote" not in p
    assert "Python" not in plan(df)


def test_operators_take_empty_tables(spark):
    empty = catalogue.reqs(spark, DATA).limit(0)
    from clausewright.operators import requirements as Q
    from clausewright.operators import services as V

    assert Q.deduplicated(empty).count() == 0 and Q.fold_duplicates(empty).count() == 0
    assert V.checklist(empty, "cybersecurity").count() == 0
    assert Q.stats(empty, empty, catalogue.chunks(spark, DATA).limit(0)).first().coverage_pct == 0.0


def test_trace_takes_every_stated_target(spark):
    """The targets are those of all types and references, as counted by hand."""
    rows = [tuple(r) for r in catalogue.reqs(spark, DATA).select("req_seq", "source_ref", "source_pdf").collect()]
    want = set()
    for t, ref, own in (r for r in rows if r[0] % 50 == 0 and r[1]):
        first = {}
        for k, x, pdf in sorted(rows, key=lambda r: r[0]):
            if x == ref and k != t and (pdf is None or pdf != own):
                first.setdefault(pdf if pdf is not None else k, (t, k, pdf))
        want |= set(first.values())
    got = {tuple(r) for r in catalogue.QUERIES["trace_cross_matches"](spark, DATA).collect()}
    assert got == want and want


def test_searches_take_every_stated_query(spark):
    """Every row with a quote and a number divisible by 50 is a query, in the compare
    and evidence results too, and finds itself."""
    asked = {r[0] for r in catalogue.reqs(spark, DATA).where("req_seq % 50 = 0 and source_quote rlike '[A-Za-z0-9]'").select("req_seq").collect()}
    for name in ("bm25_tf_topk", "bm25_idf_topk", "filtered_search", "compare_semantic", "evidence_groups", "evidence_prompt"):
        got = catalogue.QUERIES[name](spark, DATA)
        assert {r[0] for r in got.select("query_id").distinct().collect()} == asked and len(asked) > 4, name
        if name.startswith("bm25"):
            assert got.where("query_id = req_seq").count() == len(asked)


def test_stats_count_the_whole_cascade(spark, tmp_path):
    """Ungrounded quotes and heading echoes are failures, definitional openers count."""
    text = "Access Control Policy. The depot shall keep the logs of every officer. The fleet as defined in the annex shall report."
    spark.createDataFrame([("d", 1, text, 1, 1, None, "2025-01-01", 1)], "document_id string, chunk_id int, text string, page_start int, page_end int, parent_header_text string, ingested_at string, chunk_seq long").write.parquet(f"{tmp_path}/sample_chunks.parquet")
    quotes = ["The depot shall keep the logs of every officer.", "Quarterly zebra juggling workshops must exclude xylophones!", "Access Control Policy", "The fleet as defined in the annex shall report.", ""]
    rows = [(i, "d", 1, q, "AC-1", "A description of some length.", ["Access Control Policy"], 0.5) for i, q in enumerate(quotes)]
    spark.createDataFrame(rows, "req_seq long, document_id string, chunk_id int, source_quote string, source_ref string, description string, section_title_path array<string>, confidence double").write.parquet(f"{tmp_path}/sample_normalized_reqs.parquet")
    got = catalogue.QUERIES["stats_whole"](spark, str(tmp_path)).first()
    assert (got.requirements, got.failures, got.requirements_before, got.success_pct) == (2, 3, 5, 40.0)
    assert (got.chunks, got.distinct_refs, got.coverage_pct, got.avg_confidence, got.per_1000_chars) == (1, 1, 100.0, 0.5, round(2000 / len(text), 3))

"""Answer plans, enrichment, index publication, diagnosis and reports on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright import providers
from clausewright.functions.model_json import recover_json_object
from clausewright.operators import diagnosis as D
from clausewright.operators import enrichment as N
from clausewright.operators import gate as G
from clausewright.operators import indexing as X
from clausewright.operators import reports
from clausewright.operators import requirements as Q
from clausewright.operators import retrieval as R
from clausewright.operators import sections as S
from clausewright.operators import services as V
from clausewright.plans import answer
from clausewright.plans.ingest import ingest
from clausewright.sources import exports, files

EMBED = providers.OfflineEmbedder(32)
QUOTES = ["The clerk must file forms.", "The owner shall keep logs.", "The guard shall lock the gate.", "The clerk shall file logs."]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"R{i}", q, ref, pdf, "d" + pdf[0], i, 0.5 + i / 10, ["privacy"], "policy", m) for i, (q, ref, pdf, m) in enumerate(zip(QUOTES, ["AC-2", "AC-2", "(a)", ""], ["a.pdf", "b.PDF", "a.pdf", "b.PDF"], [None, "other", None, None]))]
    reqs = spark.createDataFrame(rows, "req_seq long, requirement_id string, source_quote string, source_ref string, source_pdf string, document_id string, chunk_id int, confidence double, domain_tags array<string>, requirement_type string, embedding_model string")
    reqs = reqs.withColumns({"description": F.lit(""), "section_ref_path": F.array(F.lit("3")), "parent_section_ref": F.lit(None).cast("string"), "domain_profile": F.lit(None).cast("string")})
    chunks = reqs.select("document_id", "chunk_id", F.concat(F.lit("Before. "), "source_quote", F.lit(" After.")).alias("text"))
    vectors = spark.createDataFrame([(i, EMBED.embed(q)) for i, q in enumerate(QUOTES)], "req_seq long, dense array<double>")
    return reqs, chunks, vectors


class Broken:
    def rewrite(self, q):
        raise OSError

    hypothesize = synthesize = rewrite


def test_retrieve(corpus):
    reqs, chunks, vectors = corpus
    model = providers.OfflineSynthesizer()
    got = answer.retrieve("who must file forms for AC-2?", reqs, vectors, EMBED.embed, chunks=chunks, rewriter=model, hypothesizer=model, synthesizer=model, document_ids=["a", "b"], tags=["Privacy"], top_k=3)
    rows = got.results.orderBy("rank").collect()
    assert rows[0].source_quote == QUOTES[0] and rows[0].context_text.startswith("Before. ") and got.total == len(rows) == 3
    assert got.synthesis.startswith("who must file") and len(got.warnings) == (1 if any(r.embedding_model for r in rows) else 0)
    with pytest.raises(ValueError, match="nowhere"):
        answer.retrieve("x", reqs, vectors, EMBED.embed, document_ids=["nowhere", "a"])
    plain = answer.retrieve("file forms", reqs, vectors, EMBED.embed, rewriter=Broken(), hypothesizer=Broken(), synthesizer=Broken())
    assert plain.expanded_query == "file forms" and plain.synthesis is None and plain.total
    none = answer.retrieve("file forms", reqs, vectors, EMBED.embed, min_score=9.0)
    assert none.total == 0 and none.warnings == [] and none.synthesis is None
    for k in (0, 101):
        with pytest.raises(ValueError):
            answer.ask("x", reqs, vectors, EMBED.embed, top_k=k)


def test_rewriting_splits_the_legs():
    class Fenced:
        def rewrite(self, q):
            return '```json\n{"expanded_query": " keep logs ", "control_ids": ["AU-2", ""], "domain_tags": ["privacy", "none"]}\n```'

    assert answer.rewritten("q", Fenced(), ["privacy"]) == ("keep logs", "keep logs AU-2", ["privacy"])
    assert answer.rewritten("q", Broken(), []) == ("q", "q", [])
    assert [answer.clamped_top_k(x) for x in (None, "", "nan", "inf", "0", 500, "7.5", "x")] == [20, 20, 20, 20, 1, 100, 8, 20]


def test_compare_goes_by_what_the_query_is(corpus):
    reqs, _, vectors = corpus
    mode, out = answer.compare(" ac-2 ", reqs, vectors, EMBED.embed)
    assert mode == "exact" and {r.source_pdf: r.req_seq for r in out.collect()} == {"a.pdf": 0, "b.PDF": 1}
    assert {r.source_pdf for r in answer.compare("AC-2", reqs, vectors, EMBED.embed, doc_keys=["a"])[1].collect()} == {"a.pdf"}
    assert {r.document_id for r in answer.compare("AC-2", reqs, vectors, EMBED.embed, document_ids=["db"])[1].collect()} == {"db"}
    mode, out = answer.compare("file logs", reqs, vectors, EMBED.embed)
    assert mode == "semantic" and out.where("ref_rank = 1").count() >= 1
    assert "semantic" in reports.compare_text("file logs", mode, out)
    with pytest.raises(ValueError):
        answer.compare("ZZ-9", reqs, vectors, EMBED.embed)


def test_trace_and_evidence(corpus):
    reqs, chunks, vectors = corpus
    one, matches = answer.trace("R0", reqs, chunks)
    assert one.first().context_text.startswith("Before.") and one.first().domain_profile == "cybersecurity" and [m.req_seq for m in matches.collect()] == [1]
    assert "R0" in reports.trace_text(one, matches)
    with pytest.raises(ValueError):
        answer.trace("none", reqs)
    got = answer.evidence("file logs", reqs, vectors, EMBED.embed, chunks=chunks, synthesizer=Broken())
    assert got.total_sources == 4 and got.synthesis is None and "[1] Control: " in got.prompt and "__no_ref__" not in got.prompt
    keys = {r.group_key for r in V.public_group_keys(got.groups).collect()}
    assert keys == {"AC-2", "3(a)", "R3"}


def test_blocked_searches_rank_as_the_plain_ones(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words, r.integers(0, 12)))) for i in range(300)] + [(900 + i, "w1 w2 w3") for i in range(40)] + [(999, None)], "id long, t string")
    queries = spark.createDataFrame([(i, " ".join(r.choice(words, 5))) for i in range(25)] + [(77, ""), (78, "zz")], "query_id long, query string")
    show = lambda d: sorted((x.query_id, x.id, round(x.score, 6)) for x in d.collect())
    for idf in (True, False):
        want = show(R.top(R.lexical_scores(docs, queries, "id", "t", idf), 7, "id"))
        assert want == show(R.lexical_top(docs, queries, "id", "t", 7, idf, rows_a_block=50, queries_a_block=4)) == show(R.lexical_top(docs, queries, "id", "t", 7, idf))
    vecs = spark.createDataFrame([(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(200)] + [(500, None), (501, [0.0] * 4)], "id long, v array<double>")
    asked = vecs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    want = show(R.top(R.dense_scores(vecs, asked, "id", "v"), 5, "id"))
    assert want == show(R.dense_top(vecs, asked, "id", "v", 5, rows_a_block=30, queries_a_block=3)) == show(R.dense_top(vecs, asked, "id", "v", 5))
    assert R.lexical_top(docs.limit(0), queries, "id", "t", 5).count() == R.dense_top(vecs, asked.limit(0), "id", "v", 5).count() == 0


def test_only_a_documents_first_row_of_a_reference_meets_a_target(spark):
    rows = [(1, "A", "x.pdf"), (2, "A", "y.pdf"), (3, "A", "y.pdf"), (4, "A", None), (5, "A", None), (6, "B", "z.pdf"), (7, "", "y.pdf")]
    df = spark.createDataFrame(rows, "req_seq long, source_ref string, source_pdf string")
    got = lambda **k: sorted((r.target, r.req_seq) for r in V.cross_matches(df, df.where("req_seq in (1, 4)"), **k).collect())
    assert got() == [(1, 2), (1, 4), (1, 5), (4, 1), (4, 2), (4, 5)] and got(most=2) == [(1, 2), (4, 1), (4, 2)]


def test_enrichment_falls_back_row_by_row(spark):
    class Model(providers.OfflineEnricher):
        def enrich_batch(self, pairs):
            answers = json.loads(super().enrich_batch(pairs))
            return "no list" if any(q[:3] in ("odd", "fai") for _, q in pairs) else json.dumps(answers if len(pairs) > 1 else answers * 2)

        def enrich_one(self, ref, quote):
            if "fail" in quote:
                raise OSError
            return f"```json\n{super().enrich_one(ref, quote)}\n```"

    rows = [("a", "", "the badge shall hold"), ("b", "1", "fail"), ("c", "", "odd"), ("d", None, None), (None, "", "x")]
    fresh = spark.createDataFrame(rows, "requirement_id string, source_ref string, source_quote string").withColumns({"description": F.lit(None).cast("string"), "domain_tags": F.array().cast("array<string>"), "requirement_type": F.lit(""), "parent_stem": F.lit("fresh")})
    cache = spark.createDataFrame([("a", "old", ["t"], "", "m", 1), ("a", "new", [], "x", "m", 2), ("b", "", [], "", "m", 9), ("c", "other", [], "", "n", 1)], "requirement_id string, description string, domain_tags array<string>, requirement_type string, enrichment_model string, enriched_at int")
    run = lambda **k: {r.requirement_id: r for r in N.enriched(fresh, Model({"badge": "privacy"}), "m", ["privacy"], ["policy"], cache, **k).collect()}
    got = run()
    assert (got["a"].description, got["a"].requirement_type, got["a"].parent_stem, got["a"].enriched) == ("new", "x", "fresh", True)
    assert not got["b"].enriched and got["b"].enrichment_model is None and got["c"].description == "Asks: odd" and got["d"].enriched and not got[None].enriched and len(got) == 5
    got = run(default_profile=False)
    assert got["a"].domain_tags == ["privacy"] and got["a"].requirement_type == "policy"
    assert sum(r.enriched for r in run(most=2).values()) == 2
    assert N.enriched(fresh.limit(0), Model({}), "m", [], [], cache).count() == 0
    raw = spark.createDataFrame([("k", '{"description": " d ", "domain_tags": "Privacy", "requirement_type": "Nope"}'), ("l", "{}"), ("m", None)], "requirement_id string, raw string")
    assert {r[0]: tuple(r[1]) for r in N.parsed_answers(raw, ["privacy"], ["policy"]).collect()} == {"k": ("d", ["privacy"], ""), "l": ("", [], "")}
    assert recover_json_object('x {"a": 1} y') == {"a": 1} and recover_json_object("[{}]") == {} and recover_json_object('{"a": ') is None and recover_json_object(None) is None


def test_gate_with_scores(spark):
    df = spark.createDataFrame([(1, "The clerk files forms.", "The clerk files forms weekly and burns them."), (2, "A b.", "a  B."), (3, "x", None), (4, "The clerk files forms.", "The clerk files forms")], "k int, source_quote string, description string")

    class Fails:
        def score(self, q, d):
            raise OSError

    got = {r.k: (r.support, r.gate_errors) for r in G.gated(G.with_support(df, providers.OfflineScorer()), F.col("support")).collect()}
    assert got[1][1] == ["low_support"] and got[2] == (None, []) and got[3] == (None, []) and got[4] == (1.0, [])
    assert all(r.support is None and r.gate_errors == [] for r in G.gated(G.with_support(df, Fails()), F.col("support")).collect())


def test_index_is_all_or_nothing(spark, tmp_path, corpus):
    reqs, chunks, _ = corpus
    root = str(tmp_path / "index")
    more = reqs.unionByName(reqs.limit(1).withColumns({"source_quote": F.lit(" "), "requirement_id": F.lit("blank")})).unionByName(reqs.where("req_seq = 1").withColumns({"req_seq": F.lit(50).cast("long"), "source_quote": F.lit("Last write.")}))
    points = X.requirement_points(more, "6ba7b8119dad11d180b400c04fd430c8", providers.embedding_column(EMBED), "hash", ["req_seq"])
    assert {r.requirement_id: r.source_quote for r in points.collect()}["R1"] == "Last write." and points.count() == 4 and points.first().embedding_dim == 32
    X.publish_index(points, root, "v1")
    X.publish_index(points, root, "v2")
    assert files.current_version(spark, root) == "v2" and not files.exists(spark, f"{root}/v1")
    uneven = points.withColumn("embedding_dim", F.when(F.col("requirement_id") == "R0", 3).otherwise(4))
    for bad in (points.limit(0), uneven, points.unionByName(points)):
        with pytest.raises(RuntimeError):
            X.publish_index(bad, root, "v3")
    with pytest.raises(Exception):
        X.publish_index(points.withColumn("x", F.raise_error(F.lit("no"))), root, "v3")
    assert files.current_version(spark, root) == "v2" and files.read_current(spark, root).count() == 4 and not files.exists(spark, f"{root}/v3")
    long = chunks.limit(1).withColumns({"text": F.lit("x" * 2000), "document_id": F.lit(""), "source_pdf": F.lit("doc_chunks.jsonl"), "page_start": F.lit(1), "page_end": F.lit(2), "n": F.lit(1)})
    p = X.context_points(long, lambda t: F.array(F.length(t).cast("double")), "m", ["n"]).first()
    assert (p.document_id, p.dense, len(p.text)) == ("doc", [1500.0], 2000)
    fresh = points.where("requirement_id = 'R0'").withColumn("source_ref", F.lit("new"))
    up = X.upserted(points, fresh)
    assert up.count() == 4 and up.where("source_ref = 'new'").count() == 1

    class Down:
        def ready(self):
            raise OSError

    s = X.status(spark, str(tmp_path), ["index", "none"], {"enricher": providers.OfflineEnricher({}), "down": Down()})
    assert s["indexes"]["index"] == {"version": "v2", "points": 4} and s["indexes"]["none"]["points"] is None and s["providers"] == {"enricher": True, "down": False}
    assert "down: not ready" in reports.status_text(s)


def test_pointer_is_never_missing(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(3):
        files.publish(spark.range(i + 1), root, f"v{i}")
        assert files.read_current(spark, root).count() == i + 1
    with pytest.raises(ValueError):
        files.publish(spark.range(9), root, "v1")
    assert files.read_current(spark, root).count() == 3 and files.exists(spark, f"{root}/v1")


def test_a_failing_parse_stops_no_other(spark):
    class Parser:
        def parse(self, content, first, last):
            if content == b"bad":
                raise ValueError("broken")
            return [("1. A", None, 1), (None, content.decode(), 2)]

    docs = spark.createDataFrame([("a.pdf", "1", bytearray(b"bad")), ("b.pdf", "2", bytearray(b"text"))], "source_pdf string, document_id string, content binary")
    items, failed = files.parsed_documents(docs, Parser())
    assert [(r.item_seq, r.heading, r.text, r.page) for r in items.orderBy("item_seq").collect()] == [(0, "1. A", None, 1), (1, None, "text", 2)]
    assert [(r.source_pdf, r.error) for r in failed.collect()] == [("a.pdf", "ValueError: broken")]


def test_ancestry_of_prose_and_deep_headings(spark):
    deep = ".".join("1" * 9)
    rows = [(0, "SCOPE ", None), (1, None, "One."), (2, None, "  "), (3, f"{deep} Deep", None), (4, None, None), (5, f"{deep}.1 Deeper", None), (6, None, "Body."), (7, "2. Next ..... 4", None), (8, "2. Next", None)]
    a = S.with_parent_context(S.ancestry(spark.createDataFrame([("d", *r) for r in rows], "document_id string, item_seq int, heading string, text string")))
    got = {r.item_seq: (r.section_ref_path, r.section_title_path, r.parent_header_text, r.parent_context) for r in a.collect()}
    assert got[0] == ([], [], None, None) and got[1] == ([], ["SCOPE"], "SCOPE", "One.") and 7 not in got
    assert got[6] == ([deep, deep + ".1"], ["SCOPE", f"{deep} Deep", f"{deep}.1 Deeper"], f"{deep}.1 Deeper", "Body.")
    assert got[4][3] == f"{deep} Deep" and got[8] == ([], [], None, None)


def test_heading_echo_drops_numbers(spark):
    rows = [(1, "3.2 Access Control", ["Access Control"]), (2, "Access badges shall be issued for the purpose of entry.", ["Purpose", None, " "]), (3, "Section 4: Duties", ["1. Scope", "DUTIES"])]
    df = spark.createDataFrame(rows, "req_seq long, source_quote string, section_title_path array<string>").withColumns({"chunk_known": F.lit(False), "chunk_text": F.lit(None).cast("string"), "description": F.lit(""), "parent_header_text": F.lit(None).cast("string")})
    assert {r.req_seq: r.error for r in Q.validated(df).collect()} == {1: "heading_echo", 2: None, 3: "heading_echo"}


def test_fold_by_both_keys(spark):
    """As replayed row by row; empty quotes and descriptions are no keys."""
    import random

    r = random.Random(6)
    rows = [(i, r.choice(["d", None]), r.choice(["x", "X", None, ""]), r.choice(["", None, "q one", "Q  One", "q2"]), r.choice(["", None, "same", "other"]), r.choice([None, 0.1, 0.9])) for i in range(200)]
    df = spark.createDataFrame(rows, "req_seq long, document_id string, source_ref string, source_quote string, description string, confidence double")
    held, norm = {}, lambda x: " ".join((x or "").lower().split())
    for i, doc, ref, q, de, c in rows:
        score, keys = (c or 0) * 1000 - len(q or ""), [(doc, ref or "", k, v) for k, v in (("d", norm(de)), ("q", norm(q))) if v]
        old = next((k for k in keys if k in held), None)
        if old is None:
            held.update({k: (i, score) for k in keys})
        elif score > held[old][1]:
            held[old] = (i, score)
    want = sorted({i for i, _ in held.values()})
    assert sorted(x.seq for x in Q.fold_duplicates(df).collect()) == want == sorted(x.req_seq for x in Q.deduplicated_all(df).collect())


def test_misses_by_first_rule(spark):
    reqs = spark.createDataFrame([("t", "d", 1, "Alpha beta = 1 Gamma delta = 2"), ("f", "d", 2, "(a) Do x."), *((k, "d", 3, "The owner of every depot in the region shall keep and review the logs of each gate and each vault, in writing, weekly.") for k in ("e", "z", "p", "r", "s"))], "requirement_id string, document_id string, chunk_id int, source_quote string")
    chunks = spark.createDataFrame([("d", 3, "x")], "document_id string, chunk_id int, text string")
    pool = spark.createDataFrame([(0, "s", 1, 0.9), (0, "r", 40, 0.5), (0, "p", 41, 0.4), (0, "z", 90, 0.001)] + [(0, f"n{i}", 2 + i, 0.8) for i in range(30)], "query_id int, requirement_id string, rank int, score double")
    rel = spark.createDataFrame([(0, k) for k in ("gone", "moved", "t", "f", "e", "z", "p", "r", "s")], "query_id int, requirement_id string")
    plain = spark.createDataFrame([(0, "p", 3)], "query_id int, requirement_id string, rank int")
    lost = spark.createDataFrame([(0, "moved", False)], "query_id int, requirement_id string, confirmed boolean")
    m = D.miss_categories(rel, pool, plain, reqs, chunks, lost)
    assert {r.requirement_id: r.category for r in m.collect()} == {"gone": "extraction_failure", "moved": None, "t": "table_serialization", "f": "missing_context", "e": "embedding_miss", "z": "zero_truth_confidence_failure", "p": "query_filter_issue", "r": "ranking_miss"}
    grabs = D.over_grabs(pool.unionByName(spark.createDataFrame([(0, "e", 50, 0.3)], pool.schema)), rel.where("requirement_id = 's'"), reqs, spark.createDataFrame([(0, "e")], "query_id int, requirement_id string"), shown=40)
    assert {r.requirement_id for r in grabs.collect()} == {"r", "p", "e"}
    n = {r.category: r.n for r in D.prevalence(m, grabs).collect()}
    assert len(n) == 8 and n["extraction_failure"] == 1 and n["over_grab"] == grabs.count()


def test_checks_on_labels(spark):
    expected = spark.createDataFrame([(1, "a", "k", "Text one"), (1, "b", "k", "gone text"), (1, "c", "k", "nothing")], "query_id int, requirement_id string, doc_key string, quote string")
    now = spark.createDataFrame([("k", "text  ONE")], "doc_key string, source_quote string")
    assert {r.requirement_id: r.confirmed for r in D.extraction_loss(expected, now, now.select("doc_key", F.lit("Gone text").alias("source_quote"))).collect()} == {"a": False, "b": True, "c": None}
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    D.removed_exactly(spark.range(5), spark.range(3), ids, "id")
    with pytest.raises(ValueError):
        D.removed_exactly(spark.range(5), spark.range(4), ids, "id")
    q = spark.createDataFrame([(0, "broad", 3, 5, None, 0.5, 0.5, 1.0, 1.0), (1, "zero", 0, 4, None, 0.0, 0.0, 0.0, 0.0), (2, "broad", 0, 4, None, 0.0, 0.0, 0.0, 0.0), (3, "broad", 2, 0, "down", None, None, None, None)], "query_id int, shape string, n_relevant int, returned int, error string, recall_5 double, recall_10 double, recall_20 double, mrr double")
    t = D.harness_totals(q).first()
    assert (t.mean_recall_5, t.scored, t.zero, t.zero_returned, t.unscored, t.failed) == (0.5, 1, 1, 4.0, 1, 1)
    labelled = spark.createDataFrame([("REAL", None, "The clerk files."), ("FRAGMENT", "colon_too_long", "The clerk will:"), ("OVER_GRAB", "x", "Is kept.")], "category string, subtype string, quote string")
    g = D.rule_gate(labelled, {"colon_too_long": 1}).first()
    assert (g.real_rejected, g.scope_violations, g.coverage_regressions, g.passed) == (0, 1, 0, False)
    rows = spark.createDataFrame([(1, "a.pdf", 1, "See:", "one two three four five", "2025"), (2, "a.pdf", 1, "See:", "one two three four five", "2026"), (3, "a.pdf", 2, "The clerk files forms.", "The clerk shall file forms.", "2025"), (4, "a.pdf", 3, "The clerk files.", "Clerk files.", "2024"), (5, "a.pdf", 4, "Gates stay shut.", "Gates shut.", "2026")], "req_seq long, source_pdf string, chunk_id int, source_quote string, description string, run_timestamp string")
    got = {r.req_seq: r.route for r in D.harvested(rows, ("shall",), 5, fixed_after="2025-06").collect()}
    assert got == {1: "citation_fragment_shaped", 3: "modality_shaped", 5: "clean"}
    assert D.skip_sections_applied([], "docling") is None and D.skip_sections_applied(["x"], "pymupdf") is False
    s = spark.createDataFrame([(1, True, 0.9), (2, False, 0.8)], "k int, faithful boolean, score double")
    assert not D.regression_checked(s, 0.5).first().all_correct and D.support_errors(s, 0.5).first().false_negatives == 1


def test_workbook_rows_and_reports(spark):
    rows = [("R1", "=SUM(1)", "1.2", None, ["A", "B"], ["privacy"], "policy", 0.4, 1, 2, "x.pdf", "cybersecurity")]
    df = spark.createDataFrame(rows, "requirement_id string, source_quote string, source_ref string, description string, section_title_path array<string>, domain_tags array<string>, requirement_type string, confidence double, page_start int, page_end int, source_pdf string, domain_profile string")
    ((values, flagged),) = exports.sheet_rows(V.checklist(df, "cybersecurity"))
    assert flagged and values[:10] == ["1.2", "A > B", "1, 2", "'=SUM(1)", "", "not-started", "", "Yes", "low-confidence", 0.4] and len(values) == 13 == exports.GROUPS[-1][2]
    assert reports.markdown_table(spark.createDataFrame([("a|b", 0.5)], "k string, v double"), "T") == "# T\n\n| k | v |\n|---|---|\n| a\\|b | 0.5 |\n"
    with pytest.raises(ValueError):
        reports.markdown_table(spark.range(5), "T", most=3)
    docs = spark.createDataFrame([("k1", "B.pdf", 2, "2025-01-01"), ("k2", "", 5, None)], "doc_key string, source_pdf string, n_reqs long, run_date string")
    assert [r.doc_key for r in V.sorted_documents(docs, "count", True).collect()] == ["k2", "k1"] and V.filtered_names(docs, "b.p").count() == 1
    assert reports.documents_text(docs).count("\n") == 4


def test_ingest_enriches_scores_and_takes_parts(spark):
    rows = [("d", i, i, f"The owner shall keep badge number {i} in the vault of the northern depot.") for i in range(4)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id int, chunk_seq long, text string").withColumns({"section_title_path": F.array(F.lit("2. Duties")), "section_ref_path": F.array(F.lit("2")), "parent_header_text": F.lit(None).cast("string"), "page_start": F.lit(1), "page_end": F.lit(1), "ingested_at": F.lit("2025-01-01").cast("timestamp_ntz")})
    profile = {"skip_sections": [], "domain_tags": ["privacy"], "requirement_types": ["policy"]}
    got = ingest(chunks, providers.OfflineExtractor(["shall"]), profile, enricher=providers.OfflineEnricher({"badge": "privacy"}), scorer=providers.OfflineScorer(), most_chunks=2, first_chunk=1)
    rows = got.requirements.orderBy("req_seq").collect()
    assert [r.chunk_id for r in rows] == [1, 2] and all(r.domain_tags == ["privacy"] and r.requirement_type == "policy" and r.enriched for r in rows)
    assert len({(r.document_id, r.req_seq) for r in rows}) == 2

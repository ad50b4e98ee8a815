import itertools
import random
from datetime import datetime

from pyspark.sql import functions as F

from clausewright.operators import evaluation as E
from clausewright.operators import gate as G
from clausewright.operators import requirements as Q
from clausewright.operators import retrieval as R
from clausewright.operators import runs as U
from clausewright.operators import sections as S
from clausewright.operators import services as V
from clausewright.operators import stems as M


def flag(spark, column, **v):
    return spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(column).first()[0]


def test_ancestry_is_the_heading_stack(spark):
    r = random.Random(4)
    rows, want = [], {}
    for doc in "ab":
        stack = []
        for i in range(60):
            if r.random() < 0.5:
                d = r.randint(1, 4)
                h = ".".join(str(r.randint(1, 9)) for _ in range(d)) + " T"
                while stack and stack[-1][0] >= d:
                    stack.pop()
                want[doc, i] = [x[1] for x in stack]
                stack.append((d, h))
            else:
                h = None
                want[doc, i] = [x[1] for x in stack]
            rows.append((doc, i, h))
    got = S.ancestry(spark.createDataFrame(rows, "document_id string, item_seq int, heading string")).collect()
    assert {(x.document_id, x.item_seq): x.section_title_path for x in got} == want


def test_rules(spark):
    q = F.col("q")
    assert flag(spark, Q.is_fragment(q), q="The office will: ")
    assert not flag(spark, Q.is_fragment(q), q="12 characters: no exceptions.")
    assert flag(spark, Q.is_citation_only(q), q="Term, as defined in CNSSI 4009.")
    assert not flag(spark, Q.is_citation_only(q), q="Term, as defined in CNSSI 4009, requires care.")
    assert not flag(spark, Q.is_citation_only(q), q="(3) Restrain competition.")
    assert flag(spark, Q.is_dangling(q), q="Is\nresponsible for x")
    assert not flag(spark, Q.is_dangling(q), q="Are logs reviewed at least weekly?")


def test_dedup_fold_keeps_two(spark):
    rows = [(1, "d", "r", "quote one", "same", 0.5), (2, "d", "r", "quote two", "same", 0.9), (3, "d", "r", "quote one", "", 0.7)]
    df = spark.createDataFrame(rows, "req_seq long, document_id string, source_ref string, source_quote string, description string, confidence double")
    assert sorted(x.seq for x in Q.fold_duplicates(df).collect()) == [2, 3]
    assert Q.deduplicated(df.unionByName(df)).count() == 2


def test_stems(spark):
    q = F.col("q")
    assert flag(spark, M.stem_of(q), q="This defines: The rest") == "This defines:"
    assert flag(spark, M.stem_of(q), q="(1) Implement x;") is None
    assert flag(spark, M.stem_of(q), q="see https://a.b") == "see https://a.b"
    reqs = spark.createDataFrame([(1, "d", 1, "The office shall:"), (2, "d", 1, "(a) Do x."), (3, "d", 2, "(b) Do y."), (4, "d", 2, "(a) Do z.")], "req_seq long, document_id string, chunk_id int, source_quote string")
    chunks = spark.createDataFrame([("d", 1, "The office shall:\n(a) Do x.", None), ("d", 2, "(b) Do y.", "H")], "document_id string, chunk_id int, text string, parent_header_text string")
    got = {x.req_seq: x.parent_stem for x in M.with_stems(reqs, chunks).collect()}
    assert got == {1: None, 2: "The office shall:", 3: "The office shall:", 4: None}


def test_gate(spark):
    g = lambda q, d: flag(spark, G.fabricated(F.col("q"), F.col("d")), q=q, d=d)
    assert g("systems configured to ensure availability", "Ensure availability.")
    assert not g("The ISSO maintains access logs.", "Maintain access logs.")
    assert not g(None, "Implement X.")
    assert not g("a duty to enforce rules", "Enforce rules.")


def test_current_runs(spark):
    t = lambda h: datetime(2025, 1, 1, h)
    rows = [("a", "r1", "normalized", t(1)), ("a", "r2", "normalized", t(5)), ("a", "r2", "gated", t(4)), ("b", "r1", "normalized", t(1)), ("b", "r1", "enriched", t(1))]
    got = U.current_runs(spark.createDataFrame(rows, "doc_key string, run_dir string, tier string, mtime timestamp_ntz")).collect()
    assert {(x.doc_key, x.run_dir, x.tier) for x in got} == {("a", "r2", "normalized"), ("b", "r1", "enriched")}


def test_fusion_and_metrics(spark):
    leg = lambda *k: spark.createDataFrame([(0, i, 1.0 - n / 10) for n, i in enumerate(k)], "query_id int, id long, score double")
    got = R.fused([leg(1, 2), leg(2, 3)], 3, "id").orderBy("rank").collect()
    assert [(x.id, x.score) for x in got] == [(2, round(1 / 3 + 1 / 2, 9)), (1, 0.5), (3, round(1 / 3, 9))]
    ranked = spark.createDataFrame([(0, 9, 1), (0, 1, 2), (0, 8, 3)], "query_id int, id long, rank int")
    rel = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4)] + [(1, 5)], "query_id int, id long")
    m = {x.query_id: (x.recall_5, x.mrr) for x in E.retrieval_metrics(ranked, rel, "id").collect()}
    assert m == {0: (0.25, 0.5), 1: (0.0, 0.0)}


def test_sweep(spark):
    s = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.1), (False, 0.8)], "faithful boolean, score double")
    assert tuple(E.threshold_sweep(s, [0.5]).first())[1:] == (0.5, 0.5)
    assert E.threshold_sweep(s.where("faithful"), [0.5]).first().catch_rate is None


def test_assignment():
    r = random.Random(2)
    for _ in range(60):
        n, m = r.randint(1, 4), r.randint(4, 5)
        c = [[r.random() for _ in range(m)] for _ in range(n)]
        got = E.assignment(c)
        assert abs(sum(c[i][j] for i, j in enumerate(got)) - min(sum(c[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))) < 1e-9


def test_evidence_keys(spark):
    rows = [(1, 1, "(a)", ["SECTION-3", "3.4"], None, 0.5), (2, 2, "(f)", None, None, 0.5), (3, 3, "(f)", None, None, 0.6), (4, 4, "", None, None, None)]
    h = spark.createDataFrame(rows, "req_seq long, rank int, source_ref string, section_ref_path array<string>, parent_section_ref string, confidence double")
    got = {x.representative: (x.group_key, x.label) for x in V.evidence_groups(h).collect()}
    assert got == {1: ("3.4(a)", "3.4(a)"), 2: ("__bare_fragment__2", "(f)"), 3: ("__bare_fragment__3", "(f)"), 4: ("__no_ref__4", "(no ref)")}

import itertools
import random
import uuid

import pytest
from pyspark.sql import functions as F

from clausewright.functions import fuzzy, ids, model_json
from clausewright.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "given,want",
    [("1.2.3 Glossary", "glossary"), ("4. References", "references"), ("A. Acronyms", "acronyms"), ("Table  of   Contents", "table of contents"), ("Annex B: Abbreviations", "abbreviations"), (" X y ", "x y")],
)
def test_heading(spark, given, want):
    assert one(spark, T.normalize_heading(F.col("x")), x=given) == want


@pytest.mark.parametrize("given,depth,ref", [("3.1.4 Requirements", 3, "3.1.4"), ("A4.2. Annex", 2, "A4.2"), ("ENCLOSURE 3: x", 1, "ENCLOSURE-3"), ("Authority", 1, ""), ("1. Intro", 1, "1")])
def test_depth_and_ref(spark, given, depth, ref):
    assert one(spark, T.heading_depth(F.col("x")), x=given) == depth
    assert one(spark, T.section_ref(F.col("x")), x=given) == ref


def test_source_refs(spark):
    assert one(spark, T.scan_source_refs(F.col("x")), x="see AC-3(4) and 10.0.0.1, Section 5.2, para 3, 4.2.1, AC-3(4)") == ["4.2.1", "AC-3(4)", "Section 5.2", "para 3"]


def test_text_helpers(spark):
    assert one(spark, T.csv_safe(F.col("x")), x="  =1+1") == "'  =1+1"
    assert one(spark, T.context_window(F.col("x"), F.col("q"), 3), x="aaaaabbbccccc", q="bbb") == "...aaabbbccc..."
    assert one(spark, T.context_window(F.col("x"), F.col("q")), x="short", q="none") == "short"
    assert one(spark, T.first_real_colon(F.col("x")), x="https://a b: c") == 12
    assert one(spark, T.page_refs(F.col("a"), F.col("b")), a=3, b=5) == [3, 4, 5]
    assert one(spark, T.page_refs(F.col("a"), F.col("b")), a=3, b=1) == [3]
    assert one(spark, T.ligatures_repaired(F.col("x")), x="negoated") == "negotiated"


def test_ids(spark):
    ns = uuid.UUID(ids.URL_NAMESPACE)
    for name in ("d:1", "é:22", ""):
        assert one(spark, ids.uuid5(F.col("x")), x=name) == str(uuid.uuid5(ns, name))
    sid = lambda q: one(spark, ids.stable_id(*(F.col(c) for c in "dryctz")), d="D", r="r", y=q, c=1, t="t", z="")
    assert sid("a") == sid(" A ") != sid("b") and sid("a").startswith("REQ-")


def test_ratios():
    def lcs(a, b):
        best = 0
        for n in range(len(a), 0, -1):
            if any(all(c in it for c in s) for s in itertools.combinations(a, n) for it in [iter(b)]):
                return n
        return best

    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in "ab")
        assert fuzzy.lcs_length(a, b) == lcs(a, b)
        s, t = sorted((a, b), key=len)
        if not s:
            continue
        m, n = len(s), len(t)
        want = max((fuzzy.indel_ratio(s, t[max(0, i) : min(n, i + m)]) for i in range(1 - m, n)), default=100.0 if not t else 0.0)
        assert abs(fuzzy.partial_ratio(a, b) - want) < 1e-9
    assert fuzzy.token_sort_ratio("b a", "a  b") == 100.0
    assert fuzzy.partial_ratio("", "x") == 0.0 and fuzzy.partial_ratio("", "") == 100.0


@pytest.mark.parametrize(
    "raw,n,cut",
    [('[{"a": 1}, {"a": "inc', 1, True), ('```json\n[{"a": 1}]\n```', 1, False), ('Here: [{"a": "]"}] done', 1, False), ('{"requirements": [{}, {}]}', 2, False), ("prose", None, False), (None, None, False), ("[", None, False)],
)
def test_json(raw, n, cut):
    items, recovered = model_json.recover_json_array(raw)
    assert (None if items is None else len(items), recovered) == (n, cut)

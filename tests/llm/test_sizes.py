"""Packing and mixing: every constraint, nothing lost, shares kept."""

import numpy as np
import pytest

from clausewright.llm import mixing, packing
from clausewright.llm.sizes import token_sizes


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    r = np.random.default_rng(2)
    sizes = r.integers(1, 400, 500)
    c = packing.best_fit(sizes, 1000, 6, 500_000.0, rule)
    assert np.bincount(c, sizes).max() <= 1000 and np.bincount(c).max() <= 6
    assert np.bincount(c, np.minimum(sizes.astype(float) ** 2, 5e5)).max() <= 500_000
    assert len(packing.best_fit(np.array([], int), 10, 5, 1e9)) == 0


def sizes_of(spark, rows, columns="row_key long, text_key string, n_tokens long, source string"):
    return spark.createDataFrame(rows, columns)


def test_packing(spark):
    r = np.random.default_rng(3)
    rows = [(i, str(i), int(n), "s") for i, n in enumerate(r.integers(0, 300, 2000))] + [(5000, "x", 2500, "s"), (5001, "y", 1000, None)]
    out = packing.packed(sizes_of(spark, rows), 1000, block=300).toPandas()
    assert out.groupby("container").n_tokens.sum().max() <= 1000
    assert out.groupby("row_key").n_tokens.sum().to_dict() == {i: n for i, _, n, _ in rows if n}
    assert not out.duplicated(["row_key", "piece_no"]).any()
    assert list(out[out.row_key == 5000].sort_values("piece_no").n_tokens) == [1000, 1000, 500]
    assert (out[~out.row_key.isin([5000])].groupby("row_key").size() == 1).all()
    assert out.n_tokens.sum() / (out.container.nunique() * 1000) > 0.97
    assert packing.packed(sizes_of(spark, rows).limit(0), 1000).count() == 0


def test_every_capacity_binds(spark):
    """With production parameters both the number of texts and the attention cost stop
    containers that tokens alone would fill further."""
    r = np.random.default_rng(6)
    rows = [(i, str(i), int(n), "s") for i, n in enumerate([*r.integers(1, 5, 6000), *r.integers(850, 870, 60), *r.integers(60, 100, 300)])]
    for rule in ("norm", "dot"):
        x = packing.report(packing.packed(sizes_of(spark, rows), 1000, rule=rule), 1000).first()
        assert x.most_items == packing.MOST_ITEMS and x.full_of_items > 10 and x.full_of_cost > 10
        assert x.containers >= max(x.least_by_tokens, x.least_by_items, x.least_by_cost) and x.containers < 1.4 * max(x.least_by_tokens, x.least_by_items, x.least_by_cost)


def test_pivotal_keeps_mass_and_expectation():
    r = np.random.default_rng(4)
    size, p = r.integers(1, 50, 40).astype(float), np.full(40, 0.3)
    total = np.zeros(40)
    for seed in range(400):
        q = mixing.pivotal(p, size, seed)
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1
        total += q
    assert abs(total / 400 - 0.3).max() < 0.12


def test_mixing(spark):
    r = np.random.default_rng(5)
    src = ["a"] * 900 + ["b"] * 300 + ["c"] * 40 + [None] * 5 + ["zz"] * 5
    rows = [(i, f"t{i}", int(n), s) for i, (s, n) in enumerate(zip(src, r.integers(1, 200, len(src))))]
    rows += [(9000, "t1", rows[1][2], "b"), (9001, "e", 0, "a")]
    targets = spark.createDataFrame([("a", 0.5, 1, 1), ("b", 0.3, 2, 1), ("c", 0.2, 4, 1), ("none", 0.0, 3, 1)], "source string, target_share double, max_repeats int, n_tokens int")
    mix = mixing.mixed(sizes_of(spark, rows), targets, block=100, fan_in=3)
    pdf = mix.toPandas()
    assert not pdf.doc_id.duplicated().any() and set(pdf.source) == {"a", "b", "c"} and not {9000, 9001} & set(pdf.doc_id)
    assert (pdf.groupby("source").copies.max() <= [1, 2, 4]).all()
    for x in mixing.shares(mix, targets).collect():
        assert abs(x.actual_share - x.target_share) < 0.002
    assert mixing.mixed(sizes_of(spark, rows).limit(0), targets).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Some words here.", "s", 0), (2, None, None, 0), (3, "", "s", 0), (None, "x", "s", 0), (4, "ü " * 30000, "s", 0)], "doc_id long, text string, source string, row_key int")
    got = {r.row_key: r.n_tokens for r in token_sizes(df, "doc_id", "text", "source").collect()}
    assert got[1] >= 3 and got[2] == got[3] == 0 and got[4] >= 30000 and len(got) == 4

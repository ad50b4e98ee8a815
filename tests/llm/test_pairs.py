"""Copies and near copies against brute force, with every awkward row."""

import random
import re

import pytest

from clausewright.llm import format_duplicates as D
from clausewright.llm import near_duplicates as N

SCHEMA = "req_seq long, source_quote string, source_ref string, description string, seq string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [
    (1, "The Owner shall keep logs.", "1.2", None),
    (2, "  the owner, shall KEEP\nlogs ", "1.2.", "d"),
    (3, "The owner shall keep logs", "§ 1.2", None),
    (4, "The owner shall keep 3.5 logs", None, None),
    (5, "The owner shall keep 35 logs", "", None),
    (6, "the owner shall keep 3.5 logs!", "", None),
    (7, "Control: A b | Owner: C | Interval: 3 days | Remark: x", "A-1; B-2(3)", None),
    (8, "remark = X / owner = c / control = a B / interval = 3 DAYS", "b-2(3), a-1", None),
    (9, "logs keep shall owner the", "1.2", None),
    (10, None, "1.2", None),
    (11, "", "1.2", None),
    (12, " -- ", None, None),
    (None, "The owner shall keep logs.", "1.2", None),
    (1, "The Owner shall keep logs.", "1.2", None),
    (13, "word " * 20000, None, None),
    (14, "WORD" * 20000, "", None),
]


@pytest.mark.parametrize("limits", [{}, {"fits": 1, "first_bytes": 1}, {"fits": 2, "first_bytes": 2}])
def test_copies(spark, limits):
    got = {(r.keep_seq, r.copy_seq) for r in D.found(frame(spark, ROWS), **limits).collect()}
    assert got == {(1, 2), (1, 3), (4, 6), (7, 8), (13, 14)}


def test_copy_counts_and_clashing_names(spark):
    df = frame(spark, ROWS).withColumnRenamed("bucket", "n_copies")
    out = D.collapsed(df)
    assert {r.req_seq: r.n_copies_ for r in out.where("n_copies_ > 1").collect()} == {1: 3, 4: 2, 7: 2, 13: 2}
    assert D.found(df.limit(0)).count() == 0 and D.collapsed(df.limit(0)).count() == 0


def test_one_value_holds_most_rows(spark):
    rows = [(i, "same text, always" if i % 3 else f"text number {i}", None, None) for i in range(600)]
    got = D.found(frame(spark, rows), fits=50, first_bytes=2).collect()
    assert len(got) == 399 and {r.keep_seq for r in got} == {1}


def brute(rows, least):
    words = lambda x: frozenset(re.findall(r"[^\W_]+", (x or "").lower()))
    rows = [(s, words(q), words(d), (re.sub(r"[\W_]+", "", q.lower()), re.sub(r"\W+", "", (r or "").lower()))) for s, q, r, d in {x for x in rows if x[0] is not None and x[1]}]
    out = set()
    for i, (s, a, da, k) in enumerate(rows):
        for t, b, db, m in rows[:i]:
            if len(a) >= least and len(b) >= least and k != m and 5 * len(a & b) >= 4 * len(a | b) and (not da or not db or 2 * len(da & db) >= len(da | db)):
                out.add((min(s, t), max(s, t)))
    return out


@pytest.mark.parametrize("fits", [4000, 8, 2])
def test_near_copies(spark, fits):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    rows, n = [(None, "x " * 30, None, None), (5000, None, None, None), (5001, "", "", "")], 0
    for _ in range(40):
        base = r.sample(vocab, r.randint(10, 20))
        for _ in range(r.randint(1, 5)):
            w = base[:]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            r.shuffle(w)
            rows.append((n, " ".join(w), r.choice([None, "1", "2"]), r.choice([None, "", "a b c", "a b d", "x y"])))
            n += 1
    rows += [(n + i, rows[5][1], "9", None) for i in range(6)] + [rows[5]]
    got = [(x.seq_a, x.seq_b) for x in N.found(frame(spark, rows), least_words=8, fits=fits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 8)


def test_links_of_documents_are_the_pairs_of_records(spark):
    """The counts of the class form equal those of the expanded pairs, with copies,
    sets of few words and a unit that holds a third of all rows."""
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(r.sample(vocab, r.randint(1, 9))), r.choice([None, "1", "2"]), r.choice([None, "a b", "x y"])) for i in range(150)]
    rows += [(1000 + i, "w1 w2 w3 w4 w5 w6", "7", None) for i in range(75)] + [rows[3]]
    want: dict[int, int] = {}
    for a, b in brute(rows, 1):
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    for fits in (4000, 5):
        got = N.document_links(frame(spark, rows), fits=fits).collect()
        assert {x.seq: x.n_links for x in got} == want and len(got) == len(want)
        sets = {s: frozenset((q or "").split()) for s, q, _, _ in rows}
        assert all((sets[x.seq] == sets[y.seq]) == (x.class_id == y.class_id) for x in got for y in got)


def test_labels_are_learnt(spark):
    """Words before a sign in rows with three such; neither a rare one nor a note."""
    rows = [(i, f"Größe: {i} | Ort = x | Rang – {i % 3} | Tag: y", None, None) for i in range(60)] + [(100 + i, "Note: a text. Low- and high-impact", None, None) for i in range(60)] + [(300, "Odd: 1 | Ort: 2 | Rang: 3", None, None), (301, "rang: 3 / ort: 2 / odd: 1", None, None)]
    assert D.field_labels(frame(spark, rows), share=0.02) == ("größe", "ort", "rang", "tag")
    assert {(r.keep_seq, r.copy_seq) for r in D.found(frame(spark, [(1001, rows[0][1], None, None), (1002, "RANG: 0; TAG - Y; GRÖßE: 0; ORT: X", None, None), *rows[1:]])).collect()} >= {(1001, 1002)}


def test_near_copies_of_nothing(spark):
    assert N.found(frame(spark, ROWS).limit(0)).count() == 0

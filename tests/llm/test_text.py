"""Scan noise, look-alikes, splitting, truncation and personal data on small texts."""

import random

import pytest

from clausewright.llm import lookalikes as K
from clausewright.llm import personal_data as P
from clausewright.llm import pii_labels, scan_noise, splitting, truncation

WORDS = {"required": 900, "paragraph": 800, "depot": 500, "the": 9000, "supervisor": 400, "fleet": 300, "officer": 300, "in": 3000, "of": 4000, "single": 40, "dual": 40, "key": 60, "moderate": 90, "impact": 90, "modern": 30, "shall": 900}


@pytest.fixture(scope="module")
def model():
    return scan_noise.Model(WORDS, {("the", "depot"): 300})


#: Heads of one publication: its title in either case, codes, and numbers that stand alone.
HEADS = scan_noise.Furniture(("Protection of Ledger Assets", "PROTECTION OF LEDGER ASSETS", "=PTG #.#", "ENCLOSURE #"))


@pytest.mark.parametrize(
    "text,clean,kinds",
    [
        ("the re-\nquired depot", "the required depot", {"broken_word"}),
        ("the re- quired depot", "the required depot", {"broken_word"}),
        ("the super¬\nvisor", "the supervisor", {"broken_word"}),
        ("for single- or dual-key", "for single- or dual-key", set()),
        ("the moderate-\nimpact depot", "the moderate- impact depot", set()),
        ("the requirecl dep0t", "the required depot", {"wrong_char"}),
        ("THE DEP0T", "THE DEPOT", {"wrong_char"}),
        ("the rquired depto", "the rquired depto", set()),
        ("the depot\nPage 3 of 9\nof the fleet", "the depot of the fleet", {"page_furniture"}),
        ("the depot PROTECTION OF LEDGER ASSETS of", "the depot of", {"page_furniture"}),
        ("the super-\n- 12 -\nPTG 7513.35, 2006-07-10\nvisor", "the supervisor", {"page_furniture", "broken_word"}),
        ("the depot\n12\nof the fleet", "the depot 12 of the fleet", set()),
        ("the depot\n8\nof the fleet", "the depot of the fleet", {"page_furniture"}),
        ("the depot\n12\n\nENCLOSURE 4\nof the fleet", "the depot of the fleet", {"page_furniture"}),
        ("the depot Change 2, PTG 7513.35 of the fleet", "the depot of the fleet", {"page_furniture"}),
        ("the dépot", "the dépot", set()),
        ("the\ndepot", "the depot", set()),
        ("the depot shall:\n(a) the fleet\n(b) the officer", "the depot shall:\n(a) the fleet\n(b) the officer", set()),
        ("see https://x.example/dep0t", "see https://x.example/dep0t", set()),
        ("the modern officer", "the modern officer", set()),
        (" ", " ", set()),
    ],
)
def test_repair(model, text, clean, kinds):
    out, got = model.repair(text, HEADS, 7, 8)
    assert set(got) == kinds and out.strip() == clean.strip()


def test_pairs_decide_whether_a_word_is_misread():
    """One misreading from a rare word a value stays as it is read, and is wrong only
    after the word that always stands before the other."""
    m = scan_noise.Model({"the": 900000, "of": 900000, "at": 400, "bad": 6}, {("at", "bad"): 6})
    assert m.repair("the had of the")[1] == () and m.repair("at had of the") == ("at bad of the", ("wrong_char",))


@pytest.mark.parametrize("seen,true", [("8a8y", "baby"), ("he1icopter" * 5, "helicopter" * 5), ("clepartmeut", "department")])
def test_all_misreadings_are_searched(seen, true):
    """Two of the rarer kinds, a word of 50 letters, and two in a word seen three times."""
    m = scan_noise.Model({"the": 60000000, "baby": 5000, "helicopter" * 5: 40, "department": 10000000, "clepartmeut": 3}, {})
    assert m.repair(f"the {seen} the") == (f"the {true} the", ("wrong_char",))


def test_accented_words_are_repaired():
    m = scan_noise.Model({"the": 900000, "pêcheron": 4000, "señal": 3000}, {})
    assert m.repair("the pêchcron seña1") == ("the pêcheron señal", ("wrong_char",))


def test_heads_are_known_by_repetition(spark):
    """What repeats on the pages of one publication is its head; a line or a number that
    stands on one page only is text, and so is a repeated line that ends a sentence."""
    body = "the depot of the fleet shall\n{}\nkeep the key of {}"
    rows = [(i, "a.pdf", i, 90 + i, body.format(h, i)) for i, h in enumerate(["Ledger of Fleet Keys", "Ledger of Fleet Keys", "Depot Rules Apply", "17", "Part 7/B", "Part 8/B", "The officer signs."])]
    rows += [(20 + i, f"{c}_x.pdf", i, 5, body.format("Part 9/B", i)) for i, c in enumerate("bbcd")]
    rows += [(30 + i, "e.pdf", i, None, body.format(n, i)) for i, n in enumerate(["3", "4"])] + [(40, "f.pdf", 1, None, body.format("Own Long Title", 1)), (41, None, 1, None, body.format("Own Long Title", 1)), (42, "a.pdf", 9, 9, body.format("The officer signs.", 2))]
    chunks = spark.createDataFrame(rows, "chunk_seq long, source_pdf string, chunk_id int, page_start int, text string").selectExpr("*", "coalesce(source_pdf, 'f.pdf') document_id", "page_start page_end", "cast(null as string) parent_context")
    reqs = spark.createDataFrame([], "req_seq long, source_quote string")
    manifest = spark.createDataFrame([("F.pdf", "Own Long Title", None), (None, "No File Has It", "X 1"), ("a.pdf", None, None)], "source_pdf string, title string, doc_key string")
    got = {r.row_seq for r in scan_noise.found(chunks, reqs, manifest).where("noise_kind = 'page_furniture'").collect()}
    assert got == {0, 1, 4, 5, 20, 21, 22, 23, 30, 31, 40, 41}


def test_repair_over_tables(spark):
    chunks = spark.createDataFrame([(1, "the depot " * 30, None, 0), (2, None, "", 0), (3, "the dep0t " + "x" * 60000, "the depot", 0), (None, "the dep0t", None, 0), (3, "the dep0t " + "x" * 60000, "the depot", 0)], "chunk_seq long, text string, parent_context string, value int")
    reqs = spark.createDataFrame([(1, "the depot " * 40)], "req_seq long, source_quote string")
    manifest = spark.createDataFrame([(None,), ("A b c d",)], "title string")
    got = {tuple(r) for r in scan_noise.found(chunks, reqs, manifest).collect()}
    assert got == {("text", 3, "wrong_char")}
    assert scan_noise.found(chunks.limit(0), reqs.limit(0), manifest).count() == 0


def test_copies_do_not_outvote_the_channel(spark):
    """A misread value that is a third of all rows is found in each of its copies."""
    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    right = [(i, f"the {n} modern officer {i}") for i, n in enumerate(names)]
    reqs = spark.createDataFrame([*right, *((1000 + i, "the modem officer stays here") for i in range(50)), *((2000 + i, "an offieer") for i in range(50))], "req_seq long, source_quote string")
    chunks = spark.createDataFrame([], "chunk_seq long, text string, parent_context string")
    got = {tuple(r) for r in scan_noise.found(chunks, reqs, spark.createDataFrame([("A b c d",)], "title string")).collect()}
    assert got == {("source_quote", i, "wrong_char") for i in [*range(1000, 1050), *range(2000, 2050)]}


@pytest.mark.parametrize(
    "text,want",
    [
        ("ｔｈｅ dеpot", "the depot"), ("𝐭𝐡𝐞", "the"), ("oﬃcer", "officer"), ("de​pot of", "depot of"), ("Pêcheron", "Pêcheron"), ("Pêcheron ß", "Pêcheron ß"),
        ("Вестрал Φωλέψις", "Вестрал Φωλέψις"), ("• 5 ¬ ™ ½ …", "• 5 ¬ ™ ½ …"), ("negoated", "negoated"), ("plain", "plain"), ("", ""), ("５１.2", "51.2"), ("Тhe", "The"),
    ],
)
def test_one_form(text, want):
    assert K.consistent(text, K.Automaton(WORDS), {}) == want


def test_automaton_weighs_edits():
    exact, loose = K.Automaton({"depot": 5, "depth": 9}), K.Automaton({"depot": 5, "depth": 9, "señal": 2}, budget=1.0)
    assert exact.spelling("dеpоt") == "depot" and exact.spelling("depат") is None
    assert loose.spelling("dеpаt") == "depot"


def test_found_values(spark):
    chunks = spark.createDataFrame([(1, "dеpot"), (2, None), (3, ""), (4, "Élorine"), (1, "dеpot")], "chunk_seq long, text string")
    reqs = spark.createDataFrame([(7, "a​b" + "y" * 50000, 1)], "req_seq long, source_quote string, value int")
    assert {tuple(r) for r in K.found(chunks, reqs).collect()} == {("text", 1), ("source_quote", 7)}
    assert K.found(chunks.limit(0), reqs.limit(0)).count() == 0


def test_split_round_trip():
    r = random.Random(5)
    for _ in range(80):
        text = "".join(r.choice(["word ", "x", ". ", "\n", "\n\n", "(a) ", "é"]) for _ in range(r.randint(0, 900)))
        limit, overlap = r.randint(20, 200), r.randint(0, 19)
        got = splitting.split_text(text, limit, overlap)
        assert all(len(p) <= limit for _, p in got) or len(text) <= limit
        assert "".join(p if i == 0 else p[min(overlap, s) :] for i, (s, p) in enumerate(got)) == text
        assert all(p[:overlap] == text[max(0, s - overlap) : s] for s, p in got[1:] if s >= overlap)
    with pytest.raises(ValueError):
        splitting.split_text("abc", 2, 2)


def test_split_prefers_strong_boundaries():
    text = "a" * 60 + ". B" + "b" * 20 + "\n\n" + "c" * 70
    assert splitting.cut_points(text, 100, 0) == [text.index("c")]


def test_pieces(spark):
    rows = [(1, "x" * 50, 1, 4, ["1"], 0), (2, "short", 1, 1, None, 0), (3, None, None, None, None, 0), (4, "y y" * 20, 5, 3, [], 0), (5, "z" * 40, None, 2, ["2"], 0), (1, "x" * 50, 1, 4, ["1"], 0)]
    df = spark.createDataFrame(rows, "chunk_seq long, text string, page_start int, page_end int, section_ref_path array<string>, piece int")
    lim = spark.createDataFrame([("chunk_text", 30, 5), ("pack_small", 9, None)], "item_kind string, max_size long, overlap long")
    assert sorted(r.chunk_seq for r in splitting.found(df, lim).collect()) == [1, 4, 5]
    pages = {r.row_key: set() for r in []}
    for r in splitting.pieces(df.dropDuplicates(["chunk_seq"]), 30, 5).collect():
        pages.setdefault(r.row_key, []).append(r.page)
    assert pages[1] == sorted(pages[1]) and pages[1][0] == 1 and max(pages[1]) <= 4 and set(pages[4]) == {5} and set(pages[5]) == {None}
    assert splitting.found(df.limit(0), lim).count() == 0


def test_truncation(spark):
    full = [f"The owner of depot {c} shall keep the logs in accordance with paragraph 3.5 of Reference (a)." for c in "abcdefghijklmnopqrstuvwxyz"] * 8
    others = spark.createDataFrame([(q,) for q in full], "source_quote string")
    rows = [
        (1, "k", "The owner of depot x shall keep the logs in accordance with", 10, False), (2, "k", full[0], 17, False), (3, "k", "The owner shall keep the lo...", 6, None), (4, "k", "Clerk records", 2, False),
        (5, None, None, None, None), (6, "k", "", 0, False), (7, "k", "The owner of depot x shall:", 6, True), (8, "k", "The owner of depot x shall keep the logs in accor", 10, None), (9, "k", "The clerk said so", 9, False), (9, "k", "The clerk said so", 9, False),
        (10, "k", "The logs in accordance with paragraph 3.5 of Reference (a)", 11, False),
    ]
    f = spark.createDataFrame([(*r, 1) for r in rows], "failure_seq long, doc_key string, quote string, word_count int, ends_colon boolean, cut int")
    assert sorted(r.failure_seq for r in truncation.found(f, others).collect()) == [1, 3, 8]
    share = {r.doc_key: (r.n_rows, r.n_cut) for r in truncation.share_by_source(f, others).collect()}
    assert share == {"k": (10, 3), None: (1, 0)}
    assert {r.failure_seq: r.level for r in truncation.scored(f, others).where("cut").collect()} == {1: "trigram", 3: "trigram", 8: "trigram"}
    assert truncation.found(f.limit(0), others.limit(0)).count() == 0


def test_only_the_quotes_tell_a_cut(spark):
    """Stored counts and flags change nothing; a cut quote that is a third of all rows
    does not make its own end usual; a link and a usual phrase end are whole."""
    full = [f"The {a} of depot {b} shall keep the logs of {b} in the vault unless the {a} agrees in writing." for a in ("owner", "clerk", "guard") for b in "abcdefgh"]
    heads = [f"Ledger summary for the {a} {b}" for a in ("North", "South", "Upper") for b in ("depot", "vault", "hub")]
    others = spark.createDataFrame([(q,) for q in full], "source_quote string")
    cut, link = "The owner of depot q shall keep the lo", "See https://x.example/depot"
    rows = [(i, "k", cut) for i in range(30)] + [(100 + i, "m", q) for i, q in enumerate([*heads, link, full[0].rstrip("."), "The guard of depot zz shall keep the"])]
    schema = "failure_seq long, doc_key string, quote string, word_count int, ends_colon boolean, unrepairable_fragment boolean"
    for flags in ((900, True, True), (None, None, None), (1, False, False)):
        got = {r.failure_seq for r in truncation.found(spark.createDataFrame([(*r, *flags) for r in rows], schema), others).collect()}
        assert got == {*range(30), 100 + len(rows) - 31}


@pytest.fixture(scope="module")
def field():
    return P.trained()


def test_held_out_accuracy(field):
    rows = pii_labels.labelled(2, seed=99)
    hit = gold = got = 0
    for (_, marks), tags in zip(rows, P.Tagger(field).tag([r[0] for r in rows])):
        a, b = {(s, k) for s, _, k in marks if k in P.NAMES}, {(s, k) for s, _, k in tags}
        hit, gold, got = hit + len(a & b), gold + len(a), got + len(b)
    assert hit / gold > 0.95 and hit / got > 0.95


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np

    t, r = P.Tagger(field), np.random.default_rng(1)
    L = len(P.LABELS)
    e = r.normal(size=(7, L)).astype(np.float32) * 3
    y = t._viterbi(e, np.array([0, 3]), np.array([3, 4]), np.array([True, False]), np.array([False, True]))
    score = lambda p: t.trans[L, p[0]] + sum(e[i, k] for i, k in enumerate(p)) + sum(t.trans[i, j] for i, j in zip(p, p[1:]))
    assert tuple(y[:3]) == max(itertools.product(range(L), repeat=3), key=score)


def test_stretches_are_decoded_as_the_whole_text(field):
    """The best path of a whole text in which only tokens near a capital, digit or at
    sign can be part of a mention is the one the stretches have."""
    import numpy as np

    texts = [t for t, _ in pii_labels.labelled(1, seed=5)[:60]] + ["no mention is in here at all", "Anna", "", "word " * 300 + "call 212-555-0143 " + "word " * 40]
    t = P.Tagger(field)
    for text in texts:
        ids, _, ((a, b),) = t._read([text])
        if b > a:
            use = t._near(ids)
            e = t._emissions(ids, use)
            e[~use, 1:], e[~use, 0] = -1e6, 0
            whole = t._viterbi(e, np.array([a]), np.array([b - a]), np.array([True]), np.array([False]))
            assert (whole == t.labels(ids)).all(), text


def test_held_back_patterns():
    """A field trained without a fifth of the sentence patterns, on mentions in those."""
    kept, model = pii_labels.ROWS, None
    out = [r for i, r in enumerate(dict.fromkeys(kept)) if i % 5 == 2]
    try:
        pii_labels.ROWS = tuple(r for r in kept if r not in out)
        model = P.train(pii_labels.labelled())
        pii_labels.ROWS = tuple(out)
        rows = pii_labels.labelled(6, seed=41)
    finally:
        pii_labels.ROWS = kept
    hit = gold = got = 0
    for (_, marks), tags in zip(rows, P.Tagger(model).tag([r[0] for r in rows])):
        a, b = {(s, k) for s, _, k in marks if k in P.NAMES}, {(s, k) for s, _, k in tags}
        hit, gold, got = hit + len(a & b), gold + len(a), got + len(b)
    print("held-back patterns: recall", hit / gold, "precision", hit / got)
    assert hit / gold > 0.85 and hit / got > 0.85


def test_no_mention_is_cut_by_the_window(field):
    """An address with a domain of three parts ends the text, alone or beside others."""
    text = "all questions go to adahlescu@office.example.net."
    want = [(text.index("adah"), len(text) - 1, "email")]
    t = P.Tagger(field)
    assert t.tag([text]) == [want] and t.tag([text, "Anna Bell", text])[::2] == [want, want]


def test_redaction(spark, field):
    text = "Questions go to anna.bel@mail.example. Return the form to 12 Old Corburg Street, Port Lund."
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "plain words only", 0), (None, text, 0), (5, "Anna " * 20000, 0), (1, text, 0)], "doc_id long, text string, kinds int")
    got = {(r.doc_id, r.pii_kind, r.start_char) for r in P.found(df.where("doc_id <> 5")).collect()}
    assert got == {(1, "email", text.index("anna")), (1, "street_address", text.index("12 Old"))}
    out = {r.row_key: r.redacted for r in P.redacted(df).collect()}
    assert out[1] == "Questions go to [EMAIL]. Return the form to [STREET_ADDRESS]." and out[3] == "" and out[4] == "plain words only" and 2 not in out
    assert P.found(df.limit(0)).count() == 0

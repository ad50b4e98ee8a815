"""Why a search missed, how often, and the checks of rules, scores and prompts on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from . import requirements as Q
from . import stems as M
from .retrieval import cosine

# Categories of a miss, what is shown and its score floor, obligation words, rules that catch a subtype.
CATEGORIES = ("extraction_failure", "missing_context", "table_serialization", "embedding_miss", "ranking_miss", "over_grab", "query_filter_issue", "zero_truth_confidence_failure")
SHOWN, FLOOR = 20, 0.02
TARGET_RULES = {"colon_too_long": "unrepairable_fragment", "orphaned_list_item": "orphaned_list_item", "dangling_clause": "dangling_clause", "malformed_garbled": None}


def extraction_loss(expected: DataFrame, reqs: DataFrame, failures: DataFrame) -> DataFrame:
    """(query_id, requirement_id, confirmed) of expected quotes (query_id, requirement_id,
    doc_key, quote) whose id is gone: false where the text is there under another id,
    true where validation rejected it, null where neither is known."""
    e = expected.withColumn("_q", T.normalize_text(F.col("quote")))
    alive = reqs.select("doc_key", T.normalize_text(F.col("source_quote")).alias("_q")).distinct().withColumn("_alive", F.lit(True))
    lost = failures.select("doc_key", T.normalize_text(F.col("source_quote")).alias("_q")).distinct().withColumn("_lost", F.lit(True))
    d = e.join(alive, ["doc_key", "_q"], "left").join(lost, ["doc_key", "_q"], "left")
    return d.select("query_id", "requirement_id", F.when(F.col("_alive"), False).when(F.col("_lost"), True).alias("confirmed"))


def miss_categories(relevant: DataFrame, pool: DataFrame, plain: DataFrame, reqs: DataFrame, chunks: DataFrame, lost: DataFrame | None = None, shown: int = SHOWN, floor: float = FLOOR) -> DataFrame:
    """(query_id, requirement_id, category) of the relevant ids that were not shown, by
    the first rule that holds: gone from the corpus; a garbled table in the quote or its
    chunk; a fragment without governing clause; not in the pool; under the floor; shown
    when the question was neither rewritten nor answered hypothetically; else ranked too
    low. A gone id whose text lives on under another (``lost``, of ``extraction_loss``)
    has no category.

    ``pool`` is (query_id, requirement_id, rank, score) of one wide search without
    floor, ``plain`` that of the plain one; a row of ``reqs`` is one id."""
    known = reqs.select("requirement_id", "document_id", "chunk_id", "source_quote", (F.col("parent_stem") if "parent_stem" in reqs.columns else F.lit("")).alias("parent_stem")).withColumn("_known", F.lit(True))
    text = chunks.select("document_id", "chunk_id", F.col("text").alias("_text"))
    kept = pool.where(F.col("score") >= floor).withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= shown)
    missed = relevant.join(kept.select("query_id", "requirement_id"), ["query_id", "requirement_id"], "left_anti")
    d = missed.join(known, "requirement_id", "left").join(text, ["document_id", "chunk_id"], "left").join(pool.select("query_id", "requirement_id", "rank", "score"), ["query_id", "requirement_id"], "left")
    d = d.join(plain.where(F.col("rank") <= shown).select("query_id", "requirement_id", F.lit(True).alias("_plain")), ["query_id", "requirement_id"], "left")
    gone = F.lit("extraction_failure")
    if lost is not None:
        d = d.join(lost.withColumnRenamed("confirmed", "_confirmed"), ["query_id", "requirement_id"], "left")
        gone = F.when(F.coalesce("_confirmed", F.lit(True)), "extraction_failure")
    garbled = F.coalesce(T.garbled_table(F.col("source_quote")), F.lit(False)) | F.coalesce(T.garbled_table(F.col("_text")), F.lit(False))
    bare = (F.coalesce("parent_stem", F.lit("")) == "") & M.is_candidate(F.col("source_quote"))
    category = (
        F.when(F.col("_known").isNull(), gone).when(garbled, "table_serialization").when(bare, "missing_context").when(F.col("rank").isNull(), "embedding_miss")
        .when(F.col("score") < floor, "zero_truth_confidence_failure").when(F.coalesce("_plain", F.lit(False)) & (F.col("rank") > shown), "query_filter_issue").otherwise("ranking_miss")
    )
    return d.select("query_id", "requirement_id", category.alias("category"))


def over_grabs(pool: DataFrame, relevant: DataFrame, reqs: DataFrame, expected: DataFrame | None = None, shown: int = SHOWN, floor: float = FLOOR) -> DataFrame:
    """(query_id, requirement_id, rank): shown results that are not relevant but from the
    chunk of one that is, and those labelled so by hand (``expected``) at any rank."""
    ranked = pool.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    ids = ["query_id", "requirement_id"]
    other = ranked.join(relevant.select(*ids), ids, "left_anti").join(reqs.select("requirement_id", "document_id", "chunk_id"), "requirement_id")
    places = relevant.join(reqs.select("requirement_id", "document_id", "chunk_id"), "requirement_id").where("chunk_id is not null").select("query_id", "document_id", "chunk_id").distinct()
    near = other.where(F.col("rank") <= shown).join(places, ["query_id", "document_id", "chunk_id"], "left_semi").select(*ids, "rank")
    if expected is not None:
        near = near.unionByName(other.join(expected.select(*ids), ids, "left_semi").select(*ids, "rank")).distinct()
    return near


def prevalence(misses: DataFrame, grabs: DataFrame) -> DataFrame:
    """(category, n) over all categories, those without any as 0."""
    dim = misses.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    got = misses.where("category is not null").select("category").unionByName(grabs.select(F.lit("over_grab").alias("category"))).groupBy("category").agg(F.count("*").alias("n"))
    return dim.join(got, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def harness_totals(per_query: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row over (query_id, shape, n_relevant, returned, error, recall_*, mrr): means
    of the scored queries, how many were off topic, unscored or failed, and how much the
    off-topic ones returned."""
    ok, zero = F.col("error").isNull(), F.col("shape") == "zero"
    scored = ok & ~zero & (F.col("n_relevant") > 0)
    mean = lambda c, name: F.round(F.avg(F.when(scored, F.col(c))), 4).alias(name)
    return per_query.agg(
        *(mean(f"recall_{k}", f"mean_recall_{k}") for k in cuts), mean("mrr", "mean_mrr"), F.count_if(scored).alias("scored"), F.count_if(ok & zero).alias("zero"),
        F.round(F.avg(F.when(ok & zero, F.col("returned"))), 2).alias("zero_returned"), F.count_if(ok & ~zero & (F.col("n_relevant") == 0)).alias("unscored"), F.count_if(~ok).alias("failed"),
    )


def rejected_by(quote: Column, echo: Column | None = None) -> Column:
    """The first of the quote's own rules that rejects it, null for none."""
    never = F.lit(False)
    return F.coalesce(
        F.when(F.coalesce(echo >= 90, never) if echo is not None else never, "heading_echo"), F.when(Q.is_fragment(quote), "unrepairable_fragment"),
        F.when(Q.is_citation_only(quote), "orphaned_list_item"), F.when(Q.is_dangling(quote), "dangling_clause"),
    )


def rule_gate(labelled: DataFrame, least: dict[str, int]) -> DataFrame:
    """One row over (category, subtype, quote): real records rejected, records out of the
    rules' scope rejected, and subtypes whose own rule catches fewer than ``least``; a
    gate passes with three zeros."""
    d = labelled.withColumn("rule", rejected_by(F.coalesce("quote", F.lit(""))))
    hit = F.col("rule").isNotNull()
    real = F.count_if((F.col("category") == "REAL") & hit).alias("real_rejected")
    scope = F.count_if((F.col("category").isin("OVER_GRAB", "JUDGMENT") | ((F.col("category") != "REAL") & (F.col("subtype") == "malformed_garbled"))) & hit).alias("scope_violations")
    caught = [F.count_if((F.col("category") != "REAL") & (F.col("subtype") == s) & (F.col("rule") == TARGET_RULES[s])) < n for s, n in least.items()]
    short = sum((c.cast("int") for c in caught), F.lit(0)).alias("coverage_regressions")
    return d.agg(real, scope, short).withColumn("passed", F.col("real_rejected") + F.col("scope_violations") + F.col("coverage_regressions") == 0)


def rules_before_and_after(labelled: DataFrame, before: Column, after: Column) -> DataFrame:
    """(subtype, n, before, after, gained, lost) of two variants of a rule on labelled rows."""
    a, b = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return labelled.groupBy("subtype").agg(F.count("*").alias("n"), F.count_if(a).alias("before"), F.count_if(b).alias("after"), F.count_if(b & ~a).alias("gained"), F.count_if(a & ~b).alias("lost"))


def removed_exactly(before: DataFrame, after: DataFrame, ids: DataFrame, key: str) -> None:
    """Raises unless as many rows were removed as ids were listed."""
    gone, listed = before.count() - after.count(), ids.select(key).distinct().count()
    if gone != listed:
        raise ValueError(f"{gone} rows would be removed for {listed} listed ids")


def citation_shaped(quote: Column, description: Column, most_words: int = 20, longer: int = 2, most_alike: float = 45) -> Column:
    """A short or open quote whose description is much longer and unlike it."""
    q, d = T.stripped(quote), T.stripped(description)
    words = F.greatest(T.word_count(q), F.lit(1))
    alike = fuzzy.token_sort_ratio_udf(T.normalize_text(quote), T.normalize_text(description))
    shaped = (q.endswith(":") | (T.word_count(q) <= most_words)) & (T.word_count(d) >= longer * words)
    return F.when(shaped, alike < most_alike).otherwise(False)


def modality_shaped(quote: Column, description: Column, verbs: tuple[str, ...]) -> Column:
    """The description holds an obligation word that the quote does not."""
    held = lambda x: F.filter(F.array(*(F.when(T.normalize_text(x).rlike(rf"\b{v}\b"), v) for v in verbs)), lambda v: v.isNotNull())
    return F.size(F.array_except(held(description), held(quote))) > 0


def harvested(rows: DataFrame, verbs: tuple[str, ...], clean: int, key: str = "req_seq", run: str = "run_timestamp", fixed_after: str | None = None, seed: str = "35") -> DataFrame:
    """Rows with quote and description, one for each (file, chunk, quote, description),
    by route; of the clean ones a sample of ``clean`` in hash order, of runs after
    ``fixed_after`` if there are such."""
    d = rows.where("coalesce(source_quote, '') <> '' and coalesce(description, '') <> ''")
    group = [F.col(c) for c in ("source_pdf", "chunk_id", "source_quote", "description")]
    d = d.groupBy(*group).agg(F.min(key).alias(key), F.max(run).alias("_run"))
    q, de = F.col("source_quote"), F.col("description")
    d = d.withColumn("route", F.when(citation_shaped(q, de), "citation_fragment_shaped").when(modality_shaped(q, de, verbs), "modality_shaped").otherwise("clean"))
    late = F.coalesce(F.col("_run") >= fixed_after, F.lit(False)) if fixed_after else F.lit(False)
    pool = d.where("route = 'clean'").withColumn("_late", late).withColumn("_any", F.max("_late").over(W.partitionBy())).where("_late or not _any")
    sample = pool.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(clean)
    return d.where("route <> 'clean'").drop("_run").unionByName(sample.select(*(c for c in d.columns if c != "_run")))


def traced_labels(labels: DataFrame, reqs: DataFrame, chunks: DataFrame, key: str = "req_seq") -> DataFrame:
    """Each label (requirement_id, subtype, quote) with its chunk's text and header and
    every record extracted from that chunk; ``is_label`` tells the one it is about."""
    at = reqs.groupBy("requirement_id").agg(F.min_by(F.struct("document_id", "chunk_id"), key).alias("p")).select("requirement_id", "p.*")
    d = labels.join(at, "requirement_id").join(chunks.select("document_id", "chunk_id", F.col("text").alias("chunk_text"), "parent_header_text"), ["document_id", "chunk_id"], "left")
    c = reqs.select("document_id", "chunk_id", F.col(key).alias("candidate"), F.col("source_quote").alias("_quote"))
    same = T.stripped(F.coalesce("_quote", F.lit(""))) == T.stripped(F.coalesce("quote", F.lit("")))
    return d.join(c, ["document_id", "chunk_id"]).withColumn("is_label", same).drop("_quote")


def prompt_comparison(chunks: DataFrame, templates: dict[str, str], provider) -> DataFrame:
    """(group, document_id, chunk_id, template, n_quotes): what the provider extracts from
    known chunks (group, document_id, chunk_id, text) under each template with {text}."""
    from ..functions.model_json import recover_json_array_udf

    @F.pandas_udf("string")
    def call(prompt):  # noqa: ANN001
        return prompt.map(provider.complete)

    t = F.explode(F.array(*(F.struct(F.lit(n).alias("template"), F.lit(b).alias("body")) for n, b in templates.items())))
    d = chunks.select("group", "document_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), t.alias("t"))
    d = d.withColumn("x", recover_json_array_udf(call(F.replace(F.col("t.body"), F.lit("{text}"), F.col("text")))))
    return d.select("group", "document_id", "chunk_id", "t.template", F.coalesce(F.size("x.items"), F.lit(0)).alias("n_quotes"))


def support_errors(scored: DataFrame, threshold: float) -> DataFrame:
    """(false_negatives, bad, false_positives, good) of (faithful, score) under a threshold."""
    ok = F.col("score") >= threshold
    return scored.agg(F.count_if(~F.col("faithful") & ok).alias("false_negatives"), F.count_if(~F.col("faithful")).alias("bad"), F.count_if(F.col("faithful") & ~ok).alias("false_positives"), F.count_if("faithful").alias("good"))


def regression_checked(scored: DataFrame, threshold: float) -> DataFrame:
    """Each (key, faithful, score) with what is predicted and expected, and whether all agree."""
    d = scored.withColumn("rejected", F.col("score") < threshold).withColumn("expected", ~F.col("faithful"))
    d = d.withColumn("correct", F.col("rejected") == F.col("expected"))
    return d.withColumn("all_correct", F.min("correct").over(W.partitionBy()))


def stem_deltas(cases: DataFrame) -> DataFrame:
    """(case, bare, stemmed, delta): how much nearer the query is to a quote with its
    governing clause; vectors are given as query_vector, bare_vector and stem_vector."""
    bare, stem = (F.round(cosine(F.col("query_vector"), F.col(c)), 6) for c in ("bare_vector", "stem_vector"))
    return cases.select("case", bare.alias("bare"), stem.alias("stemmed"), F.round(stem - bare, 6).alias("delta"))


def worst_chunks(results: DataFrame, n: int = 10) -> DataFrame:
    """The chunks (stem, chunk_id, fp, fn) with the most errors, ties by name."""
    return results.orderBy((F.col("fp") + F.col("fn")).desc(), "stem", "chunk_id").limit(n)


def seeded_gold(gold: DataFrame, extracted: DataFrame, runs: DataFrame) -> DataFrame:
    """Each gold chunk (stem, chunk_id) with the quotes to correct by hand, in order, and
    the outcome: ``seeded``, ``empty_model_output`` or ``missing_file`` where the stem has
    no run (stem in ``runs``). ``extracted`` is (stem, chunk_id, seq, source_quote)."""
    quotes = extracted.groupBy("stem", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_quote"))), lambda x: x["source_quote"]).alias("quotes"))
    d = gold.join(runs.select("stem").distinct().withColumn("_run", F.lit(True)), "stem", "left").join(quotes, ["stem", "chunk_id"], "left")
    outcome = F.when(F.col("_run").isNull(), "missing_file").when(F.size(F.coalesce("quotes", F.array().cast("array<string>"))) == 0, "empty_model_output").otherwise("seeded")
    return d.withColumn("outcome", outcome).withColumn("quotes", F.when(outcome == "seeded", F.col("quotes")).otherwise(F.array().cast("array<string>"))).drop("_run")


def skip_sections_applied(skips: list[str], layout_mode: str) -> bool | None:
    """Whether skipped sections took effect; None where none are configured."""
    return layout_mode == "docling" if skips else None

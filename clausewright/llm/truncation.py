"""Quotes cut off before their end, found from where word trigrams end texts, in SQL.

Word trigrams are counted inside texts and at their ends over all different quotes. The
final trigram of a quote is joined to those counts; its last word may be a part of one,
so trigrams whose last word only begins with it count as inside. A trigram that is
frequent inside but almost never ends another text marks a cut. One that is too rare to
tell falls back on its last two words, then on the last. A quote is whole all the same
where the trigram one or two words before its end nearly always stands just there, as
in a heading or noun phrase, or where it ends in a link or a stop. A cut mark at the
end adds to the score. Nothing but the quotes is looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged

#: Fewest occurrences that tell; log odds of a cut; what a cut mark adds; share that makes an ending.
LEAST, ODDS, MARK, ENDING = 5, 2.0, 3.0, 0.8

_TOKENS = r"regexp_extract_all(regexp_replace({0}, '\\p{{N}}+', '#'), '[\\p{{L}}\\p{{M}}]+|[^\\s\\p{{L}}\\p{{M}}]', 0)"
_BARE = r"regexp_replace({0}, '(\\s|\\.\\.\\.|…|�)+$', '')"
_CORE = r"regexp_replace({0}, '[.!?]\\s*$', '')"


def _sql(text: str) -> str:
    """Braces of patterns kept apart from the named parts of a query."""
    return text.replace("{", "{{").replace("}", "}}")


#: The last words of each quote, without cut marks, white space and one final stop.
_FINALS = (
    r"""
SELECT failure_seq, doc_key, q, flagged, marked, stopped, link, element_at(t, -1) AS c, IF(size(t) > 1, xxhash64(t[size(t) - 2]), NULL) AS hb,
  IF(size(t) > 2, xxhash64(t[size(t) - 3], t[size(t) - 2]), NULL) AS ctx,
  IF(size(t) > 3, xxhash64(t[size(t) - 4], t[size(t) - 3]), NULL) AS ctx1, IF(size(t) > 3, t[size(t) - 2], NULL) AS w1,
  IF(size(t) > 4, xxhash64(t[size(t) - 5], t[size(t) - 4]), NULL) AS ctx2, IF(size(t) > 4, t[size(t) - 3], NULL) AS w2
FROM (SELECT *, bare RLIKE '[:;!?]\\s*$|(?<!\\p{{N}})[.]\\s*$' AND NOT marked AS stopped, q RLIKE '://\\S*\\s*$' AS link, """
    + _sql(_TOKENS.format(_CORE.format("bare")))
    + r""" AS t FROM (SELECT *, q RLIKE '(\\.\\.\\.|…|�)\\s*$' AS marked, """
    + _sql(_BARE.format("q"))
    + r""" AS bare FROM {src}))
WHERE size(t) > 0
"""
)

#: (ctx, hb, w): how often word w follows two words (hashed), and how often 0, 1 or 2 words before an end.
_COUNTS = (
    r"""
WITH texts AS (SELECT DISTINCT q FROM (SELECT q FROM {failures} UNION ALL SELECT q FROM {others}) WHERE q IS NOT NULL),
toks AS (SELECT """
    + _sql(_TOKENS.format(_CORE.format(_BARE.format("q"))))
    + r""" AS t FROM texts),
grams AS (
  SELECT explode(transform(sequence(1, size(t)), i -> named_struct(
    'ctx', IF(i > 2, xxhash64(t[i-3], t[i-2]), NULL), 'hb', IF(i > 1, xxhash64(t[i-2]), NULL), 'w', t[i-1], 'r', size(t) - i))) AS g
  FROM toks WHERE size(t) > 0)
SELECT g.ctx, g.hb, g.w, count(*) AS n, count_if(g.r = 0) AS r0, count_if(g.r = 1) AS r1, count_if(g.r = 2) AS r2 FROM grams GROUP BY 1, 2, 3
"""
)

#: For each final word p after a context: counts of the word inside and at ends, and of longer words that begin with it.
_LEVEL = r"""
WITH keys AS (SELECT DISTINCT {key} AS k, c FROM {finals} WHERE {key} IS NOT NULL),
words AS (SELECT {key} AS k, w, sum(n) AS n, sum(r0) AS r0 FROM {counts} WHERE {key} IS NOT NULL GROUP BY 1, 2),
parts AS (SELECT k, w, n, r0, explode(transform(sequence(1, length(w)), i -> left(w, i))) AS p FROM words LEFT SEMI JOIN (SELECT DISTINCT k FROM keys) USING (k))
SELECT parts.k, parts.p, sum(IF(w = p, n - r0, n)) AS inside, sum(IF(w = p, r0, 0L)) AS ends FROM parts JOIN keys ON parts.k = keys.k AND parts.p = keys.c GROUP BY 1, 2
"""

_SCORES = r"""
WITH s AS (
  SELECT f.*, l3.inside AS i3, l3.ends - 1 AS e3, l2.inside AS i2, l2.ends - 1 AS e2, l1.inside AS i1, l1.ends - 1 AS e1,
    coalesce(q1.n >= {least} AND q1.r1 - 1 > {ending} * (q1.n - 1), false) OR coalesce(q2.n >= {least} AND q2.r2 - 1 > {ending} * (q2.n - 1), false) AS ending
  FROM {finals} f LEFT JOIN {l3} l3 ON f.ctx = l3.k AND f.c = l3.p LEFT JOIN {l2} l2 ON f.hb = l2.k AND f.c = l2.p LEFT JOIN {l1} l1 ON f.c = l1.p
  LEFT JOIN {counts} q1 ON f.ctx1 = q1.ctx AND f.w1 = q1.w LEFT JOIN {counts} q2 ON f.ctx2 = q2.ctx AND f.w2 = q2.w),
levels AS (SELECT *, CASE WHEN i3 + e3 >= {least} THEN 'trigram' WHEN i2 + e2 >= {least} THEN 'pair' ELSE 'word' END AS level FROM s)
SELECT failure_seq, doc_key, flagged, marked, level, ending, odds, coalesce(NOT stopped AND NOT link AND NOT ending AND odds + IF(marked, {mark}, 0D) > {least_odds}, false) AS cut
FROM (SELECT *, CASE level WHEN 'trigram' THEN ln((i3 + 0.5D) / (e3 + 0.5D)) WHEN 'pair' THEN ln((i2 + 0.5D) / (e2 + 0.5D)) ELSE coalesce(ln((i1 + 0.5D) / (greatest(e1, 0) + 0.5D)), 0D) END AS odds FROM levels)
"""


def scored(failures: DataFrame, others: DataFrame) -> DataFrame:
    """Every row of ``failures`` (failure_seq, doc_key, quote) with a word in its quote:
    ``odds``, the log odds that its final words go on, by which ``level`` they were told
    (trigram, pair or word), whether they are an ``ending`` or ``marked``, and ``cut``.
    ``flagged`` is the row's stored flag for fragments, which decides nothing.

    Null and blank quotes give no row: they are never cut. Repeated quotes count once.
    """
    spark = failures.sparkSession
    flag = F.col("unrepairable_fragment") if "unrepairable_fragment" in failures.columns else F.lit(None).cast("boolean")
    f = failures.select("failure_seq", "doc_key", F.col("quote").alias("q"), flag.alias("flagged"))
    counts = staged(spark.sql(_COUNTS, failures=f.select("q"), others=others.selectExpr("source_quote AS q")), "trigrams")
    finals = staged(spark.sql(_FINALS, src=f), "finals")
    one = F.lit(0).cast("long")
    level = lambda key, x=finals, n=counts: spark.sql(_LEVEL.replace("{key}", key), finals=x, counts=n)
    l1 = level("one", finals.withColumn("one", one), counts.withColumn("one", one))
    return spark.sql(_SCORES, finals=finals, counts=counts, l3=level("ctx"), l2=level("hb"), l1=l1, least=LEAST, ending=ENDING, mark=MARK, least_odds=ODDS)


def found(failures: DataFrame, others: DataFrame) -> DataFrame:
    return scored(failures, others).where("cut and failure_seq is not null").select("failure_seq").distinct()


def share_by_source(failures: DataFrame, others: DataFrame) -> DataFrame:
    """(doc_key, n_rows, n_cut, cut_share, n_cut_flagged) of all rows; rows without
    doc_key are one source. The last is how many of the cut rows were flagged as
    fragments when audited."""
    cut = scored(failures, others).where("cut").groupBy("doc_key").agg(F.count("*").alias("n_cut"), F.count_if("flagged").alias("n_cut_flagged"))
    rows = failures.groupBy("doc_key").agg(F.count("*").alias("n_rows"))
    d = rows.join(cut, rows["doc_key"].eqNullSafe(cut["doc_key"]), "left").select(rows["doc_key"], "n_rows", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.coalesce("n_cut_flagged", F.lit(0)).alias("n_cut_flagged"))
    return d.select("doc_key", "n_rows", "n_cut", (F.col("n_cut") / F.col("n_rows")).alias("cut_share"), "n_cut_flagged")


def levels(failures: DataFrame, others: DataFrame) -> DataFrame:
    """(level, n_cut): by what the cut rows were told."""
    return scored(failures, others).where("cut").groupBy("level").agg(F.count("*").alias("n_cut"))

"""Named queries of the core operators over the test tables, and the SQL of each.

A query without SQL uses something SQL cannot say (fuzzy ratios, order-dependent folds,
assignment, tolerant JSON); those are tested against brute force in ``tests``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import ids as I
from .functions import model_json
from .functions import text as T
from .operators import audit as A
from .operators import chunks as C
from .operators import evaluation as E
from .operators import diagnosis as D
from .operators import enrichment as N
from .operators import gate as G
from .operators import indexing as X
from .operators import requirements as Q
from .operators import retrieval as R
from .operators import runs as U
from .operators import sections as S
from .operators import services as V
from .operators import stems as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SKIPS = ["GLOSSARY", "REFERENCES", "Shared", "Weekly"]
TAGS = ["access-control", "network-security", "privacy", "risk-management", "audit-and-logging"]
TYPES = ["policy", "technical-control", "procedural-control", "assessment", "guidance"]
FLOORS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reqs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sample_normalized_reqs")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sample_chunks")


# ---- SQL pieces of the comparison engine -----------------------------------------
_SP = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ς', 'σ'), '{_SP}+', ' ', 'g'))"


_HEAD = r"^(?i:(?:appendix|attachment|annex|section|chapter|part|addendum|enclosure|exhibit)\s+[\w.-]+\s*[-–—:.]?\s*|\d+(?:\.\d+)*\.?\s+|[a-z]\.\s+)"


def _heading(x: str) -> str:
    return f"trim(regexp_replace({_norm(x)}, '{_HEAD}', ''))"


def _list(values: list) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values)


_LATEST = "(SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_seq DESC) AS _n FROM sample_chunks) WHERE _n = 1)"
_DEDUP = (
    "(SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, coalesce(source_ref, ''), "
    + _norm("source_quote")
    + " ORDER BY coalesce(confidence, 0) * 1000 - length(source_quote) DESC, req_seq) AS _n FROM sample_normalized_reqs WHERE "
    + _norm("coalesce(source_quote, '')")
    + " <> '') WHERE _n = 1)"
)


def _sigma(c):
    return F.translate(c, "ς", "σ")


# ---- text and identifiers ---------------------------------------------------------
@query(f"SELECT req_seq, sha256({_norm('source_quote')}) AS quote_hash FROM sample_normalized_reqs WHERE source_quote IS NOT NULL")
def normalize_text_hash(spark, d):
    return reqs(spark, d).where("source_quote is not null").select("req_seq", F.sha2(_sigma(T.normalize_text(F.col("source_quote"))), 256).alias("quote_hash"))


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{_SP}+', ' ', 'g'))"


@query(
    f"""WITH n AS (SELECT req_seq, document_id, chunk_id, requirement_type, {_plain('source_ref')} AS r, {_plain('source_quote')} AS q, {_plain('description')} AS de FROM sample_normalized_reqs)
SELECT req_seq, 'REQ-' || substr(sha256(CASE WHEN q <> '' AND r <> '' THEN concat_ws(':', document_id, r, q) WHEN q <> '' THEN concat_ws(':', document_id, q)
ELSE concat_ws(':', document_id, coalesce(CAST(chunk_id AS VARCHAR), 'None'), coalesce(requirement_type, ''), de) END), 1, 12) AS stable_id FROM n"""
)
def stable_id_cascade(spark, d):
    return Q.fresh_ids(reqs(spark, d)).select("req_seq", "stable_id")


@query("SELECT document_id, source_ref, 'CHK-' || substr(sha256(string_agg(requirement_id, '|' ORDER BY requirement_id)), 1, 16) AS item_id FROM (SELECT DISTINCT document_id, source_ref, requirement_id FROM sample_normalized_reqs) GROUP BY ALL")
def checklist_item_id(spark, d):
    g = reqs(spark, d).groupBy("document_id", "source_ref").agg(F.collect_set("requirement_id").alias("ids"))
    return g.select("document_id", "source_ref", I.checklist_item_id(F.col("ids")).alias("item_id"))


@query(
    f"""WITH h AS (SELECT chunk_seq, sha1(unhex('{I.URL_NAMESPACE}') || encode(document_id || ':' || chunk_id)) AS h FROM sample_chunks)
SELECT chunk_seq, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h,17,1)), 1)||substr(h,18,3)||'-'||substr(h,21,12) AS point_id FROM h"""
)
def uuid5_point_id(spark, d):
    return chunks(spark, d).select("chunk_seq", I.uuid5(F.concat_ws(":", "document_id", F.col("chunk_id").cast("string"))).alias("point_id"))


_CRUMB = "CASE WHEN len(coalesce(section_title_path, [])) > 0 THEN array_to_string(section_title_path, ' > ') ELSE coalesce(parent_header_text, '') END"
_PROMPT = f"CASE WHEN {_CRUMB} <> '' THEN '[' || {_CRUMB} || ']' || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END"


@query(f"SELECT chunk_seq, {_CRUMB} AS breadcrumb, sha256({_PROMPT}) AS prompt_hash FROM sample_chunks")
def chunk_breadcrumb_text(spark, d):
    return C.prompts(chunks(spark, d)).select("chunk_seq", "breadcrumb", F.sha2("prompt", 256).alias("prompt_hash"))


@query(f"WITH p AS (SELECT chunk_seq, ingested_at, substr(sha256({_PROMPT}), 1, 16) AS h FROM sample_chunks) SELECT chunk_seq, h AS prompt_hash FROM p WHERE h NOT IN (SELECT h FROM p WHERE ingested_at < TIMESTAMP '2025-07-01')")
def prompt_hash_cache_miss(spark, d):
    """Chunks that a cache of all prompts seen before July does not hold."""
    p = C.prompts(chunks(spark, d)).select("chunk_seq", "ingested_at", I.prompt_hash(F.col("prompt")).alias("prompt_hash"))
    cache = p.where("ingested_at < timestamp_ntz'2025-07-01'").select("prompt_hash").distinct()
    return p.join(cache, "prompt_hash", "left_anti").select("chunk_seq", "prompt_hash")


_REFS = [
    r"\b[A-Z]{2,4}-\d+(?:\([a-zA-Z0-9]+\))+|\b[A-Z]{2,4}-\d+\b",
    r"\b(?i:Section|Sec\.)\s+\d+(?:\.\d+)*",
    r"\b(?i:Para(?:graph)?)\s+\d+(?:\.\d+)*",
    r"\b\d+\.\d+(?:\.\d+)+\b",
]


@query(
    "WITH f AS (SELECT chunk_seq, list_filter("
    + " || ".join(f"regexp_extract_all(text, '{p}')" for p in _REFS)
    + r""", lambda r: NOT (regexp_full_match(r, '\d+(\.\d+){3}') AND len(list_filter(string_split(r, '.'), lambda p: TRY_CAST(p AS INT) > 255)) = 0)) AS l FROM sample_chunks WHERE text IS NOT NULL),
u AS (SELECT chunk_seq, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM f), o AS (SELECT chunk_seq, r, min(i) AS i FROM u GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk_seq ORDER BY i) AS n FROM o) SELECT chunk_seq, string_agg(r, ',' ORDER BY encode(r)) AS refs FROM k WHERE n <= 20 GROUP BY chunk_seq"""
)
def source_ref_scan(spark, d):
    refs = F.array_join(T.scan_source_refs(F.col("text")), ",")
    return chunks(spark, d).where("text is not null").select("chunk_seq", refs.alias("refs")).where("refs <> ''")


@query(f"SELECT DISTINCT requirement_type, translate(lower({_strip('requirement_type')}), ' _', '--') AS value FROM sample_normalized_reqs")
def filter_value_normalize(spark, d):
    return reqs(spark, d).select("requirement_type", T.normalize_filter_value(F.col("requirement_type")).alias("value")).distinct()


_TITLES = "SELECT DISTINCT t FROM (SELECT unnest(section_title_path) AS t FROM sample_chunks UNION ALL SELECT string_split(text, chr(10))[1] FROM sample_chunks WHERE text IS NOT NULL)"


def _titles(spark, d):
    c = chunks(spark, d)
    return c.select(F.explode("section_title_path").alias("t")).unionByName(c.where("text is not null").select(F.split("text", "\n")[0].alias("t"))).distinct()


@query(f"SELECT t, {_heading('t')} AS heading FROM ({_TITLES}) WHERE t IS NOT NULL")
def heading_normalize(spark, d):
    return _titles(spark, d).where("t is not null").select("t", _sigma(T.normalize_heading(F.col("t"))).alias("heading"))


_NUM = r"^(?i:([a-z]?\d+(?:\.\d+)*))"
_KW = r"^(?i:(section|enclosure|appendix|annex|attachment)\s+(\w+))"


def _depth_ref(x: str) -> tuple[str, str]:
    t = _strip(x)
    num = f"regexp_extract({t}, '{_NUM}', 1)"
    depth = f"length({num}) - length(replace({num}, '.', '')) + 1"
    return depth, f"CASE WHEN {num} <> '' THEN {num} WHEN regexp_matches({t}, '{_KW}') THEN upper(regexp_extract({t}, '{_KW}', 1) || '-' || regexp_extract({t}, '{_KW}', 2)) ELSE '' END"


@query(f"SELECT t, {_depth_ref('t')[0]} AS depth, {_depth_ref('t')[1]} AS ref FROM ({_TITLES}) WHERE t IS NOT NULL")
def heading_depth_ref(spark, d):
    t = F.col("t")
    return _titles(spark, d).where("t is not null").select("t", T.heading_depth(t).alias("depth"), T.section_ref(t).alias("ref"))


# ---- sections and chunks ----------------------------------------------------------
_ITEMS = f"""items AS (
  SELECT document_id, chunk_id * 2 AS item_seq, section_ref_path[-1] || '. ' || section_title_path[-1] AS heading, NULL AS body FROM {_LATEST} WHERE len(section_ref_path) > 0 AND chunk_id IS NOT NULL
  UNION ALL SELECT document_id, chunk_id * 2 + 1, NULL, text FROM {_LATEST} WHERE chunk_id IS NOT NULL)"""


def _items(spark, d):
    c = C.latest_delivery(chunks(spark, d)).where("chunk_id is not null")
    heads = c.where("size(section_ref_path) > 0").select("document_id", (F.col("chunk_id") * 2).alias("item_seq"), F.concat(F.element_at("section_ref_path", -1), F.lit(". "), F.element_at("section_title_path", -1)).alias("heading"), F.lit(None).cast("string").alias("body"))
    return heads.unionByName(c.select("document_id", (F.col("chunk_id") * 2 + 1).alias("item_seq"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("body")))


#: A heading is open at an item where every heading between the two is deeper, and the
#: item, if it is a heading itself, is deeper too.
_OPEN = f"""WITH {_ITEMS}, i AS (SELECT *, {_depth_ref('heading')[0]} AS depth, {_depth_ref('heading')[1]} AS ref FROM items),
pairs AS (SELECT i.document_id, i.item_seq, i.depth AS own, h.item_seq AS pos, h.depth, {_strip('h.heading')} AS title, h.ref,
  min(h.depth) OVER (PARTITION BY i.document_id, i.item_seq ORDER BY h.item_seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS between_depth
  FROM i JOIN i h ON i.document_id = h.document_id AND h.heading IS NOT NULL AND h.item_seq < i.item_seq),
opened AS (SELECT * FROM pairs WHERE (between_depth IS NULL OR depth < between_depth) AND (own IS NULL OR depth < own)),
paths AS (SELECT document_id, item_seq, string_agg(nullif(ref, ''), '>' ORDER BY pos) AS refs, string_agg(title, '>' ORDER BY pos) AS titles, arg_max(title, pos) AS parent_header_text, max(pos) AS parent_seq FROM opened GROUP BY ALL)"""


@query(f"{_OPEN} SELECT document_id, item_seq, coalesce(refs, '') AS refs, coalesce(titles, '') AS titles, parent_header_text FROM i LEFT JOIN paths USING (document_id, item_seq)")
def section_ancestry(spark, d):
    a = S.ancestry(_items(spark, d))
    return a.select("document_id", "item_seq", F.array_join("section_ref_path", ">").alias("refs"), F.array_join("section_title_path", ">").alias("titles"), "parent_header_text")


@query(
    f"""{_OPEN}, under AS (SELECT p.document_id, p.parent_seq, p.item_seq, {_strip('i.body')} AS body FROM paths p JOIN i USING (document_id, item_seq) WHERE i.heading IS NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY document_id, parent_seq ORDER BY item_seq) AS n FROM under WHERE coalesce(body, '') <> ''),
bodies AS (SELECT document_id, parent_seq, substr(string_agg(body, ' ' ORDER BY n), 1, 600) AS preview FROM kept WHERE n <= 5 GROUP BY ALL)
SELECT i.document_id, i.item_seq, coalesce(preview, parent_header_text) AS parent_context FROM i LEFT JOIN paths USING (document_id, item_seq) LEFT JOIN bodies ON bodies.document_id = i.document_id AND bodies.parent_seq = paths.parent_seq"""
)
def parent_context(spark, d):
    """The body under the nearest heading, else that heading."""
    return S.with_parent_context(S.ancestry(_items(spark, d)), body="body").select("document_id", "item_seq", "parent_context")


@query(
    """WITH p AS (SELECT document_id, unnest(list_zip(section_ref_path[:-2], section_ref_path[2:])) AS x FROM sample_normalized_reqs WHERE len(section_ref_path) > 1),
e AS (SELECT DISTINCT document_id, x[1] AS parent, x[2] AS child FROM p WHERE x[1] <> '' AND x[2] <> '') SELECT document_id, parent, string_agg(child, ',' ORDER BY encode(child)) AS children FROM e GROUP BY ALL"""
)
def section_children(spark, d):
    return S.children(reqs(spark, d), "section_ref_path", "document_id").select("document_id", "parent", F.array_join("child_section_refs", ",").alias("children"))


@query(
    f"""WITH n AS (SELECT document_id, section_ref_path[-1] AS ref, text, row_number() OVER (PARTITION BY document_id, section_ref_path[-1] ORDER BY chunk_id) AS n FROM {_LATEST} WHERE {_strip("coalesce(text, '')")} <> '' AND len(section_ref_path) > 0)
SELECT document_id, ref, substr(string_agg(text, ' ' ORDER BY n), 1, 600) AS body_preview FROM n WHERE n <= 5 GROUP BY ALL"""
)
def section_bodies(spark, d):
    c = C.latest_delivery(chunks(spark, d)).where("size(section_ref_path) > 0").withColumn("ref", F.element_at("section_ref_path", -1))
    return S.bodies(c, ["document_id", "ref"], "chunk_id", "text")


@query(f"SELECT document_id, array_to_string(arg_max(section_ref_path, {{'n': len(section_ref_path), 's': chunk_seq}}), '>') AS path FROM sample_chunks WHERE section_ref_path IS NOT NULL GROUP BY document_id")
def deepest_ancestry(spark, d):
    return S.deepest(chunks(spark, d).where("section_ref_path is not null"), ["document_id"], "chunk_seq", "section_ref_path").select("document_id", F.array_join("section_ref_path", ">").alias("path"))


def _toc(leader: str) -> str:
    lines = f"list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: {_strip('l')} <> '')"
    return f"len(list_filter({lines}, lambda l: regexp_matches(l, '{leader}'))) * 1.0 / nullif(len({lines}), 0)"


@query(f"SELECT chunk_seq, coalesce({_toc('[0-9]')}, 0) > 0.4 AS numbers, coalesce({_toc('[.]{5,}')}, 0) > 0.4 AS leaders FROM sample_chunks WHERE text IS NOT NULL")
def toc_line_ratio(spark, d):
    t = F.col("text")
    return chunks(spark, d).where("text is not null").select("chunk_seq", T.is_toc_text(t, "[0-9]").alias("numbers"), T.is_toc_text(t).alias("leaders"))


_SKIP = f"len(list_filter(coalesce(section_title_path, []), lambda h: {' OR '.join(f'''starts_with({_heading('h')}, '{s.lower()}')''' for s in SKIPS)})) > 0"


@query(f"SELECT chunk_seq FROM sample_chunks WHERE {_SKIP}")
def skip_section_filter(spark, d):
    return chunks(spark, d).where(T.in_skipped_section(F.col("section_title_path"), SKIPS)).select("chunk_seq")


@query(f"SELECT chunk_seq, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) - 1 AS chunk_no FROM {_LATEST} WHERE {_strip("coalesce(text, '')")} <> '' AND NOT coalesce({_toc('[.]{5,}')}, 0) > 0.4 AND NOT ({_SKIP})")
def chunk_numbering(spark, d):
    return C.numbered(C.kept(C.latest_delivery(chunks(spark, d)), SKIPS)).select("chunk_seq", "chunk_no")


@query("SELECT source_pdf, coalesce(min(CASE WHEN page_start > 0 THEN page_start END), 1) AS page_start, coalesce(max(CASE WHEN page_start > 0 THEN page_start END), 1) AS page_end FROM sample_chunks GROUP BY source_pdf")
def chunk_page_range(spark, d):
    return C.page_range(chunks(spark, d), ["source_pdf"], "page_start")


@query("SELECT req_seq, CASE WHEN source_ref IS NULL OR row_number() OVER (PARTITION BY document_id, source_ref ORDER BY req_seq) = 1 THEN source_quote ELSE '' END AS emitted FROM sample_normalized_reqs WHERE source_quote LIKE 'Control:%'")
def table_emit_once(spark, d):
    return C.emit_once(reqs(spark, d).where("source_quote like 'Control:%'"), "document_id", "source_ref", "req_seq", "source_quote").select("req_seq", "emitted")


@query("SELECT count(*) AS chunks, round(avg(length(coalesce(text, ''))), 1) AS avg_chars, min(length(coalesce(text, ''))) AS min_chars, max(length(coalesce(text, ''))) AS max_chars, round(100 * avg(CASE WHEN len(coalesce(section_title_path, [])) > 0 THEN 1 ELSE 0 END), 1) AS breadcrumb_pct FROM sample_chunks")
def chunk_size_stats(spark, d):
    return C.size_stats(chunks(spark, d))


@query("SELECT chunk_seq, CASE WHEN page_start IS NULL THEN '' WHEN page_end > page_start THEN 'pp. ' || page_start || '–' || page_end ELSE 'p. ' || page_start END AS label, CASE WHEN page_start IS NULL THEN '' WHEN page_end > page_start THEN array_to_string(generate_series(page_start, page_end), ',') ELSE CAST(page_start AS VARCHAR) END AS pages FROM sample_chunks")
def page_refs_label(spark, d):
    a, b = F.col("page_start"), F.col("page_end")
    return chunks(spark, d).select("chunk_seq", T.page_label(a, b).alias("label"), F.array_join(T.page_refs(a, b).cast("array<string>"), ",").alias("pages"))


_LIG = "source_quote"
for _a, _b in T.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"


@query(f"SELECT req_seq, {_LIG} AS repaired, length(source_quote) - length(regexp_replace(source_quote, '[{''.join(T.LIGATURES)}]', '', 'g')) AS n FROM sample_normalized_reqs WHERE source_quote IS NOT NULL")
def ligature_repair(spark, d):
    q = F.col("source_quote")
    return reqs(spark, d).where("source_quote is not null").select("req_seq", T.ligatures_repaired(q).alias("repaired"), T.ligature_count(q).alias("n"))


# ---- requirements -----------------------------------------------------------------
@query(
    f"SELECT req_seq, array_to_string(list_filter(list_transform(coalesce(domain_tags, []), lambda t: lower({_strip('t')})), lambda t: t IN ({_list(TAGS)})), ',') AS tags, CASE WHEN lower({_strip("coalesce(requirement_type, '')")}) IN ({_list(TYPES)}) THEN lower({_strip("coalesce(requirement_type, '')")}) ELSE '' END AS requirement_type FROM sample_normalized_reqs WHERE {_strip("coalesce(source_quote, '')")} <> ''"
)
def pass1_validate(spark, d):
    return Q.pass1(reqs(spark, d), TAGS, TYPES).select("req_seq", F.array_join("domain_tags", ",").alias("tags"), "requirement_type")


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_SP}+'), lambda w: w <> '')"


_EDGE = "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$"
_DANG = f"(NOT contains({_strip('q')}, '?') AND lower(regexp_replace(coalesce({_words(_strip('q'))}[1], ''), '{_EDGE}', '', 'g')) IN ('is', 'are', 'was', 'were'))"
_CITED = r"(?is)^[^,]{1,80},\s*as defined in\b(.*)$"
_CITE_REST = f"regexp_extract({_strip('q')}, '{_CITED}', 1)"
_CITE_WORDS = f"list_filter(list_transform({_words(_CITE_REST)}, lambda w: regexp_replace(w, '{_EDGE}', '', 'g')), lambda w: w <> '' AND lower(w) NOT IN ({_list(list(Q.CONNECTORS))}))"
#: A citation and nothing else: no word in lower case, no two words of capitals in a row.
_CITE = (
    f"(regexp_matches({_strip('q')}, '{_CITED}') AND len(list_filter({_CITE_WORDS}, lambda w: regexp_matches(w, '^\\p{{Ll}}'))) = 0"
    f" AND NOT contains(array_to_string(list_transform(list_filter({_CITE_WORDS}, lambda w: NOT regexp_matches(w, '\\d')), lambda w: CASE WHEN regexp_full_match(w, '\\p{{L}}+') AND w = upper(w) THEN 'U' ELSE 'x' END), ''), 'UU'))"
)
_RULES = f"""CASE WHEN {_strip('q')} = '' THEN 'empty_source_quote' WHEN ends_with({_strip('q')}, ':') THEN 'unrepairable_fragment' WHEN {_CITE} THEN 'orphaned_list_item'
  WHEN {_DANG} AND {_strip("coalesce(h, '')")} = '' THEN 'dangling_clause' WHEN starts_with({_norm('de')}, 'not explicitly stated') THEN 'not_actionable'
  WHEN starts_with({_norm('de')}, 'change ') AND (contains({_norm('de')}, ' to ') OR contains({_norm('de')}, ' from ')) AND length({_norm('de')}) < 100 THEN 'errata_change_entry' END"""
_JOINED = f"SELECT r.req_seq, coalesce(source_quote, '') AS q, coalesce(description, '') AS de, c.parent_header_text AS h FROM sample_normalized_reqs r LEFT JOIN {_LATEST} c ON r.document_id = c.document_id AND r.chunk_id = c.chunk_id"


def _joined(spark, d):
    return Q.with_chunks(reqs(spark, d), C.latest_delivery(chunks(spark, d)))


@query(f"SELECT req_seq, {_RULES} AS error FROM ({_JOINED})")
def validation_rules(spark, d):
    """The rules that need no fuzzy ratio; all are in ``validation_cascade``."""
    return _joined(spark, d).select("req_seq", Q.first_error().alias("error"))


@query()
def validation_cascade(spark, d):
    return Q.validated(_joined(spark, d)).select("req_seq", "error", F.round("grounding_score", 4).alias("grounding_score"))


@query()
def normalization_failures(spark, d):
    v = Q.validated(_joined(spark, d)).where("error is not null")
    return v.select("requirement_id", "chunk_id", "error", F.to_json(F.struct("req_seq", "source_quote", "source_ref", "description")).alias("raw"))


_CONF = f"(100 - CASE WHEN len(coalesce(domain_tags, [])) = 0 THEN 20 ELSE 0 END - CASE WHEN {_strip("coalesce(source_quote, '')")} = '' THEN 20 ELSE 0 END - CASE WHEN length(coalesce(description, '')) < 20 THEN 10 ELSE 0 END - CASE WHEN {_strip("coalesce(source_ref, '')")} = '' THEN 10 ELSE 0 END) / 100.0"


@query(f"SELECT req_seq, CAST({_CONF} AS DOUBLE) AS confidence FROM sample_normalized_reqs")
def confidence_score(spark, d):
    return reqs(spark, d).select("req_seq", Q.confidence().alias("confidence"))


@query(f"SELECT req_seq, document_id, source_ref, source_quote, confidence FROM {_DEDUP}")
def dedup_requirements(spark, d):
    return Q.deduplicated(reqs(spark, d)).select("req_seq", "document_id", "source_ref", "source_quote", "confidence")


@query()
def dedup_general_fold(spark, d):
    return Q.fold_duplicates(reqs(spark, d))


@query(f"SELECT r.req_seq, c.page_start AS chunk_page_start, c.page_end AS chunk_page_end, c.document_id IS NOT NULL AS chunk_known, length(coalesce(c.text, '')) * CASE WHEN c.document_id IS NULL THEN NULL ELSE 1 END AS chunk_chars FROM sample_normalized_reqs r LEFT JOIN {_LATEST} c ON r.document_id = c.document_id AND r.chunk_id = c.chunk_id")
def requirement_page_hierarchy_join(spark, d):
    return _joined(spark, d).select("req_seq", "chunk_page_start", "chunk_page_end", "chunk_known", F.length("chunk_text").alias("chunk_chars"))


@query(f"WITH k AS ({ORACLES['section_children']}) SELECT r.req_seq, k.children FROM sample_normalized_reqs r LEFT JOIN k ON r.document_id = k.document_id AND r.section_ref_path[-1] = k.parent")
def requirement_children_join(spark, d):
    k = section_children(spark, d).withColumnRenamed("parent", "last_ref")
    return reqs(spark, d).withColumn("last_ref", F.try_element_at("section_ref_path", F.lit(-1))).join(k, ["document_id", "last_ref"], "left").select("req_seq", "children")


@query()
def parent_stems(spark, d):
    return M.with_stems(reqs(spark, d), C.latest_delivery(chunks(spark, d))).select("req_seq", "parent_stem", "embedding_text")


def _stem(x: str) -> str:
    t = _strip(f"coalesce({x}, '')")
    u = f"replace({t}, '://', chr(1) || chr(1) || chr(1))"
    return f"CASE WHEN {t} = '' THEN NULL WHEN instr({u}, ':') > 0 THEN {_strip(f'substr({t}, 1, instr({u}, {chr(39)}:{chr(39)}))')} WHEN regexp_matches({t}, '^\\(?[a-zA-Z0-9]{{1,3}}[.)]\\s') OR starts_with({t}, '-') THEN NULL WHEN NOT regexp_matches({t}, '[.!?,;]$') THEN {t} END"


@query(f"SELECT req_seq, last_value(s IGNORE NULLS) OVER (PARTITION BY document_id, chunk_id ORDER BY req_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stem FROM (SELECT req_seq, document_id, chunk_id, {_stem('source_quote')} AS s FROM sample_normalized_reqs)")
def parent_stem_same_chunk(spark, d):
    w = W.partitionBy("document_id", "chunk_id").orderBy("req_seq").rowsBetween(W.unboundedPreceding, -1)
    return reqs(spark, d).withColumn("s", M.stem_of(F.col("source_quote"))).select("req_seq", F.last("s", True).over(w).alias("stem"))


@query("SELECT req_seq, CASE WHEN coalesce(source_quote, '') = '' THEN NULL ELSE source_quote || CASE WHEN coalesce(source_ref, '') <> '' THEN chr(10) || 'Ref: ' || source_ref ELSE '' END END AS embedding_text FROM sample_normalized_reqs")
def embedding_text(spark, d):
    return reqs(spark, d).select("req_seq", T.embedding_text(F.lit(None).cast("string"), F.col("source_quote"), F.col("source_ref")).alias("embedding_text"))


_FILLED = "(coalesce(description, '') <> '' OR len(coalesce(domain_tags, [])) > 0 OR coalesce(requirement_type, '') <> '')"
_CACHED = f"(SELECT requirement_id, description, domain_tags, requirement_type FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY ingested_at DESC NULLS LAST, req_seq DESC) AS n FROM sample_normalized_reqs WHERE extraction_model = 'local-small' AND requirement_id IS NOT NULL AND {_FILLED}) WHERE n = 1)"
_MERGED = "SELECT r.req_seq, c.requirement_id IS NOT NULL AS enriched, CASE WHEN c.requirement_id IS NOT NULL THEN c.description ELSE r.description END AS description, array_to_string(CASE WHEN c.requirement_id IS NOT NULL THEN c.domain_tags ELSE r.domain_tags END, ',') AS tags, CASE WHEN c.requirement_id IS NOT NULL THEN c.requirement_type ELSE r.requirement_type END AS requirement_type FROM sample_normalized_reqs r LEFT JOIN c USING (requirement_id)"


def _enriched_fields(x):
    return x.select("req_seq", "enriched", "description", F.array_join("domain_tags", ",").alias("tags"), "requirement_type")


@query(f"WITH c AS {_CACHED} {_MERGED}")
def enrichment_merge(spark, d):
    """Rows with what a cache of one model's answers fills; the others are still to enrich."""
    r = reqs(spark, d)
    return _enriched_fields(N.merged(r, N.usable_cache(r.withColumn("enrichment_model", F.col("extraction_model")), "local-small", ["ingested_at", "req_seq"])))


_ENRICHER = {"badge": "privacy", "ledger": "audit-and-logging", "sensor": "network-security"}
_ENRICHER_TAGS = ", ".join(f"CASE WHEN contains(lower(q), '{w}') THEN '{t}' END" for w, t in _ENRICHER.items())
_ASKS = _strip("'Asks: ' || substr(q, 1, 60)")


@query(
    f"""WITH old AS {_CACHED}, ask AS (SELECT requirement_id, max(coalesce(source_quote, '')) AS q FROM sample_normalized_reqs WHERE requirement_id IS NOT NULL AND requirement_id NOT IN (SELECT requirement_id FROM old) GROUP BY requirement_id),
new AS (SELECT requirement_id, {_ASKS} AS description, list_filter([{_ENRICHER_TAGS}], lambda t: t IS NOT NULL) AS domain_tags,
  CASE WHEN contains(lower(q), 'shall') THEN 'policy' WHEN contains(lower(q), 'must') THEN 'technical-control' ELSE '' END AS requirement_type FROM ask),
c AS (SELECT * FROM old UNION ALL SELECT * FROM new) {_MERGED}"""
)
def enrichment_run(spark, d):
    """All rows enriched: from the cache, the rest by an offline model in batches."""
    from .providers import OfflineEnricher

    r = reqs(spark, d)
    return _enriched_fields(N.enriched(r, OfflineEnricher(_ENRICHER), "local-small", TAGS, TYPES, r.withColumn("enrichment_model", F.col("extraction_model")), ("ingested_at", "req_seq")))


_MODAL = f"(?:^|[^a-z0-9_])(?:{'|'.join(G.MODALS)})(?:$|[^a-z0-9_])"


def _governed(x: str) -> str:
    verbs = "|".join(f for fs in G.VERBS.values() for f in fs)
    tied = "|".join([m for m in G.MODALS if m.endswith(" to")] + [f"{n} to" for n in G.NOUNS])
    free = f"regexp_matches(regexp_replace({_norm(x)}, '\\bto (?:{verbs})\\b', ' ', 'g'), '\\b(?:{verbs})\\b')"
    return f"({free} OR regexp_matches({_norm(x)}, '\\b(?:{tied}) (?:{verbs})\\b'))"


@query(f"SELECT req_seq, regexp_matches({_norm('source_quote')}, '\\b(?:{'|'.join(G.MODALS)})\\b') AS modal, regexp_matches({_norm('source_quote')}, '\\b(?:{'|'.join(G.MODALS)})\\b') OR {_governed('source_quote')} AS obligation FROM sample_normalized_reqs WHERE source_quote IS NOT NULL")
def obligation_flags(spark, d):
    q = F.col("source_quote")
    return reqs(spark, d).where("source_quote is not null").select("req_seq", G.has_modal(q).alias("modal"), G.has_obligation(q).alias("obligation"))


def _obl(x: str) -> str:
    return f"(regexp_matches({_norm(x)}, '\\b(?:{'|'.join(G.MODALS)})\\b') OR {_governed(x)})"


@query(
    f"SELECT req_seq, coalesce(source_quote, '') <> '' AND coalesce(description, '') <> '' AND {_norm('description')} <> {_norm('source_quote')} AND NOT {_obl('source_quote')} AND {_obl('description')} AS rejected FROM sample_normalized_reqs WHERE source_quote IS NOT NULL AND description IS NOT NULL"
)
def description_gate(spark, d):
    g = G.gated(reqs(spark, d).where("source_quote is not null and description is not null"))
    return g.select("req_seq", (F.size("gate_errors") > 0).alias("rejected"))


@query(
    f"""WITH v AS (SELECT r.* FROM sample_normalized_reqs r JOIN ({ORACLES['validation_rules']}) e USING (req_seq) WHERE e.error IS NULL), f AS (SELECT count(*) AS failures FROM ({ORACLES['validation_rules']}) WHERE error IS NOT NULL), c AS (SELECT count(*) AS chunks, sum(length(coalesce(text, ''))) AS chars FROM {_LATEST}),
a AS (SELECT count(*) AS requirements, coalesce(round(avg(confidence), 3), 0) AS avg_confidence, count(DISTINCT nullif({_strip('source_ref')}, '')) AS distinct_refs, count(DISTINCT CASE WHEN document_id IS NOT NULL AND chunk_id IS NOT NULL THEN (document_id, chunk_id) END) AS covered FROM v)
SELECT requirements, failures, requirements + failures AS requirements_before, chunks, avg_confidence, distinct_refs, round(covered * 100.0 / chunks, 1) AS coverage_pct, round(requirements * 1000.0 / chars, 3) AS per_1000_chars, round(requirements * 100.0 / (requirements + failures), 1) AS success_pct FROM a, f, c"""
)
def stats_summary(spark, d):
    """By the rules that need no fuzzy ratio; by all rules in ``stats_whole``."""
    v = _joined(spark, d).withColumn("error", Q.first_error())
    return Q.stats(v.where("error is null"), v.where("error is not null"), C.latest_delivery(chunks(spark, d)))


@query()
def stats_whole(spark, d):
    """The statistics of the operator's whole cascade over all rows, with grounding and
    heading echo; ``stats_summary`` keeps the rules that its SQL can say."""
    v = Q.validated(_joined(spark, d))
    return Q.stats(v.where("error is null"), v.where("error is not null"), C.latest_delivery(chunks(spark, d)))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(domain_tags) AS tag FROM sample_normalized_reqs) GROUP BY tag")
def tag_histogram(spark, d):
    return Q.tag_histogram(reqs(spark, d))


@query("SELECT coalesce(requirement_type, 'unknown') AS requirement_type, count(*) AS n FROM sample_normalized_reqs GROUP BY 1")
def type_histogram(spark, d):
    return Q.type_histogram(reqs(spark, d))


@query("SELECT source_pdf, count(*) AS n_reqs, count(DISTINCT document_id) AS n_docs, grouping(source_pdf) AS is_total FROM sample_normalized_reqs GROUP BY ROLLUP (source_pdf)")
def corpus_docs_rollup(spark, d):
    return reqs(spark, d).rollup("source_pdf").agg(F.count("*").alias("n_reqs"), F.countDistinct("document_id").alias("n_docs"), F.grouping("source_pdf").cast("int").alias("is_total"))


@query("SELECT m.framework, m.document_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, max(coalesce(m.authority_weight, 1)) AS weight FROM sample_normalized_reqs r LEFT JOIN source_manifest m USING (source_pdf) GROUP BY ALL")
def corpus_analyze_pct(spark, d):
    m = _t(spark, d, "source_manifest").select("source_pdf", "framework", "document_type", F.coalesce("authority_weight", F.lit(1)).alias("w"))
    g = reqs(spark, d).join(m, "source_pdf", "left").groupBy("framework", "document_type").agg(F.count("*").alias("n"), F.coalesce(F.max("w"), F.lit(1)).alias("weight"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4)).select("framework", "document_type", "n", "pct", "weight")


@query(
    "WITH s AS (SELECT DISTINCT regexp_replace(source_pdf, '(?i)\\.pdf$', '') AS stem FROM sample_normalized_reqs WHERE source_pdf IS NOT NULL) SELECT stem, arg_min(doc_key, {'o': doc_key, 'k': doc_key}) AS registry_key FROM s LEFT JOIN source_manifest m ON contains(lower(stem), lower(doc_key)) OR contains(lower(doc_key), lower(stem)) GROUP BY stem"
)
def authority_containment_join(spark, d):
    s = reqs(spark, d).where("source_pdf is not null").select(F.regexp_replace("source_pdf", r"(?i)\.pdf$", "").alias("stem")).distinct()
    return U.containment_match(s, _t(spark, d, "source_manifest"), "stem", "doc_key", "doc_key")


_FILES = "SELECT user_id AS doc_key, 'run_' || strftime(ts, '%Y%m%d') || '_000000' AS run_dir, CASE event_type WHEN 'click' THEN 'gated' WHEN 'view' THEN 'normalized' ELSE 'enriched' END AS tier, ts AS mtime FROM events"


def _files(spark, d):
    e = _t(spark, d, "events")
    tier = F.when(F.col("event_type") == "click", "gated").when(F.col("event_type") == "view", "normalized").otherwise("enriched")
    return e.select(F.col("user_id").alias("doc_key"), F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd"), F.lit("_000000")).alias("run_dir"), tier.alias("tier"), F.col("ts").alias("mtime"))


@query(
    f"""WITH w AS (SELECT doc_key, run_dir, max(CASE WHEN tier = 'normalized' THEN mtime END) AS n, max(CASE WHEN tier = 'enriched' THEN mtime END) AS e, max(CASE WHEN tier = 'gated' THEN mtime END) AS g FROM ({_FILES}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY greatest(n, e, g) DESC, run_dir DESC) AS k FROM w)
SELECT doc_key, run_dir, CASE WHEN g IS NOT NULL AND NOT coalesce(g < greatest(n, e), false) THEN 'gated' WHEN e IS NOT NULL AND NOT coalesce(e < n, false) THEN 'enriched' WHEN n IS NOT NULL THEN 'normalized' WHEN e IS NOT NULL THEN 'enriched' ELSE 'gated' END AS tier,
substr(run_dir, 5, 4) || '-' || substr(run_dir, 9, 2) || '-' || substr(run_dir, 11, 2) AS run_date FROM r WHERE k = 1"""
)
def latest_run_tier(spark, d):
    return U.current_runs(_files(spark, d)).withColumn("run_date", U.run_date())


# ---- retrieval --------------------------------------------------------------------
_STATED = "q AS (SELECT req_seq AS query_id, coalesce(source_quote, '') AS query FROM sample_normalized_reqs WHERE req_seq % 50 = 0)"


def _stated(spark, d):
    """The queries are the quotes of all rows whose number is divisible by 50."""
    return reqs(spark, d).where("req_seq % 50 = 0").select(F.col("req_seq").alias("query_id"), F.coalesce("source_quote", F.lit("")).alias("query"))


def _lex_stated(spark, d, n=100, idf=True, where="true"):
    return R.lexical_top(reqs(spark, d).where(where), _stated(spark, d), "req_seq", "source_quote", n, idf)


def _bm25(idf: bool, where: str = "true", asked: str | None = None) -> str:
    w = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))" if idf else "1.0"
    return f"""{asked or _STATED}, qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q),
tok AS (SELECT req_seq, regexp_extract_all(lower(coalesce(source_quote, '')), '[a-z0-9]+') AS t FROM sample_normalized_reqs WHERE {where}),
sz AS (SELECT avg(len(t)) AS avgdl, count(*) AS n_docs FROM tok), tf AS (SELECT req_seq, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT req_seq, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (SELECT query_id, req_seq, round(sum({w} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), sz GROUP BY ALL)"""


def _ranked(src: str, n: int, alias: str, key: str = "req_seq") -> str:
    return f"{alias} AS (SELECT * FROM (SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM {src}) WHERE rank <= {n})"


_TOP = "SELECT query_id, req_seq, rank, round(score, 6) AS score FROM r"


def _show(x, key="req_seq"):
    return x.select("query_id", key, F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_QV = "SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0"
_DENSE = f"qv AS ({_QV}), dense AS (SELECT query_id, vec_id, round(coalesce(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 0), 9) AS score FROM qv, embeddings)"


def _dense(spark, d, n=100):
    v = _t(spark, d, "embeddings")
    return R.dense_top(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "vec_id", "embedding", n)


@query(f"WITH {_DENSE}, {_ranked('dense', 20, 'r', 'vec_id')} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r")
def dense_topk(spark, d):
    """Queries are the vectors whose id is divisible by 50, against all vectors."""
    return _show(R.top(_dense(spark, d), 20, "vec_id"), "vec_id")


def _legs(spark, d, third: bool):
    """The stated queries are the vectors whose id is divisible by 50, with the quote of
    that number as text and the next vector as that of a hypothetical answer."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("req_seq"), "embedding")
    at = lambda shift: v.select((F.col("req_seq") - shift).alias("query_id"), F.col("embedding").alias("query_vector")).where("query_id % 50 = 0 and query_id >= 0")
    r = reqs(spark, d)
    texts = r.join(at(0).select(F.col("query_id").alias("req_seq")), "req_seq").select(F.col("req_seq").alias("query_id"), F.coalesce("source_quote", F.lit("")).alias("query"))
    legs = [R.lexical_top(r, texts, "req_seq", "source_quote", 100)]
    return legs + [R.dense_top(v, at(shift), "req_seq", "embedding", 100) for shift in ((0, 1) if third else (0,))]


_ASKED = "q AS (SELECT vec_id AS query_id, coalesce(source_quote, '') AS query FROM embeddings JOIN sample_normalized_reqs ON req_seq = vec_id WHERE vec_id % 50 = 0)"


def _rrf(third: bool, floor: float) -> str:
    def leg(name, shift):
        return f"{name} AS (SELECT a.vec_id - {shift} AS query_id, b.vec_id AS req_seq, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 9) AS score FROM embeddings a, embeddings b WHERE (a.vec_id - {shift}) % 50 = 0 AND a.vec_id >= {shift})"

    ctes = [_bm25(True, asked=_ASKED), leg("den", 0), _ranked("lex", 100, "r1"), _ranked("den", 100, "r2")]
    union = "SELECT query_id, req_seq, rank FROM r1 UNION ALL SELECT query_id, req_seq, rank FROM r2"
    if third:
        ctes += [leg("hyde", 1), _ranked("hyde", 100, "r3")]
        union += " UNION ALL SELECT query_id, req_seq, rank FROM r3"
    ctes += [f"fu AS (SELECT query_id, req_seq, round(sum(1.0 / (rank - 1 + 2)), 9) AS score FROM ({union}) GROUP BY ALL)", f"fl AS (SELECT * FROM fu WHERE score >= {floor})", _ranked("fl", 20, "r")]
    return "WITH " + ", ".join(ctes) + " " + _TOP


@query(_rrf(False, 0.0))
def hybrid_rrf(spark, d):
    return _show(R.fused(_legs(spark, d, False), 20, "req_seq"))


@query(_rrf(True, 0.02))
def hybrid_rrf_hyde(spark, d):
    return _show(R.fused(_legs(spark, d, True), 20, "req_seq", min_score=0.02))


@query(f"WITH {_bm25(False)}, {_ranked('lex', 100, 'r')} {_TOP}")
def bm25_tf_topk(spark, d):
    return _show(R.top(_lex_stated(spark, d, idf=False), 100, "req_seq"))


@query(f"WITH {_bm25(True)}, {_ranked('lex', 100, 'r')} {_TOP}")
def bm25_idf_topk(spark, d):
    return _show(R.top(_lex_stated(spark, d), 100, "req_seq"))


@query(f"WITH {_bm25(True, '''list_has_any(coalesce(domain_tags, []), ['access-control', 'privacy']) AND requirement_type IN ('policy', 'guidance')''')}, {_ranked('lex', 50, 'r')} {_TOP}")
def filtered_search(spark, d):
    """The filters are those of the rows searched; every stated row is a query."""
    f = R.query_filter(tags=["Access Control", "privacy"], types=["policy", "guidance"])
    return _show(R.top(_lex_stated(spark, d, 50, where=f), 50, "req_seq"))


_NAMES = ["PTG_7513.35", "HARV 5597.03.pdf", "no such file"]


@query(
    "WITH c AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', '{n + e}', {i})" for n in _NAMES for i, e in enumerate(("", ".pdf", ".PDF")) if not (i and n.endswith(".pdf")))
    + ") AS t(name, source_pdf, k)) SELECT name, arg_min(source_pdf, k) AS source_pdf FROM c JOIN (SELECT DISTINCT source_pdf FROM source_manifest) USING (source_pdf) GROUP BY name"
)
def resolve_document_ids(spark, d):
    return R.resolve_sources(_NAMES, _t(spark, d, "source_manifest"))[0]


_AT = "instr(text, source_quote)"


@query(
    f"""WITH j AS (SELECT r.req_seq, source_quote, c.text FROM sample_normalized_reqs r JOIN {_LATEST} c ON r.document_id = c.document_id AND r.chunk_id = c.chunk_id WHERE coalesce(source_quote, '') <> '' AND coalesce(text, '') <> '')
SELECT req_seq, CASE WHEN {_AT} > 0 THEN CASE WHEN {_AT} > 301 THEN '...' ELSE '' END || substr(text, greatest({_AT} - 300, 1), least({_AT} + length(source_quote) + 300, length(text) + 1) - greatest({_AT} - 300, 1)) || CASE WHEN {_AT} + length(source_quote) + 300 <= length(text) THEN '...' ELSE '' END
WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END AS context_text FROM j"""
)
def context_window(spark, d):
    c = C.latest_delivery(chunks(spark, d)).where("coalesce(text, '') <> ''")
    return R.with_context(reqs(spark, d).where("coalesce(source_quote, '') <> ''"), c).where("context_text is not null").select("req_seq", "context_text")


@query("SELECT req_seq, confidence, page_start FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY ingested_at DESC, req_seq DESC) AS n FROM sample_normalized_reqs) WHERE n = 1")
def upsert_latest_point(spark, d):
    return R.latest_points(reqs(spark, d), "requirement_id", ["ingested_at", "req_seq"]).select("req_seq", "confidence", "page_start")


@query("SELECT count(*) AS mismatched, string_agg(DISTINCT m, ', ' ORDER BY m) AS models FROM (SELECT coalesce(extraction_model, 'nomic-embed-text') AS m FROM sample_normalized_reqs) WHERE m <> 'nomic-embed-text'")
def embedding_warnings(spark, d):
    return R.model_warnings(reqs(spark, d).withColumn("embedding_model", F.col("extraction_model")), "nomic-embed-text")


# ---- services ---------------------------------------------------------------------
@query(
    """WITH t AS (SELECT req_seq AS target, source_ref, source_pdf AS own FROM sample_normalized_reqs WHERE req_seq % 50 = 0 AND source_ref <> ''),
m AS (SELECT t.target, r.req_seq, r.source_pdf, row_number() OVER (PARTITION BY target, r.source_pdf ORDER BY r.req_seq) AS n FROM sample_normalized_reqs r JOIN t USING (source_ref) WHERE r.req_seq <> t.target AND (r.source_pdf IS NULL OR r.source_pdf IS DISTINCT FROM t.own))
SELECT target, req_seq, source_pdf FROM m WHERE n = 1 OR source_pdf IS NULL"""
)
def trace_cross_matches(spark, d):
    """Targets are all rows whose number is divisible by 50 and that have a reference."""
    r = reqs(spark, d)
    return V.cross_matches(r, r.where("req_seq % 50 = 0")).select("target", "req_seq", "source_pdf")


@query("SELECT source_pdf, req_seq, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_pdf ORDER BY confidence DESC NULLS LAST, req_seq) AS n FROM sample_normalized_reqs WHERE upper(source_ref) = 'ENCLOSURE-3') WHERE n = 1")
def compare_exact(spark, d):
    return V.compare_exact(reqs(spark, d), "enclosure-3").select("source_pdf", "req_seq", "confidence")


@query(f"WITH {_bm25(True)}, {_ranked('lex', 100, 'k')}, h AS (SELECT k.*, source_ref, source_pdf FROM k JOIN sample_normalized_reqs USING (req_seq)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_ref, source_pdf ORDER BY rank, req_seq) AS n FROM h) SELECT query_id, req_seq, source_ref, source_pdf, rank, min(rank) OVER (PARTITION BY query_id, source_ref) AS ref_rank FROM o WHERE n = 1")
def compare_semantic(spark, d):
    hits = R.top(_lex_stated(spark, d), 100, "req_seq").join(reqs(spark, d).select("req_seq", "source_ref", "source_pdf"), "req_seq")
    return V.compare_ranked(hits, by=("query_id",)).select("query_id", "req_seq", "source_ref", "source_pdf", F.col("rank").cast("long").alias("rank"), F.col("ref_rank").cast("long").alias("ref_rank"))


_ONE, _TWO = "coalesce(source_pdf LIKE 'PTG%', false)", "coalesce(source_pdf LIKE 'HARV%', false)"


@query(f"SELECT source_ref, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_first' ELSE 'only_second' END AS side FROM (SELECT source_ref, bool_or({_ONE}) AS a, bool_or({_TWO}) AS b FROM sample_normalized_reqs WHERE ({_ONE} OR {_TWO}) AND coalesce(source_ref, '') <> '' GROUP BY source_ref)")
def compare_split(spark, d):
    return V.compare_split(reqs(spark, d), F.expr(_ONE), F.expr(_TWO))


_REF = _strip("coalesce(source_ref, '')")
_ABOVE = "coalesce(nullif(section_ref_path[-1], ''), nullif(parent_section_ref, ''))"
_BARE = f"regexp_full_match({_REF}, '\\([0-9a-zA-Z]{{1,4}}\\)')"


@query(
    f"""WITH {_bm25(True)}, {_ranked('lex', 100, 'k')}, h AS (SELECT k.query_id, k.rank, r.*, CASE WHEN {_REF} = '' THEN '__no_ref__' || req_seq WHEN {_BARE} AND {_ABOVE} IS NULL THEN '__bare_fragment__' || req_seq WHEN {_BARE} THEN {_ABOVE} || {_REF} ELSE {_REF} END AS group_key FROM k JOIN sample_normalized_reqs r USING (req_seq))
SELECT query_id, group_key, min(rank) AS first_rank, arg_max(req_seq, {{'c': coalesce(confidence, 0), 'r': -rank}}) AS representative, string_agg(CAST(req_seq AS VARCHAR), ',' ORDER BY rank) AS sources FROM h GROUP BY query_id, group_key"""
)
def evidence_groups(spark, d):
    hits = R.top(_lex_stated(spark, d), 100, "req_seq").join(reqs(spark, d), "req_seq")
    return V.evidence_groups(hits, by=("query_id",)).select("query_id", "group_key", F.col("first_rank").cast("long").alias("first_rank"), "representative", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


_REASONS = """array_to_string(list_filter([CASE WHEN coalesce(source_ref, '') = '' THEN 'missing-source-ref' END, CASE WHEN len(coalesce(section_title_path, [])) = 0 THEN 'missing-section-title-path' END, CASE WHEN page_start IS NULL THEN 'missing-page-refs' END,
CASE WHEN len(coalesce(domain_tags, [])) = 0 THEN 'missing-domain-tags' END, CASE WHEN coalesce(confidence, 0) < 0.8 THEN 'low-confidence' END, CASE WHEN coalesce(domain_profile, 'cybersecurity') <> 'cybersecurity' THEN 'profile-mismatch' END], lambda x: x IS NOT NULL), ',')"""
_LISTED = f"FROM sample_normalized_reqs WHERE coalesce(requirement_id, '') <> '' AND {_strip("coalesce(source_quote, '')")} <> ''"


@query(f"SELECT req_seq, 'CHK-' || substr(sha256(requirement_id), 1, 16) AS item_id, {_REASONS} AS reasons {_LISTED}")
def checklist_items(spark, d):
    return V.checklist(reqs(spark, d), "cybersecurity").select("req_seq", "item_id", F.array_join("review_reasons", ",").alias("reasons"))


@query(f"SELECT count(*) AS total, count_if(reasons <> '') AS needing_review FROM (SELECT {_REASONS} AS reasons {_LISTED})")
def checklist_summary(spark, d):
    return V.checklist_summary(V.checklist(reqs(spark, d), "cybersecurity"))


@query(
    f"""SELECT req_seq, CASE WHEN regexp_matches(regexp_replace(source_quote, '^{_SP}+', ''), '^[=+@-]') THEN '''' || source_quote ELSE source_quote END AS quote, array_to_string(coalesce(section_title_path, []), ' > ') AS section, array_to_string(coalesce(domain_tags, []), ', ') AS tags {_LISTED}"""
)
def checklist_csv(spark, d):
    from .sources.exports import csv_columns

    return csv_columns(V.checklist(reqs(spark, d), "cybersecurity")).select("req_seq", F.col("source_quote").alias("quote"), F.col("section_title_path").alias("section"), F.col("domain_tags").alias("tags"))


def _garbled(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9 &/\\-]{{2,40}}\\s=\\s')) >= 2"


@query(f"SELECT 'requirement' AS kind, req_seq AS seq FROM sample_normalized_reqs WHERE {_garbled('source_quote')} UNION ALL SELECT 'audited', failure_seq FROM labeled_failures WHERE {_garbled('quote')} UNION ALL SELECT 'chunk', chunk_seq FROM sample_chunks WHERE {_garbled('text')}")
def garbled_table(spark, d):
    """Quotes and texts that hold a table run together, of all three tables."""
    each = ((reqs(spark, d), "requirement", "req_seq", "source_quote"), (_t(spark, d, "labeled_failures"), "audited", "failure_seq", "quote"), (chunks(spark, d), "chunk", "chunk_seq", "text"))
    parts = [t.where(T.garbled_table(F.col(c))).select(F.lit(k).alias("kind"), F.col(s).alias("seq")) for t, k, s, c in each]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- evaluation -------------------------------------------------------------------
_TIER = "CASE WHEN n = 0 THEN 'none' WHEN n <= 3 THEN 'low' ELSE 'high' END"
_DENSITY = f"WITH n AS (SELECT c.chunk_seq, c.source_pdf, count(r.req_seq) AS n FROM {_LATEST} c LEFT JOIN sample_normalized_reqs r ON r.document_id = c.document_id AND r.chunk_id = c.chunk_id GROUP BY ALL) SELECT chunk_seq, source_pdf, n, {_TIER} AS tier FROM n"


def _density(spark, d):
    c, r = C.latest_delivery(chunks(spark, d)), reqs(spark, d).groupBy("document_id", "chunk_id").agg(F.count("*").alias("n"))
    n = c.select("document_id", "chunk_id", "chunk_seq", "source_pdf").join(r, ["document_id", "chunk_id"], "left").select("chunk_seq", "source_pdf", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("tier", F.expr(_TIER))


@query(_DENSITY)
def density_strata(spark, d):
    return _density(spark, d)


@query(f"SELECT chunk_seq, tier FROM (SELECT *, row_number() OVER (PARTITION BY source_pdf, tier ORDER BY md5('7|' || chunk_seq), chunk_seq) AS k FROM ({_DENSITY})) WHERE k <= CASE tier WHEN 'none' THEN 2 WHEN 'low' THEN 4 ELSE 4 END")
def stratified_sample(spark, d):
    return E.stratified_sample(_density(spark, d), "source_pdf", "tier", "chunk_seq", 10, {"none": 0.25, "low": 0.35, "high": 0.4}, "7").select("chunk_seq", "tier")


@query("SELECT req_seq FROM (SELECT req_seq, count(*) OVER (PARTITION BY source_pdf) AS pop, count(*) OVER () AS al, row_number() OVER (PARTITION BY source_pdf ORDER BY md5('3|' || req_seq), req_seq) AS k FROM sample_normalized_reqs WHERE source_pdf IS NOT NULL) WHERE k <= greatest(15, round(1000.0 * pop / al))")
def proportional_sample(spark, d):
    return E.proportional_sample(reqs(spark, d).where("source_pdf is not null"), "source_pdf", "req_seq", 1000, 15, "3").select("req_seq")


@query()
def bipartite_match(spark, d):
    """The requirements of each chunk against the sentences of its text."""
    k = F.concat_ws(":", "document_id", F.col("chunk_id").cast("string")).alias("chunk")
    c = C.latest_delivery(chunks(spark, d)).where("text <> '' and chunk_id is not null").select(k, F.posexplode(F.split("text", r"(?<=[.;:])\s+")).alias("k", "t"))
    r = reqs(spark, d).where("chunk_id is not null").select(k, F.col("req_seq").alias("k"), F.col("source_quote").alias("t"))
    return E.bipartite_match(r, c.withColumn("k", F.col("k").cast("long")), "chunk", "k", "t")


_HIT = "EXISTS (SELECT 1 FROM g WHERE g.requirement_id = f.requirement_id AND g.q = f.q)"
_TFN = f"""WITH g AS (SELECT DISTINCT requirement_id, {_norm('source_quote')} AS q FROM sample_normalized_reqs), f AS (SELECT category, subtype, requirement_id, {_norm('quote')} AS q FROM labeled_failures),
m AS (SELECT category, subtype, CASE WHEN {_HIT} THEN 1 ELSE 0 END AS tp, CASE WHEN {_HIT} THEN 0 ELSE 1 END AS fp, CASE WHEN q IS NULL THEN 1 ELSE 0 END AS fn FROM f),
s AS (SELECT category, subtype, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m GROUP BY GROUPING SETS ((), (category), (subtype)))
SELECT category, subtype, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 4) AS f1 FROM s"""


@query(_TFN)
def extraction_prf(spark, d):
    """Exact matches of audited quotes with the stored ones: overall, by category and by subtype."""
    g = reqs(spark, d).select("requirement_id", _sigma(T.normalize_text(F.col("source_quote"))).alias("q")).distinct().withColumn("m", F.lit(1))
    f = _t(spark, d, "labeled_failures").withColumn("q", _sigma(T.normalize_text(F.col("quote"))))
    hit = F.col("m").isNotNull().cast("int")
    return E.extraction_scores(f.join(g, ["requirement_id", "q"], "left").select("category", "subtype", hit.alias("tp"), (1 - hit).alias("fp"), F.col("q").isNull().cast("int").alias("fn")), ["category", "subtype"])


_REL = "rel AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"
_RANK = f"{_DENSE}, {_ranked('dense', 100, 'r', 'vec_id')}, {_REL}"
_MET = f"""WITH {_RANK}, n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY ALL), h AS (SELECT query_id, min(rank) AS f, count_if(rank <= 5) AS h5, count_if(rank <= 10) AS h10, count_if(rank <= 20) AS h20 FROM r JOIN rel USING (query_id, vec_id) GROUP BY ALL)
SELECT query_id, n_relevant, round(coalesce(h5, 0) / n_relevant, 4) AS recall_5, round(coalesce(h10, 0) / n_relevant, 4) AS recall_10, round(coalesce(h20, 0) / n_relevant, 4) AS recall_20, round(coalesce(1.0 / f, 0), 4) AS mrr FROM n LEFT JOIN h USING (query_id)"""


def _relevant(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", "label")
    return v.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "label").join(v, "label").where("query_id <> vec_id").select("query_id", "vec_id")


@query(_MET)
def retrieval_metrics(spark, d):
    return E.retrieval_metrics(R.top(_dense(spark, d), 100, "vec_id"), _relevant(spark, d), "vec_id")


@query(f"SELECT count(*) AS queries, round(avg(recall_5), 4) AS mean_recall_5, round(avg(recall_10), 4) AS mean_recall_10, round(avg(recall_20), 4) AS mean_recall_20, round(avg(mrr), 4) AS mean_mrr FROM ({_MET})")
def retrieval_aggregate(spark, d):
    return E.aggregate_metrics(retrieval_metrics(spark, d))


_FL = "(VALUES " + ", ".join(f"(CAST({x} AS DOUBLE))" for x in FLOORS) + ")"


@query(f"WITH {_RANK}, n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL), x AS (SELECT f.floor, n.query_id, n.n, count_if(r.score >= f.floor AND r.rank <= 5 AND rel.vec_id IS NOT NULL) AS got, count_if(r.score >= f.floor) AS kept FROM n CROSS JOIN {_FL} f(floor) LEFT JOIN r USING (query_id) LEFT JOIN rel ON rel.query_id = r.query_id AND rel.vec_id = r.vec_id GROUP BY ALL) SELECT floor, count(*) AS queries, round(avg(got / n), 4) AS mean_recall, count_if(kept = 0) AS empty FROM x GROUP BY floor")
def confidence_floor_sweep(spark, d):
    return E.floor_sweep(R.top(_dense(spark, d), 100, "vec_id"), _relevant(spark, d), FLOORS, "vec_id")


_SCORED = "SELECT category <> 'FRAGMENT' AS faithful, least(1.0, coalesce(word_count, 0) / 40.0) AS score FROM labeled_failures WHERE category IS NOT NULL"
_SWEEP = f"SELECT t AS threshold, round(count_if(faithful AND score < t) / nullif(count_if(faithful), 0), 4) AS fp_rate, round(count_if(NOT faithful AND score < t) / nullif(count_if(NOT faithful), 0), 4) AS catch_rate FROM ({_SCORED}), {_FL} f(t) GROUP BY t"


def _scored(spark, d):
    return _t(spark, d, "labeled_failures").where("category is not null").select((F.col("category") != "FRAGMENT").alias("faithful"), F.least(F.lit(1.0), F.coalesce("word_count", F.lit(0)) / 40.0).alias("score"))


@query(_SWEEP)
def threshold_sweep(spark, d):
    return E.threshold_sweep(_scored(spark, d), FLOORS)


@query(f"WITH s AS ({_SWEEP}) SELECT * FROM s WHERE fp_rate <= 0.1 OR (SELECT count(*) FROM s WHERE fp_rate <= 0.1) = 0 ORDER BY catch_rate DESC NULLS LAST, threshold LIMIT 1")
def select_threshold(spark, d):
    return E.select_threshold(E.threshold_sweep(_scored(spark, d), FLOORS))


@query(f"SELECT max(CASE WHEN score < 0.5 THEN score END) AS below, min(CASE WHEN score >= 0.5 THEN score END) AS above FROM ({_SCORED})")
def margin_analysis(spark, d):
    return E.margins(_scored(spark, d), 0.5)


@query("WITH s AS (SELECT doc_key, count(*) AS pop, count(ends_colon) AS n, count_if(ends_colon) AS hit FROM labeled_failures GROUP BY doc_key) SELECT round(sum(hit) / sum(n), 6) AS unweighted, round(sum(coalesce(hit / nullif(n, 0), 0) * pop) / sum(pop), 6) AS weighted FROM s")
def weighted_prevalence(spark, d):
    return E.weighted_prevalence(_t(spark, d, "labeled_failures"), "doc_key", F.col("ends_colon"))


@query("SELECT r.req_seq FROM sample_normalized_reqs r SEMI JOIN (SELECT r2.document_id, r2.chunk_id FROM labeled_failures f JOIN sample_normalized_reqs r2 USING (requirement_id) WHERE f.category = 'OVER_GRAB') k ON r.document_id = k.document_id AND r.chunk_id = k.chunk_id")
def over_grab(spark, d):
    """Requirements in the chunk of an audited over-grab; unknown chunks join nothing."""
    r = reqs(spark, d)
    bad = _t(spark, d, "labeled_failures").where("category = 'OVER_GRAB'").select("requirement_id").distinct()
    keys = r.join(bad, "requirement_id", "left_semi").select("document_id", "chunk_id").distinct()
    return r.join(keys, ["document_id", "chunk_id"], "left_semi").select("req_seq")


_LIVE = "SELECT document_id, count(*) AS n, max(document_hash_full) AS h FROM sample_normalized_reqs GROUP BY document_id"


@query(f"WITH e AS (SELECT document_id, count(*) AS n, max(document_hash_full) AS h FROM sample_normalized_reqs WHERE ingested_at < TIMESTAMP '2025-09-01' GROUP BY document_id), a AS ({_LIVE}) SELECT coalesce(e.document_id, a.document_id) AS document_id, CASE WHEN a.document_id IS NULL THEN 'missing' WHEN e.document_id IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM e FULL JOIN a USING (document_id) WHERE a.n IS DISTINCT FROM e.n OR a.h IS DISTINCT FROM e.h")
def manifest_diff(spark, d):
    r = reqs(spark, d)
    tally = lambda x: x.groupBy("document_id").agg(F.count("*").alias("n"), F.max("document_hash_full").alias("h"))
    return E.manifest_diff(tally(r.where("ingested_at < timestamp_ntz'2025-09-01'")), tally(r), "document_id", ["n", "h"])


@query("SELECT req_seq FROM sample_normalized_reqs WHERE requirement_id NOT IN (SELECT requirement_id FROM labeled_failures WHERE requirement_id IS NOT NULL)")
def quarantine(spark, d):
    return E.quarantined(reqs(spark, d), _t(spark, d, "labeled_failures").where("requirement_id is not null"), "requirement_id").select("req_seq")


@query("SELECT subtype, count(*) AS n, count_if(rule_status = 'COVERED') AS covered, count_if(coalesce(heading_echo, false) OR coalesce(unrepairable_fragment, false)) AS caught FROM labeled_failures GROUP BY subtype")
def rule_coverage(spark, d):
    f = _t(spark, d, "labeled_failures")
    return f.groupBy("subtype").agg(F.count("*").alias("n"), F.count_if(F.col("rule_status") == "COVERED").alias("covered"), F.count_if(F.coalesce("heading_echo", F.lit(False)) | F.coalesce("unrepairable_fragment", F.lit(False))).alias("caught"))


_W = "list_filter(regexp_split_to_array(quote, '\\s+'), lambda w: w <> '')"


@query(
    f"""SELECT failure_seq, array_to_string(list_filter([CASE WHEN len({_W}) <= 8 THEN 'short' END, CASE WHEN NOT regexp_matches(quote, '[.!?;]\\s*$') THEN 'open' END, CASE WHEN len({_W}) <= 10 AND quote = upper(quote) AND regexp_matches(quote, '[A-Z]') THEN 'all-caps' END,
CASE WHEN len({_W}) <= 6 AND len(list_filter({_W}, lambda w: NOT regexp_matches(w, '^[^a-z]'))) = 0 AND NOT (quote = upper(quote) AND regexp_matches(quote, '[A-Z]')) THEN 'title-case' END, CASE WHEN regexp_matches(lower(substr(quote, 1, 40)), '\\b(?:means|refers to|is defined as|definition)\\b') THEN 'definition' END], lambda x: x IS NOT NULL), ',') AS signals FROM labeled_failures WHERE quote IS NOT NULL"""
)
def discovery_candidates(spark, d):
    return _t(spark, d, "labeled_failures").where("quote is not null").select("failure_seq", F.array_join(E.discovery_signals(F.col("quote")), ",").alias("signals"))


@query()
def json_recovery(spark, d):
    """Lists of the events' properties, cut off before their last bracket."""
    e = _t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("props")), ",").alias("p"))
    return e.select("user_id", model_json.recover_json_array_udf(F.concat(F.lit("["), F.col("p"))).alias("x")).select("user_id", F.size("x.items").alias("items"), "x.recovered")


# ---- audits -----------------------------------------------------------------------
@query("WITH r AS (SELECT source_pdf || '_20250101_000000' AS run_dir, count(*) AS n FROM sample_normalized_reqs WHERE source_pdf IS NOT NULL GROUP BY ALL), d AS (SELECT regexp_replace(run_dir, '_\\d{8}_\\d{6}$', '') AS doc_key, max(n) AS requirements FROM r GROUP BY ALL) SELECT doc_key, sum(requirements) AS requirements FROM d GROUP BY ROLLUP (doc_key)")
def baseline_snapshot(spark, d):
    files = reqs(spark, d).where("source_pdf is not null").groupBy(F.concat("source_pdf", F.lit("_20250101_000000")).alias("run_dir")).agg(F.count("*").alias("n_lines"))
    return A.snapshot(files)


@query("SELECT source_pdf, CASE WHEN contains(arg_min(l, chunk_seq), 'TABLE_START') THEN 'pdfplumber' WHEN contains(arg_min(l, chunk_seq), '\"section_ref_path\"') THEN 'docling' ELSE 'pymupdf' END AS mode FROM (SELECT source_pdf, chunk_seq, CASE WHEN len(section_ref_path) > 0 THEN '{\"section_ref_path\":' ELSE '{' END || coalesce(text, '') AS l FROM sample_chunks) GROUP BY source_pdf")
def layout_modes(spark, d):
    line = F.concat(F.when(F.size(F.coalesce("section_ref_path", F.array().cast("array<string>"))) > 0, '{"section_ref_path":').otherwise("{"), F.coalesce("text", F.lit("")))
    g = chunks(spark, d).groupBy("source_pdf").agg(F.min_by(line, "chunk_seq").alias("l"))
    return g.select("source_pdf", A.layout_mode(F.col("l")).alias("mode"))


@query(f"""SELECT source_pdf, count(*) AS n, count_if({_strip("coalesce(text, '')")} <> '' AND NOT regexp_matches({_strip("coalesce(text, '')")}, '[.!?:"\'\']$')) AS split FROM sample_chunks GROUP BY source_pdf""")
def mid_paragraph_splits(spark, d):
    return chunks(spark, d).groupBy("source_pdf").agg(F.count("*").alias("n"), F.count_if(A.splits_mid_paragraph(F.col("text"))).alias("split"))


@query("SELECT requirement_id, string_agg(DISTINCT category, ',' ORDER BY category) AS labels FROM labeled_failures WHERE category IS NOT NULL GROUP BY requirement_id HAVING count(DISTINCT category) > 1")
def label_conflicts(spark, d):
    return A.label_conflicts(_t(spark, d, "labeled_failures"), "requirement_id", "category").select("requirement_id", F.array_join("labels", ",").alias("labels"))


@query("WITH a AS (SELECT requirement_id, min(category) AS a FROM labeled_failures WHERE failure_seq IS NOT NULL AND in_skip_sections GROUP BY ALL), b AS (SELECT requirement_id, min(category) AS b FROM labeled_failures WHERE NOT in_skip_sections GROUP BY ALL) SELECT requirement_id, CASE WHEN a IS NULL THEN 'only_second' WHEN b IS NULL THEN 'only_first' WHEN a <> b THEN 'conflict' END AS problem FROM a FULL JOIN b USING (requirement_id)")
def merged_labels(spark, d):
    f = _t(spark, d, "labeled_failures")
    side = lambda x: x.groupBy("requirement_id").agg(F.min("category").alias("category"))
    return A.merged_labels(side(f.where("in_skip_sections")), side(f.where("not in_skip_sections")), "requirement_id", "category").select("requirement_id", "problem")


@query(f"WITH k AS ({ORACLES['section_children']}) SELECT document_id, parent, len(string_split(children, ',')) AS n_children FROM k WHERE contains(children, ',')")
def parent_child_groups(spark, d):
    return A.parent_groups(reqs(spark, d), "document_id").select("document_id", "parent", "n_children")


@query("SELECT CASE WHEN k >= 2 THEN '2+' ELSE CAST(k AS VARCHAR) END AS depth, count(*) AS n FROM (SELECT greatest(len(coalesce(section_ref_path, [])) - 1, 0) AS k FROM sample_chunks) GROUP BY 1")
def depth_histogram(spark, d):
    return A.depth_histogram(chunks(spark, d))


@query("WITH g AS (SELECT source_pdf, max(len(coalesce(section_ref_path, []))) AS depth, avg(CASE WHEN len(coalesce(section_ref_path, [])) > 0 THEN 1 ELSE 0 END) AS u, count_if(coalesce(parent_context, '') <> '') AS context FROM sample_chunks GROUP BY source_pdf), k AS (SELECT *, (depth >= 2)::INT + (u >= 0.5)::INT + (context > 0)::INT AS n FROM g) SELECT source_pdf, depth, context, CASE WHEN n = 3 THEN 'pass' WHEN n > 0 THEN 'partial' ELSE 'fail' END AS verdict FROM k")
def structure_verdicts(spark, d):
    return A.verdicts(chunks(spark, d))


@query(f"WITH f AS (SELECT r.requirement_type, {_obl('source_quote')} AS q, {_obl('description')} AS de FROM sample_normalized_reqs r WHERE coalesce(source_quote, '') <> '' AND coalesce(description, '') <> '') SELECT requirement_type, count(*) AS n, count_if(NOT q AND de) AS caught FROM f GROUP BY requirement_type")
def fabricated_by_type(spark, d):
    r = reqs(spark, d).where("coalesce(source_quote, '') <> '' and coalesce(description, '') <> ''")
    return r.groupBy("requirement_type").agg(F.count("*").alias("n"), F.count_if(G.fabricated(F.col("source_quote"), F.col("description"))).alias("caught"))


@query("SELECT DISTINCT requirement_id FROM labeled_failures WHERE requirement_id NOT IN (SELECT requirement_id FROM sample_normalized_reqs WHERE source_quote LIKE 'Control:%')")
def label_set_difference(spark, d):
    have = reqs(spark, d).where("source_quote like 'Control:%'").select("requirement_id")
    return _t(spark, d, "labeled_failures").where("requirement_id is not null").select("requirement_id").distinct().join(have, "requirement_id", "left_anti")


@query(f"WITH {_bm25(True)}, {_ranked('lex', 100, 'k')} SELECT k.query_id, k.rank, '[' || k.rank || '] ' || coalesce(source_ref, '-') || ' (' || coalesce(source_pdf, '-') || '): ' || coalesce(nullif(description, ''), source_quote) AS line FROM k JOIN sample_normalized_reqs USING (req_seq)")
def evidence_prompt(spark, d):
    hits = R.top(_lex_stated(spark, d), 100, "req_seq").join(reqs(spark, d), "req_seq")
    return V.evidence_lines(hits, by=("query_id",)).select("query_id", F.col("rank").cast("long").alias("rank"), "line")


@query("SELECT CASE WHEN count(DISTINCT domain_profile) = 1 AND max(domain_profile) = 'cybersecurity' THEN 'access-control, audit-and-logging, privacy' ELSE 'general' END AS tags FROM sample_normalized_reqs")
def domain_tag_rule(spark, d):
    return A.tag_rule(reqs(spark, d), {"cybersecurity": ["access-control", "audit-and-logging", "privacy", "maintenance"]})


@query("SELECT req_seq, CASE WHEN length(source_quote) > 220 THEN substr(source_quote, 1, 220) || '…' ELSE source_quote END AS snippet, CASE WHEN length(source_quote) > 120 THEN substr(source_quote, 1, 120) || '...' ELSE source_quote END AS short FROM sample_normalized_reqs WHERE source_quote IS NOT NULL")
def snippets(spark, d):
    q = F.col("source_quote")
    return reqs(spark, d).where("source_quote is not null").select("req_seq", T.snippet(q, 220, "…").alias("snippet"), T.snippet(q, 120, "...").alias("short"))


_SEED = "SELECT source_pdf, chunk_id, '[' || string_agg(CAST(req_seq AS VARCHAR), ',' ORDER BY req_seq) || ']' AS gold FROM sample_normalized_reqs WHERE source_pdf IS NOT NULL AND chunk_id IS NOT NULL"


@query(f"WITH s AS ({_SEED} GROUP BY source_pdf, chunk_id), c AS ({_SEED} AND confidence < 0.8 GROUP BY source_pdf, chunk_id) SELECT k.chunk_seq, coalesce(c.gold, s.gold) AS gold, CASE WHEN c.gold IS NOT NULL THEN 'done' WHEN s.gold IS NOT NULL THEN 'seeded' ELSE 'open' END AS review_status FROM {_LATEST} k LEFT JOIN s ON k.source_pdf = s.source_pdf AND k.chunk_id = s.chunk_id LEFT JOIN c ON k.source_pdf = c.source_pdf AND k.chunk_id = c.chunk_id")
def gold_review_table(spark, d):
    r = reqs(spark, d).where("source_pdf is not null and chunk_id is not null")
    gold = lambda x: x.groupBy("source_pdf", "chunk_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("req_seq")), lambda v: v.cast("string")), ","), F.lit("]")).alias("gold"))
    t = A.review_table(C.latest_delivery(chunks(spark, d)), gold(r), gold(r.where("confidence < 0.8")))
    return t.select("chunk_seq", "gold", "review_status")


# ---- diagnosis --------------------------------------------------------------------
#: The ids of a search are those of rows of requirements; the pool is one wide search, the plain one that by the next vector.
_REL_REQ = "rel AS (SELECT a.vec_id AS query_id, CAST(b.vec_id AS VARCHAR) AS requirement_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"
_PLAIN = "plain_scores AS (SELECT a.vec_id - 1 AS query_id, b.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 9) AS score FROM embeddings a, embeddings b WHERE (a.vec_id - 1) % 50 = 0 AND a.vec_id >= 1)"
_POOLS = f"{_DENSE}, {_ranked('dense', 100, 'r', 'vec_id')}, {_PLAIN}, {_ranked('plain_scores', 20, 'p', 'vec_id')}, {_REL_REQ}, kept AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE score >= 0.1)"
_CANDIDATE = f"({_strip('q')} <> '' AND (regexp_matches({_strip('q')}, '^\\(?[a-zA-Z0-9]{{1,3}}[.)]\\s') OR len({_words(_strip('q'))}) <= 20 OR {_DANG}))"
_MISSES = f"""WITH {_POOLS}, k AS (SELECT CAST(req_seq AS VARCHAR) AS requirement_id, document_id, chunk_id, coalesce(source_quote, '') AS q FROM sample_normalized_reqs), c AS (SELECT document_id, chunk_id, text FROM {_LATEST})
SELECT rel.query_id, rel.requirement_id, CASE WHEN k.requirement_id IS NULL THEN 'extraction_failure' WHEN coalesce({_garbled('k.q')}, false) OR coalesce({_garbled('c.text')}, false) THEN 'table_serialization' WHEN {_CANDIDATE} THEN 'missing_context'
WHEN r.rank IS NULL THEN 'embedding_miss' WHEN r.score < 0.1 THEN 'zero_truth_confidence_failure' WHEN p.rank IS NOT NULL AND r.rank > 20 THEN 'query_filter_issue' ELSE 'ranking_miss' END AS category
FROM rel LEFT JOIN kept ON kept.query_id = rel.query_id AND CAST(kept.vec_id AS VARCHAR) = rel.requirement_id AND kept.n <= 20 LEFT JOIN k ON k.requirement_id = rel.requirement_id LEFT JOIN c ON c.document_id = k.document_id AND c.chunk_id = k.chunk_id
LEFT JOIN r ON r.query_id = rel.query_id AND CAST(r.vec_id AS VARCHAR) = rel.requirement_id LEFT JOIN p ON p.query_id = rel.query_id AND CAST(p.vec_id AS VARCHAR) = rel.requirement_id WHERE kept.n IS NULL"""
_GRABS = f"""WITH {_POOLS}, k AS (SELECT CAST(req_seq AS VARCHAR) AS requirement_id, document_id, chunk_id FROM sample_normalized_reqs), places AS (SELECT DISTINCT query_id, document_id, chunk_id FROM rel JOIN k USING (requirement_id) WHERE chunk_id IS NOT NULL)
SELECT kept.query_id, k.requirement_id, kept.n AS rank FROM kept JOIN k ON k.requirement_id = CAST(kept.vec_id AS VARCHAR) SEMI JOIN places ON places.query_id = kept.query_id AND places.document_id = k.document_id AND places.chunk_id = k.chunk_id WHERE kept.n <= 20 AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.query_id = kept.query_id AND rel.requirement_id = k.requirement_id)"""


def _searched(spark, d):
    """(relevant, pool, plain, reqs): as ``_POOLS`` says."""
    v = _t(spark, d, "embeddings")
    named = lambda x: x.withColumn("requirement_id", F.col("vec_id").cast("string")).drop("vec_id")
    plain = R.dense_top(v, v.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("query_vector")).where("query_id % 50 = 0 and query_id >= 0"), "vec_id", "embedding", 20)
    r = reqs(spark, d).withColumn("requirement_id", F.col("req_seq").cast("string")).withColumn("source_quote", F.coalesce("source_quote", F.lit(""))).drop("parent_stem")
    return named(_relevant(spark, d)), named(R.top(_dense(spark, d), 100, "vec_id")), named(R.top(plain, 20, "vec_id")), r


@query(_MISSES)
def miss_classification(spark, d):
    """Why each relevant row was not shown, by eight categories."""
    rel, pool, plain, r = _searched(spark, d)
    return D.miss_categories(rel, pool, plain, r, C.latest_delivery(chunks(spark, d)), floor=0.1)


@query(_GRABS)
def over_grab_ranks(spark, d):
    rel, pool, _, r = _searched(spark, d)
    return D.over_grabs(pool, rel, r, floor=0.1).select("query_id", "requirement_id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT category, count(x.category_) AS n FROM (VALUES {', '.join(f'''('{c}')''' for c in D.CATEGORIES)}) v(category) LEFT JOIN (SELECT category AS category_ FROM ({_MISSES}) UNION ALL SELECT 'over_grab' FROM ({_GRABS})) x ON x.category_ = v.category GROUP BY category")
def category_prevalence(spark, d):
    """How often each of the eight categories is met, zeros kept."""
    return D.prevalence(miss_classification(spark, d), over_grab_ranks(spark, d))


_BY_KEY = "SELECT m.doc_key, r.source_quote, r.confidence FROM sample_normalized_reqs r JOIN source_manifest m USING (source_pdf)"


@query(
    f"""WITH k AS ({_BY_KEY}), e AS (SELECT failure_seq, requirement_id, doc_key, {_norm('quote')} AS q FROM labeled_failures WHERE quote IS NOT NULL), alive AS (SELECT DISTINCT doc_key, {_norm('source_quote')} AS q FROM k WHERE confidence >= 0.8), lost AS (SELECT DISTINCT doc_key, {_norm('source_quote')} AS q FROM k WHERE confidence < 0.8)
SELECT failure_seq AS query_id, requirement_id, CASE WHEN alive.q IS NOT NULL THEN false WHEN lost.q IS NOT NULL THEN true END AS confirmed FROM e LEFT JOIN alive ON alive.doc_key = e.doc_key AND alive.q = e.q LEFT JOIN lost ON lost.doc_key = e.doc_key AND lost.q = e.q"""
)
def extraction_losses(spark, d):
    """Audited quotes against the confident rows, as alive, and the others, as rejected."""
    k = reqs(spark, d).join(_t(spark, d, "source_manifest").select("source_pdf", "doc_key"), "source_pdf").withColumn("source_quote", _sigma(F.col("source_quote")))
    e = _t(spark, d, "labeled_failures").where("quote is not null").select(F.col("failure_seq").alias("query_id"), "requirement_id", "doc_key", "quote")
    return D.extraction_loss(e, k.where("confidence >= 0.8"), k.where("confidence < 0.8"))


_SHAPED = f"SELECT query_id, CASE WHEN query_id % 500 = 0 THEN 'zero' ELSE 'broad' END AS shape, CASE WHEN query_id % 350 = 0 THEN 0 ELSE n_relevant END AS n_relevant, CASE WHEN query_id % 450 = 0 THEN 'timeout' END AS error, query_id % 7 AS returned, recall_5, recall_10, recall_20, mrr FROM ({_MET})"


@query(
    f"""WITH q AS (SELECT *, error IS NULL AND shape <> 'zero' AND n_relevant > 0 AS s FROM ({_SHAPED})) SELECT round(avg(CASE WHEN s THEN recall_5 END), 4) AS mean_recall_5, round(avg(CASE WHEN s THEN recall_10 END), 4) AS mean_recall_10, round(avg(CASE WHEN s THEN recall_20 END), 4) AS mean_recall_20, round(avg(CASE WHEN s THEN mrr END), 4) AS mean_mrr,
count_if(s) AS scored, count_if(error IS NULL AND shape = 'zero') AS zero, round(avg(CASE WHEN error IS NULL AND shape = 'zero' THEN returned END), 2) AS zero_returned, count_if(error IS NULL AND shape <> 'zero' AND n_relevant = 0) AS unscored, count_if(error IS NOT NULL) AS failed FROM q"""
)
def harness_totals(spark, d):
    """Means over scored queries with the off-topic, unscored and failed ones counted apart."""
    q = F.col("query_id")
    m = retrieval_metrics(spark, d).withColumns({"shape": F.when(q % 500 == 0, "zero").otherwise("broad"), "n_relevant": F.when(q % 350 == 0, 0).otherwise(F.col("n_relevant")), "error": F.when(q % 450 == 0, "timeout"), "returned": q % 7})
    return D.harness_totals(m)


_REJECTED = f"CASE WHEN ends_with({_strip('q')}, ':') THEN 'unrepairable_fragment' WHEN {_CITE} THEN 'orphaned_list_item' WHEN {_DANG} THEN 'dangling_clause' END"
_GATED = f"SELECT coalesce(category, 'REAL') AS category, subtype, {_REJECTED} AS rule FROM (SELECT *, coalesce(quote, '') AS q FROM labeled_failures)"


def _labelled(spark, d):
    return _t(spark, d, "labeled_failures").withColumn("category", F.coalesce("category", F.lit("REAL")))


@query(
    f"""WITH g AS ({_GATED}), n AS (SELECT count_if(category = 'REAL' AND rule IS NOT NULL) AS real_rejected, count_if((category IN ('OVER_GRAB', 'JUDGMENT') OR (category <> 'REAL' AND subtype = 'malformed_garbled')) AND rule IS NOT NULL) AS scope_violations,
(count_if(category <> 'REAL' AND subtype = 'colon_too_long' AND rule = 'unrepairable_fragment') < 3)::INT + (count_if(category <> 'REAL' AND subtype = 'orphaned_list_item' AND rule = 'orphaned_list_item') < 2)::INT + (count_if(category <> 'REAL' AND subtype = 'dangling_clause' AND rule = 'dangling_clause') < 1)::INT AS coverage_regressions FROM g)
SELECT *, real_rejected + scope_violations + coverage_regressions = 0 AS passed FROM n"""
)
def rule_gate(spark, d):
    """The quote rules on audited rows: what must not be rejected and what must be caught."""
    return D.rule_gate(_labelled(spark, d), {"colon_too_long": 3, "orphaned_list_item": 2, "dangling_clause": 1})


@query(f"SELECT subtype, count(*) AS n, count_if(b) AS before, count_if(a) AS after, count_if(a AND NOT b) AS gained, count_if(b AND NOT a) AS lost FROM (SELECT subtype, coalesce(unrepairable_fragment, false) AS b, ends_with({_strip('q')}, ':') AS a FROM (SELECT *, coalesce(quote, '') AS q FROM labeled_failures)) GROUP BY subtype")
def rule_variants(spark, d):
    """The stored fragment flag against the rule as it is now."""
    return D.rules_before_and_after(_t(spark, d, "labeled_failures"), F.col("unrepairable_fragment"), Q.is_fragment(F.coalesce("quote", F.lit(""))))


@query(
    f"""WITH places AS (SELECT requirement_id, arg_min({{'d': document_id, 'c': chunk_id}}, req_seq) AS p FROM sample_normalized_reqs GROUP BY requirement_id)
SELECT failure_seq, r.req_seq AS candidate, {_strip("coalesce(r.source_quote, '')")} = {_strip("coalesce(f.quote, '')")} AS is_label, c.text IS NOT NULL AS has_text FROM labeled_failures f JOIN places USING (requirement_id) JOIN sample_normalized_reqs r ON r.document_id = p.d AND r.chunk_id = p.c LEFT JOIN {_LATEST} c ON c.document_id = p.d AND c.chunk_id = p.c"""
)
def traced_labels(spark, d):
    """Each audited quote with all that was extracted from its chunk."""
    t = D.traced_labels(_t(spark, d, "labeled_failures").select("failure_seq", "requirement_id", "subtype", "quote"), reqs(spark, d), C.latest_delivery(chunks(spark, d)))
    return t.select("failure_seq", "candidate", "is_label", F.col("chunk_text").isNotNull().alias("has_text"))


@query()
def prompt_comparison(spark, d):
    """What an offline extractor takes from the chunks under two templates."""
    from .providers import OfflineExtractor

    c = C.latest_delivery(chunks(spark, d)).select(F.when(F.length("text") > 1500, "long").otherwise("short").alias("group"), "document_id", "chunk_id", "text")
    return D.prompt_comparison(c, {"plain": "{text}", "headed": "Extract.\n\n{text}"}, OfflineExtractor(["shall", "must"]))


@query(f"SELECT count_if(NOT faithful AND score >= 0.5) AS false_negatives, count_if(NOT faithful) AS bad, count_if(faithful AND score < 0.5) AS false_positives, count_if(faithful) AS good FROM ({_SCORED})")
def support_errors(spark, d):
    return D.support_errors(_scored(spark, d), 0.5)


@query("SELECT failure_seq, least(1.0, coalesce(word_count, 0) / 40.0) < 0.5 AS rejected, category = 'FRAGMENT' AS expected, (least(1.0, coalesce(word_count, 0) / 40.0) < 0.5) = (category = 'FRAGMENT') AS correct, min((least(1.0, coalesce(word_count, 0) / 40.0) < 0.5) = (category = 'FRAGMENT')) OVER () AS all_correct FROM labeled_failures WHERE category IS NOT NULL")
def regression_checked(spark, d):
    s = _t(spark, d, "labeled_failures").where("category is not null").select("failure_seq", (F.col("category") != "FRAGMENT").alias("faithful"), F.least(F.lit(1.0), F.coalesce("word_count", F.lit(0)) / 40.0).alias("score"))
    return D.regression_checked(s, 0.5).select("failure_seq", "rejected", "expected", "correct", "all_correct")


@query('SELECT q.vec_id AS "case", round(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS bare, round(coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 0), 6) AS stemmed FROM embeddings q JOIN embeddings b ON b.vec_id = q.vec_id + 1 JOIN embeddings s ON s.vec_id = q.vec_id + 2')
def stem_deltas(spark, d):
    """Each vector as a question with the next two as the bare and the stemmed quote."""
    v = _t(spark, d, "embeddings")
    at = lambda n, name: v.select((F.col("vec_id") - n).alias("case"), F.col("embedding").alias(name))
    return D.stem_deltas(at(0, "query_vector").join(at(1, "bare_vector"), "case").join(at(2, "stem_vector"), "case")).select("case", "bare", "stemmed")


@query("SELECT stem, chunk_id, fp, fn FROM (SELECT document_id AS stem, chunk_id, count_if(confidence < 0.8) AS fp, count_if(coalesce(description, '') = '') AS fn FROM sample_normalized_reqs WHERE document_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL) ORDER BY fp + fn DESC, stem, chunk_id LIMIT 10")
def worst_chunks(spark, d):
    """The ten chunks with the most doubtful or undescribed rows."""
    r = reqs(spark, d).where("document_id is not null and chunk_id is not null")
    return D.worst_chunks(r.groupBy(F.col("document_id").alias("stem"), "chunk_id").agg(F.count_if(F.col("confidence") < 0.8).alias("fp"), F.count_if(F.coalesce("description", F.lit("")) == "").alias("fn")))


_MADE = "SELECT document_id AS stem, chunk_id, req_seq, source_quote FROM sample_normalized_reqs WHERE document_id < 'a' AND chunk_id IS NOT NULL AND source_quote IS NOT NULL"


@query(f"WITH x AS ({_MADE}), q AS (SELECT stem, chunk_id, count(*) AS n, string_agg(CAST(length(source_quote) AS VARCHAR), ',' ORDER BY req_seq) AS lengths FROM x GROUP BY ALL) SELECT c.chunk_seq, CASE WHEN c.document_id NOT IN (SELECT stem FROM x) THEN 'missing_file' WHEN q.n IS NULL THEN 'empty_model_output' ELSE 'seeded' END AS outcome, coalesce(lengths, '') AS lengths FROM {_LATEST} c LEFT JOIN q ON q.stem = c.document_id AND q.chunk_id = c.chunk_id WHERE c.document_id IS NOT NULL AND c.chunk_id IS NOT NULL")
def seeded_gold(spark, d):
    """Chunks with what was extracted of them, for documents of which there is a run."""
    x = reqs(spark, d).where("document_id < 'a' and chunk_id is not null and source_quote is not null").select(F.col("document_id").alias("stem"), "chunk_id", F.col("req_seq").alias("seq"), "source_quote")
    g = C.latest_delivery(chunks(spark, d)).where("document_id is not null and chunk_id is not null").select("chunk_seq", F.col("document_id").alias("stem"), "chunk_id")
    return D.seeded_gold(g, x, x).select("chunk_seq", "outcome", F.array_join(F.transform("quotes", lambda q: F.length(q).cast("string")), ",").alias("lengths"))


_HAS = [f"CASE WHEN regexp_matches({{0}}, '\\b{v}\\b') THEN '{v}' END" for v in ("shall", "must", "will", "is required to")]
_HELD = "list_filter([" + ", ".join(_HAS) + "], lambda v: v IS NOT NULL)"


@query(f"SELECT req_seq, len(list_filter({_HELD.format(_norm('description'))}, lambda v: NOT list_contains({_HELD.format(_norm('source_quote'))}, v))) > 0 AS modality FROM sample_normalized_reqs WHERE source_quote IS NOT NULL AND description IS NOT NULL")
def modality_flags(spark, d):
    """Descriptions that hold an obligation word their quote does not."""
    r = reqs(spark, d).where("source_quote is not null and description is not null")
    return r.select("req_seq", D.modality_shaped(F.col("source_quote"), F.col("description"), ("shall", "must", "will", "is required to")).alias("modality"))


@query()
def harvest_router(spark, d):
    """Rows by how their description relates to the quote, with a sample of the clean ones."""
    return D.harvested(reqs(spark, d), ("shall", "must", "will", "is required to"), 500).select("req_seq", "route")


# ---- index ------------------------------------------------------------------------
_LAST_REQ = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY ingested_at DESC NULLS LAST, req_seq DESC) AS _n FROM sample_normalized_reqs WHERE requirement_id IS NOT NULL AND " + _strip("coalesce(source_quote, '')") + " <> '') WHERE _n = 1)"


def _length_vector(text):
    return F.array(F.length(text).cast("double"), F.lit(1.0))


def _uuid_sql(x: str) -> str:
    h = f"sha1(unhex('{I.URL_NAMESPACE}') || encode({x}))"
    return f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h},17,1)), 1)||substr({h},18,3)||'-'||substr({h},21,12)"


@query(
    f"""SELECT {_uuid_sql('requirement_id')} AS point_id, requirement_id, length({_strip('source_quote')}) + CASE WHEN {_strip("coalesce(source_ref, '')")} <> '' THEN 6 + length({_strip('source_ref')}) ELSE 0 END AS embedded_chars, coalesce(document_id, '') AS document_id, coalesce(source_ref, '') AS source_ref, array_to_string(coalesce(domain_tags, []), ',') AS tags, page_start,
coalesce(confidence, 0.0) AS confidence, coalesce(domain_profile, 'cybersecurity') AS domain_profile, parent_section_ref, array_to_string(coalesce(child_section_refs, []), ',') AS children, 2 AS embedding_dim FROM {_LAST_REQ}"""
)
def requirement_points(spark, d):
    """The points of requirements with their payload; the vector here is the length of the text."""
    p = X.requirement_points(reqs(spark, d), I.URL_NAMESPACE, _length_vector, "lengths", ["ingested_at", "req_seq"])
    return p.select("point_id", "requirement_id", p["dense"][0].cast("int").alias("embedded_chars"), "document_id", "source_ref", F.array_join("domain_tags", ",").alias("tags"), "page_start", "confidence", "domain_profile", "parent_section_ref", F.array_join("child_section_refs", ",").alias("children"), "embedding_dim")


@query(f"SELECT {_uuid_sql('document_id || chr(58) || chunk_id')} AS point_id, document_id, chunk_id, least(length(coalesce(text, '')), 1500) AS embedded_chars, length(coalesce(text, '')) AS chars FROM {_LATEST} WHERE coalesce(document_id, '') <> '' AND chunk_id IS NOT NULL")
def context_points(spark, d):
    """The points of chunks: the whole text is kept, 1500 characters of it are embedded."""
    p = X.context_points(chunks(spark, d), _length_vector, "lengths", ["ingested_at", "chunk_seq"])
    return p.select("point_id", "document_id", "chunk_id", p["dense"][0].cast("int").alias("embedded_chars"), F.length("text").alias("chars"))


# ---- what readers see ---------------------------------------------------------------
_ITEMPATH = "SELECT document_id, chunk_id, bool_and(section_title_path IS NOT NULL AND " + _SKIP + ") AS every FROM sample_normalized_reqs GROUP BY ALL"


@query(f"SELECT document_id, chunk_id FROM ({_ITEMPATH}) WHERE every")
def skipped_chunks(spark, d):
    """Chunks whose every row is under a skipped heading."""
    return C.skipped_by_items(reqs(spark, d), SKIPS)


@query("WITH f AS (SELECT document_id AS doc_key, arg_min(source_pdf, req_seq) AS source_pdf FROM sample_normalized_reqs WHERE run_timestamp LIKE '2025%' GROUP BY document_id) SELECT k.doc_key, coalesce(f.source_pdf, '') AS source_pdf, coalesce(nullif(f.source_pdf, ''), CASE WHEN ends_with(lower(k.doc_key), '.pdf') THEN k.doc_key ELSE k.doc_key || '.pdf' END) AS canonical FROM (SELECT DISTINCT document_id AS doc_key FROM sample_chunks) k LEFT JOIN f USING (doc_key)")
def source_of_keys(spark, d):
    """The file of each document's current run, and the name it goes by."""
    r = reqs(spark, d).where("run_timestamp like '2025%'").withColumnRenamed("document_id", "doc_key").withColumn("run_dir", F.lit("r"))
    s = V.source_of_keys(chunks(spark, d).select(F.col("document_id").alias("doc_key")), r, r.select("doc_key", "run_dir").distinct())
    return s.withColumn("canonical", V.canonical_source(F.col("doc_key"), F.col("source_pdf")))


@query("SELECT chunk_seq, CASE WHEN len(coalesce(section_title_path, [])) > 0 THEN array_to_string(section_title_path, ' › ') ELSE '—' END AS path, coalesce(CASE WHEN trim(source_pdf) <> '' THEN source_pdf END, document_id) AS name FROM sample_chunks")
def shown_names(spark, d):
    return chunks(spark, d).select("chunk_seq", V.shown_path(F.col("section_title_path")).alias("path"), V.shown_name(F.col("source_pdf"), F.col("document_id")).alias("name"))

"""Text expressions: everything here is a Column built from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it (Java's ``\s`` is ASCII only).
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
# Heading prefixes and keywords, reference patterns, private-use ligatures, dot leaders, list markers.
_HEADING_PREFIX = r"^(?i:(?:appendix|attachment|annex|section|chapter|part|addendum|enclosure|exhibit)\s+[\w.-]+\s*[-–—:.]?\s*|\d+(?:\.\d+)*\.?\s+|[a-z]\.\s+)"
_NUMBERED = r"^(?i:([a-z]?\d+(?:\.\d+)*))"
_KEYWORD = r"^(?i:(section|enclosure|appendix|annex|attachment)\s+(\w+))"
REF_PATTERNS = (
    r"\b[A-Z]{2,4}-\d+(?:\([a-zA-Z0-9]+\))*(?!\w)",
    r"\b(?i:Section|Sec\.)\s+\d+(?:\.\d+)*",
    r"\b(?i:Para(?:graph)?)\s+\d+(?:\.\d+)*",
    r"\b\d+\.\d+(?:\.\d+)+\b",
)
LIGATURES = {"": "ti", "": "tt", "": "ft", "": "tt", "": "tf"}
TOC_LEADER = r"\.{5,}"
LIST_MARKER = r"^\(?[a-zA-Z0-9]{1,3}[.)]\s"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(x: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), f"{SPACE}+", " "))


def normalize_heading(x: Column) -> Column:
    """As ``normalize_text`` without one leading number, letter or section keyword."""
    return F.trim(F.regexp_replace(normalize_text(x), _HEADING_PREFIX, ""))


def normalize_filter_value(x: Column) -> Column:
    return F.translate(F.lower(stripped(x)), " _", "--")


def heading_depth(x: Column) -> Column:
    """Segments of the leading number; 1 for keyword and prose headings."""
    number = F.regexp_extract(stripped(x), _NUMBERED, 1)
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1


def section_ref(x: Column) -> Column:
    """The leading number, else KEYWORD-WORD, else an empty string."""
    t = stripped(x)
    word = F.regexp_extract(t, _KEYWORD, 1)
    return (
        F.when(F.regexp_extract(t, _NUMBERED, 1) != "", F.regexp_extract(t, _NUMBERED, 1))
        .when(word != "", F.upper(F.concat(word, F.lit("-"), F.regexp_extract(t, _KEYWORD, 2))))
        .otherwise("")
    )


def breadcrumb(path: Column, header: Column) -> Column:
    return F.when(F.size(F.coalesce(path, F.array())) > 0, F.array_join(path, " > ")).otherwise(F.coalesce(header, F.lit("")))


def prompt_text(crumb: Column, raw: Column) -> Column:
    return F.when(crumb != "", F.concat(F.lit("["), crumb, F.lit("]\n\n"), raw)).otherwise(raw)


def embedding_text(stemmed: Column, quote: Column, ref: Column) -> Column:
    """Null without a quote; else the stemmed text or quote, and the reference below."""
    body = F.coalesce(F.nullif(stemmed, F.lit("")), quote)
    has_ref = F.coalesce(ref, F.lit("")) != ""
    return F.when(F.coalesce(quote, F.lit("")) == "", None).otherwise(F.concat(body, F.when(has_ref, F.concat(F.lit("\nRef: "), ref)).otherwise("")))


def is_ipv4(x: Column) -> Column:
    parts = F.split(x, r"\.")
    return x.rlike(r"^\d+(?:\.\d+){3}$") & F.forall(parts, lambda p: (F.length(p) <= 9) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def scan_source_refs(x: Column, most: int = 20) -> Column:
    """References of the pattern families in order, IPv4 dropped, the first ``most``, sorted."""
    found = F.concat(*(F.regexp_extract_all(x, F.lit(p), 0) for p in REF_PATTERNS))
    return F.array_sort(F.slice(F.array_distinct(F.filter(found, lambda r: ~is_ipv4(r))), 1, most))


def page_refs(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.array().cast("array<int>")).when(end > start, F.sequence(start, end)).otherwise(F.array(start))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), "").when(end > start, F.format_string("pp. %d–%d", start, end)).otherwise(F.format_string("p. %d", start))


def csv_safe(x: Column) -> Column:
    """A quote sign before text that a spreadsheet would read as a formula."""
    return F.when(F.regexp_replace(x, f"^{SPACE}+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def snippet(x: Column, n: int, more: str) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(more))).otherwise(x)


def context_window(text: Column, quote: Column, window: int = 300) -> Column:
    """``window`` characters around the quote, dots on clipped sides; else the head."""
    at = F.when(F.coalesce(quote, F.lit("")) != "", F.position(quote, text)).otherwise(0)
    lo, hi = F.greatest(at - window, F.lit(1)), F.least(at + F.length(quote) + window, F.length(text) + 1)
    inside = F.concat(F.when(lo > 1, "...").otherwise(""), F.substr(text, lo, hi - lo), F.when(hi <= F.length(text), "...").otherwise(""))
    return F.when(at > 0, inside).otherwise(snippet(text, 600, "..."))


def first_real_colon(x: Column) -> Column:
    """1-based place of the first colon that begins no ``://``; 0 without one."""
    return F.regexp_instr(x, F.lit(r":(?!//)"))


def ligatures_repaired(x: Column, table: dict[str, str] | None = None) -> Column:
    for seen, meant in (table or LIGATURES).items():
        x = F.replace(x, F.lit(seen), F.lit(meant))
    return x


def ligature_count(x: Column, table: dict[str, str] | None = None) -> Column:
    return F.length(x) - F.length(F.translate(x, "".join(table or LIGATURES), ""))


def is_toc_text(x: Column, leader: str = TOC_LEADER, share: float = 0.4) -> Column:
    """More than ``share`` of the non-blank lines have dot leaders."""
    lines = F.filter(F.split(x, "\r?\n"), lambda ln: stripped(ln) != "")
    return F.coalesce(F.try_divide(F.size(F.filter(lines, lambda ln: ln.rlike(leader))), F.size(lines)), F.lit(0.0)) > share


def in_skipped_section(path: Column, skips: list[str]) -> Column:
    """Some heading equals or starts with a skip phrase."""
    phrases = [" ".join(s.lower().split()) for s in skips if s.strip()]
    if not phrases:
        return F.lit(False)
    starts = lambda h: F.reduce(F.array(*map(F.lit, phrases)), F.lit(False), lambda acc, s: acc | F.startswith(normalize_heading(h), s))
    return F.coalesce(F.exists(path, starts), F.lit(False))


def garbled_table(x: Column, pattern: str = r"[A-Za-z][A-Za-z0-9 &/\-]{2,40}\s=\s", least: int = 2) -> Column:
    return F.regexp_count(x, F.lit(pattern)) >= least


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, f"{SPACE}+"), lambda w: w != ""))

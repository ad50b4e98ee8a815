"""Text that looks the same brought to one form.

Every word with a character outside ASCII is read by a weighted edit automaton that
walks a trie of the corpus vocabulary: look-alike letters, wide, styled and joined
forms and ignorable characters cost nothing, a changed accent or letter costs. The
cheapest (then most frequent) word within the budget gives the spelling; a word the
vocabulary does not hold is normalised by table. Words wholly in another script keep
their letters, ordinary symbols and private-use characters stay as they are.
"""

from __future__ import annotations

import unicodedata as ud
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged

#: Letters of other scripts and the Latin letters they look like, likeliest first.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j",
    "к": "k", "м": "m", "н": "hn", "о": "o", "р": "p", "с": "c", "т": "t", "у": "yu", "х": "x", "г": "r", "п": "n", "и": "u",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ӏ": "l", "ь": "b", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "α": "a",
    "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x",
    "ω": "w", "ϲ": "c", "ϳ": "j",
}
#: Compatibility kinds that are another shape of the same letters.
_STYLED = ("<wide>", "<narrow>", "<font>")
_IGNORABLE = "\\p{Cf}\ufe00-\ufe0f\u034f\u115f\u1160\u17b4\u17b5\u3164"
_SPACE = regex.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_RUN = regex.compile(rf"[\p{{L}}\p{{M}}\p{{N}}{_IGNORABLE}]+|[\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\uffe0-\uffe6]")
_INVISIBLE = regex.compile(rf"[{_IGNORABLE}]")
_LATIN = regex.compile(r"\p{Latin}")
_JOINING = regex.compile(r"[^\P{L}\p{Latin}\p{Greek}\p{Cyrillic}\p{Common}]")
#: Values with none of these need no look: all they hold stays.
SUSPECT = r"[^\x00-\x7F]"


def _shape(ch: str) -> str:
    """The letters a wide, styled or joined form stands for, else the character."""
    kind = ud.decomposition(ch).split(" ")[0]
    if kind in _STYLED or kind == "<compat>" and ud.category(ch) in ("Ll", "Lu", "Lt", "Lo") and len(ud.normalize("NFKC", ch)) > 1:
        return ud.normalize("NFKC", ch)
    return ch


class Automaton:
    """Zero-cost and costly readings of a word against a trie of spellings."""

    def __init__(self, counts: dict[str, int], budget: float = 0.0, accent: float = 0.5, letter: float = 1.0):
        self.root: dict = {}
        self.budget, self.accent, self.letter = budget, accent, letter
        for word, n in counts.items():
            node = self.root
            for c in word.lower():
                node = node.setdefault(c, {})
            node[""] = max(n, node.get("", 0))

    def _readings(self, ch: str) -> list[tuple[str, float]]:
        if _INVISIBLE.match(ch):
            return [("", 0.0)]
        s = _shape(ch)
        out = [(s.lower(), 0.0)] + [(x.lower(), 0.0) for x in LOOK_ALIKES.get(ch, "")]
        if self.budget >= self.accent and len(s) == 1 and (base := ud.normalize("NFD", s)[0].lower()) != s.lower():
            out.append((base, self.accent))
        return out

    def spelling(self, word: str) -> str | None:
        states: dict[int, tuple[float, dict, str]] = {id(self.root): (0.0, self.root, "")}
        for ch in word:
            after: dict[int, tuple[float, dict, str]] = {}

            def reach(cost: float, node: dict, text: str) -> None:
                if cost <= self.budget and (id(node) not in after or after[id(node)][0] > cost):
                    after[id(node)] = (cost, node, text)

            for cost, node, text in states.values():
                for s, w in self._readings(ch):
                    at = node
                    for c in s:
                        at = at.get(c) if c else None
                        if at is None:
                            break
                    if at is not None:
                        reach(cost + w, at, text + (s.upper() if ch.isupper() or _shape(ch).isupper() else s))
                if cost + self.letter <= self.budget:
                    for c, at in node.items():
                        if c:
                            reach(cost + self.letter, at, text + c)
            if not (states := after):
                return None
        ends = [(cost, -node[""], text) for cost, node, text in states.values() if "" in node]
        return min(ends)[2] if ends else None


def _by_table(word: str, latin: bool) -> str:
    out = []
    for ch in word:
        if _INVISIBLE.match(ch):
            continue
        s = _shape(ch)
        out.append(LOOK_ALIKES.get(ch, s)[:1] if latin and s == ch and ch in LOOK_ALIKES else s)
    return "".join(out)


def consistent_word(word: str, automaton: Automaton) -> str:
    """One form of a run of letters, marks, digits and ignorables."""
    if word.isascii():
        return word
    if _JOINING.search(word) and not _LATIN.search(word):
        return ud.normalize("NFC", word)
    composed = ud.normalize("NFC", _INVISIBLE.sub("", word))
    latin = any(_LATIN.match(_shape(c)) for c in composed)
    if latin and composed and not composed.isascii():
        if (s := automaton.spelling(composed)) is not None:
            return s
    return ud.normalize("NFC", _by_table(composed, latin))


def consistent(text: str, automaton: Automaton, cache: dict[str, str]) -> str:
    if text.isascii():
        return text

    def one(m: regex.Match) -> str:
        w = m.group()
        if w.isascii():
            return w
        if (s := cache.get(w)) is None:
            if len(cache) > 200_000:
                cache.clear()
            s = cache[w] = consistent_word(w, automaton)
        return s

    return _RUN.sub(one, _SPACE.sub(" ", text))


def vocabulary(values: DataFrame, share: float = 1e-6, least: int = 3) -> dict[str, int]:
    """Counts of the words of ``values.value`` written in Latin letters, over all rows;
    those of at least ``share`` of all words, which bounds the table to ``1 / share``."""
    words = values.select(F.explode(F.regexp_extract_all("value", F.lit(r"\p{IsLatin}{2,}"), 0)).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    counts = staged(counts, "vocabulary")
    total = counts.agg(F.sum("n")).first()[0] or 0
    plain = F.col("w").rlike(r"^[A-Za-zÀ-ɏ]+$")
    return {r["w"]: r["n"] for r in counts.where(plain & (F.col("n") >= max(least, int(total * share)))).collect()}


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(key: str, counts, budget: float) -> Automaton:
    """One trie a process for each run of the operator, however many tasks it has."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(counts.value, budget)
    return _AUTOMATA[key]


def _suspects(values: DataFrame, budget: float) -> DataFrame:
    """The values with a character outside ASCII, with ``consistent``."""
    counts, key = values.sparkSession.sparkContext.broadcast(vocabulary(values, least=3)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = _automaton(key, counts, budget), {}
        for b in batches:
            out = [consistent(v, automaton, cache) for v in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("field_name"), b.column("row_seq"), b.column("value"), pa.array(out, pa.string())], ["field_name", "row_seq", "value", "consistent"])

    return values.where(F.col("value").rlike(SUSPECT)).mapInArrow(run, "field_name string, row_seq long, value string, consistent string")


def consistent_column(values: DataFrame, budget: float = 0.0) -> DataFrame:
    """(field_name, row_seq, value) to the same rows with ``consistent`` added. Nulls
    stay null, empty texts empty; whole texts are read, of any length."""
    rest = values.where(F.col("value").isNull() | ~F.col("value").rlike(SUSPECT))
    return _suspects(values, budget).unionByName(rest.withColumn("consistent", F.col("value")))


def values_of(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(field_name, row_seq, value), one row for each named text column of each row."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields)))
    d = df.select(F.col(key).cast("long").alias("row_seq"), each.alias("x"))
    return d.select("x.field_name", "row_seq", "x.value")


def found(chunks: DataFrame, reqs: DataFrame) -> DataFrame:
    """(field_name, row_seq) of the values that the consistent form changes."""
    values = values_of(chunks, "chunk_seq", "text").unionByName(values_of(reqs, "req_seq", "source_quote"))
    # a value of ASCII only is its own consistent form
    changed = _suspects(values, 0.0).where("value <> consistent and row_seq is not null")
    return changed.select("field_name", "row_seq").distinct()

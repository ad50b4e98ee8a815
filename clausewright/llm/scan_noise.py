"""Text of scanned pages repaired into continuous paragraphs.

Running heads and page numbers go first, then words divided at line ends are joined,
then misread words are corrected by a noisy channel: candidates come from inverse
character confusions, each with its probability, and the word as it is read; the corpus
gives word and word-pair likelihoods, and a Viterbi pass over the doubtful words and
their neighbours picks the likeliest reading. A word is wrong where that is not the one
read. Counts are taken over all different values; the tables sent to executors
hold only words and pairs above a share of all, which bounds them.

A running head is known because it repeats: the same piece of a line, but for its
digits, on several pages of one publication or, with digits, of several publications;
a publication's own title and key, if there is a register of them, count too. These
are joined to the rows of their publication. A bare number is a page number where it
is the page its row is on or the next to it, or other numbers stand alone on other
pages as well.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import staged
from .lookalikes import Automaton, consistent

#: What is read, what stood there, and how often it is so misread.
CONFUSIONS = (
    ("c", "e", 3e-3), ("f", "t", 2e-3), ("1", "i", 2e-3), ("1", "l", 1e-3), ("!", "i", 1e-3), ("!", "l", 3e-4), ("@", "a", 1e-3), ("0", "o", 2e-3),
    ("|", "l", 1e-3), ("|", "i", 5e-4), ("5", "s", 1e-3), ("$", "s", 5e-4), ("9", "g", 1e-3), ("6", "b", 1e-3), ("8", "b", 3e-4), ("3", "e", 3e-4),
    ("ri", "n", 1e-3), ("li", "h", 1e-3), ("rn", "m", 1e-3), ("ii", "u", 1e-3), ("cl", "d", 1e-3), ("vv", "w", 1e-3), ("m", "in", 1e-3), ("m", "rn", 2e-4), ("d", "cl", 1e-4),
    ("l", "i", 2e-4), ("i", "l", 2e-4), ("b", "h", 2e-4), ("h", "b", 2e-4), ("u", "n", 1e-4), ("n", "u", 1e-4), ("e", "c", 2e-4), ("t", "f", 1e-4), ("nn", "m", 1e-4), ("lt", "h", 1e-4), ("q", "g", 1e-4), ("7", "t", 1e-4), ("4", "a", 1e-4), ("h", "li", 1e-4), ("n", "ri", 1e-4), ("w", "vv", 1e-4),
)
#: Share of words that no count speaks for, of letters alone or with digits and marks, and the letters they are spelt from.
NEW, NEW_MIXED, LETTERS = 1e-3, 1e-6, 30.0
_MARK = "-¬­‐‑"
_WORD = r"[^\W_](?:[^\W_]|[|!@$](?=[^\W\d_])|[|@$](?=[\s.,;:)]|$))*|[|!@$](?=[^\W_]{2})(?:[^\W_]|[|!@$](?=[^\W\d_]))*"
_TOKEN = re.compile(_WORD)
_BROKEN = re.compile(rf"([^\W\d_][^\W_|!@$]*)([{_MARK}])([ \t]*\r?\n\s*|[ \t]+)((?:{_WORD}))")
_DIVIDED = re.compile(rf"[{_MARK}]\s")
_MARKED_CHAR = re.compile(r"[|!@$\d]")
_URL = re.compile(r"\S*(?:://|www\.)\S*")
_LIST_LINE = re.compile(r"\s*(?:\(?\w{1,4}[.)]|[•*–-])\s|\s*\d+(?:\.\d+)*\.?\s+[A-Z]|\s*[A-Z][\w ]{0,30}:\s|\s*\|")
_ITEM = re.compile(r"\s*\(([a-z0-9])\)\s")
_PAGE = r"(?:Page \d+(?: of \d+)?|p\. ?\d+|- ?\d+ ?-|\d+ ?\| ?P a g e|\[\d+\])"
_BARE = re.compile(r"(?:\d{1,3}-)?(\d{1,4})")
#: What can be a piece of a running head: a capital first, or a digit with a capital or
#: digit in the last word too; no sign of a sentence, list or field.
_PIECE = r"^(?=.*(?:[\p{L}\p{N}]\s+\S|\d))(?=.*\p{L})(?=\p{Lu}|[0-9].*(?:\s|^)[\p{Lu}0-9]\S*$)[\p{Lu}0-9][^:=|;]{0,99}(?<![.,!?¬\u00AD-])$"
_SEPARATOR = "\x1f"


class Furniture:
    """Patterns of running heads and page numbers. ``heads`` are pieces with their
    digits as #; after = comes the publication's key, which a numbered label can precede
    and a date follow. Bare numbers are page numbers by themselves where ``#`` or
    ``#-#`` is one of the heads."""

    def __init__(self, heads: tuple[str, ...] = ()):
        self.bare = {h for h in heads if h in ("#", "#-#")}
        keys = sorted({h[1:] for h in heads if h[0] == "="}, key=lambda h: (-len(h), h))
        pieces = sorted({h for h in heads if h not in self.bare and h[0] != "="}, key=lambda h: (-len(h), h))
        form = lambda h: re.sub(r"(?:\\ )+", " +", re.escape(h)).replace(r"\#", r"\d+")
        forms = [rf"(?:[A-Z][a-z]+ \d+, )?{form(k)}(?:, (?:\d{{4}}-\d\d-\d\d|undated))?" for k in keys] + [form(h) for h in pieces]
        strong = "(?:" + "|".join([*forms, _PAGE]) + ")"
        bare = r"(?:\d{1,3}-)?\d{1,4}"
        self.line = re.compile(rf"(?:{bare}\s+)?{strong}(?:\s+(?:{strong}|{bare}))*")
        starts = sorted({form(h[:12].rstrip()) for h in (*keys, *pieces)})
        self.hint = re.compile("|".join([r"Page \d|p\. ?\d|P a g e|\[\d|- ?\d+ ?-(?!\w)", *starts]))
        before = rf"(?:{bare}\s+(?=(?:{'|'.join(forms)})))?" if forms else ""
        self.inline = re.compile(rf"(?<!\S){before}{strong}(?:\s+{strong})*(?:\s{{2,}}{bare})?(?!\S)")

    def _marked(self, lines: list[str], first: int | None, last: int | None) -> list[bool]:
        kept = [ln.strip() for ln in lines]
        out = [bool(s and self.line.fullmatch(s)) for s in kept]
        numbers = [(i, m) for i, s in enumerate(kept) if s and (m := _BARE.fullmatch(s))]
        for i, m in numbers:
            n = int(m.group(1))
            here = first is not None and first - 1 <= n <= max(first, last or first) + 1
            out[i] = here or ("#-#" if "-" in kept[i] else "#") in self.bare
        for i, _ in numbers:  # beside a head
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(kept) and not kept[j]:
                    j += step
                out[i] = out[i] or 0 <= j < len(kept) and out[j]
        return out

    def without(self, text: str, first: int | None = None, last: int | None = None) -> tuple[str, bool]:
        """The text with furniture replaced by nothing, and whether it held any; ``first``
        and ``last`` are the pages it is from."""
        hit = False
        if "\n" in text:
            lines = text.split("\n")
            marked = self._marked(lines, first, last)
            if any(marked):
                hit = True
                text = "\n".join(ln for ln, out in zip(lines, marked) if not out)
                text = re.sub(r"(?<![.:;!?\s])(?:[ \t]*\r?\n){2,}|(?:[ \t]*\r?\n){2,}(?=\s*[a-z])", "\n", text)
        cut, n = self.inline.subn(" ", text) if self.hint.search(text) else (text, 0)
        return (re.sub(r"  +", " ", cut) if n else text), hit or n > 0


PLAIN = Furniture()


class Model:
    """Word and word-pair counts with the channel."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.words, self.pairs, self.total = words, pairs, max(1, sum(words.values()))
        self.inverse: dict[str, list[tuple[str, float]]] = {}
        for seen, true, p in CONFUSIONS:
            self.inverse.setdefault(seen, []).append((true, p))
        self.known: dict[str, tuple] = {}
        self.automaton, self.forms = Automaton(words), {}
        self.most = max(words.values(), default=1)
        #: A pair that is not in the table can still be seen so often.
        self.hidden = min(pairs.values(), default=1) - 1
        self.into: dict[str, int] = {}
        self.trusted: dict[str, float] = {}
        for (_, b), n in pairs.items():
            self.into[b] = max(self.into.get(b, 0), n)

    def _new(self, w: str) -> float:
        """How often a word no count speaks for is expected where it is read."""
        return self.total * (NEW_MIXED if _MARKED_CHAR.search(w) else NEW) * LETTERS ** -len(w)

    def _reached(self, w: str, least: float) -> dict[str, float]:
        """Every word of the vocabulary of which ``w`` can be a misreading, with the
        probability of the likeliest way: a walk over the trie without those below ``least``."""
        states: list[dict[int, tuple[float, dict, str]]] = [{} for _ in range(len(w) + 1)]
        states[0][id(self.automaton.root)] = (1.0, self.automaton.root, "")

        def reach(i: int, p: float, node: dict, text: str) -> None:
            if p >= least and (id(node) not in states[i] or states[i][id(node)][0] < p):
                states[i][id(node)] = (p, node, text)

        for i, c in enumerate(w):
            ways = [(k, true, q) for k in (1, 2) if i + k <= len(w) for true, q in self.inverse.get(w[i : i + k], ())]
            for p, node, text in states[i].values():
                if (at := node.get(c)) is not None:
                    reach(i + 1, p, at, text + c)
                for k, true, q in ways:
                    at = node
                    for x in true:
                        if (at := at.get(x)) is None:
                            break
                    else:
                        reach(i + k, p * q, at, text + true)
        # letters in another order were mistyped, not misread
        return {u: p for p, node, u in states[-1].values() if "" in node and u != w and sorted(u) != sorted(w)}

    def _true(self, w: str, ups: dict[str, float] | None = None) -> float:
        """How often a word of the counts stood there itself: not those times that can
        be misreadings of a commoner word, with room for pages that are read badly."""
        if (n := self.trusted.get(w)) is None:
            ups = self._reached(w, 1e-12) if ups is None else ups
            slack = max((8 * self.words[u] * p + (2 if self.words[u] >= 20 else 0) for u, p in ups.items()), default=0.0)
            n = max(0.0, self.words.get(w, 0) - slack)
            if w in self.words:
                self.trusted[w] = n
        return n

    def readings(self, w: str) -> tuple[tuple[str, float, float, bool], ...]:
        """(word, log channel probability, count as a true word, as read) of what a
        doubtful word can be, itself first; nothing for a word that no context changes."""
        if (r := self.known.get(w)) is not None:
            return r
        own, new = self.words.get(w, 0), self._new(w)
        ups = self._reached(w, new / (self.most * 1e6) if own == 0 else 1e-12)
        s = self._true(w, ups)
        stay = max(1e-6, 1.0 - sum(ups.values()))
        unseen, best = min(s, self.hidden), []
        for u, p in ups.items():
            n = self._true(u)
            # the most that pairs before and after can speak for u against w
            gain = max(self.into.get(u, 0) / unseen if unseen else math.inf, n / (s + new)) * max(1.0, own / unseen if unseen else math.inf)
            if p * gain > stay:
                best.append((u, math.log(p), n, False))
        r = ((w, math.log(stay), s + new, True), *best) if best else ()
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[w] = r
        return r

    def _step(self, a: tuple, b: tuple) -> float:
        """Log likelihood of b after a, pairs interpolated with words. A pair with a
        doubtful word as read counts as often as it may be without being in the table,
        but not more often than the word is true."""
        n = self.words.get(a[0], 0)
        two = self.pairs.get((a[0], b[0]), 0)
        if n and (a[3] or b[3]):
            two = max(two, self.hidden)
            two = min(two, *(x[2] for x in (a, b) if x[3]), self.words.get(b[0], 0))
        return math.log((0.7 * two / n if n else 0.0) + 0.3 * b[2] / self.total + 1e-30)

    def decode(self, before: str, doubtful: list[str], after: str) -> list[str]:
        """Viterbi over the candidates of neighbouring doubtful words between two that
        stand; those part a line into stretches that do not touch one another."""
        stands = lambda w: ((w, 0.0, float(self.words.get(w, 0)), False),)
        paths: list[tuple[float, tuple, tuple | None]] = [(0.0, stands(before)[0], None)]
        for cands in [*map(self.readings, doubtful), stands(after) if after else ()]:
            if cands:
                paths = [max(((s + self._step(a, c) + c[1], c, (a, back)) for s, a, back in paths), key=lambda x: x[0]) for c in cands]
        _, last, back = max(paths, key=lambda x: x[0])
        out = [last[0]]
        while back is not None:
            out.append(back[0][0])
            back = back[1]
        return out[::-1][1 : len(doubtful) + 1]

    def misread(self, w: str) -> bool:
        """Whether a word alone is likelier to be another."""
        return bool(self.readings(w)) and self.decode("", [w], "") != [w]

    def joined(self, text: str) -> tuple[str, bool]:
        """Words divided at line ends in one piece; a hyphen for a left-out word part
        and that of a compound stay."""
        if not _DIVIDED.search(text):
            return text, False
        hit, again = False, True

        def one(m: re.Match) -> str:
            nonlocal hit, again
            a, mark, _, b = m.groups()
            whole = (a + b).lower()
            sure = mark not in "-‐‑" and "\n" in m.group(3) and mark != "­"
            if b.lower() in ("and", "or", "to") and mark == "-":
                return m.group()
            n = self.words.get(whole, 0)
            if sure or n >= 5 or (self.misread(whole) and not (self.words.get(a.lower(), 0) > 50 and self.words.get(b.lower(), 0) > 50)):
                hit = again = True
                return a + b
            return m.group()

        while again:
            again = False
            text = _BROKEN.sub(one, text)
        return text, hit

    def corrected(self, text: str) -> tuple[str, bool]:
        known = self.known
        for w in _TOKEN.findall(text.lower()):
            if (r := known.get(w)) is None:
                r = self.readings(w) if _doubtful(w) else ()
                known.setdefault(w, r)
            if r:
                break
        else:
            return text, False
        urls = [m.span() for m in _URL.finditer(text)] if "/" in text or "www" in text else []
        out, at, hit = [], 0, False
        get = known.get
        for line in text.splitlines(keepends=True):
            toks = list(_TOKEN.finditer(line))
            low = [m.group().lower() for m in toks]
            doubtful = []
            for i, w in enumerate(low):
                r = get(w)
                if r is None:
                    r = self.readings(w) if _doubtful(w) else ()
                    known.setdefault(w, r)
                if r and not any(a <= at + toks[i].start() < b for a, b in urls):
                    doubtful.append(i)
            if doubtful:
                pos, made, free = 0, [], set(doubtful)
                for i in doubtful:
                    if i - 1 in free:
                        continue
                    j = i
                    while j in free:
                        j += 1
                    best = self.decode(low[i - 1] if i else "", low[i:j], low[j] if j < len(low) else "")
                    for k, word in enumerate(best, i):
                        if word != low[k]:
                            hit = True
                            made += [line[pos : toks[k].start()], _cased(toks[k].group(), word)]
                            pos = toks[k].end()
                line_out = "".join(made) + line[pos:]
            else:
                line_out = line
            out.append(line_out)
            at += len(line)
        return "".join(out), hit

    def repair(self, text: str, furniture: Furniture = PLAIN, first: int | None = None, last: int | None = None) -> tuple[str, tuple[str, ...]]:
        """The repaired text and the kinds of noise the value held."""
        kinds = []
        clean, furnished = furniture.without(consistent(text, self.automaton, self.forms) if not text.isascii() else text, first, last)
        if furnished:
            kinds.append("page_furniture")
        clean, broken = self.joined(clean)
        if broken:
            kinds.append("broken_word")
        clean, wrong = self.corrected(clean)
        if wrong:
            kinds.append("wrong_char")
        return paragraphs(clean), tuple(kinds)


def _doubtful(w: str) -> bool:
    letters = sum(c.isalpha() for c in w)
    return len(w) > 1 and letters * 2 >= len(w) and (w.isascii() or all(c < "ɐ" for c in w))


def _cased(seen: str, word: str) -> str:
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word.capitalize() if seen[:1].isupper() else word


def paragraphs(text: str) -> str:
    """Wrapped lines joined; blank lines, list lines and headings stay apart."""
    if "\n" not in text:
        return text
    out: list[str] = []
    for block in re.split(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+", text):
        cur = ""
        for ln in block.splitlines():
            ends = cur.rstrip()[-1:] in (".", ":", ";", "!", "?", "") and (_LIST_LINE.match(ln) or ln[:1].isupper() and cur.rstrip()[-1:] == ":")
            heading = cur and cur.isupper()
            mark, before = _ITEM.match(ln), _ITEM.match(cur)
            follows = mark and before and ord(mark.group(1)) == ord(before.group(1)) + 1
            item = _LIST_LINE.match(ln) and not re.match(r"\s*\(\w\)\s*[a-z,.]", ln)
            if cur and not (ends or heading or item or follows):
                cur = cur.rstrip() + " " + ln.lstrip()
            else:
                if cur:
                    out.append(cur)
                cur = ln
        if cur:
            out.append(cur)
        out.append("")
    return "\n".join(out).strip("\n")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(rf"(?<![|!@$\w])[^\W\d_]{{2,}}(?![|!@$\w]|[{_MARK}]\s)|#|\d[\d.,]*|[.;:()]")
    tail = re.compile(rf"[{_MARK}]\s+\S*")
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        a, b, n = [], [], []
        for k, v in counts.items():
            x, y = k if isinstance(k, tuple) else (k, None)
            a.append(x)
            b.append(y)
            n.append(v)
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["a", "b", "n"])

    for batch in batches:
        for text in batch.column("value").to_pylist():
            toks = word.findall(tail.sub(" # ", text.lower()))
            counts.update(toks)
            counts.update(zip(toks, toks[1:]))
        if len(counts) > 1_000_000:
            yield flush()
    yield flush()


def statistics(values: DataFrame, word_share: float = 2e-7, pair_share: float = 5e-6) -> tuple[dict[str, int], dict[tuple[str, str], int], int]:
    """Counts of words and word pairs over all different values, so that copies of a
    misread value do not speak for its misreadings, and the number of all words; kept
    are those of at least the given shares of all words, thus at most ``1 / share`` of either."""
    d = values.where("value <> ''").select("value").distinct()
    g = d.mapInArrow(_grams, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    g = staged(g, "grams")
    total = g.where("b is null").agg(F.sum("n")).first()[0] or 0
    word = F.col("a").rlike(r"^\p{L}+$")
    ones = g.where(word & F.col("b").isNull() & (F.col("n") >= max(2, int(total * word_share))))
    twos = g.where(word & F.col("b").rlike(r"^\p{L}+$") & (F.col("n") >= max(3, int(total * pair_share))))
    return {r[0]: r[2] for r in ones.collect()}, {(r[0], r[1]): r[2] for r in twos.collect()}, total


def publication(pdf: Column) -> Column:
    """A file name without its ending, however it is written."""
    return F.lower(F.regexp_replace(F.regexp_replace(pdf, r"(?i)\.pdf$", ""), r"[\s_]+", " "))


def running_heads(values: DataFrame, manifest: DataFrame, value_share: float = 0.002, doc_share: float = 0.01) -> tuple[DataFrame, list[str]]:
    """(doc, heads) of each publication, the heads joined in one string, and the heads
    with digits of all publications.

    A piece is a whole line or a part between wider gaps. It is a head of its publication
    if it is on two of its pages (``place``), and on ``value_share`` as many as there are
    values with line ends, as lines of text meet by chance in many; and of all if it
    has digits and is a head of two publications and of ``doc_share`` of those that have
    heads; both shares bound what is kept. Titles of three words or more and keys come
    from the register.
    """
    v = values.where("doc is not null and place is not null and contains(value, '\n')")
    lines = F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x))
    pieces = F.filter(F.flatten(F.transform(F.filter(lines, lambda x: F.length(x) <= 160), lambda x: F.split(x, r"\s{2,}"))), lambda x: x.rlike(_PIECE))
    numbers = F.filter(lines, lambda x: x.rlike(r"^(?:\d{1,3}-)?\d{1,4}$"))
    d = v.select("doc", "place", F.explode(F.concat(pieces, numbers)).alias("piece"))
    d = d.groupBy("doc", F.regexp_replace("piece", r"\d+", "#").alias("head"), "place").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    d = staged(d.groupBy("doc", "head").agg(F.count("*").alias("n"), (F.min("lo") != F.max("hi")).alias("differs")), "pieces")
    sizes = v.groupBy("doc").agg(F.count("*").alias("values"))
    own = d.where("n >= 2 and (differs or head not in ('#', '#-#'))").join(sizes, "doc").where(F.col("n") >= F.col("values") * value_share).select("doc", "head")
    own = staged(own, "own")
    docs = own.select("doc").distinct().count()
    common = own.where(F.col("head").rlike(r"#.*\p{L}|\p{L}.*#")).groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, docs * doc_share))
    key = publication(F.col("source_pdf")).alias("doc")
    m = {c: F.col(c) if c in manifest.columns else F.lit(None).cast("string") for c in ("source_pdf", "title", "doc_key")}
    known = manifest.select(*(x.cast("string").alias(c) for c, x in m.items()))
    titles = known.where(F.col("title").rlike(r"^\S+(?:\s+\S+){2}")).select(key, F.trim("title").alias("head"))
    keys = known.where("doc_key rlike '[0-9]' and doc_key rlike '[A-Za-z]'").select(key, F.concat(F.lit("="), F.regexp_replace(F.trim("doc_key"), r"\d+", "#")).alias("head"))
    all_ = own.unionByName(titles).unionByName(titles.select("doc", F.upper("head").alias("head"))).unionByName(keys).where("doc is not null")
    heads = all_.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("head")), _SEPARATOR).alias("heads"))
    # rows without a file go by their document, whose other rows name it
    named = values.where("document is not null and doc <> document").groupBy("document").agg(F.min("doc").alias("doc"))
    heads = heads.unionByName(named.join(heads, "doc").select(F.col("document").alias("doc"), "heads"))
    return staged(heads, "heads"), sorted(r["head"] for r in common.select("head").collect())


_MODELS: dict[str, Model] = {}


def _model(key: str, shared) -> Model:
    """One model a process for each run of the operator, however many tasks it has."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*shared.value[:2])
    return _MODELS[key]


def repaired(values: DataFrame, manifest: DataFrame) -> DataFrame:
    """(field_name, row_seq, repaired, kinds) of every row of ``scanned_values`` with text.
    Nulls and empty texts give no row; whole texts are read, of any length. Rows without
    publication or pages are rid only of what shows it in itself. Texts are spread by
    their keys over tasks of like size, wherever they were stored."""
    words, pairs, total = statistics(values)
    heads, common = running_heads(values, manifest)
    spark = values.sparkSession
    shared, run_key = spark.sparkContext.broadcast((words, pairs, tuple(common))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common, seen, furniture = _model(run_key, shared), shared.value[2], {}, {}
        for b in batches:
            texts, kinds = [], []
            for v, h, first, last in zip(*(b.column(c).to_pylist() for c in ("value", "heads", "page_first", "page_last"))):
                if (r := seen.get((v, h, first, last))) is None:
                    if (f := furniture.get(h)) is None:
                        if len(furniture) > 2000:
                            furniture.clear()
                        f = furniture[h] = Furniture((*(x for x in h.split(_SEPARATOR) if x), *common) if h else common)
                    r = model.repair(v, f, first, last)
                    if len(v) < 2000:
                        if len(seen) > 5000:
                            seen.clear()
                        seen[v, h, first, last] = r
                texts.append(r[0])
                kinds.append(r[1])
            yield pa.RecordBatch.from_arrays([b.column("field_name"), b.column("row_seq"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["field_name", "row_seq", "repaired", "kinds"])

    parts = max(3 * spark.sparkContext.defaultParallelism, total // 1_000_000)
    d = values.where("value <> ''").select("field_name", "row_seq", "value", "doc", "page_first", "page_last").repartition(int(parts), "field_name", "row_seq")
    d = d.join(heads, "doc", "left").select("field_name", "row_seq", "value", "heads", "page_first", "page_last")
    return d.mapInArrow(run, "field_name string, row_seq long, repaired string, kinds array<string>")


def _values(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(field_name, row_seq, value, doc, document, place, page_first, page_last) of each
    named text column. The publication is told by the file, else by the document; a
    column that is missing counts as null. The context of a parent is from another place."""
    have = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    document = have("document_id", "string")
    d = df.select(
        F.col(key).cast("long").alias("row_seq"), F.coalesce(publication(have("source_pdf", "string")), document).alias("doc"), document.alias("document"), F.xxhash64(have("document_id", "string"), have("chunk_id", "long")).alias("at"), have("chunk_id", "long").isNotNull().alias("placed"),
        have("page_start", "int").alias("page_first"), have("page_end", "int").alias("page_last"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x"),
    )
    place = F.when(F.col("placed") & (F.col("x.field_name") != "parent_context"), F.col("at"))
    return d.select("x.field_name", "row_seq", "x.value", "doc", "document", place.alias("place"), "page_first", "page_last")


def scanned_values(chunks: DataFrame, reqs: DataFrame) -> DataFrame:
    return _values(chunks, "chunk_seq", "text", "parent_context").unionByName(_values(reqs, "req_seq", "source_quote"))


def found(chunks: DataFrame, reqs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(field_name, row_seq, noise_kind), one row for each kind a value holds."""
    d = repaired(scanned_values(chunks, reqs), manifest).where("row_seq is not null and size(kinds) > 0")
    return d.select("field_name", "row_seq", F.explode("kinds").alias("noise_kind")).distinct()

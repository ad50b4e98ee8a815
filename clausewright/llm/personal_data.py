"""Personal data in free text found by a linear-chain conditional random field.

The field sees word shapes, affixes and the words around; it is trained on the driver
from the labelled table of ``pii_labels`` (seeded, so every run trains the same field)
and decoded by Viterbi over many stretches of text at once in numpy. Other numbers and
other capitalised names have labels of their own, which lets the chain carry what a
ticket, form or place name is over its whole length. A mention must then hold what its
kind needs (digits, a sign or its word, a capital), or it is dropped.

Every mention holds a token with a capital, a digit or an at sign (or its word), and all
of it is near one: that is a constraint of the field, which allows no label but the
empty one farther than ``BEFORE`` tokens before or ``AFTER`` behind such a token and the
tokens joined to it without white space. The best path of a whole text under it goes
through the empty label at all other tokens, so the stretches between them are decoded
by themselves, each from and to the empty label, with the same result (tested).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_labels
from .base import keyed

KINDS = ("email", "phone", "id", "addr", "person", "num", "cap")
NAMES = {"email": "email", "phone": "phone", "id": "id_number", "addr": "street_address", "person": "person_name"}
LABELS = ["O"] + [p + k for k in KINDS for p in ("B-", "I-")]
_L = len(LABELS)
_OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
_TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_)")
_NONE = np.float32(-1e4)
BEFORE, AFTER = 7, 4
_PADS = BEFORE + AFTER + 1  # between texts, so that none sees its neighbours
#: Labels that any label can precede, and those that go on, with their beginnings.
_FREE = [i for i, x in enumerate(LABELS) if x[0] != "I"]
_GOES_ON = [i for i, x in enumerate(LABELS) if x[0] == "I"]
_BEGINS = [LABELS.index("B" + LABELS[i][1:]) for i in _GOES_ON]
#: What the first character of a mention can be.
_STARTS = {
    "B-person": str.isupper,
    "B-addr": lambda c: c.isdigit() or c.isupper(),
    "B-id": lambda c: c.isdigit() or c.isupper(),
    "B-phone": lambda c: c.isdigit() or c in "+(",
    "B-email": str.isalnum,
}


def _shape(w: str) -> str:
    if w.isdigit():
        return "d" + str(min(len(w), 13))
    if not w[0].isalpha():
        return w
    if w.isupper():
        return "X" if len(w) == 1 else "XX"
    return "x" if w.islower() else "Xx" if w[0].isupper() and w[1:].islower() else "xX"


def token_features(token: str) -> list[str]:
    w = token.lstrip()
    gap = "n" if "\n" in token else "s" if len(w) < len(token) else "-"
    s, low = _shape(w), w.lower()
    f = ["s" + s, "g" + gap + s[:1], "w" + low]
    if w[0].isalpha() and len(w) > 3:
        f += ["e" + low[-3:], "e" + low[-4:], "c" + s + low[-2:]]
    elif w.isdigit():
        f += ["p" + low[:2], "p" + low[:3]]
    return f


def _allowed() -> np.ndarray:
    t = np.zeros((_L + 1, _L), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i in range(_L + 1):
                if i == _L or LABELS[i][2:] != b[2:]:
                    t[i, j] = _NONE
    return t


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 10, rate: float = 0.1, batch: int = 24, seed: int = 3) -> dict:
    """Weights by AdaGrad on the conditional log-likelihood. A word seen in a single row
    only is left to its shape and affixes."""
    index: dict[str, int] = {}
    sentences, labels, seen = [], [], {}
    for text, marks in rows:
        toks = _TOKEN.findall(text)
        at, y, feats = 0, [], []
        for t in toks:
            start = at + len(t) - len(t.lstrip())
            at += len(t)
            inside = next(((s, k) for s, e, k in marks if s <= start < e), None)
            y.append(0 if inside is None else LABELS.index(("B-" if start == inside[0] else "I-") + inside[1]))
            feats.append(token_features(t))
            for f in feats[-1]:
                seen[f] = seen.get(f, 0) + 1
        sentences.append(feats)
        labels.append(np.array(y))
    rare = {f for f, n in seen.items() if n < 6}
    pad = index.setdefault("", 0)
    coded = [[[index.setdefault(f, len(index)) for f in fs if f not in rare] for fs in s] for s in sentences]
    n_f, k = len(index), len(_OFFSETS)
    width = 6 * k
    inputs = []
    for s in coded:
        x = np.full((len(s), width), -1)
        for i in range(len(s)):
            c = 0
            for o, off in enumerate(_OFFSETS):
                j = i + off
                for f in s[j] if 0 <= j < len(s) else [pad]:
                    x[i, c] = o * n_f + f
                    c += 1
        inputs.append(x)
    w, trans = np.zeros((k * n_f + 1, _L)), np.zeros((_L + 1, _L))
    gw, gt, hard = np.full_like(w, 1e-3), np.full_like(trans, 1e-3), _allowed().astype(float)
    order, rng = np.arange(len(inputs)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for b0 in range(0, len(order), batch):
            ids = sorted(order[b0 : b0 + batch], key=lambda i: -len(inputs[i]))
            lens = np.array([len(inputs[i]) for i in ids])
            n, top = len(ids), lens.max()
            x, y = np.full((n, top, width), -1), np.zeros((n, top), int)
            for r, i in enumerate(ids):
                x[r, : lens[r]], y[r, : lens[r]] = inputs[i], labels[i]
            e, m = w[x].sum(axis=2), trans + hard
            live = np.arange(top)[None] < lens[:, None]
            alpha, beta = np.zeros((n, top, _L)), np.zeros((n, top, _L))
            alpha[:, 0] = m[_L] + e[:, 0]
            for t in range(1, top):
                alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + m[None, :_L], 1) + e[:, t]
            for t in range(top - 2, -1, -1):
                b = _logsumexp(m[None, :_L] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(live[:, t + 1, None], b, 0)
            z = _logsumexp(alpha[np.arange(n), lens - 1], 1)
            p = np.exp(alpha + beta - z[:, None, None])
            grad = -p
            np.add.at(grad, (np.arange(n)[:, None], np.arange(top)[None], y), 1.0)
            grad[~live] = 0
            g_w = np.zeros_like(w)
            flat = np.broadcast_to(grad[:, :, None, :], (n, top, width, _L))[live]
            np.add.at(g_w, x[live].ravel(), flat.reshape(-1, _L))
            g_w[-1] = 0
            g_t = np.zeros_like(trans)
            g_t[_L] = -p[:, 0].sum(0)
            np.add.at(g_t, (np.full(n, _L), y[:, 0]), 1.0)
            for t in range(1, top):
                on = live[:, t]
                q = np.exp(alpha[on, t - 1, :, None] + m[None, :_L] + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None])
                g_t[:_L] -= q.sum(0)
                np.add.at(g_t, (y[on, t - 1], y[on, t]), 1.0)
            for v, g, h in ((w, g_w - 1e-3 * w, gw), (trans, g_t - 1e-3 * trans, gt)):
                h += g * g
                v += rate * g / np.sqrt(h) * (np.abs(g) > 0)
    return {"index": index, "weights": w[:-1].reshape(k, n_f, _L).astype(np.float32), "trans": (trans + hard).astype(np.float32)}


@cache
def trained() -> dict:
    """The field of the labelled table; it depends on no data, so once a process is enough."""
    return train(pii_labels.labelled())


class Tagger:
    """Decodes texts with a trained field; keeps what it knows of each token."""

    def __init__(self, model: dict, most_types: int = 150_000):
        self.index, self.w, self.trans, self.most = model["index"], model["weights"], model["trans"], most_types
        self._clear()

    def _clear(self) -> None:
        self.types: dict[str, int] = {}
        self.score = np.zeros((4096, len(_OFFSETS), _L), np.float32)
        self.score[0] = self.w[:, 0]
        self.hot, self.glued = np.zeros((2, 4096), bool)
        self.n = 1

    def _type(self, token: str) -> int:
        if self.n == len(self.hot):
            self.score = np.concatenate([self.score, np.zeros_like(self.score)])
            self.hot, self.glued = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hot, self.glued))
        w, i = token.lstrip(), self.n
        fs = [self.index[f] for f in token_features(token) if f in self.index]
        self.score[i] = self.w[:, fs].sum(axis=1) if fs else 0
        for label, start in _STARTS.items():
            if not start(w[0]):
                self.score[i, _OFFSETS.index(0), LABELS.index(label)] = _NONE
        self.hot[i] = w[0].isdigit() or w in "@[" or token == "at" or w.lower() == "dot" or (w[0].isalpha() and not w.islower())
        self.glued[i] = not token[0].isspace()
        self.types[token] = i
        self.n += 1
        return i

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, lens: np.ndarray, fresh: np.ndarray, open_end: np.ndarray) -> np.ndarray:
        """Best labels of the stretches [start, start + len) of the emissions. Those with
        ``fresh`` begin a text, the others follow the empty label; those with
        ``open_end`` are followed by it."""
        out = np.zeros(len(e), np.int8)
        order = np.argsort(-lens, kind="stable")
        starts, lens, fresh, open_end = starts[order], lens[order], fresh[order], open_end[order]
        top = int(lens[0]) if len(lens) else 0
        alive = np.searchsorted(-lens, -np.arange(top), "left")
        to_free = self.trans[:_L, _FREE]
        from_begin, from_on = self.trans[_BEGINS, _GOES_ON], self.trans[_GOES_ON, _GOES_ON]
        row, free = np.arange(len(starts))[:, None], np.arange(len(_FREE))[None]
        begins, goes_on = np.array(_BEGINS, np.int8), np.array(_GOES_ON, np.int8)
        back = []
        v = np.where(fresh[:, None], self.trans[_L], self.trans[0]) + e[starts]
        for t in range(1, top):
            n = alive[t]
            w = v[:n]
            s = w[:, :, None] + to_free
            k = s.argmax(axis=1)
            one, two = w[:, _BEGINS] + from_begin, w[:, _GOES_ON] + from_on
            on = two > one
            b = np.empty((n, _L), np.int8)
            b[:, _FREE] = k
            b[:, _GOES_ON] = np.where(on, goes_on, begins)
            back.append(b)
            best = np.empty((n, _L), np.float32)
            best[:, _FREE] = s[row[:n], k, free]
            best[:, _GOES_ON] = np.where(on, two, one)
            v[:n] = best + e[starts[:n] + t]
        best = (v + np.where(open_end[:, None], self.trans[:_L, 0], 0)).argmax(axis=1)
        for t in range(top - 1, 0, -1):
            n = alive[t]
            out[starts[:n] + t] = best[:n]
            best[:n] = back[t - 1][np.arange(n), best[:n]]
        out[starts] = best
        return out

    def _read(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[tuple[int, int]]]:
        """Token types of the texts with pads between them, token lengths, and where each
        text's tokens are."""
        if self.n > self.most:
            self._clear()
        get, gap = self.types.get, [0] * _PADS
        ids, lens, bounds = gap[:], gap[:], []
        for text in texts:
            toks = _TOKEN.findall(text)
            bounds.append((len(ids), len(ids) + len(toks)))
            ids += [get(t) or self._type(t) for t in toks]
            lens += map(len, toks)
            ids += gap
            lens += gap
        return np.array(ids), lens, bounds

    def _near(self, ids: np.ndarray) -> np.ndarray:
        """Which tokens can be part of a mention."""
        at = np.flatnonzero(self.hot[ids])
        near = np.zeros(len(ids) + 1, np.int32)
        np.add.at(near, np.maximum(at - BEFORE, 0), 1)
        np.add.at(near, np.minimum(at + AFTER + 1, len(ids)), -1)
        # tokens without white space between them are in or out together
        run = np.cumsum(~self.glued[ids])
        reached = np.zeros(run[-1] + 1, bool)
        reached[run[np.cumsum(near[:-1]) > 0]] = True
        return reached[run] & (ids > 0)

    def _emissions(self, ids: np.ndarray, use: np.ndarray) -> np.ndarray:
        e = np.zeros((len(ids), _L), np.float32)
        on = np.flatnonzero(use)
        for o, off in enumerate(_OFFSETS):
            e[on] += self.score[ids[np.clip(on + off, 0, len(ids) - 1)], o]
        return e

    def labels(self, ids: np.ndarray) -> np.ndarray:
        use = self._near(ids)
        edge = np.diff(np.concatenate([[0], use.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.zeros(len(ids), np.int8)
        return self._viterbi(self._emissions(ids, use), starts, ends - starts, ids[starts - 1] == 0, ids[np.minimum(ends, len(ids) - 1)] > 0)

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the mentions of each text."""
        ids, lens, bounds = self._read(texts)
        y = self.labels(ids)
        lens = np.array(lens)
        out = []
        for text, (a, b) in zip(texts, bounds):
            yy = y[a:b]
            begin = np.flatnonzero((yy % 2 == 1) & (yy < 11))
            if not len(begin):
                out.append([])
                continue
            stop = np.cumsum(lens[a:b])
            found = []
            for i in begin:
                j = i + 1
                while j < len(yy) and yy[j] == yy[i] + 1:
                    j += 1
                s, t = int(stop[i] - lens[a + i]), int(stop[j - 1])
                s += len(text[s:t]) - len(text[s:t].lstrip())
                if plausible(kind := KINDS[yy[i] // 2], text[s:t]):
                    found.append((s, t, kind))
            out.append(found)
        return out


_AT = re.compile(r"@|\bat\b", re.I)


def plausible(kind: str, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        return bool(_AT.search(value)) and len(value) > 6
    if kind == "phone":
        return digits >= 7
    if kind == "id":
        return digits >= 6
    if kind == "addr":
        return digits >= 1
    return any(c.isupper() for c in value) and sum(c.isalpha() for c in value) > 3 and not digits


def mentions(df: DataFrame, key: str = "doc_id", text: str = "text", batch_chars: int = 2_000_000, model: dict | None = None) -> DataFrame:
    """(row_key, text, kinds, starts, ends): every row with a text; the arrays are empty
    where none is found. Rows without key or text are out; whole texts are read."""
    model = df.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for b in batches:
            texts, hits = b.column("text").to_pylist(), []
            group, size = [], 0
            for t in texts:
                group.append(t)
                size += len(t)
                if size > batch_chars:
                    hits += tagger.tag(group)
                    group, size = [], 0
            hits += tagger.tag(group) if group else []
            cols = [pa.array([[NAMES[k] for _, _, k in h] for h in hits], pa.list_(pa.string()))]
            cols += [pa.array([[x[i] for x in h] for h in hits], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("row_key"), b.column("text"), *cols], ["row_key", "text", "kinds", "starts", "ends"])

    d = keyed(df, key).where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("text"))
    return d.mapInArrow(run, "row_key long, text string, kinds array<string>, starts array<long>, ends array<long>")


def found(df: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, start_char), one row for each mention."""
    m = mentions(df).where(F.size("kinds") > 0).select("row_key", F.explode(F.arrays_zip("kinds", "starts")).alias("x"))
    return m.select(F.col("row_key").alias("doc_id"), F.col("x.kinds").alias("pii_kind"), F.col("x.starts").alias("start_char"))


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, redacted): each text with typed placeholders such as [PHONE]; the text
    between mentions is kept as it is. Null texts give no row, empty ones stay empty."""
    m = mentions(df, key, text)
    kept = F.aggregate(
        F.arrays_zip("kinds", "starts", "ends"),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), (x["starts"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["kinds"]), F.lit("]")).alias("out"), x["ends"].alias("at")),
        lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))),
    )
    return m.select("row_key", kept.alias("redacted"))

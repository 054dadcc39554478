"""Language identification by cross-parsing entropy.

A suffix automaton over labelled text of each language tells how far a text can
be read as one phrase of that language's text. A text is parsed greedily into
longest matches against every language; the language in which its phrases cost
least wins. A phrase costs the logarithm of what it could be, a place in the
language's text or a single sign, so languages with little text compare with others.

The automaton is run as a table: for each state and character it holds the next
state, or, where the match ends, the state after restarting at the root together
with a phrase mark. Texts are cut into pieces, and many pieces step through all languages at once
in numpy: first as if each piece began a text, then once more those whose piece before
ends in another state than assumed, until all begin where the one before ends. The
phrases are those of the whole text, read from its first character to its last.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Characters of labelled text an automaton is built from, for each language.
FIT_CHARS = 20_000
#: Labelled rows used of each language, and characters of each from its first letter on.
FIT_ROWS, FIT_ROW_CHARS = 200, 20_000
#: Characters of a piece; the result doesn't depend on it.
PIECE = 1024
FOLDS, HELD = 4, 2
#: Phrases that say nothing yet against a text's language.
SPARE = 3
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """The automaton of all factors of ``codes`` as a parsing table, ``state * width + code``.

    Upper bits: the next state; lowest bit: a phrase begins with this character.
    The last state stands before the text and after a character that the automaton lacks.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.empty((len(step) + 1, width), dtype=np.int32)
    root = np.array([step[0].get(c, len(step)) for c in range(width)], dtype=np.int32)
    table[:] = root * 2 + 1
    for s, to in enumerate(step):
        for c, t in to.items():
            table[s, c] = 2 * t
    return table.ravel()


class Parser:
    """``texts``: language to labelled text. Characters outside all of them count as one foreign sign."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        plain = {k: self.plain(texts[k]) for k in self.langs}
        signs = sorted(set("".join(plain.values())))
        self.width = len(signs) + 1
        self.code = np.zeros(0x110000, dtype=np.uint16 if self.width > 255 else np.uint8)
        for i, ch in enumerate(signs):
            self.code[ord(ch)] = i + 1
        tables = [suffix_automaton(self.code[self.points(plain[k])].tolist(), self.width) for k in self.langs]
        at = np.cumsum([0] + [len(t) for t in tables])
        base = (at[:-1] // self.width).astype(np.int32)
        self.before = (at[1:] // self.width - 1).astype(np.int32)[:, None]
        cost = np.log([len(plain[k]) + self.width + 1.0 for k in self.langs])
        #: Cost of a phrase in each language; 1 in that of the longest text.
        self.cost = (cost / cost.max(initial=1.0))[:, None]
        #: Phrases of that language that cost as much as a letter spelt in equally likely signs.
        self.spelt = float(np.log(self.width) / cost.max(initial=1.0))
        self.table = np.concatenate([t + 2 * b for t, b in zip(tables, base, strict=True)]) if tables else np.zeros(0, np.int32)

    @staticmethod
    def plain(text: str) -> str:
        """Lower case; whatever is no letter becomes one space."""
        out = _NOT_LETTERS.sub(" ", text.lower()).strip()
        if out.isascii() or all(map(str.isalpha, set(out) - {" "})):
            return out
        return " ".join("".join(ch if ch.isalpha() else " " for ch in out).split())  # letter-like numbers and marks

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language and text, and characters parsed of each text."""
        pieces, owner, follows = [], [], []
        for i, t in enumerate(texts):
            codes = self.letters(t)
            for k in range(0, len(codes), PIECE):
                pieces.append(codes[k : k + PIECE])
                owner.append(i)
                follows.append(k > 0)
        counts, chars = np.zeros((len(self.langs), len(texts)), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        if not pieces:
            return counts, chars
        size, who = np.array([len(p) for p in pieces]), np.array(owner)
        begin = np.repeat(self.before, len(pieces), axis=1)
        end, found = self._run(pieces, begin)
        later = np.flatnonzero(follows)
        while len(again := later[(end[:, later - 1] != begin[:, later]).any(axis=0)]):
            begin[:, again] = end[:, again - 1]
            end[:, again], found[:, again] = self._run([pieces[k] for k in again.tolist()], begin[:, again])
        for k in range(len(self.langs)):
            counts[k] = np.bincount(who, weights=found[k], minlength=len(texts))
        chars[:] = np.bincount(who, weights=size, minlength=len(texts))
        return counts, chars

    def _run(self, pieces: list[np.ndarray], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each piece, by language, and the phrases that begin in it."""
        if not pieces:
            return begin, np.zeros_like(begin)
        size = np.array([len(p) for p in pieces])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        grid = np.zeros((int(size[0]), len(pieces)), dtype=self.code.dtype)
        for col, k in enumerate(order.tolist()):
            grid[: size[col], col] = pieces[k]
        live = np.searchsorted(-size, -np.arange(len(grid)), side="left")
        state = begin[:, order]
        found = np.zeros(state.shape, dtype=np.int32)
        for row, n in zip(grid, live.tolist(), strict=True):
            got = self.table[state[:, :n] * self.width + row[:n]]
            found[:, :n] += got & 1
            state[:, :n] = got >> 1
        back = np.argsort(order)
        return state[:, back], found[:, back]

    def letters(self, text: str) -> np.ndarray:
        """Codes of :meth:`plain` of the text."""
        return self.code[self.points(self.plain(text))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, scores, and whether the text fits its language: beyond the first ``SPARE``, phrases cost less than spelling it."""
        names, scores, fits = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.langs or not use:
            return names, scores, fits
        counts, chars = self.phrases([texts[i] for i in use])
        cost = counts * self.cost
        rate = cost / np.maximum(chars, 1)
        best = rate.argmin(axis=0)  # ties: the first language in order
        for k, i in enumerate(use):
            # phrases' cost saved against each other language, as odds
            odds = sum(math.exp(-min(50.0, float(cost[j, k] - cost[best[k], k]))) for j in range(len(self.langs)))
            names[i], scores[i] = self.langs[best[k]], 1.0 / odds
            fits[i] = bool(cost[best[k], k] - SPARE * self.cost[best[k], 0] < self.spelt * chars[k])
        return names, scores, fits


def fit(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> dict[str, str]:
    """Up to ``FIT_CHARS`` of labelled text of each language, from at most ``FIT_ROWS`` rows outside the held-out fold.

    Only rows whose text has a letter are numbered; of a long text the first ``FIT_ROW_CHARS`` from its first letter on are used.
    """
    spark = docs.sparkSession
    first = Window.partitionBy("lang").orderBy("k", "doc_id")
    docs = docs.where(F.col("text").rlike(r"\p{L}"))
    ids = (
        docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (common.fold("doc_id", folds) != held))
        .select("lang", "doc_id", F.xxhash64("doc_id").alias("k"))
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= FIT_ROWS).collect()
    )
    if not ids:
        return {}
    wanted = F.broadcast(spark.createDataFrame([(r["doc_id"], r["lang"], r["n"]) for r in ids], "doc_id long, lang string, n int"))
    part = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, FIT_ROW_CHARS)
    rows = docs.join(wanted, ["doc_id", "lang"]).select("lang", "n", part.alias("text")).collect()
    texts = {}
    for k in sorted({r["lang"] for r in rows}):
        own = sorted((r["n"], r["text"]) for r in rows if r["lang"] == k)
        if text := Parser.plain(" ".join(t for _, t in own))[:FIT_CHARS]:
            texts[k] = text
    return texts


_parsers: dict[str, Parser] = {}


def identify(docs: DataFrame, texts: dict[str, str], keep: list[str] | None = None, fits: bool = False, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, and with ``fits`` whether the text fits that language (:meth:`Parser.judge`).

    A null text, or one without letters, gives ``und`` and 0. Whole texts are
    parsed whatever their length. Ties go to the first language in order. A
    model without labelled text gives ``und`` everywhere. Repeated rows are each
    scored. Columns named like those that are added are replaced.
    """
    name = hashlib.md5(repr(sorted(texts.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(texts)

    def start():
        if name not in _parsers:
            _parsers.clear()
            _parsers[name] = Parser(sent.value)
        parser = _parsers[name]

        def each(batch: list) -> list[pa.Array]:
            langs, scores, fit_ = parser.judge(batch)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([pa.array(fit_, pa.bool_())] if fits else [])]

        return each

    return common.map_text(docs, start, {"lang_pred": "string", "score": "double"} | ({"fits": "boolean"} if fits else {}), keep, text)

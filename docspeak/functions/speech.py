"""Text to speakable chunks and pauses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

# Pauses in milliseconds after a sentence, a comma, and anything else; frames a second.
PAUSES = {"piper": (350, 120, 500), "kokoro": (400, 150, 600)}
FRAME_RATE = 24_000


def units(text: Column) -> Column:
    """Broken words, dimensions, scores, tolerances."""
    return R.replace(R.replace(text, R.BROKEN_LINE, "$1$2"), R.DIMENSIONS, "$1 by $2")


def operators(text: Column, pattern: str, by: str) -> Column:
    """Mark the operator of every match in one pass, then spell the marked ones."""
    text = R.replace(text, pattern, by.replace("OP", "\ue000${OP}\ue001"))
    for sign, word in R.COMPARISONS.items():
        text = F.replace(text, F.lit(f"\ue000{sign}\ue001"), F.lit(word))
    return text


def p_values(text: Column) -> Column:
    return operators(text, R.P_VALUE, "p OP ${n}")


def comparisons(text: Column) -> Column:
    return operators(text, R.COMPARISON, "${a} OP ${b}")


def abbreviations(text: Column) -> Column:
    """One pass marks every abbreviation, the longest that fits first; what stands between marks is looked up."""
    longest = sorted(R.ABBREVIATIONS, key=len, reverse=True)
    known = F.create_map(*(F.lit(x) for pair in R.ABBREVIATIONS.items() for x in pair))
    marked = R.replace(text, rf"\b(?:{'|'.join(map(re.escape, longest))}){R.ABBREVIATION_END}", "\ue002$0\ue002")
    return F.array_join(F.transform(F.split(marked, "\ue002"), lambda w, i: F.when(i % 2 == 1, F.element_at(known, w)).otherwise(w)), "")


def percent(text: Column) -> Column:
    return R.replace(text, R.PERCENT, "$1 percent")


def verbalize(text: Column) -> Column:
    """All expansions in their fixed order; an empty text stays empty, a null one null."""
    text = R.replace(p_values(units(text)), R.F_SCORE, r"F$1 score", True)
    text = percent(comparisons(R.replace(text, R.PLUS_MINUS, "$1 plus or minus $2")))
    text = R.replace(abbreviations(text), R.DASHES, "$1, $2")
    return R.strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _empty(of: str = "array<string>") -> Column:
    return F.array().cast(of)


def merge_parts(parts: Column) -> Column:
    """Join ordered parts into paragraphs: a broken word, an open bracket or a lower-case start continues the one before."""
    clean = F.filter(F.transform(parts, R.strip), lambda p: p != "")

    def add(acc: Column, part: Column) -> Column:
        last = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))
        lower = R.matches(part, r"^\p{Lower}")
        broken = last.endswith("-") & lower
        opened = F.length(F.replace(last, F.lit(")"), F.lit(""))) - F.length(F.replace(last, F.lit("("), F.lit(""))) > 0
        more = (F.size(acc) > 0) & (broken | opened | (~short_heading(last) & lower & ~ends_sentence(last)))
        joined = F.when(broken, F.concat(F.substring(last, F.lit(1), F.length(last) - 1), part)).otherwise(F.concat(last, F.lit(" "), part))
        return F.when(more, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(part)))

    merged = F.aggregate(clean, _empty(), add)
    return R.strip(F.regexp_replace(F.array_join(merged, "\n\n"), "\n{3,}", "\n\n"))


def ends_sentence(text: Column) -> Column:
    return R.matches(text, R.SENTENCE_END)


def short_heading(text: Column) -> Column:
    words = F.filter(F.split(text, R.java(r"\s+")), lambda w: w != "")
    fits = F.forall(words, lambda w: R.matches(w, r"^[\p{Lu}\p{Lt}]") | (R.matches(w, r"\p{Lu}") & ~R.matches(w, r"\p{Ll}")) | w.contains("/") | (F.lower(w) == "of"))
    return (F.length(text) <= 80) & ~text.rlike("[.!?]") & F.size(words).between(1, 8) & fits


def _pack(pieces: Column, limit: int) -> Column:
    """Greedy packing of pieces, one space between them; a piece over the limit stands alone."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("now"))

    def add(acc: Column, piece: Column) -> Column:
        both = F.btrim(F.concat(acc["now"], F.lit(" "), piece))
        cut = (acc["now"] != "") & (F.length(both) > limit)
        return F.struct(F.when(cut, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(cut, piece).otherwise(both).alias("now"))

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def long_sentence(sentence: Column, limit: int) -> Column:
    """Pieces of a sentence that is too long: after commas, and a last one that is still too long by words."""

    def last_by_words(packed: Column) -> Column:
        last = F.element_at(packed, -1)
        words = _pack(F.filter(F.split(last, R.java(r"\s+")), lambda w: w != ""), limit)
        return F.when(F.length(last) > limit, F.concat(F.slice(packed, F.lit(1), F.size(packed) - 1), words)).otherwise(packed)

    return once(_pack(F.split(sentence, R.java(R.CLAUSE_BREAK)), limit), last_by_words)


def chunks(text: Column, limit: int = 900) -> Column:
    """Ordered chunks of at most ``limit`` characters, but for a long sentence that meets a begun chunk."""
    return once(merge_parts(F.array(F.coalesce(text, F.lit("")))), lambda whole: F.when(F.length(whole) <= limit, F.array(whole)).otherwise(_by_sentences(whole, limit)))


def _by_sentences(whole: Column, limit: int) -> Column:
    sentences = F.filter(F.transform(F.split(whole, R.java(R.SENTENCE_BREAK)), R.strip), lambda s: s != "")
    start = F.struct(_empty().alias("done"), F.lit("").alias("now"))

    def add(acc: Column, s: Column) -> Column:
        both = F.btrim(F.concat(acc["now"], F.lit(" "), s))
        cut = (acc["now"] != "") & (F.length(both) > limit)
        long = ~cut & (F.length(s) > limit)
        done = F.when(cut, F.concat(acc["done"], F.array(acc["now"]))).when(long, F.concat(acc["done"], long_sentence(s, limit))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(cut, s).when(long, F.lit("")).otherwise(both).alias("now"))

    return F.aggregate(sentences, start, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def pause(chunk: Column, engine: str, default: int = 220) -> Column:
    """Milliseconds of silence after a chunk, by its last character."""
    stop, comma, other = PAUSES[engine]
    last = F.right(R.replace(chunk, r"\s+$", ""), F.lit(1))
    return F.when(last == "", F.lit(default if engine == "piper" else stop)).when(last.isin(".", "!", "?"), F.lit(stop)).when(last.isin(",", ";", ":"), F.lit(comma)).otherwise(F.lit(other))


def silence_frames(ms: Column, rate: int = FRAME_RATE) -> Column:
    return F.floor(F.greatest(ms, F.lit(0)) * rate / 1000)


def length_scale(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.bround(F.lit(1.0e0) / F.least(F.greatest(rate, F.lit(0.7e0)), F.lit(1.4e0)), 3))


def kokoro_speed(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.least(F.greatest(rate, F.lit(0.5e0)), F.lit(2.0e0)))


def chunk_limit(limit: int, engine: str) -> int:
    return max(limit, 2000) if engine == "kokoro" else limit


def pcm16(audio: Column) -> Column:
    """Samples in -1 to 1 as 16-bit numbers, cut towards zero."""
    return F.transform(audio, lambda x: (F.greatest(F.lit(-1.0e0), F.least(F.lit(1.0e0), x)) * 32767).cast("smallint"))

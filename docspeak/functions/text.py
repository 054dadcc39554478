"""Projections and predicates of one block's text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import Options
from . import rules as R

#: What compatibility normalisation leaves as it is; texts of these alone never go to Python.
PLAIN = "^[\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u2010\\u2012-\\u2015\\u2018-\\u201E\\u2020-\\u2022]*$"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility normalisation; Python gets only texts that it can change, and nulls for the others."""
    return F.coalesce(_nfkc(F.when(~text.rlike(PLAIN), text)), text)


def tidy(text: Column, strict: bool = True) -> Column:
    """Soft hyphens, hard spaces, broken words, drop capitals, bullets, runs of spaces, in this order."""
    text = F.replace(F.replace(text, F.lit("­"), F.lit("")), F.lit(" "), F.lit(" "))
    if strict:
        text = R.replace(text, R.HYPHENATED, "")
        text = R.replace(text, R.DROP_CAPITAL, "$1")
    else:  # suspended hyphens and one-letter words stay
        text = R.replace(text, r"(?<=\w)-\s+(?!(?:and|or|und|oder|et|ou|y|e)\b)(?=\w)", "")
        text = R.replace(text, r"^([B-HJ-Z])\s+(?=[a-z]{2,}\b)", "$1")
    text = F.replace(text, F.lit("•"), F.lit(""))
    return F.btrim(F.regexp_replace(text, r"[ \t]{2,}", " "), F.lit(" \t\n\r"))


def normalize(text: Column, strict: bool = True) -> Column:
    return tidy(nfkc(F.coalesce(text, F.lit(""))), strict)


def normalize_label(label: Column) -> Column:
    return F.lower(R.strip(F.coalesce(label, F.lit(""))))


def remove_citations(text: Column) -> Column:
    text = R.replace(R.replace(text, R.BRACKET_CITATION, ""), R.PAREN_CITATION, "")
    return R.strip(R.replace(text, r"\s+([,.;:])", "$1"))


def heading_class(text: Column, o: Options) -> Column:
    """``drop``, ``drop_heading_only``, ``keep`` or ``unknown``."""
    bare = R.strip(R.replace(text, r"^\d+\.?\s+", ""))
    drops = [p for on, p in ((o.drop_references_section, R.REFERENCE_SECTIONS), (o.drop_acknowledgements, R.ACKNOWLEDGEMENT_SECTIONS), (o.drop_appendices, R.APPENDIX_SECTIONS)) if on]
    out = F.when(F.lit(False), F.lit("")) if not drops else F.when(R.matches(bare, [x for p in drops for x in p], True), F.lit("drop"))
    out = out.when(R.matches(bare, R.ARTICLE_TYPES, True), F.lit("drop_heading_only")).when(R.matches(bare, R.WHITELIST, True), F.lit("keep"))
    return out.when(R.matches(text, r"^\d+\.?\s+\w"), F.lit("keep")).otherwise(F.lit("unknown"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, R.java(r"\s+")), lambda w: w != "")


def table_like(text: Column) -> Column:
    words = tokens(text)
    numeric = F.size(F.filter(words, lambda w: R.matches(w, r"^(?:\d+\.?\d*|\.\d+)$")))
    return R.matches(text, R.TABLE_LINE) | ((F.size(words) >= 6) & (numeric * 100 > F.size(words) * 55))


def non_prose(text: Column) -> Column:
    n = F.length(text)
    return (n <= 2) | ((n < 40) & R.matches(text, R.NUMERIC_HEAVY)) | (n - F.length(F.replace(text, F.lit("="), F.lit(""))) >= 2)


def caption_like(text: Column) -> Column:
    return R.matches(text, R.CAPTION, True)


def page_number(text: Column) -> Column:
    return R.matches(text, R.PAGE_NUMBER, True)


def front_matter(text: Column) -> Column:
    return R.matches(text, R.FRONT_MATTER, True)


def end_matter(text: Column) -> Column:
    out = F.lit(False)
    for p in R.END_MATTER:
        out = out | text.startswith(p)
    return out


def inline_end_matter(text: Column) -> Column:
    return R.matches(text, R.INLINE_END_MATTER, True)


def reference_entry(text: Column, strict: bool = True) -> Column:
    entry = R.matches(text, R.REFERENCE_ENTRY, strict)
    return F.length(text).between(30, 1000) & (entry | R.matches(text, R.NUMBERED_REFERENCE if strict else r"^\[\d+\]\s*[A-ZÀ-Ý][a-zà-ý]"))


def affiliation(text: Column) -> Column:
    n = F.length(text)
    mail = R.matches(text, R.EMAIL) & (F.size(tokens(text)) < 15)
    return (n <= 300) & (R.matches(text, R.AFFILIATION, True) | ((n < 100) & (mail | R.matches(text, R.ORCID))))


def known_heading(text: Column) -> Column:
    return R.matches(R.strip(R.replace(R.strip(text), r"^\d+\.?\s+", "")), R.KNOWN_HEADINGS, True)


def language(text: Column) -> Column:
    """The fallback detector: markers in the first 4000 characters."""
    sample = R.strip(F.coalesce(text, F.lit("")))
    folded = R.fold_case(F.substring(sample, 1, 4000))
    hits = F.lit(0)
    for m in R.PORTUGUESE_MARKERS:
        hits = hits + folded.contains(m).cast("int")
    return F.when(sample == "", F.lit("unknown")).when(hits >= 2, F.lit("pt-BR")).otherwise(F.lit("en"))


def effective_language(option: Column, detected: Column) -> Column:
    return F.when(option.isNull() | option.isin("", "auto"), detected).otherwise(option)

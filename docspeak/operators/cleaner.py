"""The cleaning cascade: the first rule that fits decides why a block goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import speech
from ..functions import text as T
from ..schema import Options

# How often, and how long, a line is that repeats on pages.
FURNITURE_TIMES, FURNITURE_CHARS = 3, 90


def with_reason(blocks: DataFrame, options: Options = Options(), order: str = "seq") -> DataFrame:
    """Add ``clean_text`` and ``reason``; a null reason keeps the block, ``heading_hidden`` is counted nowhere.

    One shuffle by document serves the furniture count, the section state and
    whatever groups by document afterwards.
    """
    o = options
    t, label, key = F.col("t"), F.col("norm_label"), F.col("furniture_key")
    rows = blocks.withColumn("t", T.normalize(F.col("text"), o.strict_compat)).withColumn("norm_label", T.normalize_label(F.col("label")))
    rows = rows.repartition("doc_id")  # after the Python step, which forgets how its input was dealt
    rows = rows.withColumn("furniture_key", F.when((t != "") & (F.length(R.fold_case(t)) <= FURNITURE_CHARS), R.fold_case(t)))
    rows = rows.withColumn("times", F.count(key).over(Window.partitionBy("doc_id", "furniture_key")))
    heading = label.isin("title", "section_header")
    rows = rows.withColumn("early", F.when(t == "", F.lit("empty")).when(label.isin(R.DROP_LABELS), label)
        .when((label != "") & ~label.isin(R.KEEP_LABELS) & T.non_prose(t), F.concat(F.lit("non_prose:"), label))
        .when(key.isNotNull() & (F.col("times") >= FURNITURE_TIMES), F.lit("repeated_furniture")))
    rows = rows.withColumn("heading", F.when(F.col("early").isNull() & heading, T.heading_class(t, o)))
    event = F.when((F.col("early") == "reference") & (label == "reference"), True).when(F.col("heading") == "drop", True).when(F.col("heading").isin("keep", "unknown"), False)
    so_far = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("skipping", F.coalesce(F.last(event, True).over(so_far), F.lit(False)))
    rows = rows.withColumn("clean_text", T.tidy(T.remove_citations(t), o.strict_compat) if o.remove_numeric_citations else t)
    late = F.when(F.col("skipping"), F.lit("section_skip"))
    for name, fits in (
        ("caption_like", T.caption_like(t)), ("page_number", T.page_number(t)), ("table_like", T.table_like(t)), ("non_prose", T.non_prose(t)),
        ("front_matter", T.front_matter(t)), ("end_matter", T.end_matter(t)), ("inline_end_matter", T.inline_end_matter(t)),
        ("reference_entry", T.reference_entry(t, o.strict_compat)), ("affiliation", T.affiliation(t)), ("citations_only", F.col("clean_text") == ""),
    ):
        late = late.when(fits, F.lit(name))
    shown = F.when(F.col("heading").startswith("drop"), F.lit("section_heading_drop"))
    shown = shown if o.keep_headings else shown.otherwise(F.lit("heading_hidden"))
    reason = F.when(F.col("early").isNotNull(), F.col("early")).when(heading, shown).otherwise(late)
    return rows.withColumn("reason", reason).withColumn("clean_text", F.when(heading, t).otherwise(F.col("clean_text"))).drop("t", "furniture_key", "times", "early")


def by_label() -> Column:
    return F.col("reason").isin(R.DROP_LABELS)


def stats(rows: DataFrame) -> DataFrame:
    """Per document: all blocks, kept and dropped ones."""
    out = rows.groupBy("doc_id").agg(F.count("*").alias("total_blocks"), F.count_if(F.col("reason").isNull()).alias("kept_blocks"))
    return out.withColumn("dropped_blocks", F.col("total_blocks") - F.col("kept_blocks"))


def dropped(rows: DataFrame, labels: bool) -> DataFrame:
    """``doc_id, reason, n``: drops by label, or by rule."""
    found = rows.where(F.col("reason").isNotNull() & (F.col("reason") != "heading_hidden") & (by_label() if labels else ~by_label()))
    return found.groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


def _counts(names: Column) -> Column:
    """How often each name occurs, as a map."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names)), lambda k: F.struct(k, F.size(F.filter(names, lambda x: x == k)))))


def documents(rows: DataFrame, order: str = "seq", also: dict[str, Column] | None = None) -> DataFrame:
    """One row a document, after one aggregation: the kept parts as ``text``, its ``language``, counts, and drops by label and by rule.

    ``also``: further aggregates of a document's rows, by name.
    """
    part = F.when(F.col("reason").isNull(), F.struct(F.col(order).alias("at"), F.col("clean_text").alias("part")))
    rule = F.col("reason").isNotNull() & (F.col("reason") != "heading_hidden") & ~by_label()
    out = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.count("*").alias("total_blocks"), F.count_if(F.col("reason").isNull()).alias("kept_blocks"),
        F.collect_list(F.when(by_label(), F.col("reason"))).alias("labels"), F.collect_list(F.when(rule, F.col("reason"))).alias("rules"),
        *(v.alias(k) for k, v in (also or {}).items()),
    )
    out = out.select(
        "doc_id", speech.merge_parts(F.transform("parts", lambda p: p["part"])).alias("text"), "total_blocks", "kept_blocks",
        (F.col("total_blocks") - F.col("kept_blocks")).alias("dropped_blocks"), _counts(F.col("labels")).alias("dropped_by_label"), _counts(F.col("rules")).alias("dropped_by_rule"), *(also or {}),
    )
    return out.withColumn("language", T.language(F.col("text")))


def cleaned(rows: DataFrame, order: str = "seq") -> DataFrame:
    """``doc_id, text, language``: the kept parts of each document merged into paragraphs."""
    return documents(rows, order).select("doc_id", "text", "language")

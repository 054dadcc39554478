"""A training corpus from ``documents``: quality, language, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspeak.llm import common, language_id, ngram_join, packing, quality, substring_dedup


def _aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str], list[Column]]:
    """All columns under private names beside the needed ones, the private names, and how to get the columns back: operators add none of them."""
    own = [f"__c{i}" for i in range(len(docs.columns))]
    out = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)), *needed)
    return out, own, [F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged like any other; long ones as a whole. Ties don't arise: a row stands or goes by
    its own text, and repeated rows alike. An empty table stays empty. Columns of any name come out as they were.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, own, back = _aside(docs)
    return quality.score(rows, model, keep=own, text=own[docs.columns.index("text")]).where("predicted = 1").select(back)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit a learned language; a null ``lang`` becomes the predicted one, any other stays.

    Out go null texts, texts without letters, and those whose phrases in the best language, beyond the first three,
    cost no less than spelling the text in equally likely signs. Without labelled text nothing is known to fit.
    Long texts are read whole; ties go to the first language in order; repeated rows fare alike. An empty table
    stays empty. Columns of any name, but for a null ``lang``, come out as they were.
    """
    rows, own, back = _aside(docs)
    found = language_id.identify(rows, language_id.fit(docs), own, fits=True, text=own[docs.columns.index("text")]).where("lang_pred <> 'und' and fits")
    lang = F.coalesce(own[docs.columns.index("lang")], "lang_pred").alias("lang")
    return found.select([lang if c == "lang" else b for c, b in zip(docs.columns, back, strict=True)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least id, then of the least text hash; rows with an id come first.

    Null and empty texts are one text, so one row of them stays; long texts are compared whole; of repeated rows
    one stays. Different texts of one id both stay unless they are near duplicates. An empty table stays empty.
    Columns of any name come out as they were.
    """

    def key(node: str, doc_id: str) -> Column:
        return F.concat_ws(":", F.hex(node), F.col(doc_id).cast("string"))

    least = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")).alias("r")
    kept = ngram_join.classes(docs).groupBy("label").agg(least).select(key("r.node", "r.least_id").alias("__key"))
    rows, _, back = _aside(docs, "text", "doc_id")
    rows = rows.withColumn("__node", ngram_join.node_key()).withColumn("__key", key("__node", "doc_id"))
    return rows.join(kept, "__key").dropDuplicates(["__key"]).select(back)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; texts that lose nothing stay as they are, null and empty ones too.

    Every row stays, if with an empty text; repeated rows lose all that is a window long. Long texts are read whole.
    An empty table stays empty. Columns of any name, but for ``text`` and ``n_chars``, come out as they were.
    """
    rows, own, back = _aside(docs, "doc_id", "text")
    done = substring_dedup.deduplicate(rows, keep=own, texts=True)
    was = F.col(own[docs.columns.index("text")])
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(was)
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return done.select([new.get(c, b) for c, b in zip(docs.columns, back, strict=True)])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed; what the stages before left of near copies shares a cluster.

    A null or empty text is a piece of no bytes, a long one several; equal sizes go in order of id; repeated rows are
    packed each, never in one bin. An empty table gives no row. Other columns than ``doc_id, text, source`` are not read.
    """
    return packing.pack_apart(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", passage_stage),
    ("best_fit_packing", packing_stage),
]
#: Classifiers, joins over sketches and packing aren't SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again, and deleted once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
        common.clean(spark, since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)

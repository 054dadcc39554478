"""The whole way of a document: order, layout, cleaning, review, language, voice, chunks; and what is written of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import speech, text
from ..operators import cleaner, layout, review, voices
from ..schema import Options

#: What is counted of a document.
STATS = [
    "pages", "total_blocks", "kept_blocks", "dropped_blocks", "dropped_by_label", "dropped_by_rule", "detected_language", "reading_order_repaired",
    "layout_regions_found", "layout_filter_dropped", "llm_blocks_processed", "llm_blocks_dropped", "llm_blocks_rewritten",
]


def prepared(blocks: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks in order, without those inside regions; ``layout_dropped`` is how many of the document those were."""
    rows = layout.inside(layout.reading_order(blocks, pages), regions)
    rows = rows.withColumn("layout_dropped", F.count_if(F.col("inside")).over(Window.partitionBy("doc_id")))
    return rows.where("not inside").drop("inside")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Counts of the first cleaning put right by those after a review: drops by rule of the second replace the first's, its drops by label don't count."""
    new = second.select("doc_id", *(F.col(c).alias(f"{c}_2") for c in ("text", "language", "total_blocks", "kept_blocks", "dropped_blocks", "dropped_by_rule")), "llm_processed", "llm_dropped")
    rows, lost = first.join(new, "doc_id", "left"), F.coalesce("llm_dropped", F.lit(0))
    old_rules = F.map_filter("dropped_by_rule", lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("dropped_by_rule_2", F.create_map().cast("map<string,int>"))), k))
    none = F.col("text_2").isNull()  # the review kept nothing, or there was none
    return rows.select(
        "doc_id", F.coalesce("text_2", F.lit("")).alias("text"), F.coalesce("language_2", F.lit("unknown")).alias("language"),
        (F.coalesce("total_blocks_2", F.lit(0)) + F.when(none, F.col("total_blocks")).otherwise(lost)).alias("total_blocks"), F.coalesce("kept_blocks_2", F.lit(0)).alias("kept_blocks"),
        (F.coalesce("dropped_blocks_2", F.lit(0)) + F.when(none, F.col("total_blocks")).otherwise(lost)).alias("dropped_blocks"), "dropped_by_label",
        F.map_concat(old_rules, F.coalesce("dropped_by_rule_2", F.create_map().cast("map<string,int>"))).alias("dropped_by_rule"), "layout_filter_dropped",
        F.coalesce("llm_processed", F.col("total_blocks").cast("int")).alias("llm_blocks_processed"), F.when(none, F.col("total_blocks").cast("int")).otherwise(lost).alias("llm_blocks_dropped"),
    )


def cleaned(blocks: DataFrame, pages: DataFrame, regions: DataFrame, options: Options = Options(), client: Callable[[str], str | None] | None = None) -> DataFrame:
    """A row a document: its text, language and counts. With a ``client`` blocks are reviewed after the first cleaning and cleaned once more."""
    rows = prepared(blocks, pages, regions)
    counted = {"layout_filter_dropped": F.max("layout_dropped")}
    out = cleaner.documents(cleaner.with_reason(rows, options, "pos"), "pos", counted)
    if client is None:
        return out.withColumns({"llm_blocks_processed": F.lit(0), "llm_blocks_dropped": F.lit(0)})
    kept = review.reviewed(rows.select("doc_id", F.col("pos").alias("seq"), "text", "label", "page_no"), client)
    again = cleaner.documents(cleaner.with_reason(kept, options, "place"), "place", {"llm_processed": F.max("llm_processed"), "llm_dropped": F.max("llm_dropped")})
    return merged(out, again)


def listen(blocks: DataFrame, pages: DataFrame, regions: DataFrame, options: Options = Options(), client: Callable[[str], str | None] | None = None) -> DataFrame:
    """``doc_id, text, language, voice, chunks, pauses`` and counts, one row a document."""
    out = cleaned(blocks, pages, regions, options, client)
    lang = text.effective_language(F.lit(options.language), F.col("language"))
    spoken = speech.chunks(speech.verbalize(F.col("text")), speech.chunk_limit(options.chunk_max_chars, options.engine))
    out = out.withColumn("voice", voices.resolve(F.lit(options.voice), lang, F.lit(options.engine))).withColumn("chunks", spoken)
    return out.withColumn("pauses", F.transform("chunks", lambda c: speech.pause(c, options.engine, options.pause_ms)))


def stats(done: DataFrame, page_counts: DataFrame, regions: DataFrame) -> DataFrame:
    """``doc_id, stats``: the record of a document's counts, from :func:`cleaned` or :func:`listen`; ``page_counts(doc_id, page_count)``."""
    found = regions.groupBy("doc_id").agg(F.count("*").cast("int").alias("layout_regions_found"))
    rows = done.join(page_counts.select("doc_id", F.col("page_count").alias("pages")), "doc_id", "left").join(found, "doc_id", "left")
    rows = rows.withColumns({"detected_language": F.col("language"), "reading_order_repaired": F.lit(True), "llm_blocks_rewritten": F.lit(0), "layout_regions_found": F.coalesce("layout_regions_found", F.lit(0))})
    return rows.select("doc_id", F.struct(*STATS).alias("stats"))


def audio_plan(done: DataFrame, engine: str = "piper", rate: int = speech.FRAME_RATE) -> DataFrame:
    """``doc_id, chunk_no, text, pause_ms, silence``: what an engine says, in order, and frames of silence after each chunk; none after the last."""
    rows = done.select("doc_id", F.size("chunks").alias("n"), "pauses", F.posexplode("chunks").alias("chunk_no", "text"))
    ms = F.when(F.col("chunk_no") + 1 < F.col("n"), F.get("pauses", F.col("chunk_no"))).otherwise(F.lit(0))
    return rows.select("doc_id", "chunk_no", "text", ms.alias("pause_ms"), speech.silence_frames(ms, rate).alias("silence"))


def metadata(done: DataFrame, statistics: DataFrame, job: dict[str, Column], options: Options = Options(), spoken: bool = False) -> DataFrame:
    """``job_id, value``: the JSON object of each document; with ``spoken``, as it is after synthesis, with voice and engine. ``job``: ``job_id, filename, created_at, source_pdf``."""
    rows = done.join(statistics, "doc_id").withColumns(job)
    lang = text.effective_language(F.lit(options.language), F.col("language"))
    set_ = F.struct(*(F.lit(v).alias(k) for k, v in asdict(options).items()))
    fields = [*job, F.col("language").alias("detected_language"), lang.alias("effective_language"), set_.alias("options"), "stats"]
    if spoken:
        fields += [voices.record(F.col("voice")).alias("voice"), voices.engine_of(F.col("voice")).alias("engine_used")]
    return rows.select("job_id", F.to_json(F.struct(*fields)).alias("value"))


def write_metadata(out: DataFrame, path: str) -> None:
    """A JSON object a job, below ``job_id=``; a second write, after synthesis, replaces the first."""
    out.write.mode("overwrite").partitionBy("job_id").text(path)


def write_texts(done: DataFrame, path: str) -> None:
    """The cleaned text of each document, below ``doc_id=``."""
    done.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("doc_id").text(path)

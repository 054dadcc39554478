"""Registered queries of the document engine, and the same in SQL where that can be said."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import speech
from .functions import text as T
from .operators import cleaner, jobs, layout, review, voices
from .plans import document
from .schema import Options
from .sources import blocks as B

HEADINGS = ["Abstract", "1. Introduction", "Methods", "References", "Acknowledgements", "Appendix", "RESEARCH ARTICLE", "Patient cohort"]
TRIGGERS = [
    "Figure 3 shows the scan", "Page 12", "Received: 3 May 2020 by the editor", "Open Access This article is licensed under terms",
    "Funding was given by the state", "Smith JA, Doe B (2024) A title of a paper. Journal Name 12:345-350", "[1] Smith and others wrote this line",
    "Department of Radiology, Some University", "[3, 4]", "We saw this (as others did", "The tumors were inclu-", "Images of 224×224 pixels and 3x3 kernels",
    "The effect was strong, p<0.05 and p ≥ 0.1 here", "It reached 78.3% with 5 ± 2 points", "CT and MRI, e.g. Fig. 2", "Esta é uma frase em português, não para todos com calma.",
    "| a | b | c |", "1 2 3.5 4 5 6 seven", "a = b = c", "someone@example.org writes", "R enal function fell [12] and rose (3, 4) again .", "A common running head",
    "The well- known case of pre- and post care", "in patients, as said - before", "F1-score and range 3 – 5 of 10<20", "0000-0002-1825-0097",
]
STATUS = {"signup": "pending", "click": "running", "view": "running", "purchase": "completed", "error": "failed"}
NOW, HOURS = "2024-01-03 00:00:00", 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ``documents``, some of which carry a line that a rule is for."""
    rows = B.from_lines(table(spark, sf_dir, "documents"))
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), (at % len(words)).cast("int"))
    heading, trigger = pick(HEADINGS, F.col("doc_id") + F.col("seq")), pick(TRIGGERS, F.col("doc_id") * 31 + F.col("seq"))
    return rows.withColumn("text", F.when(F.col("seq") % 12 == 5, heading).when((F.col("doc_id") + F.col("seq")) % 7 == 3, trigger).otherwise(F.col("text")))


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`seeded` blocks with more labels, pages of five columns, boxes measured from the bottom, and blocks without box."""
    rows = seeded(spark, sf_dir)
    k, five = (F.col("doc_id") + F.col("seq")) % 13, (F.col("doc_id") % 4 == 1) & (F.col("seq") % 12 != 0)
    label = F.when(k == 0, "reference").when(k == 4, "sidebar").when(k == 7, " Text ").when(k == 9, F.lit(None)).when(k == 11, "caption").otherwise(F.col("label"))
    left = 20 + 115 * (F.col("seq") % 5) - F.when(F.col("seq") % 5 == 3, 10).otherwise(0)
    top = F.when(F.col("doc_id") % 4 == 2, 792 - F.col("bbox.t")).otherwise(F.col("bbox.t"))
    bottom = F.when(F.col("doc_id") % 4 == 2, 792 - F.col("bbox.b")).otherwise(F.col("bbox.b"))
    placed = B.box(F.when(five, left).otherwise(F.col("bbox.l")), top, F.when(five, left + 60).otherwise(F.col("bbox.r")), bottom)
    return rows.withColumn("label", label).withColumn("bbox", F.when((F.col("doc_id") + F.col("seq")) % 17 != 3, placed))


def pictures(rows: DataFrame) -> DataFrame:
    """A picture on every third page."""
    at = rows.where("page_no is not null").select("doc_id", "page_no").distinct().where("(doc_id + page_no) % 3 = 0")
    return at.select("doc_id", F.lit("picture").alias("kind"), "page_no", B.box(F.lit(30), F.lit(260), F.lit(270), F.lit(360)).alias("bbox"))


def _normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).withColumn("t", T.normalize(F.col("text")))


def blocks_from_documents(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", "seq", "text", "label", "page_no", "bbox.l", "bbox.t", "bbox.r", "bbox.b")


def normalize_text(spark, sf_dir):
    return _normed(spark, sf_dir).select("doc_id", "seq", F.col("t").alias("clean"))


def numeric_citations(spark, sf_dir):
    return _normed(spark, sf_dir).select("doc_id", "seq", T.remove_citations(F.col("t")).alias("clean"))


def preview_8000(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 8000).alias("preview"))


def furniture_keys(spark, sf_dir):
    rows = _normed(spark, sf_dir).select("doc_id", R.fold_case(F.col("t")).alias("line")).where((F.col("line") != "") & (F.length("line") <= 90))
    return rows.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


def heading_class(spark, sf_dir):
    return _normed(spark, sf_dir).where("label in ('title', 'section_header')").select("doc_id", "seq", T.heading_class(F.col("t"), Options()).alias("class"))


PREDICATES = {
    "table_like": T.table_like, "non_prose": T.non_prose, "caption_like": T.caption_like, "page_number": T.page_number, "front_matter": T.front_matter,
    "end_matter": T.end_matter, "inline_end_matter": T.inline_end_matter, "reference_entry": T.reference_entry, "affiliation": T.affiliation,
}


def block_predicates(spark, sf_dir):
    return _normed(spark, sf_dir).select("doc_id", "seq", *(f(F.col("t")).alias(k) for k, f in PREDICATES.items()))


def _reasons(spark, sf_dir):
    return cleaner.with_reason(seeded(spark, sf_dir))


def section_skip(spark, sf_dir):
    return _reasons(spark, sf_dir).select("doc_id", "seq", "skipping")


def drop_reason(spark, sf_dir):
    return _reasons(spark, sf_dir).select("doc_id", "seq", "reason")


def doc_stats(spark, sf_dir):
    return cleaner.stats(_reasons(spark, sf_dir))


def drop_by_rule(spark, sf_dir):
    return cleaner.dropped(_reasons(spark, sf_dir), False)


def drop_by_label(spark, sf_dir):
    return cleaner.dropped(_reasons(spark, sf_dir), True)


def layout_antijoin(spark, sf_dir):
    rows = seeded(spark, sf_dir)
    return layout.drop_inside(rows, pictures(rows)).select("doc_id", "seq")


def reading_order(spark, sf_dir):
    rows = seeded(spark, sf_dir)
    return layout.reading_order(rows, B.pages_of(rows)).select("doc_id", "seq", "column", "is_span", "pos")


def column_detect(spark, sf_dir):
    rows = seeded(spark, sf_dir)
    return layout.columns_of(rows, B.pages_of(rows)).select("doc_id", "page_no", F.size("cols").alias("n"), F.array_min("cols").alias("first"), F.array_max("cols").alias("last"))


def language_fallback(spark, sf_dir):
    rows = seeded(spark, sf_dir).select("doc_id", "seq", T.language(F.col("text")).alias("detected"))
    option = F.when(F.col("seq") % 3 == 0, "auto").when(F.col("seq") % 3 == 1, "").otherwise("de")
    return rows.withColumn("effective", T.effective_language(option, F.col("detected")))


def verbalize_units(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", "seq", speech.percent(speech.units(F.col("text"))).alias("spoken"))


def verbalize_operators(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", "seq", speech.comparisons(speech.p_values(F.col("text"))).alias("spoken"))


def verbalize(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", "seq", speech.verbalize(F.col("text")).alias("spoken"))


def cleaned_text(spark, sf_dir):
    return cleaner.cleaned(_reasons(spark, sf_dir))


def chunks(spark, sf_dir):
    rows = cleaned_text(spark, sf_dir).select("doc_id", F.posexplode(speech.chunks(speech.verbalize(F.col("text")))).alias("chunk_no", "text"))
    return rows.select("doc_id", "chunk_no", "text", speech.pause(F.col("text"), "piper").alias("pause_ms"))


def pause_plan(spark, sf_dir):
    rows = seeded(spark, sf_dir).select("doc_id", "seq", speech.pause(F.col("text"), "piper").alias("piper_ms"), speech.pause(F.col("text"), "kokoro").alias("kokoro_ms"))
    return rows.withColumn("frames", speech.silence_frames(F.col("kokoro_ms")))


def voices_for_ui(spark, sf_dir):
    return voices.for_ui(spark)


def voice_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    asked = F.when(F.col("doc_id") % 4 == 0, "kokoro-en-bella").when(F.col("doc_id") % 4 == 1, "nobody").otherwise("auto")
    engine = F.when(F.col("doc_id") % 3 == 0, "kokoro").otherwise("piper")
    lang = F.when(F.col("doc_id") % 5 == 0, "pt-PT").otherwise(F.col("lang"))
    return docs.select("doc_id", voices.resolve(asked, lang, engine).alias("voice"), voices.compatible(asked, engine).alias("compatible"))


def page_limit(spark, sf_dir):
    rows = seeded(spark, sf_dir).groupBy("doc_id").agg(F.coalesce(F.max("page_no"), F.lit(0)).alias("page_count"))
    return B.within_page_limit(rows, 3)


def _page_counts(rows):
    return rows.groupBy("doc_id").agg(F.coalesce(F.max("page_no"), F.lit(0)).alias("page_count"))


def review_ambiguous(spark, sf_dir):
    rows = seeded(spark, sf_dir)
    return review.ambiguous(rows, _page_counts(rows)).select("doc_id", "seq")


def review_batches(spark, sf_dir):
    return review.page_batches(seeded(spark, sf_dir)).select("doc_id", "seq", "batch")


def review_fixed_batches(spark, sf_dir):
    return review.fixed_batches(seeded(spark, sf_dir)).select("doc_id", "seq", "batch")


def review_excerpts(spark, sf_dir):
    return review.excerpts(review.fixed_batches(seeded(spark, sf_dir)))


def review_apply(spark, sf_dir):
    rows = review.fixed_batches(seeded(spark, sf_dir))
    # decided twice: the second counts
    actions = rows.select("doc_id", "batch", "seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("at"))
    actions = actions.withColumn("action", F.when(((F.col("doc_id") + F.col("seq")) % 4 == 0) == (F.col("at") == 1), "DROP").otherwise("KEEP"))
    order = rows.where("seq % 3 = 0").select("doc_id", "batch", (F.lit(100000) - F.col("seq")).alias("ord"), "seq")
    return review.apply(rows, actions, order).select("doc_id", "seq", "place")


def _events(spark, sf_dir):
    status = F.lit(None).cast("string")
    for k, v in STATUS.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("job"), F.col("user_id")).alias("job_id"), "event_id", F.col("ts").alias("at"), status.alias("status"), (F.col("value") / 100).alias("progress"))


def jobs_latest(spark, sf_dir):
    return jobs.latest(_events(spark, sf_dir))


def jobs_recent(spark, sf_dir):
    return jobs.recent(jobs_latest(spark, sf_dir)).select("job_id", "created_at")


def jobs_active(spark, sf_dir):
    return jobs.active(jobs_latest(spark, sf_dir), 10)


def _now():
    return F.lit(NOW).cast("timestamp")


def jobs_expired(spark, sf_dir):
    return jobs.expired(jobs_latest(spark, sf_dir), _now(), HOURS).select("job_id")


def jobs_orphans(spark, sf_dir):
    last = jobs_latest(spark, sf_dir)
    folders = last.select(F.when(F.substring("job_id", -1, 1) == "7", F.concat(F.lit("x"), F.col("job_id"))).otherwise(F.col("job_id")).alias("name"), F.col("created_at").alias("changed_at"))
    return jobs.orphans(folders, last, _now(), HOURS).select("name")


def jobs_public(spark, sf_dir):
    last = jobs_latest(spark, sf_dir)
    done = F.col("status") == "completed"
    return jobs.public(last.select("job_id", "status", F.when(done, "t").alias("text_path"), F.when(done & (F.col("progress") > 0.5), "a").alias("audio_path"), F.col("job_id").alias("pdf_path")))


def html_blocks(spark, sf_dir):
    return B.from_html(table(spark, sf_dir, "pages")).select("doc_id", "seq", "text", "label")


def listen(spark, sf_dir):
    rows = seeded(spark, sf_dir)
    return document.listen(rows, B.pages_of(rows), pictures(rows))


def regions_from_blocks(spark, sf_dir):
    return B.regions(varied(spark, sf_dir)).select("doc_id", "kind", "page_no", "bbox.l", "bbox.t", "bbox.r", "bbox.b")


def furniture_blocks(spark, sf_dir):
    return _reasons(spark, sf_dir).where("reason = 'repeated_furniture'").select("doc_id", "seq")


def drop_reason_varied(spark, sf_dir):
    return cleaner.with_reason(varied(spark, sf_dir)).select("doc_id", "seq", "norm_label", "skipping", "reason")


def drop_reason_plain(spark, sf_dir):
    """With headings hidden, and nothing dropped by section."""
    options = Options(keep_headings=False, remove_numeric_citations=False, drop_references_section=False, drop_acknowledgements=False, drop_appendices=False)
    return cleaner.with_reason(varied(spark, sf_dir), options).select("doc_id", "seq", "reason")


def reading_order_varied(spark, sf_dir):
    rows = varied(spark, sf_dir)
    return layout.reading_order(rows, B.pages_of(rows)).select("doc_id", "seq", "column", "is_span", "pos")


def columns_varied(spark, sf_dir):
    rows = varied(spark, sf_dir)
    return layout.columns_of(rows, B.pages_of(rows)).select("doc_id", "page_no", F.posexplode("cols").alias("at", "center"))


def layout_varied(spark, sf_dir):
    rows = varied(spark, sf_dir)
    return layout.drop_inside(rows, pictures(rows)).select("doc_id", "seq")


def merge_parts(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"])
    return seeded(spark, sf_dir).groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", speech.merge_parts(F.col("parts")).alias("text"))


def verbalize_abbrev(spark, sf_dir):
    return seeded(spark, sf_dir).select("doc_id", "seq", speech.abbreviations(F.col("text")).alias("spoken"))


def _canned(payload: str) -> str:
    """An answer that depends on the first id: none that can be read, a fenced list, or an order with decisions that change."""
    import json

    ids = [x["id"] for x in json.loads(payload)]
    if ids[0] % 3 == 1:
        return "I can't say."
    if ids[0] % 3 == 2:
        return "```json\n" + json.dumps([{"id": i, "action": "drop"} for i in [*ids, -1] if i % 5 == 0]) + "\n```"
    results = [{"id": i, "action": a, "reason": "r"} for a in ("REWRITE_MINIMAL", "DROP") for i in ids if i % 5 == 0]
    return json.dumps({"order": [i for i in reversed(ids) if i % 7 != 1] + [10**6], "results": results})


def review_loop(spark, sf_dir):
    return review.reviewed(seeded(spark, sf_dir), _canned).select("doc_id", "seq", "place", "llm_processed", "llm_dropped")


def review_classify(spark, sf_dir):
    rows = seeded(spark, sf_dir)
    return review.classify(review.ambiguous(rows, _page_counts(rows)), _canned)


ANSWERS = [
    '{"order": [2, 1, 2], "results": [{"id": 1, "action": "drop"}, {"id": 2, "action": "REWRITE_MINIMAL"}]}', '```json\n[{"id": 1, "action": "DROP"}]\n```', '```[{"id": 1, "action": "DROP"}]```',
    ' [{"id": 3}, {"id": 4, "action": "DROP", "reason": "x"}]\n', "no json", "", None, '{"results": []}', "```json\n{}",
]


def review_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*map(F.lit, ANSWERS)), (F.col("doc_id") % len(ANSWERS)).cast("int")).alias("answer"))
    p = rows.select("doc_id", review.parse(F.col("answer")).alias("p"))
    return p.select("doc_id", F.array_join(F.col("p.order").cast("array<string>"), ",").alias("ids"), F.array_join(F.transform(review.decisions(F.col("p")), lambda d: F.concat_ws(":", d["id"], d["action"])), ",").alias("actions"))


def _done(spark, sf_dir, client=None):
    rows = varied(spark, sf_dir)
    return document.cleaned(rows, B.pages_of(rows), pictures(rows), client=client)


def document_counts(spark, sf_dir):
    return _done(spark, sf_dir).select("doc_id", "text", "language", "total_blocks", "kept_blocks", "dropped_blocks", "layout_filter_dropped")


def document_drops(spark, sf_dir):
    rows = _done(spark, sf_dir)
    both = [rows.select("doc_id", F.lit(kind).alias("kind"), F.explode(f"dropped_by_{kind}").alias("reason", "n")) for kind in ("label", "rule")]
    return both[0].unionByName(both[1])


def document_stats(spark, sf_dir):
    rows = varied(spark, sf_dir)
    done = document.cleaned(rows, B.pages_of(rows), pictures(rows), client=_canned)
    s = document.stats(done, _page_counts(rows), pictures(rows))
    return s.select("doc_id", *(f"stats.{c}" for c in ("pages", "total_blocks", "kept_blocks", "dropped_blocks", "reading_order_repaired", "layout_regions_found", "layout_filter_dropped", "llm_blocks_processed", "llm_blocks_dropped")))


def audio_plan(spark, sf_dir):
    out = cleaned_text(spark, sf_dir).select("doc_id", speech.chunks(speech.verbalize(F.col("text"))).alias("chunks"))
    return document.audio_plan(out.withColumn("pauses", F.transform("chunks", lambda c: speech.pause(c, "piper"))))


def extractor_blocks(spark, sf_dir):
    """Items as an extractor gives them: white space around labels, captions for empty texts, boxes of too few numbers, several provenances or none."""
    k = F.col("doc_id") % 5
    numbers = F.when(k == 1, F.array(*map(F.lit, (1.0, 2.0, 3.0)))).otherwise(F.array(F.lit(1.0), F.col("doc_id").cast("double"), F.lit(3.0), F.lit(4.0), F.lit(5.0)))
    entry = lambda n: F.struct(F.lit(n).alias("page_no"), numbers.alias("bbox"))
    prov = F.when(k == 2, F.array(entry(2)).cast("array<struct<page_no:int,bbox:array<double>>>")).when(k == 3, F.slice(F.array(entry(1)), 1, 0)).when(k == 4, F.lit(None)).otherwise(F.array(entry(3), entry(4)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("seq"), F.when(k == 0, "\u00a0\n").otherwise(F.substring("text", 1, 20)).alias("text"), F.concat(F.lit("Cap "), F.col("doc_id")).alias("caption_text"), F.lit("\u00a0Section_Header\n").alias("label"), prov.alias("prov"))
    return B.from_extractor(rows).select("doc_id", "text", "label", "page_no", "bbox.l", "bbox.t", "bbox.r", "bbox.b")


def box_spellings(spark, sf_dir):
    """Boxes from structs in each spelling, and from one that isn't a box."""
    rows, out = table(spark, sf_dir, "documents").select("doc_id"), []
    for names in (*B.BOX_NAMES, ("a", "b", "c", "d")):
        made = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.struct(*((F.col("doc_id") + i).alias(n) for i, n in enumerate(names)))).alias("x"))
        out.append(made.select("doc_id", F.lit(names[0]).alias("spelling"), B.coerce_box(F.col("x"), made.schema["x"].dataType).alias("y")))
    whole = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return whole.select("doc_id", "spelling", "y.l", "y.t", "y.r", "y.b")


def page_sizes(spark, sf_dir):
    """Pages as a map by number and as a list, some without a size."""
    page = lambda n: F.struct(F.when((F.col("doc_id") + n) % 3 != 0, F.struct((F.col("doc_id") + n).alias("width"), F.lit(792).alias("height"))).alias("size"))
    docs = table(spark, sf_dir, "documents")
    listed = B.page_sizes(docs.where("doc_id % 2 = 0").select("doc_id", F.array(*(page(n) for n in range(3))).alias("pages")))
    return listed.unionByName(B.page_sizes(docs.where("doc_id % 2 = 1").select("doc_id", F.create_map(F.lit(7), page(0), F.lit(4), page(1)).alias("pages"))))


def upload_checks(spark, sf_dir):
    """Requests each of which fails another check, or none."""
    k = F.col("doc_id") % 12
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k == 1, "").when(k == 3, "a.txt").otherwise("A.PDF").alias("filename"), F.when(k == 2, F.lit(b"%PDX-")).otherwise(F.lit(b"%PDF-")).alias("head"),
        F.when(k == 4, 60_000_000).otherwise(52_428_800).alias("length"), F.when(k == 5, "espeak").when(k == 6, "kokoro").otherwise("piper").alias("engine"),
        F.when(k == 6, "pt_BR-cadu-medium").otherwise("auto").alias("voice"), F.when(k == 7, "fast").when(k == 8, "2.5").when(k == 9, "NaN").otherwise("0.5").alias("rate"),
        F.when(k >= 10, "on").otherwise("off").alias("review"), F.when(k == 11, "localhost:8000/v1").alias("review_url"),
    )
    return B.checked(rows).select("doc_id", "code", "reason", "valid")


def source_paths(spark, sf_dir):
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 3, "../x").otherwise(F.concat(F.lit("job"), F.col("doc_id"))).alias("job_id"), F.when(k == 0, "/up/a/b.pdf").when(k == 1, "/up/../etc/x").when(k == 2, "/other/y").alias("path"))
    return rows.select("doc_id", B.source_path(F.col("path"), F.col("job_id"), "/up/").alias("source"))


def speech_rates(spark, sf_dir):
    asked = F.get(F.array(*map(F.lit, ["0.5", "2", "2.01", "x", "NaN", "Infinity", "1.05", None])), (F.col("doc_id") % 8).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", B.valid_rate(asked).alias("rate"))
    return rows.select("doc_id", "rate", speech.length_scale(F.col("rate")).alias("scale"), speech.kokoro_speed(F.col("rate")).alias("speed"))


def voices_for_choice(spark, sf_dir):
    out = [voices.for_choice(spark, lang, engine).select(F.lit(lang).alias("lang"), F.lit(engine or "").alias("asked"), "key") for lang in ("auto", "pt-BR", "en", "de") for engine in ("piper", "kokoro", None)]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def voice_records(spark, sf_dir):
    v = F.col("key")
    return voices.voices(spark).select("key", voices.record(v)["engine"].alias("engine"), voices.kokoro_name(v).alias("kokoro"), voices.kokoro_language(F.col("language_code")).alias("code"), voices.engine_name(F.concat("engine", F.when(v.contains("dora"), "x").otherwise(""))).alias("own"))


def voice_addresses(spark, sf_dir):
    return voices.addresses(spark, "https://voices.example/", "/cache/voices/")


def jobs_changes(spark, sf_dir):
    rows = _events(spark, sf_dir)
    rows = rows.select("job_id", "event_id", "at", F.when(F.col("event_id") % 3 == 0, F.col("status")).alias("status"), F.when(F.col("event_id") % 4 == 1, F.col("progress")).alias("progress"))
    return jobs.changes(rows, ["status", "progress"])


def jobs_artefacts(spark, sf_dir):
    rows = jobs_latest(spark, sf_dir).select(F.when(F.col("job_id").endswith("3"), F.concat(F.lit("../"), F.col("job_id"))).otherwise(F.col("job_id")).alias("job_id"))
    return jobs.artefacts(rows, "/d/uploads/", "/d/outputs")


def jobs_admitted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"))
    busy = jobs_latest(spark, sf_dir).orderBy("job_id").limit(7).withColumn("status", F.when(F.substring("job_id", -1, 1) < "5", "running").otherwise("failed"))
    return jobs.admitted(rows, busy, 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        blocks_from_documents, normalize_text, numeric_citations, preview_8000, furniture_keys, heading_class, block_predicates, section_skip, drop_reason,
        doc_stats, drop_by_rule, drop_by_label, layout_antijoin, column_detect, reading_order, language_fallback, verbalize_units, verbalize_operators, verbalize,
        cleaned_text, chunks, pause_plan, voices_for_ui, voice_resolution, page_limit, review_ambiguous, review_batches, review_fixed_batches, review_excerpts,
        regions_from_blocks, furniture_blocks, drop_reason_varied, drop_reason_plain, reading_order_varied, columns_varied, layout_varied, merge_parts, verbalize_abbrev,
        review_loop, review_classify, review_parse, document_counts, document_drops, document_stats, audio_plan, extractor_blocks, box_spellings, page_sizes, upload_checks,
        source_paths, speech_rates, voices_for_choice, voice_records, voice_addresses, jobs_changes, jobs_artefacts, jobs_admitted, review_apply, jobs_latest, jobs_recent, jobs_active, jobs_expired, jobs_orphans, jobs_public, html_blocks, listen,
    )
}


# ---- the same in SQL ----


def _re2(pattern: str) -> str:
    """A pattern for RE2, whose \\w is ASCII only, quoted for SQL."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == "\\w":
            out += r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]"
        else:
            inside = c == "[" or (inside and c != "]")
            out += c
        i += len(c)
    return "'" + out.replace("'", "''") + "'"


def _m(text: str, pattern: str | list[str], i: bool = False) -> str:
    return f"regexp_matches({text}, {_re2(pattern if isinstance(pattern, str) else R.any_of(pattern))}{', ' + repr('i') if i else ''})"


def _words(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tidy(x: str) -> str:
    x = f"replace(replace({x}, chr(173), ''), chr(160), ' ')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '^([A-Z])\s+([a-z]{{2,}})([^\p{{L}}\p{{N}}_]|$)', '\1\2\3')"
    return rf"trim(regexp_replace(replace({x}, '•', ''), '[ \t]{{2,}}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _uncited(x: str) -> str:
    for p in (R.BRACKET_CITATION, R.PAREN_CITATION):
        x = f"regexp_replace({x}, {_re2(p)}, '', 'g')"
    return _strip(rf"regexp_replace({x}, '\s+([,.;:])', '\1', 'g')")


_TOKENS = r"list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')"
_SQL = {
    "table_like": f"({_m('t', R.TABLE_LINE)} or (len({_TOKENS}) >= 6 and 100 * len(list_filter({_TOKENS}, lambda w: {_m('w', r'^(?:\d+\.?\d*|\.\d+)$')})) > 55 * len({_TOKENS})))",
    "non_prose": f"(length(t) <= 2 or (length(t) < 40 and {_m('t', R.NUMERIC_HEAVY)}) or length(t) - length(replace(t, '=', '')) >= 2)",
    "caption_like": _m("t", R.CAPTION, True),
    "page_number": _m("t", R.PAGE_NUMBER, True),
    "front_matter": _m("t", R.FRONT_MATTER, True),
    "end_matter": "(" + " or ".join(f"starts_with(t, {p})" for p in _words(R.END_MATTER)[1:-1].replace("', '", "'\x00'").split("\x00")) + ")",
    "inline_end_matter": _m("t", R.INLINE_END_MATTER, True),
    "reference_entry": f"(length(t) between 30 and 1000 and ({_m('t', R.REFERENCE_ENTRY, True)} or {_m('t', R.NUMBERED_REFERENCE)}))",
    "affiliation": f"(length(t) <= 300 and ({_m('t', R.AFFILIATION, True)} or (length(t) < 100 and (({_m('t', R.EMAIL)} and len({_TOKENS}) < 15) or {_m('t', R.ORCID)}))))",
}
_BARE = _strip(r"regexp_replace(t, '^\d+\.?\s+', '')")
_HEADING = (
    f"case when {_m(_BARE, [*R.REFERENCE_SECTIONS, *R.ACKNOWLEDGEMENT_SECTIONS, *R.APPENDIX_SECTIONS], True)} then 'drop' when {_m(_BARE, R.ARTICLE_TYPES, True)} then 'drop_heading_only' "
    f"when {_m(_BARE, R.WHITELIST, True)} or {_m('t', r'^\d+\.?\s+\w')} then 'keep' else 'unknown' end"
)
_BLOCKS = f"""
with raw as (select doc_id, unnest(range(len(ls))) as s, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
blocks as (select doc_id, s::int as seq,
  case when s % 12 = 5 then {_words(HEADINGS)}[(doc_id + s) % {len(HEADINGS)} + 1] when (doc_id + s) % 7 = 3 then {_words(TRIGGERS)}[(doc_id * 31 + s) % {len(TRIGGERS)} + 1] else line end as text,
  case when s % 12 = 0 then 'title' when s % 12 = 5 then 'section_header' when s % 12 = 11 then 'page_footer' else 'paragraph' end as label,
  case when doc_id % 50 <> 49 then (s // 12)::int + 1 end as page_no,
  (case when s % 12 = 0 then 30 else 30 + 290 * (s % 2) end)::double as l, (60 + 50 * ((s * 7) % 12))::double as t,
  (case when s % 12 = 0 then 580 else 270 + 290 * (s % 2) end)::double as r, (90 + 50 * ((s * 7) % 12))::double as b from raw)"""
_NORMED = _BLOCKS + f", normed as (select doc_id, seq, label, text, {_tidy('text')} as t from blocks), keyed as (select *, replace(lower(t), 'ß', 'ss') as k from normed)"
_LABEL = r"regexp_replace(lower(coalesce(label, '')), '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"


def _cascade(blocks: str, cited: bool = False, hide: bool = False, heading: str = _HEADING) -> str:
    """Reasons of blocks of the table ``blocks`` that ``blocks`` ends with."""
    late = " ".join(f"when {_SQL[k]} then '{k}'" for k in ("caption_like", "page_number", "table_like", "non_prose", "front_matter", "end_matter", "inline_end_matter", "reference_entry", "affiliation"))
    cleaned = "t" if cited else _tidy(_uncited("t"))
    return blocks + f""", normed as (select doc_id, seq, {_LABEL} as label, text, {_tidy("coalesce(text, '')")} as t from blocks), keyed as (select *, replace(lower(t), 'ß', 'ss') as k from normed),
f as (select *, count(case when k <> '' and length(k) <= 90 then k end) over (partition by doc_id, case when length(k) <= 90 and k <> '' then k end) as times from keyed),
e as (select *, case when t = '' then 'empty' when label in ({_words(R.DROP_LABELS)[1:-1]}) then label
  when label <> '' and label not in ({_words(R.KEEP_LABELS)[1:-1]}) and {_SQL["non_prose"]} then 'non_prose:' || label
  when k <> '' and length(k) <= 90 and times >= 3 then 'repeated_furniture' end as early from f),
h as (select *, case when early is null and label in ('title', 'section_header') then {heading} end as heading from e),
s as (select *, coalesce(last_value(case when early = 'reference' and label = 'reference' or heading = 'drop' then true when heading in ('keep', 'unknown') then false end ignore nulls)
  over (partition by doc_id order by seq rows between unbounded preceding and current row), false) as skipping from h),
reasons as (select doc_id, seq, label, skipping, case when label in ('title', 'section_header') then t else {cleaned} end as clean,
  case when early is not null then early when label in ('title', 'section_header') then case when heading like 'drop%' then 'section_heading_drop' {"else 'heading_hidden'" if hide else ""} end
  when skipping then 'section_skip' {late} when {cleaned} = '' then 'citations_only' end as reason from s)"""


_CASCADE = _cascade(_BLOCKS)
_LABELS = f"({_words(R.DROP_LABELS)[1:-1]})"
_JOBS = """
with ev as (select 'job' || user_id as job_id, event_id, ts as happened, case event_type when 'signup' then 'pending' when 'click' then 'running' when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' end as status, value / 100 as progress from events),
r as (select *, row_number() over (partition by job_id order by happened desc, event_id desc) as n, min(happened) over (partition by job_id) as created_at from ev),
jobs as (select job_id, created_at, happened as updated_at, status, greatest(0, least(1, progress))::double as progress from r where n = 1)"""
_HITS = " + ".join(f"contains(x, '{m}')::int" for m in R.PORTUGUESE_MARKERS)
_TITLE = f"(length({_strip('text')}) <= 60 and {_m(_strip('text'), R.TITLE_CASE)})"


def _ops(x: str) -> str:
    for sign, word in R.COMPARISONS.items():
        x = rf"regexp_replace({x}, '\bp\s*{sign}\s*([\d.]+)', 'p {word} \1', 'g')"
    for sign, word in R.COMPARISONS.items():
        x = rf"regexp_replace({x}, '(\d+(?:\.\d+)?)\s*{sign}\s*(\d+(?:\.\d+)?)', '\1 {word} \2', 'g')"
    return x


def _pause(stop: int, comma: int, other: int, empty: int) -> str:
    last = r"right(regexp_replace(text, '\s+$', ''), 1)"
    return f"(case when {last} = '' then {empty} when {last} in ('.', '!', '?') then {stop} when {last} in (',', ';', ':') then {comma} else {other} end)::int"


_VARIED = _BLOCKS.replace("blocks as (", "first as (") + """, blocks as (select doc_id, seq, text, page_no,
  case (doc_id + seq) % 13 when 0 then 'reference' when 4 then 'sidebar' when 7 then ' Text ' when 9 then null when 11 then 'caption' else label end as label,
  case when (doc_id + seq) % 17 <> 3 then case when doc_id % 4 = 1 and seq % 12 <> 0 then 20 + 115 * (seq % 5) - case when seq % 5 = 3 then 10 else 0 end else l end end::double as l,
  case when (doc_id + seq) % 17 <> 3 then case when doc_id % 4 = 2 then 792 - t else t end end::double as t,
  case when (doc_id + seq) % 17 <> 3 then case when doc_id % 4 = 1 and seq % 12 <> 0 then 80 + 115 * (seq % 5) - case when seq % 5 = 3 then 10 else 0 end else r end end::double as r,
  case when (doc_id + seq) % 17 <> 3 then case when doc_id % 4 = 2 then 792 - b else b end end::double as b from first)"""
_COLS = """, c as (select doc_id, page_no, seq, (l + r) / 2 as mid from blocks where page_no is not null and r > l and r - l < 306),
g as (select *, case when mid - lag(mid) over w >= 61.2 then 1 else 0 end as new from c window w as (partition by doc_id, page_no order by mid, seq)),
cl as (select *, sum(new) over (partition by doc_id, page_no order by mid, seq) as k from g),
cs as (select doc_id, page_no, k, sum(mid) as total, count(*) as n from cl group by all),
cl5 as (select doc_id, page_no, list({'s': total, 'n': n} order by k) as q, sum(n) as many from cs group by all having sum(n) >= 3 and count(*) > 1),
gaps as (select *, list_transform(range(1, len(q)), lambda i: q[i + 1].s / q[i + 1].n - q[i].s / q[i].n) as gap from cl5),
least as (select *, list_position(gap, list_min(gap)) as i from gaps),
cols as (select doc_id, page_no, list_sort(list_transform(case when len(q) < 5 then q else q[1:i - 1] || [{'s': q[i].s + q[i + 1].s, 'n': q[i].n + q[i + 1].n}] || q[i + 2:] end, lambda x: x.s / x.n)) as cols from least)"""
_ORDER = """, p as (select b.*, cols, coalesce(cols is not null and l is not null and (r - l >= 367.2 or len(list_filter(cols, lambda c: c >= b.l - 4 and c <= b.r + 4)) >= 2), false) as is_span,
  case when l is null then 0 when t <= b then t else 792 - t end as y, max(l) over (partition by doc_id, page_no) is not null and page_no is not null as boxed from blocks b left join cols using (doc_id, page_no)),
q as (select *, case when cols is null or is_span or l is null then 0 else list_position(list_transform(cols, lambda c: abs(c - (l + r) / 2)), list_min(list_transform(cols, lambda c: abs(c - (l + r) / 2)))) - 1 end as col from p),
z as (select x.*, case when x.cols is null or x.l is null then 0 when x.is_span then (select count(*) from q y where y.doc_id = x.doc_id and y.page_no = x.page_no and y.is_span and (y.y < x.y or (y.y = x.y and y.seq < x.seq)))
  else (select count(*) from q y where y.doc_id = x.doc_id and y.page_no = x.page_no and y.is_span and not (x.y < y.y - 3)) end as seg from q x),
placed as (select *, (row_number() over (partition by doc_id order by page_no nulls last, cols is not null and l is null, seg, cols is not null and is_span, case when cols is null then 0 else col end, case when boxed and (l is not null or cols is null) then y else 0 end, seq) - 1)::int as pos from z)"""
_INSIDE = f"""coalesce(page_no is not null and (doc_id + page_no) % 3 = 0 and not (r <= 30 - m or 270 + m <= l or b <= 260 - m or 360 + m <= t), false)"""
_LAST = "string_split(a, chr(10) || chr(10))[-1]"
_SHORT = rf"""(length({_LAST}) <= 80 and not regexp_matches({_LAST}, '[.!?]') and len(list_filter(regexp_split_to_array({_LAST}, '\s+'), lambda w: w <> '')) between 1 and 8
  and len(list_filter(regexp_split_to_array({_LAST}, '\s+'), lambda w: w <> '' and not (regexp_matches(w, '^[\p{{Lu}}\p{{Lt}}]') or (regexp_matches(w, '\p{{Lu}}') and not regexp_matches(w, '\p{{Ll}}')) or contains(w, '/') or lower(w) = 'of'))) = 0)"""
_LOWER = r"regexp_matches(x, '^[\p{Ll}ªº]')"


def _merged(parts: str) -> str:
    """Paragraphs of a list of parts."""
    fold = rf"""list_reduce(list_prepend('', list_filter(list_transform({parts}, lambda s: {_strip("s")}), lambda s: s <> '')), lambda a, x: case when a = '' then x
      when ends_with(a, '-') and {_LOWER} then left(a, length(a) - 1) || x
      when length(replace({_LAST}, ')', '')) > length(replace({_LAST}, '(', '')) or (not {_SHORT} and {_LOWER} and not regexp_matches({_LAST}, '[.?!][)\]}}''"]*$')) then a || ' ' || x
      else a || chr(10) || chr(10) || x end)"""
    return _strip(rf"regexp_replace({fold}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _abbreviated(x: str) -> str:
    for k in sorted(R.ABBREVIATIONS, key=len, reverse=True):
        if R.ABBREVIATIONS[k] != k:
            for _ in range(2):  # a neighbour's right side may have been taken for the first's left
                x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){re.escape(k)}([\s,.:;!?)\]\-]|$)', '\1{R.ABBREVIATIONS[k]}\2', 'g')"
    return x


_UNITS = r"regexp_replace(regexp_replace(text, '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g'), '(\d+)\s*[×xX]\s*(\d+)', '\1 by \2', 'g')"


def _op(x: str, pattern: str, by: str) -> str:
    """One pass marks the operators, so that none of a number's two sides is taken twice."""
    x = rf"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    for sign, word in R.COMPARISONS.items():
        x = f"replace({x}, chr(57344) || '{sign}' || chr(57345), '{word}')"
    return x


def _spoken() -> str:
    x = _op(_UNITS, r"\bp\s*([<>≤≥])\s*([\d.]+)", "p \ue000\\1\ue001 \\2")
    x = rf"regexp_replace({x}, '\bF(\d)[-\s]?score', 'F\1 score', 'gi')"
    x = rf"regexp_replace({x}, '(\d+(?:\.\d+)?)\s*±\s*(\d+(?:\.\d+)?)', '\1 plus or minus \2', 'g')"
    x = _op(x, r"(\d+(?:\.\d+)?)\s*([≤≥><])\s*(\d+(?:\.\d+)?)", "\\1 \ue000\\2\ue001 \\3")
    x = _abbreviated(rf"regexp_replace({x}, '(\d+(?:\.\d+)?)\s*%', '\1 percent', 'g')")
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])\s*[–—]\s*([\p{{L}}\p{{N}}_])', '\1, \2', 'g')"
    return _strip(rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')")


def _packed(pieces: str, limit: int, a: str) -> str:
    """Pieces packed greedily, joined by chr(30); ``a`` names the state in the fold."""
    now = f"string_split({a}, chr(30))[-1]"
    return f"""list_reduce(list_prepend('', {pieces}), lambda {a}, {a}x: case when {now} <> '' and length(trim({now} || ' ' || {a}x)) > {limit} then {a} || chr(30) || {a}x
      else left({a}, length({a}) - length({now})) || trim({now} || ' ' || {a}x) end)"""


def _chunked(limit: int) -> str:
    """Chunks of ``whole``, joined by chr(30)."""
    by_clause = _packed(r"string_split(regexp_replace(s, '([,;:])\s+', '\1' || chr(31), 'g'), chr(31))", limit, "p")
    words = _packed(r"list_filter(regexp_split_to_array(last, '\s+'), lambda w: w <> '')", limit, "v")
    cut = rf"""list_transform(list_filter(list_transform(string_split(regexp_replace(whole, '([.!?])\s+([A-ZÀ-Ý0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda s: {_strip("s")}), lambda s: s <> ''),
      lambda s: {{'s': s, 'p': case when length(s) > {limit} then {by_clause} else '' end}})"""
    more = f"""list_transform({cut}, lambda e: {{'s': e.s, 'p': list_transform([string_split(e.p, chr(30))[-1]], lambda last: case when length(last) > {limit} then left(e.p, length(e.p) - length(last)) || {words} else e.p end)[1]}})"""
    now = "string_split(a.s, chr(30))[-1]"
    fold = f"""list_reduce(list_prepend({{'s': '', 'p': ''}}, {more}), lambda a, x: {{'s': case when {now} <> '' and length(trim({now} || ' ' || x.s)) > {limit} then a.s || chr(30) || x.s
      when length(x.s) > {limit} then a.s || x.p || chr(30) else left(a.s, length(a.s) - length({now})) || trim({now} || ' ' || x.s) end, 'p': ''}}).s"""
    return f"case when length(whole) <= {limit} then whole else rtrim({fold}, chr(30)) end"


def _parts(reasons: str) -> str:
    return reasons + f", kept as (select doc_id, list(clean order by seq) filter (reason is null) as ps from reasons group by doc_id), docs as (select doc_id, {_merged('coalesce(ps, [])')} as text from kept)"


def _language(x: str = "text") -> str:
    hits = " + ".join(f"contains(replace(lower(substring({_strip(x)}, 1, 4000)), 'ß', 'ss'), '{m}')::int" for m in R.PORTUGUESE_MARKERS)
    return f"case when {_strip(x)} = '' then 'unknown' when {hits} >= 2 then 'pt-BR' else 'en' end"


_CHUNKS = _parts(_CASCADE) + f""", spoken as (select doc_id, {_spoken()} as whole from docs),
  cut as (select doc_id, string_split({_chunked(900)}, chr(30)) as cs from spoken), chunk as (select doc_id, unnest(range(len(cs)))::int as chunk_no, unnest(cs) as text, len(cs) as n from cut)"""
_BATCHES = """, pg as (select doc_id, page_no, count(*) as n, sum(least(length(coalesce(text, '')), 500)) as c, row_number() over (partition by doc_id order by page_no nulls last) as k from blocks group by doc_id, page_no),
  pack as (select doc_id, page_no, k, 0 as batch, n, c from pg where k = 1 union all select p.doc_id, p.page_no, p.k,
    case when b.n + p.n > 20 or b.c + p.c > 6000 then batch + 1 else batch end, case when b.n + p.n > 20 or b.c + p.c > 6000 then p.n else b.n + p.n end, case when b.n + p.n > 20 or b.c + p.c > 6000 then p.c else b.c + p.c end
    from pack b join pg p on p.doc_id = b.doc_id and p.k = b.k + 1),
  batched as (select b.*, batch, min(seq) over (partition by b.doc_id, batch) % 3 as mode from blocks b join pack on pack.doc_id = b.doc_id and pack.page_no is not distinct from b.page_no)"""
_RECURSIVE = lambda sql: sql.replace("with ", "with recursive ", 1)
_KNOWN = "coalesce(label, '') in ('title', 'section_header') and " + _m(_strip("regexp_replace(" + _strip("coalesce(text, '')") + ", '^[0-9]+[.]?[ ]+', '')"), R.KNOWN_HEADINGS, True)
_LOOP = _BATCHES + f""", judged as (select *, coalesce(mode <> 1 and seq % 5 = 0 and not ({_KNOWN}), false) as gone from batched),
  counted as (select *, count(*) over (partition by doc_id)::int as llm_processed, (count(*) filter (gone) over (partition by doc_id))::int as llm_dropped from judged),
  stay as (select *, (row_number() over (partition by doc_id order by batch, case when mode = 0 and seq % 7 <> 1 then -seq end nulls last, seq) - 1)::int as place from counted where not gone)"""
_AHEAD = _VARIED + _COLS + _ORDER + f""", met as (select *, case when {_TITLE.replace("text", "coalesce(text, '')")} then 42 else 12 end as m from placed),
  seen as (select *, {_INSIDE} as inside, count(*) filter ({_INSIDE}) over (partition by doc_id) as layout_dropped from met)"""
#: The table of blocks that the cascade reads, under its own name.
_AGAIN = lambda sql, name: sql.replace("from blocks)", f"from {name})")
_DONE = _AHEAD + _cascade(", ready as (select doc_id, pos as seq, label, text, layout_dropped from seen where not inside)").replace("from blocks)", "from ready)")

_AMBIGUOUS = _BLOCKS + f""", c as (select doc_id, coalesce(max(page_no), 0) as n from blocks group by doc_id),
      x as (select doc_id, seq, label, {_strip('text')} as body, coalesce(page_no <= 2 or (n > 0 and page_no >= n - 1), false) as edge from blocks join c using (doc_id)),
      ambiguous as (select doc_id, seq, label, body from x where body <> '' and case when label in ('title', 'section_header') and edge then not {_m(_strip("regexp_replace(body, '^[0-9]+[.]?[ ]+', '')"), R.KNOWN_HEADINGS, True)}
        else (edge and length(body) < 100) or (length(body) < 40 and label in ('text', 'paragraph')) end)"""

ORACLE_SQL: dict[str, str] = {
    "blocks_from_documents": _BLOCKS + " select doc_id, seq, text, label, page_no, l, t, r, b from blocks",
    "normalize_text": _NORMED + " select doc_id, seq, t as clean from normed",
    "numeric_citations": _NORMED + f" select doc_id, seq, {_uncited('t')} as clean from normed",
    "preview_8000": "select doc_id, substring(text, 1, 8000) as preview from documents",
    "furniture_keys": _NORMED + " select doc_id, k as line, count(*) as n from keyed where k <> '' and length(k) <= 90 group by all having count(*) >= 3",
    "heading_class": _NORMED + f" select doc_id, seq, {_HEADING} as class from normed where label in ('title', 'section_header')",
    "block_predicates": _NORMED + " select doc_id, seq, " + ", ".join(f"{v} as {k}" for k, v in _SQL.items()) + " from normed",
    "section_skip": _CASCADE + " select doc_id, seq, skipping from reasons",
    "drop_reason": _CASCADE + " select doc_id, seq, reason from reasons",
    "doc_stats": _CASCADE + " select doc_id, count(*) as total_blocks, count(*) filter (reason is null) as kept_blocks, count(reason) as dropped_blocks from reasons group by doc_id",
    "drop_by_rule": _CASCADE + f" select doc_id, reason, count(*) as n from reasons where reason is not null and reason not in {_LABELS} group by all",
    "drop_by_label": _CASCADE + f" select doc_id, reason, count(*) as n from reasons where reason in {_LABELS} group by all",
    "layout_antijoin": _BLOCKS + f""" select doc_id, seq from (select *, case when {_TITLE} then 42 else 12 end as m from blocks)
      where not (page_no is not null and (doc_id + page_no) % 3 = 0 and not (r <= 30 - m or 270 + m <= l or b <= 260 - m or 360 + m <= t))""",
    "column_detect": _BLOCKS + _COLS + " select doc_id, page_no, len(cols)::int as n, list_min(cols) as first, list_max(cols) as last from cols",
    "reading_order": _BLOCKS + _COLS + _ORDER + ' select doc_id, seq, col::int as "column", is_span, pos from placed',
    "reading_order_varied": _VARIED + _COLS + _ORDER + ' select doc_id, seq, col::int as "column", is_span, pos from placed',
    "columns_varied": _VARIED + _COLS + " select doc_id, page_no, unnest(range(len(cols)))::int as at, unnest(cols) as center from cols",
    "layout_varied": _VARIED + f" select doc_id, seq from (select *, case when {_TITLE} then 42 else 12 end as m from blocks) where not {_INSIDE}",
    "regions_from_blocks": _VARIED + " select doc_id, label as kind, page_no, l, t, r, b from blocks where label in ('picture', 'table', 'caption') and page_no is not null and l is not null",
    "furniture_blocks": _CASCADE + " select doc_id, seq from reasons where reason = 'repeated_furniture'",
    "drop_reason_varied": _cascade(_VARIED) + " select doc_id, seq, label as norm_label, skipping, reason from reasons",
    "drop_reason_plain": _cascade(_VARIED, True, True, _HEADING.replace(_HEADING[: _HEADING.index(" then 'drop' ")], "case when false")) + " select doc_id, seq, reason from reasons",
    "merge_parts": _BLOCKS + f", d as (select doc_id, list(text order by seq) as ps from blocks group by doc_id) select doc_id, {_merged('ps')} as text from d",
    "cleaned_text": _parts(_CASCADE) + f" select doc_id, text, {_language()} as language from docs",
    "verbalize": _BLOCKS + f" select doc_id, seq, {_spoken()} as spoken from blocks",
    "verbalize_abbrev": _BLOCKS + f" select doc_id, seq, {_abbreviated('text')} as spoken from blocks",
    "chunks": _CHUNKS + f" select doc_id, chunk_no, text, {_pause(350, 120, 500, 220)} as pause_ms from chunk",
    "audio_plan": _CHUNKS + f", w as (select *, case when chunk_no + 1 < n then {_pause(350, 120, 500, 220)} else 0 end as pause_ms from chunk) select doc_id, chunk_no, text, pause_ms, (24 * pause_ms)::bigint as silence from w",
    "document_counts": _DONE + f""", kept as (select doc_id, list(clean order by seq) filter (reason is null) as ps, count(*) as total_blocks, count(*) filter (reason is null) as kept_blocks from reasons group by doc_id),
      docs as (select doc_id, {_merged("coalesce(ps, [])")} as text, total_blocks, kept_blocks from kept), lost as (select doc_id, max(layout_dropped) as layout_filter_dropped from ready group by doc_id)
      select doc_id, text, {_language()} as language, total_blocks, kept_blocks, total_blocks - kept_blocks as dropped_blocks, layout_filter_dropped from docs join lost using (doc_id)""",
    "document_drops": _DONE + f" select doc_id, case when reason in {_LABELS} then 'label' else 'rule' end as kind, reason, count(*)::int as n from reasons where reason is not null group by all",
    "document_stats": _RECURSIVE(_VARIED.replace("first as (", "first as (")) + (_AHEAD + ", ready as (select doc_id, pos as seq, label, text, page_no, layout_dropped from seen where not inside)").removeprefix(_VARIED)
    + _LOOP.replace("from blocks", "from ready") + _cascade(", back as (select doc_id, place as seq, label, text from stay)").replace("from blocks)", "from back)")
    + """, a as (select doc_id, count(*)::int as n, max(layout_dropped) as layout_filter_dropped from ready group by doc_id), x as (select doc_id, count(*) as t, count(*) filter (reason is null) as k from reasons group by doc_id),
      l as (select doc_id, max(llm_dropped) as d from counted group by doc_id), pc as (select doc_id, coalesce(max(page_no), 0) as pages, count(distinct page_no) filter (page_no is not null and (doc_id + page_no) % 3 = 0)::int as found from blocks group by doc_id)
      select doc_id, pages, coalesce(t, 0) + d as total_blocks, coalesce(k, 0) as kept_blocks, coalesce(t - k, 0) + d as dropped_blocks, true as reading_order_repaired, found as layout_regions_found, layout_filter_dropped,
        n as llm_blocks_processed, d as llm_blocks_dropped from a join l using (doc_id) join pc using (doc_id) left join x using (doc_id)""",
    "extractor_blocks": """select doc_id, case when doc_id % 5 = 0 then 'Cap ' || doc_id when trim(substring(coalesce(text, ''), 1, 20), ' ' || chr(9) || chr(10) || chr(13)) = '' then 'Cap ' || doc_id else substring(text, 1, 20) end as text, 'section_header' as label,
      case when doc_id % 5 = 2 then 2 when doc_id % 5 < 2 then 3 end as page_no, case when doc_id % 5 in (0, 2) then 1.0 end::double as l, case when doc_id % 5 in (0, 2) then doc_id end::double as t,
      case when doc_id % 5 in (0, 2) then 3.0 end::double as r, case when doc_id % 5 in (0, 2) then 4.0 end::double as b from documents""",
    "box_spellings": """select doc_id, s as spelling, case when doc_id % 2 = 0 and s <> 'a' then doc_id end::double as l, case when doc_id % 2 = 0 and s <> 'a' then doc_id + 1 end::double as t,
      case when doc_id % 2 = 0 and s <> 'a' then doc_id + 2 end::double as r, case when doc_id % 2 = 0 and s <> 'a' then doc_id + 3 end::double as b from documents, (values ('l'), ('left'), ('x0'), ('a')) v(s)""",
    "page_sizes": """select doc_id, (case when doc_id % 2 = 0 then n + 1 when n = 0 then 7 else 4 end)::int as page_no, (doc_id + n)::double as width, 792::double as height
      from documents, range(3) x(n) where (doc_id + n) % 3 <> 0 and (doc_id % 2 = 0 or n < 2)""",
    "upload_checks": """select doc_id, (case doc_id % 12 when 1 then 400 when 2 then 400 when 3 then 400 when 4 then 413 when 5 then 422 when 6 then 422 when 7 then 422 when 8 then 422 when 9 then 422 when 10 then 422 end)::int as code,
      case doc_id % 12 when 1 then 'no file' when 2 then 'no PDF signature' when 3 then 'not named .pdf' when 4 then 'too large' when 5 then 'unknown engine' when 6 then 'voice of another engine' when 7 then 'rate is no number'
      when 8 then 'rate out of range' when 9 then 'rate out of range' when 10 then 'no review service' end as reason, doc_id % 12 in (0, 11) as valid from documents""",
    "source_paths": "select doc_id, case doc_id % 4 when 0 then '/up/a/b.pdf' when 3 then null else '/up/job' || doc_id || '/source.pdf' end as source from documents",
    "speech_rates": """with d as (select doc_id, case doc_id % 8 when 0 then 0.5 when 1 then 2.0 when 6 then 1.05 end::double as rate from documents)
      select doc_id, rate, case rate when 0.5 then 1.429 when 2.0 then 0.714 when 1.05 then 0.952 end::double as scale, rate as speed from d""",
    "voices_for_choice": "with v(key, code, engine) as (values " + ", ".join(f"('{v[0]}', '{v[1]}', '{v[4]}')" for v in voices.VOICES) + """)
      select lang, asked, key from v, (values ('auto'), ('pt-BR'), ('en'), ('de')) a(lang), (values ('piper'), ('kokoro'), ('')) b(asked) where (asked = '' or asked = engine) and (lang in ('auto', 'de') or code = lang)""",
    "voice_records": "select key, engine, case when kokoro <> '' then kokoro when code = 'pt-BR' then 'pf_dora' else 'af_heart' end as kokoro, case when code = 'pt-BR' then 'p' else 'a' end as code, case when key like '%dora%' then 'piper' else engine end as own from (values "
    + ", ".join(f"('{v[0]}', '{v[1]}', '{v[4]}', '{v[8] or ''}')" for v in voices.VOICES) + ") as v(key, code, engine, kokoro)",
    "voice_addresses": "select key, 'https://voices.example/' || folder || '/' || m as model_url, 'https://voices.example/' || folder || '/' || c as config_url, '/cache/voices/' || m as model_path, '/cache/voices/' || c as config_path from (values "
    + ", ".join(f"('{v[0]}', '{v[5]}', '{v[6]}', '{v[7]}')" for v in voices.VOICES if v[6]) + ") as v(key, folder, m, c)",
    "jobs_changes": _JOBS + """ select job_id, min(happened) as created_at, max(happened) as updated_at, arg_max(status, (happened, event_id)) filter (event_id % 3 = 0 and status is not null) as status,
      arg_max(progress, (happened, event_id)) filter (event_id % 4 = 1 and progress is not null) as progress from ev group by job_id""",
    "jobs_admitted": _JOBS + """, b as (select count(*) filter (right(job_id, 1) < '5') as busy from (select job_id from jobs order by job_id limit 7))
      select doc_id as request_id, row_number() over (order by doc_id) + busy <= 10 as admitted from documents, b""",
    "jobs_artefacts": _JOBS + " select job_id, root || job_id as folder from jobs, (values ('/d/uploads/'), ('/d/outputs/')) v(root) where right(job_id, 1) <> '3'",
    "review_batches": _RECURSIVE(_BLOCKS) + _BATCHES + " select doc_id, seq, batch::int as batch from batched",
    "review_loop": _RECURSIVE(_BLOCKS) + _LOOP + " select doc_id, seq, place, llm_processed, llm_dropped from stay",
    "review_parse": "select doc_id, case doc_id % 9 when 0 then '2,1,2' end as ids, case doc_id % 9 when 0 then '1:DROP,2:KEEP' when 1 then '1:DROP' when 2 then '1:DROP' when 3 then '3:KEEP,4:DROP' else '' end as actions from documents",
    "review_excerpts": _BLOCKS + """, x as (select doc_id, seq, seq // 20 as batch, {'id': seq, 'excerpt': substring(coalesce(text, ''), 1, 500), 'label': label} as item from blocks)
      select doc_id, batch::int as batch, to_json(list(item order by seq))::varchar as payload from x group by doc_id, batch""",
    "language_fallback": _BLOCKS + f""", x as (select doc_id, seq, {_strip('text')} as sample, replace(lower(substring({_strip('text')}, 1, 4000)), 'ß', 'ss') as x from blocks),
      y as (select doc_id, seq, case when sample = '' then 'unknown' when {_HITS} >= 2 then 'pt-BR' else 'en' end as detected from x)
      select doc_id, seq, detected, case when seq % 3 = 2 then 'de' else detected end as effective from y""",
    "verbalize_units": _BLOCKS + r""" select doc_id, seq, regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g'), '(\d+)\s*[×xX]\s*(\d+)', '\1 by \2', 'g'), '(\d+(?:\.\d+)?)\s*%', '\1 percent', 'g') as spoken from blocks""",
    "verbalize_operators": _BLOCKS + f" select doc_id, seq, {_ops('text')} as spoken from blocks",
    "pause_plan": _BLOCKS + f" select doc_id, seq, {_pause(350, 120, 500, 220)} as piper_ms, {_pause(400, 150, 600, 400)} as kokoro_ms, (24 * {_pause(400, 150, 600, 400)})::bigint as frames from blocks",
    "voices_for_ui": "select * from (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in v[:5]) + ")" for v in voices.VOICES) + ") as v(key, language_code, language_label, display_name, engine)",
    "voice_resolution": """with d as (select doc_id, case when doc_id % 4 = 0 then 'kokoro-en-bella' when doc_id % 4 = 1 then 'nobody' else 'auto' end as asked, case when doc_id % 3 = 0 then 'kokoro' else 'piper' end as engine, doc_id % 5 = 0 or coalesce(lang, '') like 'pt%' as pt from documents)
      select doc_id, case when asked = 'kokoro-en-bella' then asked when engine = 'kokoro' and pt then 'kokoro-pt-dora' when engine = 'kokoro' then 'kokoro-en-heart' when pt then 'pt_BR-faber-medium' else 'en_US-lessac-medium' end as voice,
      asked <> 'kokoro-en-bella' or engine = 'kokoro' as compatible from d""",
    "page_limit": _BLOCKS + " select doc_id, coalesce(max(page_no), 0) as page_count, coalesce(max(page_no), 0) > 3 as quarantined from blocks group by doc_id",
    "review_ambiguous": _AMBIGUOUS + " select doc_id, seq from ambiguous",
    "review_classify": _AMBIGUOUS + """, n as (select *, (row_number() over (partition by doc_id order by seq) - 1) // 20 as batch from ambiguous), y as (select *, min(seq) over (partition by doc_id, batch) % 3 as mode from n)
      select doc_id, seq, 'DROP' as action from y where mode <> 1 and seq % 5 = 0""",
    "review_fixed_batches": _BLOCKS + " select doc_id, seq, ((row_number() over (partition by doc_id order by seq) - 1) // 20)::int as batch from blocks",
    "review_apply": _BLOCKS + f""", k as (select *, seq // 20 as batch from blocks where (doc_id + seq) % 4 <> 0 or (label in ('title', 'section_header') and {_m(_strip("regexp_replace(text, '^[0-9]+[.]?[ ]+', '')"), R.KNOWN_HEADINGS, True)}))
      select doc_id, seq, (row_number() over (partition by doc_id order by batch, case when seq % 3 = 0 then 100000 - seq end nulls last, seq) - 1)::int as place from k""",
    "jobs_latest": _JOBS + " select * from jobs",
    "jobs_recent": _JOBS + " select job_id, created_at from jobs order by created_at desc, job_id limit 10",
    "jobs_active": _JOBS + " select count(*) filter (status in ('pending', 'running')) as active, count(*) filter (status in ('pending', 'running')) < 10 as may_start from jobs",
    "jobs_expired": _JOBS + f" select job_id from jobs where created_at < timestamp '{NOW}' - interval {HOURS} hours",
    "jobs_orphans": _JOBS + f" select 'x' || job_id as name from jobs where right(job_id, 1) = '7' and created_at < timestamp '{NOW}' - interval {HOURS * 60 + 10} minutes and 'x' || job_id not in (select job_id from jobs)",
    "jobs_public": _JOBS + " select job_id, status, status = 'completed' as has_text, status = 'completed' and progress > 0.5 as has_audio, true as has_pdf from jobs",
}

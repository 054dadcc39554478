"""Blocks, pages and regions from documents, extractor rows and HTML; uploads and job metadata."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import rules as R
from ..operators import jobs, voices
from ..schema import BLOCKS, JOB_METADATA, Settings

REGION_LABELS = ["picture", "table", "caption"]
PAGE = (612.0, 792.0)
#: Spellings of a box.
BOX_NAMES = [("l", "t", "r", "b"), ("left", "top", "right", "bottom"), ("x0", "y0", "x1", "y1")]
_HTML_LABELS = {"title": "title", "h1": "title", "h2": "section_header", "h3": "section_header", "p": "paragraph", "li": "list_item", "footer": "page_footer", "nav": "page_header"}


def box(l: Column, t: Column, r: Column, b: Column) -> Column:
    return F.struct(l.cast("double").alias("l"), t.cast("double").alias("t"), r.cast("double").alias("r"), b.cast("double").alias("b"))


def from_lines(docs: DataFrame) -> DataFrame:
    """A block a line, laid out in two columns of twelve lines a page under a title."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    k = F.col("seq") % 12
    left = F.when(k == 0, 30).otherwise(30 + 290 * (F.col("seq") % 2))
    right = F.when(k == 0, 580).otherwise(270 + 290 * (F.col("seq") % 2))
    top = 60 + 50 * ((F.col("seq") * 7) % 12)
    label = F.when(k == 0, "title").when(k == 5, "section_header").when(k == 11, "page_footer").otherwise("paragraph")
    page = F.when(F.col("doc_id") % 50 != 49, F.floor(F.col("seq") / 12).cast("int") + 1)
    return rows.select("doc_id", "seq", "text", label.alias("label"), page.alias("page_no"), box(left, top, right, top + 30).alias("bbox"))


def pages_of(blocks: DataFrame, size: tuple[float, float] = PAGE) -> DataFrame:
    return blocks.where("page_no is not null").select("doc_id", "page_no").distinct().withColumns({"width": F.lit(size[0]), "height": F.lit(size[1])})


def regions(blocks: DataFrame) -> DataFrame:
    """Pictures, tables and captions that have a place; they stay blocks, too."""
    return blocks.where(F.col("label").isin(REGION_LABELS) & F.col("page_no").isNotNull() & F.col("bbox").isNotNull()).select("doc_id", F.col("label").alias("kind"), "page_no", "bbox")


class Extractor(Protocol):
    """What parses a file: items of :func:`from_extractor`, and pages of :func:`page_sizes`, as JSON; none is installed here."""

    def __call__(self, content: bytes) -> tuple[str, str]: ...


ITEMS = "array<struct<text:string,caption_text:string,label:string,prov:array<struct<page_no:int,bbox:array<double>>>>>"
SIZES = "array<struct<page_no:int,size:struct<width:double,height:double>>>"


def extracted(files: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """Blocks and pages of ``doc_id, content`` through an extractor on the executors; a file that fails has neither."""

    def one(content: bytes) -> tuple[str | None, str | None]:
        try:
            return extractor(content)
        except Exception:  # one file must not stop the others
            return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(c) for c in pdf["content"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "items": [g[0] for g in got], "pages": [g[1] for g in got]})

    rows = files.select("doc_id", "content").mapInPandas(run, "doc_id long, items string, pages string")
    items = rows.select("doc_id", F.posexplode(F.from_json("items", ITEMS)).alias("seq", "i")).select("doc_id", "seq", "i.*")
    return from_extractor(items), page_sizes(rows.select("doc_id", F.from_json("pages", SIZES).alias("pages")))


def from_extractor(items: DataFrame) -> DataFrame:
    """Blocks from ``doc_id, seq, text, caption_text, label, prov``: the first provenance entry, captions for empty texts."""
    first = F.get("prov", F.lit(0))
    text = F.when(R.strip(F.coalesce("text", F.lit(""))) == "", F.coalesce("caption_text", F.lit(""))).otherwise(F.col("text"))
    kind = items.schema["prov"].dataType.elementType["bbox"].dataType
    return items.select("doc_id", "seq", text.alias("text"), F.lower(R.strip(F.col("label"))).alias("label"), first["page_no"].alias("page_no"), coerce_box(first["bbox"], kind).alias("bbox"))


def coerce_box(values: Column, kind: DataType) -> Column:
    """A box from an array of at least four numbers, or from a struct in one of three spellings; null from anything else."""
    if isinstance(kind, ArrayType):
        return F.when(F.size(values) >= 4, box(*(F.get(values, F.lit(i)) for i in range(4))))
    names = next((s for s in BOX_NAMES if isinstance(kind, StructType) and set(s) <= set(kind.names)), None)
    if names is None:
        return F.lit(None).cast("struct<l:double,t:double,r:double,b:double>")
    return F.when(values.isNotNull(), box(*(values[n] for n in names)))


def page_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, page_no, width, height`` from ``pages``: a map by page number, or an array, whose entries count from 1 unless they have a ``page_no``. Pages without a size are left out."""
    kind = docs.schema["pages"].dataType
    if isinstance(kind, MapType):
        rows = docs.select("doc_id", F.explode("pages").alias("page_no", "page"))
    else:
        rows = docs.select("doc_id", F.posexplode("pages").alias("at", "page"))
        own = F.col("page.page_no") if "page_no" in kind.elementType.names else F.lit(None)
        rows = rows.select("doc_id", F.coalesce(own, F.col("at") + 1).alias("page_no"), "page")
    rows = rows.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("page.size.width").cast("double").alias("width"), F.col("page.size.height").cast("double").alias("height"))
    return rows.where("width is not null and height is not null")


def within_page_limit(page_counts: DataFrame, most: int = 200) -> DataFrame:
    """Add ``quarantined``: documents over the limit are set aside, so that one can't fail the batch."""
    return page_counts.withColumn("quarantined", F.col("page_count") > most)


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        label = next((_HTML_LABELS[t] for t in reversed(self.open) if t in _HTML_LABELS), "text")
        if text:
            self.out.append((text, label))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HTML_LABELS or tag in ("div", "br", "script", "style"):
            self.flush()
        if tag not in ("br", "meta", "img", "hr", "link", "input"):
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            at = len(self.open) - 1 - self.open[::-1].index(tag)
            if any(t in _HTML_LABELS or t in ("div", "script", "style") for t in self.open[at:]):  # what was left open ends here, too
                self.flush()
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not {"script", "style"} & set(self.open):
            self.text.append(data)


def from_html(pages: DataFrame) -> DataFrame:
    """Blocks without place from ``page_id, html``: headings, paragraphs, list items, navigation and footers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser.flush()
                rows += [(doc_id, i, text, label, None, None) for i, (text, label) in enumerate(parser.out)]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "text", "label", "page_no", "bbox"]).astype({"page_no": "object", "bbox": "object"})

    return pages.select("page_id", "html").mapInPandas(run, BLOCKS)


def checked(requests: DataFrame, active: int = 0, settings: Settings = Settings()) -> DataFrame:
    """Add ``code`` and ``reason`` of the first check that a request fails, and ``valid``.

    ``filename, head, length, engine, voice, rate, review, review_url``; ``head`` is the file's first bytes; ``active`` jobs run already.
    """
    rate = F.col("rate").try_cast("double")
    finite = rate.isNotNull() & ~F.isnan(rate) & ~F.abs(rate).isin(float("inf"))
    wants = checkbox(F.col("review"))
    url = F.coalesce(F.nullif(F.btrim(F.coalesce("review_url", F.lit(""))), F.lit("")), F.lit(settings.review_url))
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    checks = [
        (F.coalesce("filename", F.lit("")) == "", 400, "no file"), (~F.coalesce(F.substring("head", 1, 5) == F.lit(b"%PDF-"), F.lit(False)), 400, "no PDF signature"),
        (~F.lower("filename").endswith(".pdf"), 400, "not named .pdf"), (F.col("length") > settings.max_upload_bytes, 413, "too large"),
        (~F.coalesce(F.col("engine").isin("piper", "kokoro"), F.lit(False)), 422, "unknown engine"), (~voices.compatible(F.col("voice"), F.col("engine")), 422, "voice of another engine"),
        (rate.isNull(), 422, "rate is no number"), (~finite | ~rate.between(settings.speech_rate_min, settings.speech_rate_max), 422, "rate out of range"),
        (wants & (url == ""), 422, "no review service"), (wants & ~full.rlike(r"^https?://([^/?#@]*@)?[^/?#@:]+(:[0-9]{0,5})?([/?#]|$)"), 422, "review service is no address"),
        (F.lit(active >= settings.max_active_jobs), 503, "too many jobs"),
    ]
    code, reason = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(""))
    for fails, number, why in checks:
        code, reason = code.when(fails, number), reason.when(fails, why)
    return requests.withColumns({"code": code, "reason": reason}).withColumn("valid", F.col("code").isNull())


def uploads(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    """PDF files below a folder with ``valid, code, reason``, asked for with the usual voice."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.substring("content", 1, 5).alias("head"))
    usual = {"engine": F.lit("piper"), "voice": F.lit("auto"), "rate": F.lit("1.0"), "review": F.lit(""), "review_url": F.lit("")}
    return checked(rows.withColumns(usual), settings=settings).drop("head", *usual)


def job_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Valid ``metadata.json`` files below a folder; ones that can't be read or lack an id are left out."""
    rows = spark.read.schema(f"{JOB_METADATA}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    whole = F.col("_corrupt_record").isNull() & (F.coalesce("job_id", F.lit("")) != "") & (F.coalesce("filename", F.lit("")) != "")
    return rows.where(whole & F.try_to_timestamp("created_at").isNotNull()).withColumn("created_at", F.try_to_timestamp("created_at")).drop("_corrupt_record")


def restored(spark: SparkSession, outputs: str, uploads_root: str) -> DataFrame:
    """Completed jobs from their folders: metadata that can be read beside a ``reading.wav``; of one id that of the least path, unsafe ids none.

    ``detected_language`` falls back to the effective one; a cleaned text or source file counts if it's there.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)

    def files(root: str, name: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        return found.select(folder.alias("folder"), F.col("path").alias("found"))

    none = lambda c: F.nullif(F.col(c), F.lit(""))
    jobs_ = jobs.first_of_each(job_metadata(spark, outputs).withColumn("folder", folder).join(files(outputs, "reading.wav").withColumnRenamed("found", "audio_path"), "folder"))
    jobs_ = jobs_.join(files(outputs, "cleaned_text.txt").withColumnRenamed("found", "text_path"), "folder", "left")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    pdfs = files(uploads_root, "*.pdf").select(plain("found").alias("pdf"), F.col("found").alias("pdf_path"))
    root = F.lit(uploads_root.rstrip("/") + "/")
    usual = F.concat(root, F.col("job_id"), F.lit("/source.pdf"))
    named = F.when(F.col("source_pdf").startswith(root) & ~F.col("source_pdf").contains("/../"), F.col("source_pdf"))
    own = pdfs.withColumnsRenamed({"pdf": "pdf_1", "pdf_path": "path_1"})
    jobs_ = jobs_.withColumns({"named": named, "usual": usual}).join(own, F.col("named") == F.col("pdf_1"), "left").join(pdfs, F.col("usual") == F.col("pdf"), "left")
    return jobs_.select(
        "job_id", "filename", "created_at", F.col("created_at").alias("updated_at"), F.lit("completed").alias("status"), F.lit(1.0e0).alias("progress"), "text_path", "audio_path",
        F.coalesce("path_1", "pdf_path").alias("pdf_path"), F.coalesce(none("detected_language"), none("effective_language")).alias("detected_language"), none("engine_used").alias("engine_used"), "stats",
    )


def source_path(path: Column, job_id: Column, root: str) -> Column:
    """A stored path below the uploads folder, else the usual place of a safe id, else null."""
    inside = path.startswith(root.rstrip("/") + "/") & ~path.contains("/../")
    return F.when(inside, path).when(job_id.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$"), F.concat(F.lit(root.rstrip("/") + "/"), job_id, F.lit("/source.pdf")))


def valid_rate(value: Column) -> Column:
    """A speech rate between 0.5 and 2, else null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & x.between(0.5e0, 2.0e0), x)


def checkbox(value: Column) -> Column:
    return ~F.coalesce(value, F.lit("")).isin("", "0", "false", "False", "off")

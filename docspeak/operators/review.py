"""Review of blocks by an outside model: what to send, how to read the answer, how to apply it."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

# Blocks and capped characters of a batch, characters of an excerpt.
BATCH_BLOCKS, BATCH_CHARS, EXCERPT = 20, 6000, 500
ANSWER = "struct<order:array<int>,results:array<struct<id:int,action:string>>>"


def ambiguous(blocks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Unknown headings and short blocks of the first and last two pages, and fragments anywhere."""
    rows = blocks.join(page_counts, "doc_id", "left")
    body, label, n = R.strip(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("label", F.lit(""))), F.coalesce("page_count", F.lit(0))
    edge = F.coalesce((F.col("page_no") <= 2) | ((n > 0) & (F.col("page_no") >= n - 1)), F.lit(False))
    heading = label.isin("section_header", "title") & edge
    short = (edge & (F.length(body) < 100)) | ((F.length(body) < 40) & label.isin("text", "paragraph", ""))
    return rows.where((body != "") & F.when(heading, ~T.known_heading(body)).otherwise(short)).select(blocks.columns)


def page_batches(blocks: DataFrame) -> DataFrame:
    """Add ``batch``: whole pages packed greedily by blocks and capped characters, pages without number last."""
    size = F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(EXCERPT))
    pages = blocks.groupBy("doc_id", "page_no").agg(F.count("*").cast("int").alias("n"), F.sum(size).cast("int").alias("c"))
    page = F.struct(F.col("page_no").isNull().alias("last"), "page_no", "n", "c")
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    start = F.struct(F.array().cast("array<struct<page_no:int,batch:int>>").alias("out"), F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).alias("c"))

    def add(acc: Column, p: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] + p["n"] > BATCH_BLOCKS) | (acc["c"] + p["c"] > BATCH_CHARS))
        b = acc["b"] + full.cast("int")
        entry = F.array(F.struct(p["page_no"].alias("page_no"), b.alias("batch")))
        return F.struct(F.concat(acc["out"], entry).alias("out"), b.alias("b"), F.when(full, p["n"]).otherwise(acc["n"] + p["n"]).alias("n"), F.when(full, p["c"]).otherwise(acc["c"] + p["c"]).alias("c"))

    numbers = docs.select("doc_id", F.explode(F.aggregate("pages", start, add, lambda a: a["out"])).alias("p")).select(F.col("doc_id").alias("pd"), F.col("p.page_no").alias("pn"), "p.batch")
    on = (F.col("doc_id") == F.col("pd")) & F.col("page_no").eqNullSafe(F.col("pn"))
    return blocks.join(numbers, on).select(*blocks.columns, "batch")


def fixed_batches(blocks: DataFrame) -> DataFrame:
    """Add ``batch``: every 20 blocks of a document."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return blocks.withColumn("batch", F.floor((at - 1) / BATCH_BLOCKS).cast("int"))


def excerpts(blocks: DataFrame) -> DataFrame:
    """``doc_id, batch, payload``: what is sent, as JSON."""
    item = F.struct(F.col("seq").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT).alias("excerpt"), F.coalesce("label", F.lit("")).alias("label"))
    return blocks.groupBy("doc_id", "batch").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))


def ask(payloads: DataFrame, client: Callable[[str], str | None]) -> DataFrame:
    """Add ``answer`` from ``client``, which is called on the executors; a call that fails answers null: keep all."""

    def one(p: str) -> str | None:
        try:
            return client(p)
        except Exception:  # the service being down must not stop the document
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=[one(p) for p in pdf["payload"]])

    return payloads.mapInPandas(run, "doc_id long, batch int, payload string, answer string")


def chat_client(base_url: str, prompt: str, model: str = "", key: str = "", timeout: float = 120, most: int = 4096) -> Callable[[str], str | None]:
    """A client for :func:`ask` that posts to a chat-completions service; what isn't text answers null."""

    def client(payload: str) -> str | None:
        body = {"messages": [{"role": "system", "content": prompt}, {"role": "user", "content": payload}], "temperature": 0.0, "max_tokens": most}
        body |= {"chat_template_kwargs": {"enable_thinking": False}} | ({"model": model} if model else {})
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as got:
            text = json.load(got)["choices"][0]["message"]["content"]
        return text if isinstance(text, str) else None

    return client


def service_url(address: str) -> str | None:
    """The base address of a service: a scheme is added, query, fragment and last slash go. Empty stays empty; null if it isn't one."""
    address = address.strip()
    if not address:
        return ""
    try:
        parts = urlsplit(address if "://" in address else f"http://{address}")
        parts.port  # noqa: B018  (fails where it's no number)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return None
    return f"{parts.scheme}://{parts.netloc}{parts.path}".rstrip("/")


def parse(answer: Column) -> Column:
    """Order and results of an answer: fences go, a bare list is results, what can't be read is null."""
    body = R.strip(answer)
    # an opening fence takes its line with it, or itself if there is but one line; a closing one, itself and what follows
    body = F.when(body.startswith("```"), F.when(body.contains("\n"), F.regexp_replace(body, r"^[^\n]*\n", "")).otherwise(F.substring(body, F.lit(4), F.length(body)))).otherwise(body)
    body = R.strip(F.when(body.endswith("```"), F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body))
    whole = F.when(body.startswith("["), F.concat(F.lit('{"results":'), body, F.lit("}"))).otherwise(body)
    return F.from_json(whole, ANSWER)


def decisions(parsed: Column) -> Column:
    """Actions in upper case; anything but DROP keeps."""
    return F.transform(F.coalesce(parsed["results"], F.array().cast("array<struct<id:int,action:string>>")), lambda r: F.struct(r["id"].alias("id"), F.when(F.upper(r["action"]) == "DROP", F.lit("DROP")).otherwise(F.lit("KEEP")).alias("action")))


def decided(blocks: DataFrame, actions: DataFrame, order: DataFrame) -> DataFrame:
    """Blocks of batches with ``ord`` and ``dropped``; a block stands as often as the order names it, at least once.

    ``actions(doc_id, batch, seq, action, at)``: the last of a block, by ``at``, counts; ones of another batch don't. ``order(doc_id, batch, ord, seq)``.
    Known headings stay.
    """
    on = ["doc_id", "batch", "seq"]
    act = actions.groupBy(*on).agg(F.max_by("action", "at").alias("action"))
    heading = F.lower(F.coalesce("label", F.lit(""))).isin("section_header", "title") & T.known_heading(F.coalesce("text", F.lit("")))
    rows = blocks.join(act, on, "left").join(order.select(*on, "ord"), on, "left")
    return rows.withColumn("dropped", F.coalesce(F.col("action") == "DROP", F.lit(False)) & ~heading).drop("action")


def apply(blocks: DataFrame, actions: DataFrame, order: DataFrame) -> DataFrame:
    """Blocks that stay, with ``place``: batch by batch in the answer's order, then those it left out; see :func:`decided`."""
    return placed(decided(blocks, actions, order)).select(*blocks.columns, "place")


def placed(rows: DataFrame) -> DataFrame:
    place = Window.partitionBy("doc_id").orderBy("batch", F.col("ord").asc_nulls_last(), "seq")
    return rows.where("not dropped").withColumn("place", F.row_number().over(place) - 1)


def answered(batches: DataFrame, client: Callable[[str], str | None]) -> tuple[DataFrame, DataFrame]:
    """Actions and order that the client gives for blocks with ``batch``."""
    rows = ask(excerpts(batches), client).select("doc_id", "batch", parse(F.col("answer")).alias("p"))
    actions = rows.select("doc_id", "batch", F.posexplode(decisions(F.col("p"))).alias("at", "d")).select("doc_id", "batch", F.col("d.id").alias("seq"), "d.action", "at")
    order = rows.select("doc_id", "batch", F.posexplode(F.col("p.order")).alias("ord", "seq"))
    return actions, order


def classify(blocks: DataFrame, client: Callable[[str], str | None]) -> DataFrame:
    """``doc_id, seq, action`` of the blocks, twenty at a time, that the client decided on."""
    rows = fixed_batches(blocks)
    actions, _ = answered(rows, client)
    last = actions.groupBy("doc_id", "batch", "seq").agg(F.max_by("action", "at").alias("action"))
    return rows.select("doc_id", "batch", "seq").join(last, ["doc_id", "batch", "seq"]).select("doc_id", "seq", "action")


def reviewed(blocks: DataFrame, client: Callable[[str], str | None]) -> DataFrame:
    """All blocks through the client, whole pages at a time: those that stay, with ``place``, ``llm_processed`` and ``llm_dropped`` of their document."""
    rows = page_batches(blocks)
    doc = Window.partitionBy("doc_id")
    rows = decided(rows, *answered(rows, client))
    rows = rows.withColumns({"llm_processed": F.size(F.collect_set("seq").over(doc)), "llm_dropped": F.count_if(F.col("dropped")).over(doc).cast("int")})
    return placed(rows).select(*blocks.columns, "place", "llm_processed", "llm_dropped")

"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, imatch, language_id, media, ngram_join, packing, quality, substring_dedup, toxicity, warc

RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every whole text."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, keep=["doc_id"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (common.fold("doc_id", quality.FOLDS) == quality.HELD).alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every whole text once repeated windows of 35 words are removed."""
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    docs = _table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs), keep=["doc_id"])
    return out.select("doc_id", (common.fold("doc_id", language_id.FOLDS) == language_id.HELD).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document is packed; near copies share a cluster."""
    return packing.pack_apart(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC archives."""
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8."""
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (common.fold("doc_id", toxicity.FOLDS) == toxicity.HELD).alias("held_out"), "score", "predicted")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every whole text, its edited text, and how alike they are."""
    docs = _table(spark, sf_dir, "documents")
    return imatch.compare_edits(docs, imatch.lexicon(docs))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a JPEG file and read back."""
    stored = media.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return media.read_media(stored, keep=["doc_id", "n_bytes"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_quality, op3_substring_dedup, op4_language, op5_packing, op6_warc, op7_ngram_join, op8_toxicity, op9_imatch, op10_media)
}

ORACLE_SQL = {
    "op3_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as p from d)),
r as (select doc_id, p from w where h in (select h from w group by h having count(*) > 1)),
c as (select distinct doc_id, unnest(range(p, p + 35)) as q from r),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as q from d),
k as (select words.doc_id, q, word from words anti join c using (doc_id, q)),
t as (select doc_id, count(*) as n, string_agg(word, ' ' order by q) as kept from k group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(t.n, 0))::bigint as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256
from d left join t using (doc_id)""",
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
m as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from m""",
    "op7_ngram_join": r"""
with recursive d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[p:p + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as p from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 9 * i.n >= 4 * (x.n + y.n)
      union select a.doc_id, b.doc_id from d a join d b on a.text = b.text and a.doc_id < b.doc_id),
e as (select a, b from l union select b, a from l),
reach as (select doc_id as a, doc_id as b from d union select reach.a, e.b from reach join e on reach.b = e.a)
select d.doc_id, c.class_id, coalesce(k.links, 0)::bigint as links
from d join (select a, min(b) as class_id from reach group by a) c on c.a = d.doc_id
left join (select a, count(*) as links from e group by a) k on k.a = d.doc_id""",
}

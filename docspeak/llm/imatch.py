"""I-Match document fingerprints, in DataFrame functions only.

Terms (what stands between white space and punctuation) are kept if the share of documents
that hold them lies in a band, so neither names that one text has nor words that
all have decide. Of what is kept, randomised subsets of the lexicon each hash the
sorted distinct terms; the fingerprint is the list of those hashes. A subset that
holds none of a text's terms says nothing about it, unless none holds any.

Terms are counted by their 64-bit hash. The lexicon is a list of hashes: a band that begins
at a share of ``LOW`` can't hold more terms than the mean number of distinct terms of a
document, divided by that share, however many documents there are. Up to ``MOST_TERMS``
it goes into the plan as a table; a longer one (of very long documents) is joined.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms that go into the plan as a table of so many buckets.
MOST_TERMS, BUCKETS = 200_000, 8192
#: Least and greatest share of documents that hold a term.
LOW, HIGH = 0.006, 0.04
#: A subset keeps one term of so many; so many subsets of each.
RATES, EACH = (16, 64, 256), 12
SUBSETS = len(RATES) * EACH
#: Rows that one window partition gets, about, up to so many ranges of ids (beyond, ranges grow and are sorted on disk);
#: a range is looked up in a table of tables of this many bounds.
NEIGHBOURS, MOST_RANGES, FAN = 2000, 100_000, 320


def words(text: Column) -> Column:
    """The terms of the text, with repeats; an empty one stands before or after all others."""
    return F.split(F.coalesce(text, F.lit("")), r"[\s\p{Punct}]+")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``h``, the hashes of the terms in the band, counted over all documents; written, so that it's counted once."""
    n = docs.count()
    held = docs.select(F.explode(F.array_distinct(F.transform(F.filter(words(F.col("text")), lambda w: w != ""), lambda w: F.xxhash64(w)))).alias("h"))
    held = held.groupBy("h").agg(F.count("*").alias("n"))
    return common.saved(held.where((F.col("n") >= max(2.0, low * n)) & (F.col("n") <= max(2.0, high * n))).select("h"), "lexicon")


def table_of(terms: DataFrame, most: int = MOST_TERMS) -> Column | None:
    """The lexicon as a constant, buckets of hashes by their low bits; none if it has more than ``most`` terms."""
    if terms.count() > most:
        return None
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for r in terms.collect():
        buckets[r["h"] & (BUCKETS - 1)].append(r["h"])
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")


def _hashes(text: Column) -> Column:
    return F.transform(F.filter(words(text), lambda w: w != ""), lambda w: F.xxhash64(w))


def kept_terms(text: Column, table: Column) -> Column:
    """Sorted hashes of the text's distinct terms in the band; of all its terms if none is in it."""
    inside = lambda h: F.array_contains(F.get(table, h.bitwiseAND(BUCKETS - 1).cast("int")), h)
    return F.sort_array(
        F.transform(
            F.array(_hashes(text)),
            lambda all_: F.transform(F.array(F.filter(all_, inside)), lambda own: F.array_distinct(F.when(F.size(own) > 0, own).otherwise(all_)))[0],
        )[0]
    )


def joined_terms(rows: DataFrame, text: str, terms: DataFrame, name: str) -> DataFrame:
    """Add :func:`kept_terms` of each text as column ``name``, by a join with a lexicon of any size: a row for each of its distinct terms."""
    keyed = rows.withColumns({f"{name}_k": F.xxhash64(text), f"{name}_l": F.xxhash64(F.col(text), F.lit(1))})
    key = [f"{name}_k", f"{name}_l"]
    each = keyed.groupBy(*key).agg(F.first(text).alias("t")).select(*key, F.explode(F.array_distinct(_hashes(F.col("t")))).alias("h"))
    each = each.join(terms.withColumn("in", F.lit(True)), "h", "left").groupBy(*key)
    each = each.agg(F.sort_array(F.collect_list(F.when(F.col("in"), F.col("h")))).alias("a"), F.sort_array(F.collect_list("h")).alias("b"))
    own = each.select(*key, F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")).alias(name))
    return keyed.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>"))).drop(*key)


def _zeros(mask: int) -> Callable[[Column], Column]:
    return lambda h: h.bitwiseAND(F.lit(mask).cast("bigint")) == 0


def with_fingerprint(rows: DataFrame, text: str, terms: DataFrame, table: Column | None, name: str) -> DataFrame:
    """Add column ``name``: an int for each subset, null where the subset holds none of the text's terms.

    A text without a term in the band is fingerprinted by all its terms; one
    without terms, null or empty included, has nulls only. Where no subset holds
    any of a text's terms, all of them stand in each. Equal texts have equal fingerprints.
    """
    own = f"__{name}"

    def hashed(terms: Column | str, k: int) -> Column:
        return F.xxhash64(terms, F.lit(k)).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")

    rows = rows.withColumn(own, kept_terms(F.col(text), table)) if table is not None else joined_terms(rows, text, terms, own)
    out = []
    for rate in RATES:
        for k in range(EACH):
            # a subset takes the terms whose hash has zeros at its place
            place = (5 * k + 3 * rate.bit_length()) % 57
            some = F.filter(own, _zeros((rate - 1) << place))
            out.append(F.when(F.size(some) > 0, hashed(some, len(out))))
    rows = rows.withColumn(name, F.array(*out))
    outside = F.forall(name, lambda x: x.isNull()) & (F.size(own) > 0)
    return rows.withColumn(name, F.when(outside, F.array(*(hashed(own, k) for k in range(SUBSETS)))).otherwise(F.col(name))).drop(own)


def likeness(a: Column, b: Column) -> Column:
    """Share of subsets on which both agree, of those that hold terms of either; 1 if neither text has a term."""
    same = F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("int"))), lambda x: x.isNotNull())
    return F.when(F.size(same) > 0, F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(same)).otherwise(F.lit(1.0))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit("_"))), "-")


def placed(docs: DataFrame, each: int = NEIGHBOURS) -> DataFrame:
    """Add ``th``, the hash of ``text``, and ``at``, ``part``, ``salt``: rows in order of these, then of falling ``doc_id``, then of ``th``, are in the tables' order, and about ``each`` rows share them.

    Bounds of ``at`` are quantiles of the ids, whatever their spread. An id (or null) of
    several quantiles has a range of its own, in parts by its rows' hashes, and rows of it that are
    equal by the thousands are dealt: which of them stands first makes no difference.
    """
    spark = docs.sparkSession
    nulls, n = docs.agg(F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    each = max(each, -(-n // MOST_RANGES))
    slots = max(1, (n - nulls) // each)
    marks = docs.agg(F.percentile_approx("doc_id", [k / slots for k in range(1, slots)], 10 * slots)).first()[0] if slots > 1 else []
    times = Counter(marks)
    heavy = [(b, k + 1) for b, k in times.items() if k > 1] + ([(None, -(-nulls // each))] if nulls > each else [])
    bounds = sorted({*times, *(max(b - 1, -(1 << 63)) for b, _ in heavy if b is not None)})
    tables = [bounds[k : k + FAN] for k in range(0, len(bounds), FAN)]
    tree = F.from_json(F.lit(json.dumps([{"top": t[-1], "all": t} for t in tables])), "array<struct<top:bigint,all:array<bigint>>>")
    # bounds below the id: those of all tables that end below it, and some of the next
    full = F.size(F.filter(tree, lambda t: t["top"] < F.col("doc_id")))
    below = full * FAN + F.coalesce(F.size(F.filter(F.get(tree, full)["all"], lambda b: b < F.col("doc_id"))), F.lit(0))
    at = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - F.least(below, F.lit(len(bounds))))
    rows = docs.withColumn("th", F.xxhash64("text"))
    if not heavy:
        return rows.select("*", at.alias("at"), F.lit(0).alias("part"), F.lit(0).alias("salt"))
    known = F.broadcast(spark.createDataFrame(heavy, "hid long, t int"))  # one a quantile at most
    alike = F.col("doc_id").eqNullSafe(F.col("hid"))
    hot = rows.join(known, alike).groupBy("doc_id", "th").agg(F.count("*").alias("n")).where(F.col("n") > each).orderBy("doc_id", "th").collect()
    many = [-(-r["n"] // each) for r in hot]
    pairs = [(r["doc_id"], r["th"], 1 + sum(many[:k]), many[k]) for k, r in enumerate(hot)]
    pairs = F.broadcast(spark.createDataFrame(pairs, "pid long, pth long, base int, m int"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).join(known, alike, "left")
    rows = rows.join(pairs, F.col("doc_id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")), "left")
    part, salt = F.coalesce(F.pmod("th", "t"), F.lit(0)).cast("int"), F.coalesce(F.col("base") + F.pmod("row", "m"), F.lit(0)).cast("int")
    return rows.select(*docs.columns, "th", at.alias("at"), part.alias("part"), salt.alias("salt"))


GROUP = ["at", "part", "salt"]


def with_heads(docs: DataFrame, each: int = NEIGHBOURS) -> DataFrame:
    """:func:`placed` rows with ``again`` 0, and the row that begins each group once more, in the group before, with ``again`` 1; the first of all in the last."""
    rows = placed(docs, each)
    first = rows.groupBy(*GROUP).agg(F.min(F.struct(F.bitwise_not("doc_id").alias("k"), "th")).alias("f"))
    heads = sorted((r["at"], r["part"], r["salt"], None if r["f"]["k"] is None else ~r["f"]["k"], r["f"]["th"]) for r in first.collect())
    sent = [(*heads[k - 1][:3], *heads[k][3:]) for k in range(len(heads))]
    sent = F.broadcast(docs.sparkSession.createDataFrame(sent, "at int, part int, salt int, sid long, sth long"))  # one a group
    own = docs.withColumn("th", F.xxhash64("text")).join(sent, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")))
    own = own.groupBy(*GROUP, "doc_id", "th").agg(*(F.first(c).alias(c) for c in docs.columns if c != "doc_id"))
    return rows.withColumn("again", F.lit(0)).unionByName(own.withColumn("again", F.lit(1)))


def compare_edits(docs: DataFrame, terms: DataFrame, most: int = MOST_TERMS, each: int = NEIGHBOURS) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare both and the next document's.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the
    first as many of the next document's text, or all of it. Next is the row after by descending
    doc_id, after the last the first; null ids come last, and rows of one id are in an order that their texts'
    hashes decide. Null texts count as empty. Equal rows are each other's neighbours. A table of one row is its
    own next; an empty table gives no row. Only ``doc_id`` and ``text`` are read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = table_of(terms, most)
    base = with_fingerprint(with_heads(base, each), "text", terms, table, "fp")
    order = Window.partitionBy(*GROUP).orderBy("again", F.col("doc_id").desc_nulls_last(), "th")
    base = base.select("*", *(F.lead(v).over(order).alias(f"next_{v}") for v in ("text", "fp"))).where(F.col("again") == 0)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = base.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = with_fingerprint(rows, "edited", terms, table, "edited_fp").withColumn("edited_sha256", F.sha2("edited", 256))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

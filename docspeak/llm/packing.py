"""Best-fit packing of documents into fixed windows, with conflicts.

Bins are kept in order of what is left in them. An item starts at the tightest
bin that it fits and goes on to the next until one has neither its source nor its
duplicate cluster, both kept as bitmaps; if none is left it opens a bin. Items
come in falling size. A document longer than a window fills whole windows of its
own, and only its rest is packed.

Rows are dealt by hash of a number of their own, so that repeated ones are spread like
others, into groups of bounded size that are packed apart from each other, so no task grows with the corpus; a group can at most leave one
bin a source less full than packing all at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ngram_join

#: Bytes of a window; items that one group holds.
CAPACITY, GROUP = 8192, 8192
#: Parts that the items of one cluster are dealt into when labels are joined.
SALTS = 16
SCHEMA = "doc_id long, chunk int, start_byte long, n_bytes int, bin_id string, bin_offset int"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """``(size, source bitmap, cluster bitmap)`` in falling size; the bin and the offset of each."""
    left: list[tuple[int, int]] = []  # (residual, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        at = bisect_left(left, (size, -1))
        while at < len(left) and (sources[left[at][1]] & source or clusters[left[at][1]] & cluster):
            at += 1
        if at < len(left):
            room, b = left.pop(at)
            sources[b] |= source
            clusters[b] |= cluster
        else:
            room, b = capacity, len(sources)
            sources.append(source)
            clusters.append(cluster)
        out.append((b, capacity - room))
        insort(left, (room - size, b))
    return out


def _bits(keys: pd.Series, single: bool) -> list[int]:
    """A bit for each key; with ``single``, none for a key that occurs once. Null keys conflict with nothing."""
    codes, _ = pd.factorize(keys)
    seen = pd.Series(codes).map(pd.Series(codes).value_counts())
    codes = [c if c >= 0 and not (single and n < 2) else -1 for c, n in zip(codes, seen, strict=True)]
    dense = {c: i for i, c in enumerate(dict.fromkeys(c for c in codes if c >= 0))}
    return [1 << dense[c] if c >= 0 else 0 for c in codes]


def pack_apart(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """:func:`pack` with near copies, as :mod:`ngram_join` finds them in the texts' lower case, as clusters.

    Copies up to case and whatever hangs together at a similarity of 0.8 share a cluster, with or without ids.
    """
    lower = F.lower("text")
    known = ngram_join.classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower.alias("text")))
    return pack(docs, ngram_join.node_key(lower), capacity, group, known.select(F.col("node").alias("cluster"), "label"))


def pack(docs: DataFrame, cluster: Column, capacity: int = CAPACITY, group: int = GROUP, labels: DataFrame | None = None) -> DataFrame:
    """Where each piece of each document goes: one row a window's piece.

    With ``labels`` (``cluster, label``), those of one label are one cluster.
    Sizes are UTF-8 bytes. A null or empty text is a piece of no bytes. A null
    source or cluster conflicts with nothing; rows without id are packed too.
    Equal sizes go in order of id, then of chunk. Repeated rows are packed each, and dealt
    to groups like others; being copies, they never share a bin. Other columns are not read.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), size.alias("size"))
    # rows have a number of their own, which stays as it is once written
    base = common.saved(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") - full.cast("long") * capacity
    spans = F.transform(F.sequence(F.lit(0), full), lambda k: F.struct(k.alias("chunk"), F.when(k < full, F.lit(capacity).cast("long")).otherwise(rest).alias("n")))
    spans = F.filter(spans, lambda s: (s["n"] > 0) | (F.col("size") == 0))
    rows = base.select("row", "doc_id", "source", "cluster", F.explode(spans).alias("s")).select(
        "row", "doc_id", F.col("s.chunk").alias("chunk"), (F.col("s.chunk").cast("long") * capacity).alias("start_byte"), F.col("s.n").cast("int").alias("n_bytes"), "source", "cluster"
    )
    whole = rows.where(F.col("n_bytes") == capacity).select("doc_id", "chunk", "start_byte", "n_bytes", F.concat_ws("-", F.lit("whole"), "row", "chunk").alias("bin_id"), F.lit(0).alias("bin_offset"))
    items = rows.where(F.col("n_bytes") < capacity)
    groups = max(1, -(-base.count() // group))
    if labels is not None:
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        labels = labels.where(F.col("label") != F.col("cluster")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        items = items.withColumn("salt", salt).join(labels, ["cluster", "salt"], "left").withColumn("cluster", F.coalesce("label", "cluster"))
    items = items.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).repartitionByRange(groups, "g")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_bytes", "doc_id", "chunk"], ascending=[False, True, True], kind="stable", na_position="last")
        placed = best_fit(list(zip(pdf["n_bytes"].tolist(), _bits(pdf["source"], False), _bits(pdf["cluster"], True), strict=True)), capacity)
        return pdf.assign(bin_id=[f"{key[0]}-{b}" for b, _ in placed], bin_offset=[o for _, o in placed])[["doc_id", "chunk", "start_byte", "n_bytes", "bin_id", "bin_offset"]]

    return items.select("g", "doc_id", "chunk", "start_byte", "n_bytes", "source", "cluster").groupBy("g").applyInPandas(one, SCHEMA).unionByName(whole)

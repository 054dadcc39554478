"""Exact removal of repeated word sequences by prefix-partitioned suffix trees.

Suffixes are split into groups by prefixes of variable length: the prefix of a
suffix runs from its first word to the end of the least, by hash, of the ``GRAM``-word runs within its
first ``WINDOW`` words, and all prefixes that end in the same run, the *anchor*,
make one group. A prefix has ``GRAM`` to ``WINDOW`` words, and it alone decides
the group, so suffixes equal over a window meet. Neighbouring suffixes mostly end
their prefixes in the same anchor, so a group gets a stretch of text and not a copy
of each suffix. A group whose anchor occurs nowhere else is settled without being sent.

A group small enough for memory becomes a tree: its suffixes are sorted word by
word, neighbours get the length of their common prefix, and the deep internal nodes
are the runs of the order whose common prefixes reach a window; their leaves are
the repeats. In a group that is too large prefixes are lengthened to the whole window,
where a prefix is a deep node itself: equal stretches are counted first, then the
windows of one of each distinct stretch, by aggregations that no single task has to hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textvec import U, as_bytes, gram_hashes, mix, sliding_argmin, span_hashes, word_spans

#: Words of a window, and of the prefixes that split the windows into groups.
WINDOW, GRAM = 35, 16
#: Occurrences of an anchor from which its group is split by prefixes of a whole window.
HOT = 2000
#: Parts that the rows of one stretch or window are dealt into when they are joined with what is known of it.
SALTS = 32
#: Words of suffixes that one tree building holds.
TREE_WORDS = 1 << 19


def split(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = as_bytes(text)
    return (buf, *word_spans(buf))


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the prefixes, and for each window the place of its anchor."""
    g = gram_hashes(words, gram)
    return g, sliding_argmin(g, window - gram + 1)


#: Copied texts, of 16 bytes each, up to which they are sent to all executors.
BROADCAST_COPIES = 500_000


def _with_key(docs: DataFrame) -> DataFrame:
    """Rows of equal text share a key and a result."""
    return docs.withColumns({"u": F.xxhash64("text"), "u2": F.xxhash64("text", F.lit(1))})


def copies(docs: DataFrame) -> DataFrame:
    """``u, u2, rep`` of the texts that more than one row has; all their windows are repeated."""
    return _with_key(docs).groupBy("u", "u2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where(F.col("n") > 1).select("u", "u2", "rep")


def one_each(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """``u, u2, text``: one row of each copied text, as others may share passages with it, and all other rows."""
    side = F.broadcast(copied) if copied.count() <= BROADCAST_COPIES else copied
    rows = _with_key(docs).join(side.withColumn("many", F.lit(True)), ["u", "u2"], "left")
    return rows.where(F.col("many").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))).select("u", "u2", "text")


def stretches(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose anchors are equal: the anchor, first window, how many windows, and how many places the anchor has in them."""
    g, at = anchors(words, window, gram)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    cut = np.flatnonzero(g[at[1:]] != g[at[:-1]]) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
    moved = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
    return g[at[begin]].view(np.int64), begin, end - begin, moved[end - 1] - moved[begin] + 1


def _anchor_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches):
            out = []
            for u, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                buf, s, e = split(text)
                if len(s) >= window:
                    g, begin, _, places = stretches(span_hashes(buf, s, e), window, gram)
                    out.append((g, np.full(len(g), u, np.int64), begin.astype(np.int32), places.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["g", "u", "p", "w"])

    return rows.mapInArrow(run, "g long, u long, p int, w int")


def _suffix_rows(texts: DataFrame, places: DataFrame, window: int, gram: int) -> DataFrame:
    """The stretches of windows that share a repeated anchor, as text from the first to the last of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches):
            rows: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for u, u2, text, cool, hot in zip(*columns, strict=True):
                buf, s, e = split(text)
                g, begin, many, _ = stretches(span_hashes(buf, s, e), window, gram)
                raw = buf.tobytes()
                for wanted, heat in ((cool, False), (hot, True)):
                    mine = np.isin(begin, wanted or [])
                    for k, b, n in zip(g[mine].tolist(), begin[mine].tolist(), many[mine].tolist(), strict=True):
                        rows.append((k, heat, u, u2, b, n, raw[s[b] : e[b + n + window - 2]]))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "hot", "u", "u2", "p", "n", "words"])

    joined = texts.join(places, "u").select("u", "u2", "text", "cool", "hot")
    return joined.mapInArrow(run, "g long, hot boolean, u long, u2 long, p int, n int, words binary")


def _hot_rows(suffixes: DataFrame, window: int) -> DataFrame:
    """Repeated windows below anchors that are too frequent for a task."""
    span = "struct<p:int,n:int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_ = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("p", pa.int32()), ("n", pa.int32())])), pa.int32())
        held: list[list] = [[] for _ in kinds_]

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds_, strict=True)], names=["d", "times", "places", "one", "two", "at", "home"])
            for c in held:
                c.clear()
            return out

        for batch in common.small(batches):
            for d, times, words, home in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf = np.frombuffer(words, np.uint8)
                h = span_hashes(buf, *word_spans(buf))
                both = np.stack([gram_hashes(h, window).view(np.int64), gram_hashes(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), window).view(np.int64)], axis=1)
                own, which = np.unique(both, axis=0, return_inverse=True)
                which = which.ravel()
                spans: list[list] = [[] for _ in own]
                cut = np.flatnonzero(np.diff(which)) + 1  # a window that repeats itself at once is one span
                for b, e in zip([0, *cut.tolist()], [*cut.tolist(), len(which)], strict=True):
                    spans[which[b]].append({"p": b, "n": e - b})
                n = len(own)
                for c, more in zip(held, ([d] * n, [times] * n, (times * np.bincount(which)).tolist(), own[:, 0].tolist(), own[:, 1].tolist(), spans, [home] * n), strict=True):
                    c.extend(more)
                if len(held[0]) >= 5000:
                    yield done()
        if held[0]:
            yield done()

    rows = suffixes.where("hot").withColumns({"d": F.unhex(F.md5("words")), "salt": F.pmod(F.xxhash64("u", "p"), F.lit(SALTS)).cast("int")})
    parts = rows.groupBy("d", "salt").agg(F.count("*").alias("times"), F.first("words").alias("words"))
    kinds = parts.groupBy("d").agg(F.sum("times").alias("times"), F.first("words").alias("words"), F.collect_list("salt").alias("salts"))
    many = kinds.where(F.col("times") > 1).select("d", F.explode("salts").alias("salt"))
    several = rows.join(many, ["d", "salt"]).select("u", "u2", F.array(F.struct("p", "n")).alias("spans"))
    kinds = kinds.select("d", "times", "words", F.get("salts", F.lit(0)).alias("home"))  # where the rows of a lone stretch are
    each = kinds.mapInArrow(run, f"d binary, times long, places long, one long, two long, at array<{span}>, home int")
    each = each.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
    twice = each.groupBy("one", "two", "salt").agg(F.sum("places").alias("places"))
    twice = twice.groupBy("one", "two").agg(F.sum("places").alias("places"), F.collect_list("salt").alias("salts")).where(F.col("places") > 1)
    twice = twice.select("one", "two", F.explode("salts").alias("salt"))
    lone = each.where(F.col("times") == 1).join(twice, ["one", "two", "salt"]).groupBy("d", F.col("home").alias("salt")).agg(F.flatten(F.collect_list("at")).alias("at"))
    found = rows.select("d", "salt", "u", "u2", "p").join(lone, ["d", "salt"])
    moved = F.transform("at", lambda x: F.struct((x["p"] + F.col("p")).alias("p"), x["n"].alias("n")))
    return several.unionByName(found.select("u", "u2", moved.alias("spans")))


def subtrees(groups: np.ndarray, words: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The trees of all groups: the suffixes in order, and the length, up to ``window`` words, that each has in common with the one before.

    ``words[i]`` holds the suffixes that begin at its first ``counts[i]`` words. Suffixes are numbered
    one after the other; the first of a group has nothing in common with the one before.
    Words, then runs of 2, 4 ... words, get their rank, each from the ranks of its halves.
    """
    buf = np.frombuffer(b" ".join(words), np.uint8)
    s, e = word_spans(buf)
    per = counts + window - 1
    first = np.cumsum(per) - per
    rank = np.unique(span_hashes(buf, s, e), return_inverse=True)[1].astype(np.int32)
    n, levels, size = len(rank), {1: rank}, 1

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int32)

    while size * 2 <= window:
        half = levels[size]
        right = np.zeros(n, np.int32)
        right[: n - size] = half[size:] + 1  # ranks of runs that go on past their row are never used
        size *= 2
        levels[size] = pair(half, right)
    starts = (np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))).astype(np.int32)
    group = np.repeat(np.unique(groups, return_inverse=True)[1].astype(np.int32), counts)
    key, at, rest = group, starts, window
    for size in sorted(levels, reverse=True):
        while rest >= size:
            key = pair(key, levels[size][at])
            at, rest = at + size, rest - size
    order = np.argsort(key, kind="stable")
    one, two = starts[order[:-1]], starts[order[1:]]
    depth, rest = np.zeros(len(order), np.int32), np.full(max(0, len(order) - 1), window, np.int32)
    same = group[order[:-1]] == group[order[1:]]
    for size in sorted(levels, reverse=True):
        go = same & (rest >= size)
        go[go] = levels[size][one[go]] == levels[size][two[go]]
        step = np.where(go, np.int32(size), np.int32(0))
        one, two, rest = one + step, two + step, rest - step
    depth[1:] = np.where(same, window - rest, 0)
    return order, depth


def repeated(groups: np.ndarray, words: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """Of the suffixes of :func:`subtrees`: which are leaves of an internal node that is ``window`` words deep."""
    order, depth = subtrees(groups, words, counts, window)
    deep = depth >= window
    out = np.zeros(len(order), bool)
    out[order] = deep | np.append(deep[1:], False)
    return out


def _tree_rows(suffixes: DataFrame, parts: int, window: int) -> DataFrame:
    """Stretches of windows that a deep internal node holds; suffixes come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch.column(4).to_numpy().sum()) + window * batch.num_rows
            if size >= TREE_WORDS:
                table = pa.Table.from_batches(held)
                g = table.column(0).to_numpy()
                last = int(np.searchsorted(g, g[-1], side="left"))  # the last group may go on
                if last:
                    yield from found(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = 0 if last else size // 2
        if held:
            yield from found(pa.Table.from_batches(held))

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, u, u2, p, n = (table.column(i).to_numpy() for i in range(5))
        hit = repeated(g, table.column(5).to_pylist(), n.astype(np.int64), window)
        if not hit.any():
            return
        row = np.repeat(np.arange(len(n)), n)[hit]
        at = (np.repeat(p, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))[hit]
        cut = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(at) != 1)))
        begin = np.flatnonzero(cut)
        run_n = np.diff(np.concatenate((begin, [len(at)])))
        yield pa.RecordBatch.from_arrays([pa.array(u[row[begin]]), pa.array(u2[row[begin]]), pa.array(at[begin].astype(np.int32)), pa.array(run_n.astype(np.int32))], names=["u", "u2", "p", "n"])

    rows = suffixes.where("not hot").select("g", "u", "u2", "p", "n", "words")
    return rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, "u long, u2 long, p int, n int")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``u, u2, spans, copied``: for each text's key, the stretches of repeated windows (first window, how many), and whether all are."""
    spark = docs.sparkSession
    copied = common.saved(copies(docs), "copies")
    texts = one_each(docs, copied)
    every = common.saved(_anchor_rows(texts, window, gram), "anchors")
    again = every.groupBy("g").agg(F.sum("w").alias("places")).where(F.col("places") > 1)
    kept = every.join(again, "g")
    places = common.saved(
        kept.groupBy("u").agg(
            F.collect_set(F.when(F.col("places") < hot, F.col("p"))).alias("cool"), F.collect_set(F.when(F.col("places") >= hot, F.col("p"))).alias("hot")
        ), "places")
    common.remove(spark, every)
    suffixes = common.saved(_suffix_rows(texts, places, window, gram), "suffixes")
    common.remove(spark, places)
    # tasks of a few trees' words each, whatever the session deals
    amount = suffixes.where("not hot").agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), amount // (4 * TREE_WORDS))
    trees = _tree_rows(suffixes, parts, window).select("u", "u2", F.array(F.struct("p", "n")).alias("spans"))
    found = trees.unionByName(_hot_rows(suffixes, window)).groupBy("u", "u2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = found.join(copied.select("u", "u2", F.lit(True).alias("copied")), ["u", "u2"], "full")
    spans = common.saved(found, "spans")
    common.remove(spark, suffixes)
    return spans


def kept_words(text: str | None, spans: list | None, copied: bool | None, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the others joined by one space."""
    buf, s, e = split(text)
    if copied and len(s) >= window:
        return len(s), len(s), b""
    if not spans:
        raw = buf.tobytes()
        return len(s), 0, b" ".join(raw.split()) if len(s) else b""
    edge = np.zeros(len(s) + 1, np.int64)
    for r in spans:
        edge[r["p"]] += 1
        edge[r["p"] + r["n"] + window - 1] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    raw = buf.tobytes()
    return len(s), int(gone.sum()), b" ".join([raw[a:b] for a, b in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True)])


def deduplicate(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``, ``kept_text``.

    A word goes if a window of ``window`` words that covers it also begins anywhere
    else, in the same text too. Windows are judged on the input. A null or empty text has no
    words; rows shorter than a window stay as they are. Repeated rows repeat each other, so all their windows go.
    Other columns, whatever their names, pass through unless named like an added one.
    """
    added = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if texts else {})
    names = [c for c in (keep or docs.columns) if c not in added]
    spans = repeats(docs.select("doc_id", "text"), window).select(F.col("u").alias("__u"), F.col("u2").alias("__u2"), F.col("spans").alias("__spans"), F.col("copied").alias("__copied"))
    rows = docs.select(*dict.fromkeys([*names, "doc_id", "text"])).withColumns({"__u": F.xxhash64("text"), "__u2": F.xxhash64("text", F.lit(1))})
    rows = rows.join(spans, ["__u", "__u2"], "left").select(*names, F.col("text").alias("__text"), "__spans", "__copied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small(batches):
            got = [kept_words(*row, window) for row in zip(*(batch.column(len(names) + k).to_pylist() for k in range(3)), strict=True)]
            out = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            if texts:
                out.append(pa.array([g[2].decode("utf-8") for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *out], names=[*names, *added])

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"{c} {t}" for c, t in added.items()]
    return rows.mapInArrow(run, ", ".join(schema))

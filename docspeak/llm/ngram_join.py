"""N-gram Jaccard self-join with Bayesian candidate pruning.

Nodes are the distinct texts; a node's set are the hashes of its five-word
shingles. MinHash bands name candidate pairs. A pair's MinHash values are then
compared a few at a time, and the pair is dropped as soon as the posterior
probability that it reaches the threshold is below a tolerance; what is left is
verified exactly on the shingle sets.

Pairs never become rows. A bucket of one band is searched breadth first inside a
task, which returns a spanning forest of the pairs that survive; components of
those forests hold every surviving pair. Each component, cut into blocks of
bounded size, is then joined exactly: a row a node and block pair tells how many
links the node has there, and what it hangs together with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, with_total
from .textvec import U, as_bytes, gram_hashes, mix, span_hashes, word_spans

SHINGLE = 5
#: The threshold as a fraction, so that it is compared exactly.
OVER, UNDER = 4, 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair goes.
STEP, TOLERANCE = 16, 1e-6
#: Nodes of a bucket or component that one task compares with each other or with as many others.
BUCKET_BLOCK, BLOCK = 1024, 512
#: Bytes of texts hashed at once, and shingles whose orders are worked out at once.
TEXT_BYTES, PART = 1 << 20, 4096
#: Most nodes with a candidate that are sent to every executor to pick their texts.
BROADCAST_NODES = 500_000
_SEEDS = (mix(np.arange(1, HASHES + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of the whole text. A text of fewer words is one shingle; one without words has none."""
    buf = as_bytes(text)
    s, e = word_spans(buf)
    if not len(s):
        return np.zeros(0, U)
    return np.unique(gram_hashes(span_hashes(buf, s, e), min(SHINGLE, len(s))))


def minhash(own: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """The least of the set's upper halves under each of ``HASHES`` orders, mixed; repeats don't matter. With ``ends``, a row for each of the non-empty sets that end there."""
    half = (own >> U(32)).astype(np.uint32)
    ends = np.array([len(own)]) if ends is None else ends
    begin = np.concatenate(([0], ends[:-1]))
    out = np.full((len(ends), HASHES), 0xFFFFFFFF, np.uint32)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, begin[i] + PART, side="right")))
        for k in range(int(begin[i]), int(ends[j - 1]), PART):  # several sets, or one in parts
            x = half[None, k : min(k + PART, int(ends[j - 1]))] * _SEEDS[:, None]
            x ^= x >> np.uint32(15)
            if j == i + 1:
                np.minimum(out[i], x.min(axis=1), out=out[i])
            else:
                out[i:j] = np.minimum.reduceat(x, begin[i:j] - begin[i], axis=1).T
        i = j
    return mix(out.astype(U))


def signature(values: np.ndarray) -> np.ndarray:
    """The values' low bytes."""
    return (values & U(255)).astype(np.uint8)


def bands(values: np.ndarray) -> np.ndarray:
    """A hash of each band of each row, with the band's number in it."""
    v = values.reshape(-1, BANDS, ROWS)
    out = np.repeat(np.arange(1, BANDS + 1, dtype=U)[None], len(v), axis=0)
    for k in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + v[:, :, k])
    return out.view(np.int64)


def sketches(texts: list[str | None]) -> tuple[list[bytes | None], list[list[int] | None]]:
    """Signature and bands of each whole text; none where there is no shingle. Many texts are hashed at once."""
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sigs, keys = [None] * len(texts), [None] * len(texts)
    size = np.cumsum([len(d) + 1 for d in data])
    i = 0
    while i < len(data):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + TEXT_BYTES, side="right")))
        buf = np.frombuffer(b" ".join(data[i:j]), np.uint8)
        s, e = word_spans(buf)
        h = span_hashes(buf, s, e)
        last = np.searchsorted(s, size[i:j] - (size[i - 1] if i else 0))  # words up to the end of each text
        n = np.diff(last, prepend=0)
        many = np.maximum(n - SHINGLE + 1, 0)
        sets = gram_hashes(h, SHINGLE)[np.repeat(last - n, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
        got = np.flatnonzero(many)
        values = [minhash(sets, np.cumsum(many)[got])] if len(got) else []
        few = np.flatnonzero((n > 0) & (many == 0))
        values += [minhash(gram_hashes(h[last[k] - n[k] : last[k]], int(n[k]))) for k in few.tolist()]
        if values:
            rows = np.concatenate(values)
            for at, sig, key in zip([*got.tolist(), *few.tolist()], signature(rows), bands(rows).tolist(), strict=True):
                sigs[i + at], keys[i + at] = sig.tobytes(), key
        i = j
    return sigs, keys


@lru_cache
def least_matches(tolerance: float = TOLERANCE, threshold: float = OVER / UNDER) -> tuple[int, ...]:
    """Of the first ``STEP``, 2 x ``STEP`` ... values, how many must agree for the threshold to stay credible.

    The prior of the similarity is uniform; two different values agree in their low byte once in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p + 1e-300) - (m * np.log(max(m, 1) / n) + ((n - m) * np.log(max(n - m, 1) / n))))
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rows of ``others`` (signatures) that stay credible partners of ``one``."""
    left, have = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        have = have + (others[left, part] == one[part]).sum(axis=1)
        ok = have >= least
        left, have = left[ok], have[ok]
        if not len(left):
            break
    return left


def forest(sigs: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs. ``side``: nodes of one non-zero side aren't compared with each other."""
    free, out = np.arange(len(sigs)), []
    while len(free) > 1:
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            i = queue.pop()
            may = free if not side[i] else free[side[free] != side[i]]
            got = may[survivors(sigs[i], sigs[may])]
            if len(got):
                out += [(i, int(j)) for j in got]
                queue += got.tolist()
                free = free[~np.isin(free, got)]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of one key after the other; input is sorted by its first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in range(keys):
            col = table.column(k).to_numpy()
            change |= col[1:] != col[:-1]
        cut = np.flatnonzero(change) + 1
        begin = 0
        for c in cut.tolist():
            yield table.slice(begin, c - begin)
            begin = c
        held = table.slice(begin).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _blocks(size: Column, node: Column, block: int) -> Column:
    """The block pairs that a node of a group of ``size`` goes to, as ``(low, high, own)``."""
    n = F.ceil(size / block).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(7)), n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high"), own.alias("own")))


def _sides(table: pa.Table, low: int, high: int, own: int) -> np.ndarray:
    """Sides of a block pair: within one block all are compared; else only across."""
    lo, hi, mine = (table.column(i).to_numpy() for i in (low, high, own))
    return np.where(lo == hi, 0, np.where(mine == lo, 1, 2))


def nodes_of(docs: DataFrame) -> DataFrame:
    """``node, n, doc_id, sig, bands``: distinct texts, how many rows have them, and their signatures; null where there is no shingle."""

    def start():
        def each(batch: list) -> list[pa.Array]:
            sigs, keys = sketches(batch)
            return [pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_key().alias("node"), "text")
    signed = common.map_text(rows, start, {"sig": "binary", "bands": "array<long>"}, ["doc_id", "node"])
    return signed.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))


def node_key(text: Column | str = "text") -> Column:
    """Texts that are equal are one node; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))).alias("node")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` of the forests of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in _grouped(batches, 3):
            names = table.column(4).to_pylist()
            if len(names) < 2:
                continue
            sigs = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(len(names), HASHES)
            for i, j in forest(sigs, _sides(table, 1, 2, 3)):
                a.append(names[i]), b.append(names[j])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    rows = nodes.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    rows = rows.join(full, "key").join(nodes.select("node", "sig"), "node")
    rows = rows.select("key", "node", "sig", F.explode(_blocks(F.col("size"), F.col("node"), BUCKET_BLOCK)).alias("s"))
    rows = rows.select("key", "s.low", "s.high", "s.own", "node", "sig")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "a binary, b binary")


def exact_links(texts: list[str], weights: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the weight of its exact partners, and the least text it hangs together with."""
    sets = [shingles(t) for t in texts]
    size = np.array([len(x) for x in sets])
    sigs = signature(minhash(np.concatenate(sets), np.cumsum(size)))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    by_item = owner[order]  # who has an item
    begin = np.searchsorted(flat[order], np.arange(flat.max() + 2))
    ends = np.cumsum(size)
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets) - 1):
        may = np.arange(i + 1, len(sets))
        if side[i]:
            may = may[side[may] != side[i]]
        # no pair reaches the threshold whose sizes differ by more
        may = may[(size[may] * UNDER >= size[i] * OVER) & (size[i] * UNDER >= size[may] * OVER)]
        may = may[survivors(sigs[i], sigs[may])]
        if not len(may):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        if len(may) <= 4:
            common_n = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in may])
        else:
            lens = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
            common_n = np.bincount(by_item[at], minlength=len(sets))[may]
        hit = may[common_n * (OVER + UNDER) >= OVER * (size[i] + size[may])]
        links[i] += weights[hit].sum()
        links[hit] += weights[i]
        for j in hit.tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return links, np.array([find(i) for i in range(len(sets))])


def _verified(docs: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, links, root`` for each node and block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            names = table.column(4).to_pylist()
            if len(names) < 2:
                continue
            links, root = exact_links(table.column(6).to_pylist(), table.column(5).to_numpy(), _sides(table, 1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links, pa.int64()), pa.array([names[r] for r in root], pa.binary())], names=["node", "links", "root"])

    members = with_total(labels, "label", "node", F.count("*").alias("size"), F.sum("size").alias("size")).join(nodes.select("node", "n"), "node")
    keys = F.xxhash64("label")
    members = members.select("node", "n", keys.alias("key"), F.explode(_blocks(F.col("size"), F.col("node"), BLOCK)).alias("s"))
    wanted = labels.select("node")
    if wanted.count() <= BROADCAST_NODES:  # 16 bytes each; beyond, both sides are dealt by node
        wanted = F.broadcast(wanted)
    texts = docs.select(node_key(), "text").join(wanted, "node").groupBy("node").agg(F.first("text").alias("text"))
    rows = members.join(texts, "node").select("key", "s.low", "s.high", "s.own", "node", "n", "text")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "node binary, links long, root binary")


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, links`` for every row.

    Rows whose shingle sets have a Jaccard similarity of 0.8 or more are linked;
    ``links`` counts a row's partners, ``class_id`` is the least id of all it hangs
    together with. Equal texts count as linked. A null text counts as empty; texts
    without words are linked to each other only as equal ones. Repeated rows are
    each other's copies. Null ids are never a class's least unless it has no other.
    Only ``doc_id`` and ``text`` are read.
    """
    docs = docs.select("doc_id", "text")
    return docs.select("doc_id", node_key()).join(classes(docs), "node").select("doc_id", "class_id", "links")


def classes(docs: DataFrame) -> DataFrame:
    """``node, least_id, label, class_id, links`` of every distinct text; nodes of one class, and no others, share a ``label``.

    Unlike ``class_id``, which is null where no row of a class has an id, a label is never null.
    ``least_id`` is the least id of the rows with that text.
    """
    docs = docs.select("doc_id", "text")
    nodes = common.saved(nodes_of(docs), "nodes")
    near = components(_candidates(nodes), "candidates")
    checked = common.saved(_verified(docs, nodes, near), "verified")
    linked = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")), "linked")
    counts = checked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "n", "doc_id").join(linked, "node", "left").join(counts, "node", "left")
    known = known.select("node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"), "doc_id")
    known = with_total(known, "label", "node", F.min("doc_id").alias("class_id"), F.min("class_id").alias("class_id"))
    return known.select("node", F.col("doc_id").alias("least_id"), "label", "class_id", (F.col("links") + F.col("n") - 1).alias("links"))

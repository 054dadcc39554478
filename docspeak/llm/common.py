"""Shared folder, fold and sampling helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes on average, that a function gets at once: texts can be long. Spark bounds the bytes of what a worker receives.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Folders that this thread's operators wrote, in order.
_made = threading.local()


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, whatever the session's setting."""
    for batch in batches:
        step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A local one only where it names none and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docspeak-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_root(spark).rstrip('/')}/docspeak-{uuid.uuid4().hex}"
    _made.paths = [*getattr(_made, "paths", []), folder]
    return f"{folder}/{name}"


def mark() -> int:
    """For :func:`clean`: how many folders this thread's operators have written."""
    return len(getattr(_made, "paths", []))


def clean(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what this thread's operators wrote in the shared folder since a :func:`mark`, but for the files of ``keep``.

    For when nothing reads it any more: a result that isn't written yet may.
    """
    kept = [f for f in keep.inputFiles()] if keep is not None else []
    left = []
    for folder in getattr(_made, "paths", [])[since:]:
        if any(folder.rpartition("/")[2] in f for f in kept):
            left.append(folder)
        else:
            _delete(spark, folder)
    _made.paths = [*getattr(_made, "paths", [])[:since], *left]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and lets the
    shuffle files of what came before go.
    """
    spark = df.sparkSession
    path, rows = scratch_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(rows)
    spark.conf.set(rows, BATCH_ROWS)  # for this write only
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(rows, was)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Shuffle files of plans nobody refers to any more go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`saved`, once nothing reads it any more."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, parent)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null ids are in no fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, max_chars: int
) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """At most ``per_class`` labelled texts of each class, and how many labels there are of each.

    Only rows outside the held-out fold are looked at. Ids are chosen by their
    hash from the labels alone, so the documents are read once against a small
    broadcast list; texts over ``max_chars`` and nulls are not used for fitting.
    A document that has both labels counts as of the greater one.
    """
    spark = docs.sparkSession
    train = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != held))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = [
        (r["doc_id"], r["label"])
        for k in sorted(totals)
        for r in train.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    ]
    if not ids:
        return [], totals
    wanted = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(wanted, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))
        .collect()
    )
    return [(r["doc_id"], r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])], totals


def map_text(docs: DataFrame, start: Callable[[], Callable[[list], list[pa.Array]]], added: dict[str, str], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add the columns that a function of the batch's texts gives, in Arrow batches.

    ``start`` is called once a task. Other columns pass through as they are;
    those named like an added one are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    docs = docs.select(*dict.fromkeys([*names, text]))
    at, order = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in small(batches):
            arrays = each(batch.column(at).to_pylist())
            kept = [batch.column(order.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*names, *added])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return docs.mapInArrow(run, ", ".join([*fields, *(f"`{c}` {t}" for c, t in added.items())]))

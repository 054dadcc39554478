"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Parts that the rows of one key are dealt into; a key has at most as many rows when what holds for all of it is put together.
SALTS = 32


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, label`` (the least node of the component) for every node of ``edges(a, b)``.

    Alternates large-star and small-star steps until nothing changes. Each round
    is written to the shared folder; no edge or label goes to the driver.
    """
    spark = edges.sparkSession
    now = common.saved(_tidy(edges), f"{name}-0")
    state, turn = None, 0
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = _with_least(_tidy(large))
        # the least neighbour keeps the node, the others go to the least
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        turn += 1
        after = common.saved(_tidy(small), f"{name}-{turn}")
        common.remove(spark, now)
        now = after
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sums == state:
            break
        state = sums
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def with_total(rows: DataFrame, key: str, by: str, part: Column, total: Column) -> DataFrame:
    """Add an aggregate over each ``key``: ``part`` names it, of some of a key's rows, ``total`` puts those together.

    Rows are dealt by a salt, from column ``by``, before and after, so no task has all rows of a hot key.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(part)
    known = parts.groupBy(key).agg(total, F.collect_list("salt").alias("salts")).withColumn("salt", F.explode("salts")).drop("salts")
    return salted.join(known, [key, "salt"]).drop("salt")


def _with_least(edges: DataFrame) -> DataFrame:
    """Add ``m``, the least ``b`` of each ``a``."""
    return with_total(edges, "a", "b", F.min("b").alias("m"), F.min("m").alias("m"))


def _tidy(edges: DataFrame) -> DataFrame:
    """From the greater to the lesser node, once."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

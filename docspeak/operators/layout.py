"""Reading order of positioned blocks, and removal of blocks inside pictures, tables and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

# Shares of the page width, points, and the most columns.
FULL_WIDTH, GAP, NARROW, MOST_COLUMNS, SPAN_MARGIN, SPAN_ABOVE = 0.6, 0.1, 0.5, 4, 4.0, 3.0
MARGIN, NEAR, SHORT = 12.0, 30.0, 60


def _box_y(height: Column) -> Column:
    return F.when(F.col("bbox").isNull(), F.lit(0.0e0)).when(F.col("bbox.t") <= F.col("bbox.b"), F.col("bbox.t")).otherwise(height - F.col("bbox.t"))


def _by_page(rows: DataFrame, value: Column, name: str, most: bool = True) -> DataFrame:
    """``doc_id`` and a map from page to the value, or to all of them, so that blocks dealt by document needn't move again."""
    value = F.max(value) if most else F.collect_list(value)
    pages = rows.where("page_no is not null").repartition("doc_id").groupBy("doc_id", "page_no").agg(value.alias("v"))
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_no", "v"))).alias(name))


def with_sizes(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``width`` and ``height`` of the block's page; null for pages without a positive size. Dealt by document."""
    sizes = _by_page(pages.where("width > 0 and height > 0"), F.struct("width", "height"), "sizes")
    rows = blocks.repartition("doc_id").join(sizes, "doc_id", "left").withColumn("size", F.expr("try_element_at(sizes, page_no)"))
    return rows.select(*blocks.columns, "size.width", "size.height")


def columns_of(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, cols``: centres of the text columns; null where there is one."""
    return _columns(with_sizes(blocks, pages))


def _columns(sized: DataFrame) -> DataFrame:
    rows = sized.where("bbox is not null and width is not null")
    rows = rows.select("doc_id", "page_no", "width", "seq", F.col("bbox.l").alias("l"), F.col("bbox.r").alias("r")).where((F.col("r") > F.col("l")) & (F.col("r") - F.col("l") < F.col("width") * NARROW))
    rows = rows.withColumn("mid", (F.col("l") + F.col("r")) / 2)
    place = Window.partitionBy("doc_id", "page_no").orderBy("mid", "seq")
    new = F.when(F.col("mid") - F.lag("mid").over(place) >= F.col("width") * GAP, 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("cluster", F.sum("new").over(place))
    clusters = rows.groupBy("doc_id", "page_no", "cluster").agg(F.sum("mid").alias("s"), F.count("*").alias("n"))
    pages_ = clusters.groupBy("doc_id", "page_no").agg(F.sum("n").alias("many"), F.array_sort(F.collect_list(F.struct("cluster", "s", "n"))).alias("found"))
    found = F.transform("found", lambda c: F.struct(c["s"].alias("s"), c["n"].alias("n")))
    merged = F.aggregate(F.slice(F.sequence(F.lit(0), F.greatest(F.size("found"), F.lit(MOST_COLUMNS))), F.lit(1), F.greatest(F.size("found") - MOST_COLUMNS, F.lit(0))), found, lambda acc, _: _merge_closest(acc))
    cols = F.array_sort(F.transform(merged, lambda c: c["s"] / c["n"]))
    return pages_.where((F.col("many") >= 3) & (F.size("found") > 1)).select("doc_id", "page_no", cols.alias("cols"))


def _merge_closest(acc: Column) -> Column:
    """Merge the neighbours of least distance, the first on ties."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(acc) - 2), lambda i: F.struct((F.get(acc, i + 1)["s"] / F.get(acc, i + 1)["n"] - F.get(acc, i)["s"] / F.get(acc, i)["n"]).alias("gap"), i.alias("i")))
    at = F.array_min(gaps)["i"]
    both = F.struct((F.get(acc, at)["s"] + F.get(acc, at + 1)["s"]).alias("s"), (F.get(acc, at)["n"] + F.get(acc, at + 1)["n"]).alias("n"))
    return F.concat(F.slice(acc, F.lit(1), at), F.array(both), F.slice(acc, at + 3, F.size(acc)))


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``column``, ``is_span`` and ``pos``, the place in the document; pages ascend, blocks without page come last.

    The order on a page of columns is one sort key: blocks without box last, then the
    number of full-width blocks above, the column, the height, and the old place.
    """
    rows = with_sizes(blocks, pages)
    cols = _columns(rows).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_no", "cols"))).alias("by_page"))
    rows = rows.join(cols, "doc_id", "left").withColumn("cols", F.expr("try_element_at(by_page, page_no)"))
    page = Window.partitionBy("doc_id", "page_no")
    boxed = F.max(F.col("bbox").isNotNull()).over(page) & F.col("width").isNotNull()
    covered = F.size(F.filter("cols", lambda c: (c >= F.col("bbox.l") - SPAN_MARGIN) & (c <= F.col("bbox.r") + SPAN_MARGIN)))
    span = F.col("cols").isNotNull() & F.col("bbox").isNotNull() & ((F.col("bbox.r") - F.col("bbox.l") >= F.col("width") * FULL_WIDTH) | (covered >= 2))
    mid = (F.col("bbox.l") + F.col("bbox.r")) / 2
    nearest = F.array_min(F.transform("cols", lambda c, i: F.struct(F.abs(c - mid).alias("d"), i.alias("i"))))["i"]
    rows = rows.withColumn("y", _box_y(F.col("height"))).withColumn("is_span", F.coalesce(span, F.lit(False)))
    rows = rows.withColumn("column", F.when(F.col("cols").isNull() | F.col("is_span") | F.col("bbox").isNull(), 0).otherwise(nearest))
    rows = rows.withColumn("span_ys", F.collect_list(F.when(F.col("is_span"), F.struct("y", "seq"))).over(page)).withColumn("boxed", boxed)
    above = F.size(F.filter("span_ys", lambda s: ~(F.col("y") < s["y"] - SPAN_ABOVE)))
    before = F.size(F.filter("span_ys", lambda s: (s["y"] < F.col("y")) | ((s["y"] == F.col("y")) & (s["seq"] < F.col("seq")))))
    many = F.col("cols").isNotNull()
    key = F.struct(
        (many & F.col("bbox").isNull()).alias("a"), F.when(many & F.col("bbox").isNotNull(), F.when(F.col("is_span"), before).otherwise(above)).otherwise(0).alias("b"),
        (many & F.col("is_span")).alias("c"), F.when(many, F.col("column")).otherwise(0).alias("d"),
        F.when(F.col("boxed") & (F.col("bbox").isNotNull() | ~many), F.col("y")).otherwise(0.0e0).alias("e"), F.col("seq").alias("f"),
    )
    order = Window.partitionBy("doc_id").orderBy(F.col("page_no").asc_nulls_last(), key)
    return rows.withColumn("pos", F.row_number().over(order) - 1).select(*blocks.columns, "column", "is_span", "pos")


def inside(blocks: DataFrame, regions: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Add ``inside``: whether a region of the block's page touches it or, for short title-case texts, comes near."""
    body = R.strip(F.coalesce("text", F.lit("")))
    m = F.lit(margin) + F.when((F.length(body) <= SHORT) & R.matches(body, R.TITLE_CASE), F.lit(NEAR)).otherwise(F.lit(0.0e0))
    boxes = _by_page(regions, F.col("bbox"), "boxes", False)
    rows = blocks.join(boxes, "doc_id", "left").withColumn("m", m)

    def touches(x: Column) -> Column:
        m = F.col("m")
        return ~((F.col("bbox.r") <= x["l"] - m) | (x["r"] + m <= F.col("bbox.l")) | (F.col("bbox.b") <= x["t"] - m) | (x["b"] + m <= F.col("bbox.t")))

    found = F.exists(F.expr("try_element_at(boxes, page_no)"), touches) & F.col("bbox").isNotNull()
    return rows.withColumn("inside", F.coalesce(found, F.lit(False))).drop("boxes", "m")


def drop_inside(blocks: DataFrame, regions: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Blocks that no region of their page touches, nor, for short title-case ones, comes near."""
    return inside(blocks, regions, margin).where("not inside").drop("inside")

"""Pages of image files as levels of images: primaries, overviews, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def levels(pages: DataFrame, by: str = "file") -> DataFrame:
    """(file, page, sft, width, height) -> image, level and role of each page that has one.

    Bit 0 of sft marks an overview, bit 2 a mask. An image is a primary page and the smaller
    overviews that follow it, by falling width; a mask goes with the level of its size.
    """
    order = Window.partitionBy(by).orderBy("page")
    p = pages.withColumn("is_mask", F.col("sft").bitwiseAND(4) != 0).withColumn("is_over", F.col("sft").bitwiseAND(1) != 0)
    p = p.withColumn("image", F.sum(F.when(~F.col("is_mask") & ~F.col("is_over"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    data = p.filter(~F.col("is_mask"))
    full = F.max(F.when(~F.col("is_over"), F.col("width"))).over(Window.partitionBy(by, "image"))
    data = data.withColumn("full", full).filter(~F.col("is_over") | (F.col("width") < F.col("full")))
    ranked = data.withColumn("level", F.row_number().over(Window.partitionBy(by, "image").orderBy(F.desc("width"), "page")) - 1)
    ranked = ranked.select(by, "page", "image", "level", "width", "height", F.lit("data").alias("role"))
    key = ranked.select(by, "image", "level", F.col("width").alias("w"), F.col("height").alias("h"))
    masks = p.filter("is_mask").join(key.withColumnRenamed("image", "of"), by).filter((F.col("of") == F.col("image")) & (F.col("w") == F.col("width")) & (F.col("h") == F.col("height")))
    return ranked.unionByName(masks.select(by, "page", "image", "level", "width", "height", F.lit("mask").alias("role")))

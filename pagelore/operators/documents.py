"""Documents of blocks: citations, text, outlines, truncation, content shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def citation(block_id: Column, path: Column) -> Column:
    """[id] and the trail of headings."""
    return F.concat(F.lit("["), block_id.cast("string"), F.lit("] "), F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, F.array_join(path, " › ")).otherwise("(top)"))


def _joined(value: Column, separator: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col("block_id"), value.alias("value"))))
    return F.array_join(F.transform(ordered, lambda b: b["value"]), separator)


def document_text(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """Page, text (blocks parted by an empty line), n_chars and n_blocks."""
    return blocks.groupBy(page).agg(_joined(F.col("text"), "\n\n").alias("text"), F.count("*").alias("n_blocks")).withColumn("n_chars", F.length("text").cast("long"))


def outline(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """D3: page and outline: headings, a line each, indented by level."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), "text")
    return blocks.where("kind = 'heading'").groupBy(page).agg(_joined(line, "\n").alias("outline"))


def truncate(blocks: DataFrame, max_chars: int, page: str = "page_id") -> DataFrame:
    """The blocks before the first that would bring a page over max_chars; sums never fall, so a filter does."""
    upto = Window.partitionBy(page).orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_upto", F.sum(F.length("text")).over(upto)).where(F.col("_upto") <= max_chars).drop("_upto")


def content_shape(raw: DataFrame, blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """Raw (page, raw_chars) with content_chars and content_blocks, 0 for pages without blocks."""
    shape = blocks.groupBy(page).agg(F.sum(F.length("text")).alias("content_chars"), F.count("*").alias("content_blocks"))
    return raw.join(shape, page, "left").fillna(0, ["content_chars", "content_blocks"])

"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of each line merges by aggregation. Lines whose estimate lies close to the threshold
get an exact distinct count. A line found on enough sites is cross-site boilerplate: its first occurrence stays, the
others go. One line may stand in a third of all documents, so its occurrences are dealt over SALTS tasks wherever lines
meet boilerplate. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.shared import text_or_empty

MIN_SITES = 8
LG_K = 12
#: Three standard errors of a sketch with 2^12 registers.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)

#: Two 64-bit hashes name a line; blank lines have none.
LINE = ["_h1", "_h2"]
SALTS = 32


def _lines(docs: DataFrame, text: str, site: str, doc_id: str) -> DataFrame:
    line = F.btrim(F.col("_line"), F.lit(" \t\x0b\f\r"))
    return (
        docs.select(F.col(doc_id).alias("_id"), _row_key(text, site, doc_id).alias("_row"), F.col(site).cast("string").alias("_site"), F.posexplode(F.split(text_or_empty(text), "\n")).alias("_pos", "_line"))
        .where(line != "")
        .select("_id", "_row", "_site", "_pos", F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2"), F.pmod("_row", F.lit(SALTS)).cast("int").alias("_salt"))
    )


def _salted(lines: DataFrame) -> DataFrame:
    """A copy of each line for every salt that its occurrences may bear."""
    return lines.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _row_key(text: str, site: str, doc_id: str) -> F.Column:
    return F.xxhash64(F.col(doc_id), F.col(site), F.col(text))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Lines found on min_sites distinct sites or more: _h1, _h2 and _first, the (id, position) that stays."""
    lines = _lines(docs, text, site, doc_id)
    # a sketch leaves out empty strings, so it gets hashes; a null site is none
    seen = F.when(F.col("_site").isNotNull(), F.xxhash64("_site"))
    spread = lines.groupBy(LINE).agg(F.hll_sketch_agg(seen, F.lit(LG_K)).alias("_sketch"), F.min(F.struct("_id", "_pos")).alias("_first"))
    estimated = spread.withColumn("_n", F.hll_sketch_estimate("_sketch")).drop("_sketch").where(F.col("_n") >= min_sites * (1 - BAND))
    near = F.col("_n") <= min_sites * (1 + BAND)
    exact = (
        lines.join(_salted(estimated.where(near).select(LINE)), [*LINE, "_salt"], "left_semi")
        .where(F.col("_site").isNotNull())
        .select(*LINE, "_site")
        .distinct()
        .groupBy(LINE)
        .agg(F.count("*").alias("_exact"))
    )
    return estimated.join(exact, LINE, "left").where(~near | (F.col("_exact") >= min_sites)).select(*LINE, "_first")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with text freed of boilerplate lines, and n_lines, n_removed (long).

    Lines are compared without outer white space; blank lines stay. A null site counts as no site; a null text stays
    null. Of rows that repeat a doc_id and text each keeps the line's first occurrence, if it is theirs. Columns of
    docs named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    found = boilerplate(docs, min_sites, text, site, doc_id)
    gone = (
        _lines(docs, text, site, doc_id)
        .join(_salted(found), [*LINE, "_salt"])
        .where(~(F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_pos") == F.col("_first._pos"))))
        .groupBy("_row", "_id")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    kept = docs.withColumn("_row", _row_key(text, site, doc_id)).alias("d")
    joined = kept.join(gone.alias("g"), (F.col("d._row") == F.col("g._row")) & F.col(f"d.{doc_id}").eqNullSafe(F.col("g._id")), "left")
    joined = joined.withColumn("_lines", F.split(F.col(f"d.{text}"), "\n"))  # once, not for each line
    lines = F.col("_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g._gone"))
    cleaned = F.when(F.col("g._gone").isNull(), F.col(f"d.{text}")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = [cleaned.alias(text) if c == text else F.col(f"d.{c}") for c in docs.columns]
    return joined.select(*out, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("g._gone"), F.lit(0)).cast("long").alias("n_removed"))

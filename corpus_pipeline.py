"""A pipeline over documents: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.llm import decontaminate, jaccard_join, line_dedup, pieces, quality, shared
from pagelore.llm.queries import joined_ids, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and blank texts are rejected."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go but for their first occurrence; n_chars follows the text. A null text stays null."""
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    cleaned = line_dedup.dedup_lines(docs.select("doc_id", "source", "text", F.struct(*others).alias("_others")))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_others.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(F.col(f"_others.{c}") if c in others and c != "n_chars" else length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def _row_key(docs: DataFrame) -> F.Column:
    """Names a row by doc_id and all columns, as text in the order of the ids; rows of null ids come last."""
    told = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    low = F.lit(-(2**63)).cast("long")
    at = F.coalesce(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(low)), 16, "0"), F.lit("~"))
    return F.concat(at, *(F.lpad(F.hex(F.xxhash64(F.lit(seed), *told)), 16, "0") for seed in (0, 1)))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, a similarity of 0.8 or more.

    It is the one of the smallest id. Rows are told apart by all their columns, so ids may be null or repeat; of rows
    that are the same throughout one stays. Blank texts are in no group and stay.
    """
    keyed = docs.withColumn("_key", _row_key(docs))
    found = jaccard_join.jaccard_components(keyed.select("_key", "text"), shingle=5, num=80, den=100, doc_id="_key")
    first = found.where(F.col("component_id") == F.col("_key")).groupBy("_key").agg(F.max("n_shingles").alias("_n"))
    repeat = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    alone = F.when(F.col("_n") > 0, repeat).otherwise(1) == 1
    return keyed.join(first, "_key").withColumn("_alone", alone).where("_alone").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts stay."""
    whole = docs.select("text", F.struct(*docs.columns).alias("_doc"))
    found = decontaminate.find(whole, table(spark, sf_dir, "benchmark"), keep=("_doc",))
    return found.where(F.size("hit_spans") == 0).select("_doc.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of what stayed."""
    coded = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined_ids("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sets of shingles that link across documents, and pieces, are beyond SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}

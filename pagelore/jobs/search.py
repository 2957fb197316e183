"""One job from questions and stored pages to cited passages and failures: triage, blocks, injection strip, BM25, choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.functions.stored import met, stored
from pagelore.operators import documents, page_rows, retrieval, safety, triage


def read(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, title, status_code, and maybe failure, why a fetch gave nothing) with blocks, reason (null
    if usable) and shown_title.

    The title that is judged is the page's own; its state uses the sizes of the text and of the blocks.
    """
    shape = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.length(b["text"]))
    seen = page_rows.read_pages(pages).select("page_id", "blocks", F.col("title").alias("doc_title"), F.size("blocks").alias("n_blocks"), F.length("page_text").alias("_raw"), shape.alias("_content"))
    state = triage.page_state(F.col("title"), F.col("url"), F.col("status_code"), F.col("_raw"), F.col("_content"))
    joined = pages.drop("html").join(seen, "page_id").withColumn("page_error", triage.page_error(state))
    joined = joined if "failure" in pages.columns else joined.withColumn("failure", F.lit(None).cast("string"))
    return triage.triage(joined).drop("_raw", "_content")


def evidence_blocks(read_pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """page_id, url, title, block_id, kind, path and text of usable pages' blocks.

    Text is stripped of injections after the blocks got their numbers, so a block may become empty and keeps its number;
    max_chars counts the stripped text.
    """
    rows = read_pages.where("reason is null").select("page_id", "url", F.col("shown_title").alias("title"), F.inline("blocks"))
    safe = safety.strip(rows).drop("detections", "is_clean", "text").withColumnRenamed("safe_text", "text")
    return safe if max_chars is None else documents.truncate(safe, max_chars)


def sources_of(queries: DataFrame, seen: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """query_id, url, page_id, source_rank and reason of each query's sources: a null reason is a usable source, the others
    are its failures. seen: pages that read() judged.

    candidates: query_id, url, source_rank; a candidate whose page isn't stored fails as not_fetched. Without candidates
    every page is one of every query, of source rank 0, and sources bear a null query_id, which stands for all.
    """
    told = seen.select("url", "page_id", "reason")
    if candidates is None:
        everyone = F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id")
        return told.select(everyone, "url", "page_id", F.lit(0).alias("source_rank"), "reason")
    own = candidates.join(queries.select("query_id").distinct(), "query_id", "left_semi")
    return own.join(told.withColumn("_stored", F.lit(True)), "url", "left").select("query_id", "url", "page_id", "source_rank", F.when(F.col("_stored"), F.col("reason")).otherwise("not_fetched").alias("reason"))


def passages_of(queries: DataFrame, blocks: DataFrame, sources: DataFrame | None = None, limit: int = retrieval.LIMIT) -> DataFrame:
    """Passages of each query (see top_passages) with citation. blocks: what evidence_blocks gives, stored; sources: what
    sources_of gives for candidates, or None where every block is one of every query."""
    if sources is None:
        ranks = retrieval.CorpusScores(queries, blocks).ranks
    else:
        usable = sources.where("page_id is not null and reason is null").select("query_id", "page_id", "source_rank")
        ranks = retrieval.table_ranks(stored(retrieval.bm25(queries, usable, blocks), "scores"))
    texts = blocks.select("page_id", "block_id", "text", "url", F.when(F.coalesce("title", F.lit("")) == "", F.col("url")).otherwise(F.col("title")).alias("title"))
    passages = retrieval.top_passages(ranks, texts, limit, first=8 * limit)
    cited = blocks.select("page_id", "block_id", documents.citation(F.col("block_id"), F.col("path")).alias("citation"))
    return met(cited, stored(passages, "cited"), ["page_id", "block_id"])


def search(queries: DataFrame, pages: DataFrame, candidates: DataFrame | None = None, limit: int = retrieval.LIMIT) -> tuple[DataFrame, DataFrame]:
    """(passages_of, sources_of) of stored pages, which are parsed and stripped once: what both give is stored."""
    seen = stored(read(pages), "read")
    sources = sources_of(queries, seen, candidates)
    return passages_of(queries, stored(evidence_blocks(seen), "blocks"), None if candidates is None else sources, limit), sources.select("query_id", "url", "reason")

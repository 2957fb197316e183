"""Readers and writers with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.stored import stored

ATTEMPT = "struct<attempt:int,success:boolean,turns:int,aborted:string,wall_seconds:double,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cost_usd:double,llm_calls:int>"
TASKS = f"arm string, task_id string, attempts array<{ATTEMPT}>, success boolean, attempts_used int, total_tokens bigint, llm_calls int, total_cost_usd double, total_wall_seconds double, turns int"
SEARCH_RESPONSE = "struct<web:struct<results:array<struct<url:string,title:string,description:string>>>>"


def listed_candidates(lists: DataFrame, limit: int = 8) -> DataFrame:
    """Lists (query_id, urls) to query_id, source_rank (0-based) and url, cut at limit."""
    return lists.select("query_id", F.posexplode("urls").alias("source_rank", "url")).where(F.col("source_rank") < limit)


def response_candidates(responses: DataFrame, limit: int = 8) -> DataFrame:
    """Responses (query_id, body as JSON) to ranked candidates. Results without a URL go after ranking, so ranks
    may have gaps; a missing title or snippet is empty. A body that is no JSON has no results."""
    results = F.slice(F.from_json("body", SEARCH_RESPONSE)["web"]["results"], 1, limit)
    rows = responses.select("query_id", F.posexplode(results).alias("source_rank", "r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return rows.where(text("url") != "").select("query_id", "source_rank", F.col("r.url").alias("url"), text("title").alias("title"), text("description").alias("snippet"))


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """S3: the crawl table: page_id, url, html."""
    return spark.read.schema("page_id bigint, url string, html string").parquet(path)


def read_results(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of result documents {generated_at, rows: [...]}; row is the fields' DDL."""
    found = spark.read.option("multiLine", True).schema(f"generated_at string, rows array<struct<{row}>>").json(path)
    return found.select("generated_at", F.inline("rows"))


def write_results(rows: DataFrame, path: str, generated_at: str, row: str = "row", rows_per_document: int = 10_000) -> None:
    """Result documents {generated_at, rows: [...]} of several lines, a file each. row names a column with a row as
    JSON; a document holds rows_per_document of them at most."""
    own = stored(rows.select(row), "results")
    document = F.expr(f"monotonically_increasing_id() div {rows_per_document}").alias("document")
    lists = own.select(document, row).groupBy("document").agg(F.array_join(F.collect_list(row), ",\n    ").alias("_rows"))
    head = F.concat(F.lit('{\n  "generated_at": '), F.lit(json.dumps(generated_at)), F.lit(',\n  "rows": [\n    '))
    lists.select("document", F.concat(head, "_rows", F.lit("\n  ]\n}")).alias("value")).repartition("document").write.partitionBy("document").text(path)


def read_tasks(spark: SparkSession, path: str, arm: str | None = None) -> DataFrame:
    """Task rows of JSON lines, of one arm if it is given; blank lines hold nothing."""
    rows = spark.read.schema(TASKS).json(path).where("task_id is not null")
    return rows if arm is None else rows.where(F.col("arm") == arm)


def trace_json(entry: list[Column]) -> Column:
    """A trace entry as a JSON line; a null error is left out."""
    return F.to_json(F.struct(*entry))


def write_trace(trace: DataFrame, path: str) -> None:
    """JSON lines."""
    trace.write.json(path)


def export_documents(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Title, url and blocks (texts in block order) of each page; write with .write.json."""
    texts = blocks.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda b: b["text"]).alias("blocks"))
    return pages.select("page_id", "title", "url").join(texts, "page_id").drop("page_id")

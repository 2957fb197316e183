"""Token counts of flat token files that have no index: documents are told apart by an end-of-document id alone.

Files are cut into blocks that tasks read and search at once. Each block reports where the id occurs; a prefix scan
over the blocks' summaries gives every document its number and the place where the one before ended, so documents may
cross blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.llm.shared import kept, new_dir, slices
from pagelore.llm.token_files import Encoder, put

BLOCK_BYTES = 4 << 20
FILE_IDS = 8 << 20


def scan(spark: SparkSession, folder: str, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """name, document (0-based within its file), start and n_tokens (without the end id) of every document.

    Ids that follow the last end id of a file are a document that was cut off: they count as one with complete false.
    An empty file has no documents.
    """
    width = np.dtype(dtype).itemsize
    block = block_bytes // width * width
    blocks = (
        spark.read.format("binaryFile")
        .load(folder)
        .select("path", "length")
        .where("length > 0")
        .select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("offset"))
        .repartition("path", "offset")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = pafs.FileSystem.from_uri(row["path"])
                with store.open_input_file(base) as f:
                    f.seek(row["offset"])
                    ids = np.frombuffer(f.read(min(block, row["length"] - row["offset"])), dtype)
                ends = row["offset"] // width + np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["offset"]], pa.int64()), pa.array([row["length"] // width], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["path", "offset", "total", "ends"],
                )

    found = kept(blocks.mapInArrow(run, "path string, offset bigint, total bigint, ends array<bigint>"), "ends")
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "offset", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    stitched = summary.select("path", "offset", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).cast("long").alias("previous"))
    whole = (
        found.join(stitched, ["path", "offset"])
        .select("path", "first", "previous", "ends", F.posexplode("ends").alias("k", "end"))
        .select("path", (F.col("first") + F.col("k")).alias("document"), (F.when(F.col("k") == 0, F.col("previous")).otherwise(F.get("ends", F.col("k") - 1)) + 1).alias("start"), "end", F.lit(True).alias("complete"))
    )
    rest = (
        found.groupBy("path")
        .agg(F.max("total").alias("end"), F.sum(F.size("ends")).alias("document"), (F.coalesce(F.max(F.array_max("ends")), F.lit(-1)) + 1).alias("start"))
        .where("start < end")
        .select("path", "document", "start", "end", F.lit(False).alias("complete"))
    )
    return whole.unionByName(rest).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("document").cast("long").alias("document"), "start", (F.col("end") - F.col("start")).alias("n_tokens"), "complete")


def write_flat(docs: DataFrame, folder: str, encoder: Encoder, end_id: int, dtype: str = "<u2", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes each task's documents one after another, each with end_id; returns name, document and doc_id of each."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        part = TaskContext.get().partitionId()
        own: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = seq = 0
        last = np.array([end_id], dtype)

        def close() -> pa.RecordBatch:
            nonlocal held, seq
            name = f"part-{part:07d}-{seq:06d}"
            put(folder, name, b"".join(x.tobytes() for x in own))
            ids = pa.concat_arrays(names)
            row = pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(np.arange(len(ids))), ids], ["name", "document", "doc_id"])
            own.clear()
            names.clear()
            held, seq = 0, seq + 1
            return row

        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                for ids in encode(texts):
                    if len(ids) and (ids.max() > np.iinfo(dtype).max or (ids == end_id).any()):
                        raise ValueError(f"an id is {end_id}, which ends documents, or too large for {dtype}")
                    own += [ids.astype(dtype), last]
                    held += len(ids) + 1
                names.append(rows.column("_id"))
                if held >= FILE_IDS:
                    yield close()
        if own:
            yield close()

    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return kept(rows.mapInArrow(run, f"name string, document bigint, doc_id {id_type}"), "order")


def count_tokens(docs: DataFrame, encoder: Encoder, end_id: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens (long) and file, start (long) of each row of docs, counted in flat files written for it.

    A null or empty text has no tokens. Ids may be null or repeat; rows come out once each. Where the encoder gives
    end_id, or an id too large for dtype, the job fails.
    """
    spark = docs.sparkSession
    folder = new_dir(spark, "flat")
    order = write_flat(docs, folder, encoder, end_id, dtype)
    if order.isEmpty():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.col("name").alias("file"), F.col("document").alias("start"))
    return order.join(scan(spark, folder, end_id, dtype, block_bytes), ["name", "document"]).select("doc_id", "n_tokens", F.col("name").alias("file"), "start")

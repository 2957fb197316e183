"""Token-ID files: documents in id order, ids packed as Simple-8b words, written and read by Spark tasks.

A file: 8 bytes of magic, six 64-bit counts (documents, those of them without an id, ids, id words, id blocks, length
words), the documents' ids (signed 64-bit, those without one first), their lengths as Simple-8b words, the id words'
offsets by block, the id words. All little-endian. Files lie in the shared folder; a task writes under a name of its
own attempt and renames, so a repeated task leaves the same files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.llm import simple8b
from pagelore.llm.shared import kept, new_dir, slices

MAGIC = b"PLTOK8B2"
#: A file is closed when it holds so many ids.
FILE_IDS = 2 << 20
Encoder = Callable[[], Callable[[list[str]], list[np.ndarray]]]


def to_bytes(doc_ids: np.ndarray, n_nulls: int, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.pack(ids)
    sizes, _ = simple8b.pack(lengths)
    counts = np.array([len(doc_ids), n_nulls, len(ids), len(words), len(offsets) - 1, len(sizes)], "<i8")
    return b"".join([MAGIC, counts.tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def from_bytes(data: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(doc_ids, how many of the first are none, lengths, ids) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_nulls, n_ids, n_words, n_blocks, n_sizes = np.frombuffer(data, "<i8", 6, 8)
    at = 56
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    at += 8 * n_docs
    lengths = simple8b.unpack(np.frombuffer(data, "<u8", n_sizes, at))
    at += 8 * (n_sizes + n_blocks + 1)
    ids = simple8b.unpack(np.frombuffer(data, "<u8", n_words, at))
    if len(ids) != n_ids:
        raise ValueError("a token file is damaged")
    return doc_ids, int(n_nulls), lengths.astype(np.int64), ids


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a file of the shared folder whole or not at all."""
    store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(base, recursive=True)
    part = f"{base}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    try:
        store.move(part, f"{base}/{name}")
    except OSError:  # some stores refuse a name that an earlier attempt of this task has taken
        if store.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
            raise
        store.delete_file(part)


def write(docs: DataFrame, folder: str, encoder: Encoder, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes docs in ascending id order; returns a row per file: name, n_docs, n_ids, and start, the ids before it.

    encoder makes, in a task, a function from texts to arrays of ids. end_id is appended to each document. A null or
    empty text has no other ids. Ids are whole numbers or null; rows without one come first, and rows that repeat an id
    lie together, by a hash of their text, so that they are dealt over tasks too. Other columns of docs are not read,
    whatever their names.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError("ids of token files are whole numbers")
    own_text = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    told = docs.select(F.col(doc_id).cast("bigint").alias("_id"), own_text).withColumn("_hash", F.xxhash64("_text"))
    ordered = told.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash", "_text").drop("_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        part = TaskContext.get().partitionId()
        own: list[tuple[pa.Array, list[np.ndarray]]] = []
        held = seq = 0
        last = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal held, seq
            ids = [np.concatenate([x, last]) for _, found in own for x in found]
            lengths = np.array([len(x) for x in ids], np.uint64)
            name = f"part-{part:07d}-{seq:06d}"
            doc_ids = pa.concat_arrays([x for x, _ in own])
            put(folder, name, to_bytes(doc_ids.fill_null(0).to_numpy(), doc_ids.null_count, lengths, np.concatenate(ids)))
            row = pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [len(ids)], "n_ids": [int(lengths.sum())]})
            own.clear()
            held, seq = 0, seq + 1
            return row

        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                found = encode(texts)
                own.append((rows.column("_id"), found))
                held += sum(map(len, found))
                if held >= FILE_IDS:
                    yield close()
        if own:
            yield close()

    files = kept(ordered.mapInArrow(run, "part bigint, name string, n_docs bigint, n_ids bigint"), "manifest")
    earlier = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    # The one window over all has a row for each partition that was written, not for each file.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("_before"))
    within = files.withColumn("_within", earlier(Window.partitionBy("part").orderBy("name")))
    return within.join(parts, "part").select("name", "n_docs", "n_ids", (F.col("_before") + F.col("_within")).alias("start"))


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """A row per document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, n_nulls, lengths, ids = from_bytes(batch.column("content")[i].as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                sums = [zlib.crc32(raw[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("name")[i].as_py()] * len(doc_ids), pa.string()), pa.array(doc_ids, mask=np.arange(len(doc_ids)) < n_nulls), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["name", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    contents = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    found = contents.mapInArrow(run, "name string, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(files.select("name", "start"), "name").select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, encoder: Encoder, end_id: int | None = None) -> DataFrame:
    """Writes docs' ids to a new folder of the shared one and reads them back."""
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    files = write(docs, folder, encoder, end_id)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read(spark, folder, files)

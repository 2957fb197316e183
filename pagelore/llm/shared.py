"""What several operators share: folders that a whole cluster sees, checkpoints and Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all machines share.

    Where it is unset, a local session (tests) gets a temporary one; on a cluster that is an error, because executors
    don't see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_pagelore_shared", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark._pagelore_shared = "file://" + tempfile.mkdtemp(prefix="pagelore-")
    return spark._pagelore_shared


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors.

    The shuffle files behind it are then of no more use. Spark removes them when the driver's collector finds their
    handles unreachable, by default every half hour; asking for a collection here frees the disk between steps.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    found = spark.read.schema(df.schema).parquet(path)
    found._kept_at = path
    return found


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that kept() wrote, once all that was made from them is written too."""
    for df in tables:
        if df is not None:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._kept_at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts a batch into runs of rows of about most_bytes of text each, so that what a task holds stays small."""
    texts = batch.column(column)
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start), texts.slice(start).to_pylist()

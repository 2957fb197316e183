"""Tables written once in the middle of a job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows are sent to all executors, after they are counted; larger ones meet by a shuffle in which
#: a key's rows are dealt over so many salts.
SENT_ROWS, SALTS = 500_000, 16


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name below spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pagelore-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to a new folder and reads it back, so that what is made from it several times is computed
    once and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(large: DataFrame, small: DataFrame, on: list[str], most: int = SENT_ROWS) -> DataFrame:
    """The rows of large that have a partner in small, with its columns. small has few rows a key and is counted first, so
    it should be stored or cheap; a row of large always gets the same salt."""
    if small.count() <= most:
        return large.join(F.broadcast(small), on)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(small.select("*", salts), [*on, "_salt"]).drop("_salt")

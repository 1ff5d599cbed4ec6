"""What the operators share: tables in the shared folder, document keys, task counts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all contracts: runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="guestsignal-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back.

    Later steps then start from files every executor can read, whoever is lost meanwhile.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    # Spark deletes shuffle files of frames that the driver has collected as garbage
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Stands for a null doc_id inside the operators, so that ids can be compared and joined.
NO_ID = -(2**63)


def with_text_hash(docs: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID), text (null: empty) and `th`, its hash, which tells apart rows
    that repeat a doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def id_again(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))

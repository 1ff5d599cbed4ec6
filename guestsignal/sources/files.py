"""File sources and sinks. Every reader has a fixed schema; nothing is inferred."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.functions.taxonomy import ASPECT_KEYS
from guestsignal.operators.contracts import enforce_contract, submission_output
from guestsignal.operators.ingest import (
    DAMAGED,
    REQUIRED_PROFILE_COLUMNS,
    REQUIRED_REVIEW_COLUMNS,
    require_columns,
)
from guestsignal.operators.labels import pack_scores, unpack_scores
from guestsignal.operators.search import embed_sentences
from guestsignal.sources import schemas

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
ARTIFACTS = (
    "rejected",
    "reviews",
    "instances",
    "segment_sums",
    "scores",
    "priors",
    "hotels",
    "monthly",
    "drift",
    "contradictions",
    "search_index",
    "profiles",
)
# Partitioned by year: scans of a time range skip the rest of the corpus.
BY_YEAR = ("instances", "monthly")
BY_HOTEL = ("monthly", "scores", "drift", "contradictions", "hotels", "segment_sums")
PUBLISHED = "number bigint, folder string"


def readable(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether a finished table lies there: writers move files into place when a job is committed."""
    try:
        spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _read_records(
    spark: SparkSession, path: str, schema: str, fmt: str, json_array: bool
) -> DataFrame:
    """Records by schema. Of JSON that can't be parsed the text is kept, in `damaged_record`: a
    line, or the whole file if it is one array."""
    if fmt == "json":
        options = {"multiLine": json_array, "columnNameOfCorruptRecord": DAMAGED, "mode": "PERMISSIVE"}
        return spark.read.schema(f"{schema}, {DAMAGED} string").options(**options).json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {fmt!r}: json or parquet")


def read_reviews(
    spark: SparkSession, path: str, fmt: str = "json", json_array: bool = False
) -> DataFrame:
    """JSON Lines (splittable), one JSON array per file (`json_array`, not splittable) or Parquet.

    With a fixed schema an absent JSON field reads as null, so a record that has all required
    ones is looked for first, which usually is the first one.
    """
    raw = _read_records(spark, path, schemas.RAW_REVIEWS, fmt, json_array)
    if fmt == "json":
        _require_json_fields(raw, REQUIRED_REVIEW_COLUMNS, "reviews")
    return require_columns(raw, REQUIRED_REVIEW_COLUMNS, "reviews")


def read_profiles(
    spark: SparkSession, path: str, fmt: str = "json", json_array: bool = False
) -> DataFrame:
    """Profiles; `vector`, an embedding of the description, may be given with each."""
    raw = _read_records(spark, path, schemas.RAW_PROFILES, fmt, json_array)
    if fmt == "json":
        _require_json_fields(raw, REQUIRED_PROFILE_COLUMNS, "profiles")
    return require_columns(raw, REQUIRED_PROFILE_COLUMNS, "profiles")


def _require_json_fields(records: DataFrame, required: tuple[str, ...], what: str) -> None:
    """A field no record has is a schema error, not a column of nulls. Only if no record has all
    of them is everything read, once, to name those that are missing."""
    has = {c: F.col(c).isNotNull() for c in required}
    if not records.filter(reduce(and_, has.values())).isEmpty():
        return
    found = records.agg(*[F.coalesce(F.bool_or(h), F.lit(False)).alias(c) for c, h in has.items()])
    missing = [c for c, seen in found.first().asDict().items() if not seen]
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Optional file: an absent path is an empty table."""
    if not readable(spark, path, "text"):
        return spark.createDataFrame([], schemas.OVERRIDES)
    table = spark.read.schema(schemas.OVERRIDES).options(**CSV_OPTIONS).csv(path)
    return table.withColumn("polarity", F.col("polarity").try_cast("double"))


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    packed = spark.read.schema(schemas.LABELS_CSV).options(**CSV_OPTIONS).csv(path)
    return packed.withColumn("aspects", F.split("aspects", r"\|")).withColumn(
        "aspect_scores", unpack_scores(F.col("aspect_scores"))
    )


def write_labels_csv(
    labels: DataFrame, path: str, keys: tuple[str, ...] = ASPECT_KEYS
) -> None:
    labels.withColumn("aspects", F.array_join("aspects", "|")).withColumn(
        "aspect_scores", pack_scores(F.col("aspect_scores"), keys)
    ).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_artifact(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write one table of a run and hand back the stored one: short lineage, pruned scans. Tables that
    are asked for one hotel at a time are sorted by it, so that row groups of others are skipped."""
    path = f"{root}/{name}"
    if name in BY_HOTEL:
        df = df.sortWithinPartitions("hotel_id")
    if name in BY_YEAR:
        date = "review_date" if "review_date" in df.columns else "date"
        yearly = df.withColumn("year", F.year(date))
        yearly.write.mode("overwrite").partitionBy("year").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def artifacts_exist(spark: SparkSession, root: str) -> bool:
    return all(readable(spark, f"{root}/{name}") for name in ARTIFACTS)


def load_artifacts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    if not artifacts_exist(spark, root):
        raise FileNotFoundError(f"no complete set of artifact tables under {root}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in ARTIFACTS}


# --- versions: written aside, published by one small row --------------------------------


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder readers use: the one that was published last."""
    log = f"{root}/published"
    if not readable(spark, log):
        return None
    last = F.max_by("folder", F.struct("number", "folder")).alias("folder")
    return spark.read.schema(PUBLISHED).parquet(log).agg(last).first().folder


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """`write` puts a version's tables into a new folder; once all of them are there, a row that
    names it is appended to the log readers look into. Until then, and for good if `write`
    fails or dies, readers see the version before. Earlier folders stay; remove them by age."""
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    write(folder)
    log = f"{root}/published"
    number = 0
    if readable(spark, log):
        number = spark.read.schema(PUBLISHED).parquet(log).agg(F.max("number")).first()[0] + 1
    row = spark.createDataFrame([(number, folder)], PUBLISHED)
    row.coalesce(1).write.mode("append").parquet(log)
    return folder


# --- embeddings -------------------------------------------------------------------------


def add_embeddings(
    spark: SparkSession, root: str, sentences: DataFrame, load: Callable[[], Callable]
) -> DataFrame:
    """The store under `root` with vectors of all `sentences`: the encoder sees those that have none.

    Rows are keyed by a hash of their sentence and only ever appended, so a run that dies leaves
    what was there. The hash is what the store and the sentences are joined by first; the text decides.
    """
    folder = current_version(spark, root) or publish(spark, root, lambda path: _no_vectors(spark, path))
    key = F.xxhash64("sentence_text").alias("sentence_hash")
    known = spark.read.schema(schemas.EMBEDDING_STORE).parquet(folder)
    missing = (
        sentences.select(key, "sentence_text").distinct()
        .join(known.select("sentence_hash", "sentence_text"), ["sentence_hash", "sentence_text"], "left_anti")
    )
    fresh = embed_sentences(missing, load).select(key, "sentence_text", "embedding")
    fresh.write.mode("append").parquet(folder)
    return read_embeddings(spark, root)


def _no_vectors(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], schemas.EMBEDDING_STORE).write.parquet(path)


def compact_embeddings(spark: SparkSession, root: str) -> None:
    """Rewrite the store as a new version: few files, by hash, and each sentence once (two runs at the
    same time may both have added one). Readers change over when it is complete."""
    stored = spark.read.schema(schemas.EMBEDDING_STORE).parquet(current_version(spark, root))
    keys = ["sentence_hash", "sentence_text"]
    once = stored.groupBy(*keys).agg(F.min("embedding").alias("embedding"))
    ordered = once.repartitionByRange("sentence_hash").sortWithinPartitions("sentence_hash")
    publish(spark, root, lambda path: ordered.write.parquet(path))


def read_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """sentence_text and embedding, each sentence once."""
    folder = current_version(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no embeddings under {root}")
    stored = spark.read.schema(schemas.EMBEDDING_STORE).parquet(folder)
    return stored.groupBy("sentence_hash", "sentence_text").agg(
        F.min("embedding").alias("embedding")
    ).drop("sentence_hash")


def write_embeddings(embeddings: DataFrame, root: str) -> None:
    """A store made of finished vectors, as a new version."""
    keyed = embeddings.select(F.xxhash64("sentence_text").alias("sentence_hash"), "sentence_text", "embedding")
    publish(embeddings.sparkSession, root, lambda path: keyed.write.parquet(path))


# --- outputs ----------------------------------------------------------------------------


def write_profiles_json(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def write_outputs(rich: DataFrame, root: str) -> str:
    """Publish a version with both shapes as JSON datasets, and the rich one as Parquet for lookups.

    The Parquet copy is range-partitioned and sorted by profile_id, so that a lookup
    reads the row groups around its id. The contract is checked on it; if it is broken, or the run
    dies in between, readers keep the version before.
    """
    spark = rich.sparkSession

    def write(folder: str) -> None:
        ordered = rich.repartitionByRange("profile_id").sortWithinPartitions("profile_id")
        ordered.write.parquet(f"{folder}/rich_lookup")
        stored = enforce_contract(spark.read.parquet(f"{folder}/rich_lookup"))
        stored.write.json(f"{folder}/rich")
        submission_output(stored).write.json(f"{folder}/submission")

    return publish(spark, root, write)


def load_rich_output(spark: SparkSession, root: str, profile_id: str) -> DataFrame:
    """Zero or one row; zero as well when nothing has been published yet."""
    folder = current_version(spark, root)
    if folder is None:
        return spark.createDataFrame([], "profile_id string")
    stored = spark.read.parquet(f"{folder}/rich_lookup")
    return stored.filter(F.col("profile_id") == profile_id)


def load_submission(spark: SparkSession, root: str) -> DataFrame:
    folder = current_version(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no outputs under {root}")
    return spark.read.json(f"{folder}/submission")

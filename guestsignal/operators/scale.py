"""Plan shapes that keep one hot key or one global order from landing in one task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A key is hot from this share of all rows on, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
# Groups of fewer rows stay in one range.
RANGE_ROWS = 50_000
# Rows that are looked at for each range a large group gets.
SAMPLED = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="guestsignal-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder as Parquet and read back: stable, short lineage, and each
    reader scans only its columns."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_bucket(key: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets) if isinstance(buckets, int) else buckets).cast(
        "int"
    )


def _as_list(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def hot_keys(df: DataFrame, key: str | list[str], share: float = HOT_SHARE) -> DataFrame:
    """Hash of each key with at least `share` of all rows and the number of pieces of that size
    its rows make, no more than there are tasks: at most 1 / share rows, and 2 / share pieces."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(F.xxhash64(*_as_list(key)).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t")).scalar()
    pieces = F.least(F.ceil(F.col("_n") / (total * F.lit(share))), F.lit(tasks)).cast("int")
    return counts.filter(F.col("_n") >= total * F.lit(share)).select("_hot", pieces.alias("_pieces"))


def skew_safe_left_join(
    big: DataFrame,
    unique_side: DataFrame,
    key: str | list[str],
    row_id: str | list[str],
    share: float = HOT_SHARE,
) -> DataFrame:
    """Left join on one or several key columns that may be very frequent in `big`, unique on the
    other side.

    Rows of a hot key are dealt to pieces by their row id, and the key's match is copied to each
    piece; matches may have any size, as only hashes and numbers of pieces are broadcast (at
    most 1 / share pairs of numbers, from a count of hashes). Rows without a key are spread and
    find nothing. `big` is read twice: give it stored if it is costly. The sides are always sorted: where
    the caller drops rows without a match the join is an inner one, and Spark would send `big` to all
    tasks if its file is small, whatever its rows take in memory.
    """
    keys, ids = _as_list(key), _as_list(row_id)
    payload = [c for c in unique_side.columns if c not in keys]
    hot = F.broadcast(hot_keys(big, keys, share))
    marked = lambda df: df.withColumn("_hash", F.xxhash64(*keys)).join(
        hot, F.col("_hash") == F.col("_hot"), "left"
    )
    place = F.xxhash64(*ids)
    whole_key = F.lit(True)
    for k in keys:
        whole_key = whole_key & F.col(k).isNotNull()
    piece = F.when(whole_key, F.coalesce(F.pmod(place, F.col("_pieces").cast("bigint")), F.lit(0)))
    left = marked(big).select(*big.columns, piece.otherwise(place).alias("_piece"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1)).cast("bigint") - 1)
    right = marked(unique_side).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.struct(*payload).alias("_match"),
        F.explode(copies).alias("_copy"),
    )
    same = F.col("_piece") == F.col("_copy")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    return left.hint("merge").join(right, same, "left").select(
        *big.columns, *[F.col("_match")[c].alias(c) for c in payload]
    )


def value_ranges(
    rows: DataFrame,
    keys: list[str],
    by: str,
    name: str = "_range",
    share: float = HOT_SHARE,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Adds the number of the value range a row is in, within its group.

    Ranges ascend with `by`, which has an order and is not null; small groups have one. A group is
    large from `share` of all rows and `range_rows` rows on. Its splitters are quantiles of the
    values of smallest hash, a sketch that depends on the set of rows alone, so that a task
    that runs again finds the same ones (a KLL sketch draws at random). All large groups together have at
    most 2 / share ranges, which bounds the broadcast. Rows should differ in (keys, by), or equal ones
    share a range. `rows` is read three times: give it stored.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t")).scalar()
    size = F.greatest(total * F.lit(share), F.lit(float(range_rows)))
    large = (
        counts.withColumn("_ranges", F.ceil(F.col("_n") / size).cast("int"))
        .filter("_ranges > 1")
        .withColumn("_part", F.col("_ranges") * F.lit(float(SAMPLED)) / F.col("_n"))
    )
    draw = F.pmod(F.xxhash64(*keys, by), F.lit(1 << 40)) / F.lit(float(1 << 40))
    at = lambda i: F.floor(i * F.size("_sample") / F.col("_ranges")).cast("int")
    splitters = (
        rows.select(*keys, by)
        .join(F.broadcast(large.drop("_n")), keys)
        .filter(draw < F.col("_part"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(by)).alias("_sample"), F.first("_ranges").alias("_ranges"))
        .select(
            *keys,
            F.transform(
                F.sequence(F.lit(1), F.col("_ranges") - 1), lambda i: F.get("_sample", at(i))
            ).alias("_splitters"),
        )
    )
    return (
        rows.join(F.broadcast(splitters), keys, "left")
        .withColumn(name, F.coalesce(_splitters_up_to(F.col(by), share), F.lit(0)))
        .drop("_splitters")
    )


def _splitters_up_to(value: Column, share: float) -> Column:
    """How many of a row's sorted splitters are at most `value`: binary search by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(int(2 / share).bit_length()))])
    splitters = F.col("_splitters")
    return F.when(
        splitters.isNotNull(),
        F.aggregate(
            steps,
            F.lit(0),
            lambda found, step: F.when(
                F.get(splitters, found + step - 1) <= value, found + step
            ).otherwise(found),
        ),
    )


def _range_staged(df: DataFrame, order: list[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return materialise(ranged, "ranged")


def _with_offsets(staged: DataFrame, amount: Column, order: list[Column], name: str) -> DataFrame:
    """Running total of `amount` over the whole order: local total + total of earlier parts.

    The offsets table has one row per range partition, so its window and its broadcast
    are bounded by the number of shuffle partitions.
    """
    parts = staged.groupBy("_part").agg(F.sum(amount).alias("_part_total"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", F.coalesce(F.sum("_part_total").over(before), F.lit(0)).alias("_offset")
    )
    local = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        staged.withColumn("_local", F.sum(amount).over(local))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_local", "_offset")
    )


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """row_number over the whole table, `order` being a total order, without one big task."""
    staged = _range_staged(df, order)
    return _with_offsets(staged, F.lit(1), order, name).drop("_part")


def global_step_up(df: DataFrame, p: str, unique: list[str], name: str) -> DataFrame:
    """min over q >= p of q * rows / rank(q), capped at one; `p` must not be null.

    Any order within equal p gives the same result, so the columns in `unique` make the
    order total and equal p spread over several range partitions. Running minima go down the
    ranks: Spark reads a frame that ends behind the last row anew for each row.
    """
    order = [F.col(c).asc() for c in (p, *unique)]
    staged = _range_staged(df, order)
    total = staged.agg(F.count(F.lit(1))).scalar()
    ranked = _with_offsets(staged, F.lit(1), order, "_rank").withColumn(
        "_raw", F.col(p) * total / F.col("_rank")
    )
    part_minimum = ranked.groupBy("_part").agg(F.min("_raw").alias("_part_min"))
    after = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    suffix = part_minimum.select("_part", F.min("_part_min").over(after).alias("_later"))
    down = W.partitionBy("_part").orderBy(F.desc("_rank"))
    local = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        ranked.withColumn("_here", F.min("_raw").over(local))
        .join(F.broadcast(suffix), "_part")
        .withColumn(name, F.least(F.col("_here"), F.col("_later"), F.lit(1.0)))
        .drop("_part", "_rank", "_raw", "_here", "_later")
    )

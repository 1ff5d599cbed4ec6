"""Mixing sources to target weights.

Every document gets a hash-random key; the table is range-sorted by (source, key), so a large
source spreads over many partitions. Running word counts come from sums per partition and
source, and each source is cut where its budget ends. A budget above a source's size takes
whole epochs first. Only the sizes are needed for that; texts move once, if they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guestsignal.llm.shared import WORD, stored, table, tasks

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this many times the words of all sources, a source at most CAP times its own.
SHARE, CAP = 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight and target to a table of (_gone, _source, source_size), one row a source.

    The words are shared by weight; sources whose share is above CAP times their size get that,
    and the others share the rest anew until none is above. Sorted by size for weight,
    the capped sources are the first ones, so running sums find them.
    """
    order = F.row_number().over(W.orderBy("_gone", "_source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (order - 1) % len(weights) + 1)
    every = W.partitionBy()
    weighed = sizes.withColumn("weight", weight.cast("double")).withColumn(
        "_cap", (CAP * F.col("source_size")).cast("double")
    )
    earlier = W.orderBy(F.col("_cap") / F.col("weight"), "_gone", "_source").rowsBetween(
        W.unboundedPreceding, -1
    )
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    left = SHARE * F.sum("source_size").over(every) - before("_cap")
    level = left / (F.sum("weight").over(every) - before("weight"))
    levels = weighed.withColumn("_level", level)
    open_ = F.col("_level") * F.col("weight") <= F.col("_cap")
    common = F.max(F.when(open_, F.col("_level"))).over(every)
    share = F.when(open_, common * F.col("weight")).otherwise(F.col("_cap"))
    return levels.withColumn("target", share).drop("_cap", "_level")


ADDED = ("source_size", "target", "epochs", "taken")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`docs` (doc_id, source, size; any other columns) with source_size, target, epochs, taken;
    columns of `docs` of these four names are replaced.

    epochs: whole passes over the source; taken: words taken, epochs included. The last pass
    ends inside the document where the rounded budget ends. Documents without words
    are never taken. Equal keys are ordered by doc_id and size.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "size", *ADDED)]
    keyed = docs.select(
        "doc_id", "size", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"),
        F.col("source").isNull().cast("int").alias("_gone"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.xxhash64(F.lit(17), "doc_id", "size").alias("_key"),
    )
    order = ["_key", "doc_id", "size"]
    ranged = keyed.repartitionByRange(tasks(spark), "_gone", "_source", *order)
    staged = stored(ranged.withColumn("_part", F.spark_partition_id()), "mix")
    parts = staged.groupBy("_part", "_gone", "_source").agg(F.sum("size").alias("_words"))
    source = W.partitionBy("_gone", "_source")
    earlier = source.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", "_gone", "_source",
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"),
    )
    sizes = parts.groupBy("_gone", "_source").agg(F.sum("_words").alias("source_size"))
    budgets = offsets.join(targets(sizes, weights), ["_gone", "_source"])
    cell = ["_part", "_gone", "_source"]
    local = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = staged.withColumn("_before", F.coalesce(F.sum("size").over(local), F.lit(0)))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size"))
    joined = summed.join(budgets, cell).withColumn("epochs", F.coalesce(epochs, F.lit(0)))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("_offset") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    own = [F.col(f"_others.`{c}`" if c in others else c).alias(c) for c in docs.columns if c not in ADDED]
    return joined.withColumn("taken", F.col("epochs") * F.col("size") + part).select(*own, *ADDED)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of `docs` (doc_id, text, source, ...) as often as the mix takes them.

    The document in which a source's budget ends comes with its first words only, joined by one
    space; n_chars, if there, follows.
    """
    size = word_count(F.col("text"))
    packed = docs.select(
        "doc_id", "source", size.alias("size"), F.struct(*docs.columns).alias("_row")
    )
    planned = plan(packed, weights)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    rows = planned.filter("size > 0").select("_row", "size", F.explode(copies).alias("_words"))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " ")
    shorter = F.col("_words") < F.col("size")
    out = {c: F.col("_row")[c] for c in docs.columns}
    out["text"] = F.when(shorter, cut).otherwise(F.col("_row.text"))
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        own = F.char_length(out["text"]).cast(kind)
        out["n_chars"] = F.when(shorter, own).otherwise(F.col("_row.n_chars"))
    return rows.select(*[v.alias(k) for k, v in out.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return plan(sized).select("doc_id", "size", "source_size", "target", "taken")



"""The given tables seen as reviews, sentences, vectors and profiles.

order_reviews: one review per line item (numeric path). document_reviews: one review per
document (text path). event_values: small samples per (user, event type). Every view
covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.config import UNKNOWN_SEGMENT
from guestsignal.functions.vectors import norm
from guestsignal.functions.taxonomy import Lexicon, ProfileRules
from guestsignal.operators import evidence, ingest, labels, sentences

ORDER_SEGMENTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
ORDER_ASPECTS = ("A", "N", "R")
# Suppliers of more bytes are not sent to every task; what a row costs besides its texts.
SENT_BYTES, ROW_BYTES = 32 << 20, 64
WEEKDAYS = ("1", "2", "3", "4", "5", "6", "7")

# Word lists over frequent words of the given documents.
DOCUMENT_LEXICON = Lexicon(
    aspects={
        "cleanliness": ("the", "le", "der"),
        "service": ("that", "la", "die"),
        "value": ("from", "des", "von"),
        "safety": ("and", "et", "und"),
        "quietness": ("with", "un", "mit"),
        "food_dining": ("for", "pour", "para"),
    },
    positive=("is", "this", "are", "est", "que", "es"),
    negative=("was", "not", "by", "pas", "nicht", "en"),
)
DOCUMENT_ASPECTS = tuple(DOCUMENT_LEXICON.aspects)
DOCUMENT_SEGMENTS = ("en", "fr", "de", "es")

_FIT = {
    "tight": {"3-star": 1.0, "4-star": 0.4, "5-star": -0.4},
    "mid": {"3-star": 0.6, "4-star": 1.0, "5-star": 0.5},
    "high": {"3-star": -0.4, "4-star": 0.6, "5-star": 1.0},
}
ORDER_RULES = ProfileRules(
    dimensions={"A": "red|blue|hot", "N": "small|large|old", "R": "promo|economy|cold|new"},
    travelers=(("1-URGENT", "bolt|rod"), ("2-HIGH", "ring|gear"), ("3-MEDIUM", "medium")),
    budgets=(("high", "standard|large"), ("tight", "economy|small")),
    category_fit=_FIT,
    themes={"A": "alpha", "R": "romeo"},
    default_traveler="5-LOW",
    female_pattern=r"(?i)\bred\b|\bold\b",
    female_traveler="1-URGENT",
)
DOCUMENT_RULES = ProfileRules(
    dimensions={
        "cleanliness": "red|blue",
        "service": "widget|gizmo|gear",
        "value": "economy|promo",
        "safety": "plate|anvil",
        "quietness": "small|old",
        "food_dining": "hot|cold",
    },
    travelers=(("en", "bolt|rod"), ("fr", "ring|gear"), ("de", "medium")),
    budgets=(("high", "standard|large"), ("tight", "economy|small")),
    category_fit=_FIT,
    themes={"cleanliness": "tidy", "value": "budget", "safety": "safety", "food_dining": "foodie"},
    default_traveler="es",
    female_pattern=r"(?i)\bred\b|\bold\b",
    female_traveler="en",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sent_if_small(suppliers: DataFrame) -> DataFrame:
    """Marked for a broadcast up to SENT_BYTES, which are counted first. Left to itself, Spark knows the size
    of this join of two tables only when it has run, and that may be after it began to shuffle
    all line items once more."""
    texts = F.octet_length("s_name") + F.octet_length("n_name")
    size = F.sum(F.coalesce(texts, F.lit(0)) + F.lit(ROW_BYTES)).alias("size")
    return F.broadcast(suppliers) if (suppliers.agg(size).first()["size"] or 0) <= SENT_BYTES else suppliers


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and their only aspect instance in one row, not yet weighted."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        _sent_if_small(suppliers.select("s_suppkey", "s_name", "s_nationkey", "n_name")),
        F.col("l_suppkey") == F.col("s_suppkey"),
    )
    segment = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(UNKNOWN_SEGMENT))
    reviews = joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("l_suppkey").cast("string").alias("hotel_id"),
        F.concat_ws(", ", "s_name", "n_name").alias("hotel_name"),
        F.concat((3 + F.col("s_nationkey") % 3).cast("string"), F.lit("-star")).alias(
            "hotel_category"
        ),
        F.col("l_returnflag").alias("aspect"),
        (F.rint((F.col("l_discount") - 0.05) * 100) / 5.0 + 0.0).alias("polarity"),
        (1 + F.floor("l_quantity").cast("int") % 5).alias("rating"),
        F.to_date("l_shipdate").alias("review_date"),
        (F.col("l_linestatus") == "F").alias("verified"),
        segment.otherwise(F.col("o_orderpriority")).alias("traveler_type"),
    )
    return ingest.add_calendar(reviews)


def ship_anchor(spark: SparkSession, sf_dir: str):
    """Newest review date: every line item has its order and supplier, so no join is needed."""
    return (
        table(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("d")).scalar()
    )


def order_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = ingest.add_trust(
        ingest.add_recency(
            order_reviews(spark, sf_dir), anchor=ship_anchor(spark, sf_dir)
        )
    )
    return evidence.add_weight(weighted)


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as unvalidated text fields: bad dates and ratings, repeated ids."""
    docs = table(spark, sf_dir, "documents")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 731).cast("int"))
    return docs.join(quality, "doc_id", "left").select(
        F.md5("text").alias("review_id"),
        F.col("source").alias("hotel_id"),
        _house_name().alias("hotel_name"),
        _house_category().alias("hotel_category"),
        ((F.col("n_chars") % 13) / F.lit(2.0)).cast("string").alias("rating"),
        F.when(F.col("doc_id") % 29 == 0, "unknown")
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
        .alias("review_date"),
        F.col("text").alias("review_text"),
        F.when(F.col("quality") == 1, "true").when(F.col("quality") == 0, "false").alias("verified"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("traveler_type"),
        "doc_id",
    )


def _house_name():
    number = F.substring("source", 4, 10)
    return F.concat(F.lit("House "), number, F.lit(", City "), F.substring(number, -1, 1))


def _house_category():
    number = F.substring("source", 4, 10).cast("int")
    return F.concat((3 + number % 3).cast("string"), F.lit("-star"))


def document_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 731).cast("int"))
    reviews = docs.join(quality, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("source").alias("hotel_id"),
        _house_name().alias("hotel_name"),
        _house_category().alias("hotel_category"),
        (1 + F.col("n_chars") % 5).cast("int").alias("rating"),
        day.alias("review_date"),
        ingest.clean_text(F.col("text")).alias("review_text"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("verified"),
        F.col("lang").alias("traveler_type"),
    )
    newest = table(spark, sf_dir, "documents").agg(F.max(day).alias("d")).scalar()
    return ingest.add_trust(ingest.add_recency(ingest.add_calendar(reviews), anchor=newest))


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_instances(document_reviews(spark, sf_dir))


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sentence, labelled once."""
    distinct = sentences.distinct_sentences(document_sentences(spark, sf_dir))
    scorer = labels.lexicon_scorer(DOCUMENT_LEXICON)
    return labels.label_sentences(distinct, scorer, DOCUMENT_ASPECTS)


def document_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = evidence.label_in_place(
        document_sentences(spark, sf_dir),
        labels.lexicon_scorer(DOCUMENT_LEXICON),
        keys=DOCUMENT_ASPECTS,
    )
    return evidence.aspect_instances(labelled)


def document_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections for the opening sentences of documents marked toxic."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("review_id")
    )
    size = F.length("sentence_text")
    return (
        document_sentences(spark, sf_dir)
        .filter("sentence_pos = 0")
        .join(toxic, "review_id", "left_semi")
        .select("sentence_text")
        .distinct()
        .select(
            "sentence_text",
            F.when(size % 2 == 0, "service|value").otherwise(" ").alias("aspects"),
            F.when(size % 3 != 0, F.lit(-0.5)).alias("polarity"),
            F.when(size % 2 == 0, "wrong aspect").otherwise("wrong tone").alias("reason"),
        )
    )


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values per (user, type); the weekday stands in for the season."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("hotel_id"),
        F.col("event_type").alias("aspect"),
        "value",
        F.dayofweek("ts").cast("string").alias("season"),
        F.to_date("ts").alias("review_date"),
    )


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as profiles; a part with a vector of the same number has an embedded description."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("vector")
    )
    return (
        table(spark, sf_dir, "part")
        .join(vectors, "p_partkey", "left")
        .select(
            F.col("p_partkey").cast("string").alias("profile_id"),
            F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("description"),
            "vector",
        )
    )


def label_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit mean vector per label (ten of them, whatever the scale) as descriptors of aspects."""
    aspects = F.array(*[F.lit(a) for a in DOCUMENT_ASPECTS])
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("place", "x"))
        .groupBy("label", "place")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("xs"))
    )
    return means.select(
        F.element_at(aspects, (F.col("label") % len(DOCUMENT_ASPECTS) + 1).cast("int")).alias(
            "aspect"
        ),
        F.transform("xs", lambda p: p["x"]).alias("_mean"),
    ).select("aspect", F.transform("_mean", lambda x: x / norm(F.col("_mean"))).alias("vector"))

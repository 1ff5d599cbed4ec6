"""Quotes, caveats, justifications and the nested recommendation record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestsignal.config import DEFAULTS, OVERALL, Settings
from guestsignal.functions import wording
from guestsignal.functions.numbers import rounded, signed_2dp
from guestsignal.functions.taxonomy import DISPLAY_NAMES
from guestsignal.operators.evidence import scored_rows
from guestsignal.operators.ranking import INTENT, per_profile
from guestsignal.operators.scale import skew_safe_left_join
from guestsignal.operators.temporal import seasonal_caveat, shown_name, trend_caveat

# One total order everywhere: quality first, then the newest, then ids and the text.
QUOTE_ORDER = ("minus_quality", "minus_day", "review_id", "sentence_text", "aspect")


def with_quality(instances: DataFrame) -> DataFrame:
    quality = F.col("polarity") * F.col("recency_weight") * F.col("trust_weight")
    return scored_rows(instances).withColumn("quality", quality)


def best_quotes(instances: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The best distinct sentences per (hotel, aspect).

    The best k distinct sentences over any set of aspects are among the best k of each
    aspect, so this table answers every profile. Both windows are group-limited in front
    of their shuffle: a hot hotel sends k rows per map task.
    """
    usable = (
        with_quality(instances)
        .filter(F.col("polarity") > settings.quote_polarity)
        .withColumn("minus_quality", -F.round("quality", 12))
        .withColumn("minus_day", -F.unix_date("review_date"))
    )
    order = [F.col(c) for c in QUOTE_ORDER]
    per_sentence = W.partitionBy("hotel_id", "aspect", "sentence_text").orderBy(*order)
    per_aspect = W.partitionBy("hotel_id", "aspect").orderBy(*order)
    return (
        usable.withColumn("_copy", F.row_number().over(per_sentence))
        .filter("_copy = 1")
        .withColumn("place", F.row_number().over(per_aspect))
        .filter(F.col("place") <= settings.quotes)
        .drop("_copy")
    )


def of_picked_hotels(quotes: DataFrame, described: DataFrame) -> DataFrame:
    """Only the quotes of hotels somebody is recommended: a few rows a hotel, so no key is hot."""
    picked = described.select("hotel_id").distinct()
    return quotes.join(picked, "hotel_id", "left_semi")


def packed_quotes(quotes: DataFrame) -> DataFrame:
    """One row per hotel: at most (aspects in the taxonomy) x k quote structs."""
    quote = F.struct(
        *QUOTE_ORDER,
        F.date_format("review_date", "yyyy-MM-dd").alias("date"),
        "verified",
        rounded(F.col("polarity"), 3).alias("sentiment"),
    )
    return quotes.groupBy("hotel_id").agg(F.collect_list(quote).alias("quotes"))


def pick_quotes(quotes: Column, aspects: Column, settings: Settings = DEFAULTS) -> Column:
    """Of a hotel's packed quotes: on the wanted aspects, one per sentence, the best k."""
    wanted = F.array_sort(
        F.filter(quotes, lambda q: F.array_contains(aspects, q["aspect"]))
    )
    unique = F.filter(
        wanted,
        lambda q, i: ~F.exists(
            F.slice(wanted, F.lit(1), i), lambda e: e["sentence_text"] == q["sentence_text"]
        ),
    )
    return F.transform(
        F.slice(unique, 1, settings.quotes),
        lambda q: F.struct(
            q["review_id"].alias("review_id"),
            q["sentence_text"].alias("quote"),
            q["aspect"].alias("aspect"),
            q["date"].alias("date"),
            q["verified"].alias("verified"),
            q["sentiment"].alias("sentiment"),
        ),
    )


def packed_contradictions(contradictions: DataFrame) -> DataFrame:
    """One row per hotel with its contested aspects (at most one entry per aspect)."""
    entry = F.struct((-F.col("disagreement")).alias("minus"), "aspect", "resolution")
    return contradictions.groupBy("hotel_id").agg(F.collect_list(entry).alias("contested"))


def contradiction_caveat(
    contested: Column, aspects: Column, names: dict[str, str] = DISPLAY_NAMES
) -> Column:
    """Names the most contested of the wanted aspects, with its explanation if there is one."""
    worst = F.array_min(
        F.filter(contested, lambda c: F.array_contains(aspects, c["aspect"]))
    )
    explained = F.when(
        F.trim(worst["resolution"]) != "", F.concat(F.lit(" "), worst["resolution"])
    )
    split = F.format_string(wording.SPLIT_CAVEAT, F.lower(shown_name(worst["aspect"], names)))
    return F.when(worst.isNotNull(), F.concat(split, F.coalesce(explained, F.lit(""))))


def packed_drift(drift: DataFrame, names: dict[str, str] = DISPLAY_NAMES) -> DataFrame:
    """One row per hotel with the season and trend caveats of its aspects, at most two for each."""
    notes = F.array_compact(F.array(seasonal_caveat(names), trend_caveat(names)))
    entry = F.struct("aspect", F.array_join(notes, " ").alias("note"))
    noted = drift.filter(F.size(notes) > 0)
    return noted.groupBy("hotel_id").agg(F.sort_array(F.collect_list(entry)).alias("drifting"))


def drift_caveat(drifting: Column, aspects: Column) -> Column:
    """The notes on the wanted aspects and on the rating as a whole, null if there are none."""
    about = F.filter(
        drifting, lambda d: F.array_contains(aspects, d["aspect"]) | (d["aspect"] == OVERALL)
    )
    return F.when(F.size(about) > 0, F.array_join(F.transform(about, lambda d: d["note"]), " "))


def matched_aspects(contributions: Column, settings: Settings = DEFAULTS) -> Column:
    strong = F.filter(contributions, lambda c: c["score"] > settings.matched_cut)
    return F.transform(strong, lambda c: c["aspect"])


def justification(
    hotel_name: Column,
    rank: Column,
    contributions: Column,
    first_quote: Column,
    names: dict[str, str] = DISPLAY_NAMES,
    settings: Settings = DEFAULTS,
) -> Column:
    strong = F.slice(
        F.filter(contributions, lambda c: c["score"] > settings.matched_cut), 1, 3
    )
    strengths = F.array_join(
        F.transform(
            strong,
            lambda c: F.concat(
                F.lower(shown_name(c["aspect"], names)),
                F.lit(" ("),
                signed_2dp(c["score"]),
                F.lit(")"),
            ),
        ),
        ", ",
    )
    place = F.format_string(wording.RANK_PLACE, hotel_name, rank.cast("string"))
    core = F.when(
        F.size(strong) > 0, F.format_string(wording.RANK_REASONS, place, strengths)
    ).otherwise(F.format_string(wording.RANK_ALL_ROUND, place))
    quoted = F.format_string(wording.QUOTED, core, F.coalesce(first_quote, F.lit("")))
    return F.when(hotel_name.isNotNull() & rank.isNotNull(), quoted)


def guard_text(
    candidate: Column,
    hotel_name: Column,
    category: Column,
    quotes: Column,
    template: Column,
    settings: Settings = DEFAULTS,
) -> Column:
    """A generated text is kept only if it sticks to the facts; otherwise the template is.

    Kept: not empty, at most 600 characters, names the hotel (first word of its name),
    and has no number that is not in the category or a quote. An echoed label in front
    is cut off after these checks.
    """
    numbers = lambda text: F.regexp_extract_all(text, F.lit(r"(\d+)"))
    allowed = F.concat(numbers(category), F.flatten(F.transform(quotes, numbers)))
    first_word = F.split(F.trim(F.split(hotel_name, ",").getItem(0)), r"\s+").getItem(0)
    keeps_to_facts = (
        (F.length(candidate) > 0)
        & (F.length(candidate) <= settings.max_generated)
        & F.contains(F.lower(candidate), F.lower(first_word))
        & (F.size(F.array_except(numbers(candidate), allowed)) == 0)
    )
    stripped = F.trim(F.regexp_replace(candidate, r"(?i)^(polished|answer)\s*:\s*", ""))
    return F.when(keeps_to_facts, stripped).otherwise(template)


def explained_picks(
    described: DataFrame,
    quotes: DataFrame,
    contradictions: DataFrame,
    names: dict[str, str] = DISPLAY_NAMES,
    settings: Settings = DEFAULTS,
    drift: DataFrame | None = None,
) -> DataFrame:
    """Described picks with evidence, caveat and justification; picks without evidence go,
    the others keep their rank. Quotes and contested aspects meet a pick in one join; with `drift`,
    its caveats follow."""
    dims = F.transform("dim_weights", lambda d: d["aspect"])
    facts = packed_quotes(quotes).join(
        packed_contradictions(contradictions), "hotel_id", "left"
    )
    if drift is None:
        facts = facts.withColumn("drifting", F.lit(None).cast("array<struct<aspect:string,note:string>>"))
    else:
        facts = facts.join(packed_drift(drift, names), "hotel_id", "left")
    joined = skew_safe_left_join(described, facts, "hotel_id", "intent")
    return (
        joined.withColumn("supporting_evidence", pick_quotes(F.col("quotes"), dims, settings))
        .filter(F.size("supporting_evidence") > 0)
        .withColumn("_split", contradiction_caveat(F.col("contested"), dims, names))
        .withColumn("_drift", drift_caveat(F.col("drifting"), dims))
        .withColumn(
            "caveats",
            F.when(
                F.col("_split").isNotNull() | F.col("_drift").isNotNull(),
                F.concat_ws(" ", "_split", "_drift"),
            ),
        )
        .withColumn("matched_aspects", matched_aspects(F.col("contributions"), settings))
        .withColumn(
            "justification",
            justification(
                F.col("hotel_name"),
                F.col("rank"),
                F.col("contributions"),
                F.col("supporting_evidence")[0]["quote"],
                names,
                settings,
            ),
        )
        .drop("quotes", "contested", "drifting", "_split", "_drift")
    )


def use_generated_text(explained: DataFrame, texts: DataFrame) -> DataFrame:
    """Optional wording from outside: `texts` (intent, hotel_id, candidate) replaces a
    justification where the guard lets it through."""
    guarded = guard_text(
        F.col("candidate"),
        F.col("hotel_name"),
        F.col("hotel_category"),
        F.transform("supporting_evidence", lambda e: e["quote"]),
        F.col("justification"),
    )
    return (
        explained.join(texts, ["intent", "hotel_id"], "left")
        .withColumn("justification", F.coalesce(guarded, F.col("justification")))
        .drop("candidate")
    )


def rich_output(profiles: DataFrame, explained: DataFrame) -> DataFrame:
    """One nested record per profile that has at least one explained pick."""
    recommendation = F.struct(
        "rank",
        "hotel_id",
        "hotel_name",
        "hotel_category",
        F.col("display_score").alias("score"),
        "matched_aspects",
        F.map_from_entries(
            F.transform("contributions", lambda c: F.struct(c["aspect"], c["score"]))
        ).alias("aspect_scores"),
        "justification",
        "supporting_evidence",
        "caveats",
    )
    # A struct with a map cannot be sorted directly; the rank in front of it can.
    packed = (
        explained.groupBy("intent")
        .agg(
            F.collect_list(
                F.struct(F.col("rank").alias("place"), recommendation.alias("item"))
            ).alias("_items")
        )
        .select(
            "intent",
            F.transform(
                F.array_sort(
                    "_items", lambda a, b: a["place"].cast("int") - b["place"].cast("int")
                ),
                lambda i: i["item"],
            ).alias("recommendations"),
        )
    )
    return (
        per_profile(
            profiles.select("profile_id", "archetype", "profile_summary", *INTENT), packed
        )
        .filter(F.col("recommendations").isNotNull())
        .select(
            "profile_id",
            "archetype",
            "profile_summary",
            F.transform("dim_weights", lambda d: d["aspect"]).alias("desired_dims"),
            "recommendations",
        )
    )

"""Free-text traveler descriptions -> weighted dimensions, type, budget, archetype.

One projection over the profile table: rules, lookups and the descriptor bank are bounded
by the taxonomy, so they live inside expressions instead of joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, Settings
from guestsignal.functions import wording
from guestsignal.functions.numbers import rounded
from guestsignal.functions.taxonomy import (
    DEFAULT_RULES,
    DISPLAY_NAMES,
    MAX_ARCHETYPE_PARTS,
    ProfileRules,
)
from guestsignal.functions.text import capitalised
from guestsignal.functions.vectors import dot
from guestsignal.operators.scale import materialise, skew_safe_left_join
from guestsignal.operators.search import embed_sentences
from guestsignal.operators.temporal import shown_name



def no_vector() -> Column:
    return F.lit(None).cast("array<float>")


def rule_dims(
    text: Column, rules: ProfileRules = DEFAULT_RULES, settings: Settings = DEFAULTS
) -> Column:
    """array<struct<aspect, weight, place>> of the rules that hit; place is the rule order."""
    lowered = F.lower(text)
    entries = []
    for place, (aspect, pattern) in enumerate(rules.dimensions.items()):
        hits = F.regexp_count(lowered, F.lit(pattern))
        weight = 1.0 + settings.repeat_bonus * (hits - 1)
        entry = F.struct(
            F.lit(aspect).alias("aspect"), weight.alias("weight"), F.lit(place).alias("place")
        )
        entries.append(F.when(hits > 0, entry))
    return F.array_compact(F.array(*entries))


def first_match(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    lowered = F.lower(text)
    matched = [F.when(F.regexp_like(lowered, F.lit(pattern)), label) for label, pattern in rules]
    return F.coalesce(*matched, F.lit(default))


def descriptor_bank(descriptors: DataFrame) -> Column:
    """All descriptor vectors as one scalar subquery; make it a column before using it.

    `descriptors` (aspect, vector) is a part of the taxonomy: a handful of phrases for
    each of its aspects, whatever the number of profiles.
    """
    entry = F.struct("aspect", F.col("vector").alias("vector"))
    return descriptors.agg(F.collect_list(entry).alias("bank")).scalar()


def descriptor_similarity(vector: Column, bank: Column, aspects: tuple[str, ...]) -> Column:
    """array<struct<aspect, similarity>>: best cosine per aspect, unit vectors assumed."""
    scored = F.transform(
        bank, lambda d: F.struct(d["aspect"].alias("aspect"), dot(d["vector"], vector).alias("sim"))
    )
    best = lambda aspect: F.array_max(
        F.transform(F.filter(scored, lambda s: s["aspect"] == aspect), lambda s: s["sim"])
    )
    return F.array(
        *[F.struct(F.lit(a).alias("aspect"), best(a).alias("similarity")) for a in aspects]
    )


def backstop_dims(
    dims: Column, similarities: Column, settings: Settings = DEFAULTS
) -> Column:
    """Where the rules found too little, add max(rule, 0.6 * similarity) of close aspects."""
    close = F.filter(
        similarities, lambda s: s["similarity"] >= settings.backstop_similarity
    )
    factor = settings.backstop_factor
    by_rule = F.map_from_entries(
        F.transform(dims, lambda d: F.struct(d["aspect"], d["weight"]))
    )
    by_text = F.map_from_entries(
        F.transform(close, lambda s: F.struct(s["aspect"], s["similarity"] * factor))
    )
    raised = F.transform(
        dims,
        lambda d: F.struct(
            d["aspect"].alias("aspect"),
            F.greatest(d["weight"], F.try_element_at(by_text, d["aspect"])).alias("weight"),
            d["place"].alias("place"),
        ),
    )
    new = F.filter(close, lambda s: F.try_element_at(by_rule, s["aspect"]).isNull())
    added = F.transform(
        new,
        lambda s, i: F.struct(
            s["aspect"].alias("aspect"),
            (s["similarity"] * factor).alias("weight"),
            (i + 1000).cast("int").alias("place"),
        ),
    )
    return F.when(F.size(dims) < settings.min_rule_dims, F.concat(raised, added)).otherwise(dims)


def top_dims(dims: Column, settings: Settings = DEFAULTS) -> Column:
    """array<struct<aspect, weight>>: the heaviest first (then rule order), weights sum to 1."""
    keyed = F.transform(
        F.filter(dims, lambda d: d["weight"] > 0),
        lambda d: F.struct((-d["weight"]).alias("w"), d["place"], d["aspect"].alias("aspect")),
    )
    kept = F.slice(F.array_sort(keyed), 1, settings.max_dims)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, d: acc - d["w"])
    return F.transform(
        kept,
        lambda d: F.struct(
            d["aspect"].alias("aspect"), rounded(-d["w"] / total, 4).alias("weight")
        ),
    )


def category_fit(budget: Column, rules: ProfileRules = DEFAULT_RULES) -> Column:
    """map<category, fit> of a budget band."""
    fit = None
    for band, values in rules.category_fit.items():
        entry = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        fit = F.when(budget == band, entry) if fit is None else fit.when(budget == band, entry)
    return fit


def archetype(
    traveler_type: Column, dims: Column, text: Column, rules: ProfileRules = DEFAULT_RULES
) -> Column:
    """`type[_female][_theme...]`, at most three parts and no part twice.

    The walk over the dims stops as soon as three parts are there, so a dimension
    without a theme never pushes a later theme out.
    """
    female = (traveler_type == rules.female_traveler) & F.regexp_like(
        text, F.lit(rules.female_pattern)
    )
    head = F.when(female, F.array(traveler_type, F.lit("female"))).otherwise(
        F.array(traveler_type)
    )
    themes = F.create_map(*[F.lit(x) for pair in rules.themes.items() for x in pair])
    named = F.transform(dims, lambda d: F.try_element_at(themes, d["aspect"]))
    parts = F.array_distinct(F.concat(head, F.array_compact(named)))
    return F.array_join(F.slice(parts, 1, MAX_ARCHETYPE_PARTS), "_")


def profile_summary(
    traveler_type: Column,
    budget: Column,
    dims: Column,
    names: dict[str, str] = DISPLAY_NAMES,
) -> Column:
    shown = F.transform(
        F.slice(dims, 1, 3), lambda d: F.lower(shown_name(d["aspect"], names))
    )
    return F.format_string(
        wording.PROFILE_SUMMARY,
        capitalised(traveler_type),
        F.replace(budget, F.lit("_"), F.lit("-")),
        F.array_join(shown, ", "),
    )


def with_vectors(
    profiles: DataFrame,
    load: Callable[[], Callable],
    rules: ProfileRules = DEFAULT_RULES,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """`vector` of the descriptions that need one: those the rules find too little in and that came
    without. Equal descriptions are encoded once."""
    given = profiles if "vector" in profiles.columns else profiles.withColumn("vector", no_vector())
    thin = F.size(rule_dims(F.col("description"), rules, settings)) < settings.min_rule_dims
    asked = given.filter(thin & F.col("vector").isNull()).select(
        F.col("description").alias("sentence_text")
    )
    made = embed_sentences(asked.distinct(), load).select(
        F.col("sentence_text").alias("description"), F.col("embedding").alias("_made")
    )
    met = skew_safe_left_join(given, materialise(made, "vectors"), "description", "profile_id")
    return met.withColumn("vector", F.coalesce("vector", "_made")).drop("_made")


def embedded_descriptors(phrases: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """(aspect, vector) of descriptor phrases (aspect, phrase): a few for each aspect."""
    asked = phrases.select(F.col("phrase").alias("sentence_text")).distinct()
    made = embed_sentences(asked, load).withColumnRenamed("sentence_text", "phrase")
    return materialise(phrases.join(made, "phrase"), "descriptors").select(
        "aspect", F.col("embedding").alias("vector")
    )


def enrich_profiles(
    profiles: DataFrame,
    rules: ProfileRules = DEFAULT_RULES,
    descriptors: DataFrame | None = None,
    names: dict[str, str] = DISPLAY_NAMES,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """profile_id, description -> structured intent. With descriptors, a profile's `vector`
    helps where the rules find too little; without one it is left to the rules."""
    text = F.col("description")
    if "vector" not in profiles.columns:
        profiles = profiles.withColumn("vector", no_vector())
    staged = profiles.withColumn("_rules", rule_dims(text, rules, settings))
    no_extra = F.array().cast("array<struct<aspect:string,similarity:double>>")
    if descriptors is None:
        staged = staged.withColumn("_close", no_extra)
    else:
        aspects = tuple(rules.dimensions)
        staged = staged.withColumn("_bank", descriptor_bank(descriptors))
        similar = descriptor_similarity(F.col("vector"), F.col("_bank"), aspects)
        needed = F.size("_rules") < settings.min_rule_dims
        staged = staged.withColumn(
            "_close",
            F.when(
                needed & F.col("vector").isNotNull(),
                F.filter(similar, lambda s: s["similarity"] >= settings.backstop_similarity),
            ).otherwise(no_extra),
        )
    return (
        staged.withColumn("_dims", backstop_dims(F.col("_rules"), F.col("_close"), settings))
        .withColumn("dim_weights", top_dims(F.col("_dims"), settings))
        .withColumn("traveler_type", first_match(text, rules.travelers, rules.default_traveler))
        .withColumn("budget", first_match(text, rules.budgets, rules.default_budget))
        .select(
            "profile_id",
            "description",
            "traveler_type",
            "budget",
            F.transform("dim_weights", lambda d: d["aspect"]).alias("desired_dims"),
            "dim_weights",
            category_fit(F.col("budget"), rules).alias("category_fit"),
            archetype(F.col("traveler_type"), F.col("dim_weights"), text, rules).alias("archetype"),
            profile_summary(
                F.col("traveler_type"), F.col("budget"), F.col("dim_weights"), names
            ).alias("profile_summary"),
            F.transform("_rules", lambda d: d["aspect"]).alias("rule_dims"),
            F.transform("_close", lambda d: d["aspect"]).alias("embedding_dims"),
        )
    )

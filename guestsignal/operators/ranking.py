"""Top hotels for every profile at once.

Profiles with the same traveler type, budget and weights are one intent and are ranked
once. Scores of all hotels for all intents are never rows: a task takes a block of
hotels and a block of intents, multiplies two small matrices and returns the best few
hotels of each intent.

Intents are grouped by traveler type and heaviest dimension. A hotel goes to the groups whose evidence
floor it reaches, sorted into blocks by its score in that dimension. All intents meet their
group's first block; what they find there and each further block's bounds (best score per aspect, least
penalty, best rating and category terms) prove most other blocks useless to them, and only the others are met.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestsignal.config import DEFAULTS, DRIFT_PENALTY, Settings
from guestsignal.functions.numbers import rounded
from guestsignal.functions.taxonomy import ASPECT_KEYS, CATEGORY_FIT
from guestsignal.operators.scale import (
    keyed_bucket,
    materialise,
    skew_safe_left_join,
    value_ranges,
)

# A block of hotels has about so many, or this share of all hotel rows if that is more.
HOTELS_PER_BLOCK = 1_024
BLOCK_SHARE = 0.0001
INTENTS_PER_BLOCK = 8_192
NO_TOP_DIM = -1
_CHUNK = 256
# What sums of floats may be off by; bounds are raised by it.
_SLACK = 1e-9

INTENT = ("traveler_type", "budget", "dim_weights")
GROUP = ["traveler_type", "top_dim"]
BLOCK = [*GROUP, "block"]


def intent_key() -> Column:
    return F.to_json(F.struct(*INTENT))


def intents(profiles: DataFrame) -> DataFrame:
    return profiles.select(intent_key().alias("intent"), *INTENT).dropDuplicates(["intent"])


def penalty_rows(drift: DataFrame) -> DataFrame:
    """(hotel, aspect, penalty) of confidently declining aspects."""
    amount = None
    for tier, value in DRIFT_PENALTY.items():
        hit = F.col("trend_tier") == tier
        amount = F.when(hit, value) if amount is None else amount.when(hit, value)
    return (
        drift.filter(F.col("trend_dir") == "declining")
        .select("hotel_id", "aspect", amount.alias("penalty"))
        .filter(F.col("penalty").isNotNull())
    )


def hotel_cards(
    conditioned: DataFrame,
    hotels: DataFrame,
    drift: DataFrame | None,
    segments: tuple[str, ...],
    aspects: tuple[str, ...] = ASPECT_KEYS,
) -> DataFrame:
    """One row per (hotel, traveler type) with score, evidence and penalty arrays in the
    order of `aspects`; null where a hotel has no such aspect."""
    pick = lambda c: F.array(
        *[F.max(F.when(F.col("aspect") == a, F.col(c)).cast("double")) for a in aspects]
    )
    scores = conditioned.groupBy("hotel_id", "traveler_type").agg(
        pick("score").alias("scores"), pick("evidence_weight").alias("evidence")
    )
    base = hotels.select(
        "hotel_id",
        "hotel_name",
        "hotel_category",
        "rating_norm",
        F.explode(F.array(*[F.lit(s) for s in segments])).alias("traveler_type"),
    )
    cards = base.join(scores, ["hotel_id", "traveler_type"], "left")
    if drift is None:
        return cards.withColumn("penalties", F.lit(None).cast("array<double>"))
    penalties = penalty_rows(drift).groupBy("hotel_id").agg(pick("penalty").alias("penalties"))
    return cards.join(penalties, "hotel_id", "left")


def _matrix(column: pd.Series, width: int, fill: float) -> np.ndarray:
    empty = np.full(width, fill)
    rows = np.vstack([empty, *[empty if row is None else row for row in column]])[1:]
    return np.where(np.isnan(rows), fill, rows)


def _half_up_units(value: np.ndarray) -> np.ndarray:
    """Composite in units of 1e-4, half away from zero on eight decimals."""
    small = np.rint(np.abs(value) * 1e8).astype(np.int64)
    return (np.sign(value) * ((small + 5_000) // 10_000)).astype(np.int64)


def asked_intents(wanted: DataFrame, aspects: tuple[str, ...] = ASPECT_KEYS) -> DataFrame:
    """Intents with their weights in the order of `aspects`, the place of the heaviest dimension and a bucket
    of about INTENTS_PER_BLOCK intents of the group. One whose heaviest dimension nobody writes
    about is left out; one without dimensions is open to every hotel."""
    weight_of = lambda a: F.aggregate(
        F.col("dim_weights"),
        F.lit(0.0),
        lambda acc, d: acc + F.when(d["aspect"] == a, d["weight"]).otherwise(0.0),
    )
    first = F.try_element_at("dim_weights", F.lit(1))["aspect"]
    known = F.array_position(F.array(*[F.lit(a) for a in aspects]), first) - 1
    rows = wanted.select(
        "traveler_type",
        F.when(first.isNull(), NO_TOP_DIM).when(known >= 0, known).cast("int").alias("top_dim"),
        "intent",
        "budget",
        F.array(*[weight_of(a) for a in aspects]).alias("weights"),
    ).filter(F.col("top_dim").isNotNull())
    # one row for each traveler type and aspect
    buckets = rows.groupBy(*GROUP).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(INTENTS_PER_BLOCK)).cast("int").alias("_buckets")
    )
    return (
        rows.join(F.broadcast(buckets), GROUP)
        .withColumn("bucket", keyed_bucket(F.col("intent"), F.col("_buckets")))
        .drop("_buckets")
    )


def blocked_hotels(
    cards: DataFrame,
    asked: DataFrame,
    aspects: tuple[str, ...] = ASPECT_KEYS,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """A hotel once for each group of intents that may see it, with the block it is in; block 0
    has the best in the group's dimension."""
    enough = [
        F.when(F.get("evidence", F.lit(i)) >= settings.min_evidence, F.lit(i))
        for i in range(len(aspects))
    ]
    at_top = lambda c: F.coalesce(F.get(c, F.greatest("top_dim", F.lit(0))), F.lit(0.0))
    strength = settings.rating_weight * F.col("rating_norm") + F.when(
        F.col("top_dim") >= 0, at_top("scores") - at_top("penalties")
    ).otherwise(0.0)
    rows = (
        cards.withColumn("top_dim", F.explode(F.array_compact(F.array(F.lit(NO_TOP_DIM), *enough))))
        .join(F.broadcast(asked.select(*GROUP).distinct()), GROUP, "left_semi")
        .select(
            *GROUP,
            "hotel_id",
            "hotel_category",
            "rating_norm",
            "scores",
            "penalties",
            F.struct((-strength).alias("minus"), "hotel_id").alias("_order"),
        )
    )
    placed = value_ranges(
        materialise(rows, "hotels"), GROUP, "_order", "block", BLOCK_SHARE, HOTELS_PER_BLOCK
    )
    return placed.drop("_order")


def block_bounds(
    hotels: DataFrame,
    aspects: tuple[str, ...] = ASPECT_KEYS,
    fits: dict[str, dict[str, float]] = CATEGORY_FIT,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Per block what no hotel in it exceeds: best score and least penalty per aspect, and the
    rating and category terms per budget (in the order of `fits`, then without a budget)."""
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    rating = settings.rating_weight * F.col("rating_norm")
    fit_of = lambda fit: F.coalesce(
        *[F.when(F.col("hotel_category") == c, F.lit(v)) for c, v in fit.items()], F.lit(0.0)
    )
    bases = [rating + settings.category_weight * fit_of(fit) for fit in fits.values()]
    return hotels.groupBy(*BLOCK).agg(
        F.array(*[F.max(at("scores", i)) for i in range(len(aspects))]).alias("best"),
        F.array(*[F.min(at("penalties", i)) for i in range(len(aspects))]).alias("least"),
        F.array(*[F.max(base) for base in [*bases, rating]]).alias("bases"),
        F.count(F.lit(1)).alias("n_hotels"),
    )


def _base_terms(
    cards: pd.DataFrame,
    fits: dict[str, dict[str, float]],
    rating_weight: float,
    category_weight: float,
) -> dict[str | None, np.ndarray]:
    """Per budget, what a hotel gets whatever the dimensions; None is a budget without fit."""
    rating = rating_weight * cards["rating_norm"].to_numpy(float)
    category = cards["hotel_category"].to_numpy()
    terms = {
        budget: rating + category_weight * np.array([fit.get(c, 0.0) for c in category])
        for budget, fit in fits.items()
    }
    return {None: rating, **terms}


def _rank_block(
    cards: pd.DataFrame,
    wanted: pd.DataFrame,
    width: int,
    by_budget: dict[str | None, np.ndarray],
    top_n: int,
) -> pd.DataFrame:
    """Best hotels of one hotel block for each intent of one intent block."""
    scores = _matrix(cards["scores"], width, 0.0)
    penalties = _matrix(cards["penalties"], width, 0.0)
    ids = cards["hotel_id"].to_numpy()
    # Ties go to the smaller id.
    places = np.empty(len(ids), dtype=np.int64)
    places[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    best, found = min(top_n, len(ids)), []
    for start in range(0, len(wanted) if best else 0, _CHUNK):
        chunk = wanted.iloc[start : start + _CHUNK]
        weights = _matrix(chunk["weights"], width, 0.0)
        base = np.stack([by_budget.get(b, by_budget[None]) for b in chunk["budget"]], axis=1)
        composite = scores @ weights.T + base - penalties @ (weights > 0).T.astype(float)
        units = _half_up_units(composite)
        rows = np.argpartition(places[:, None] - units * len(ids), best - 1, axis=0)[:best]
        columns = np.broadcast_to(np.arange(len(chunk)), rows.shape)
        found.append(
            pd.DataFrame(
                {
                    "intent": chunk["intent"].to_numpy()[columns.ravel()],
                    "hotel_id": ids[rows.ravel()],
                    "composite": units[rows, columns].ravel() / 1e4,
                    "exact": composite[rows, columns].ravel(),
                }
            )
        )
    return pd.concat(found) if found else pd.DataFrame(columns=["intent", "hotel_id", "composite", "exact"])


def _open_blocks(
    bounds: pd.DataFrame, asked: pd.DataFrame, width: int, budgets: list[str], top_n: int
) -> pd.DataFrame:
    """(block, intent) pairs that the bounds do not rule out. `floor` is the composite of an
    intent's last place so far; a block that can only reach less is of no use to it, and one that can
    reach the same may hold a smaller id."""
    bases = np.vstack([np.zeros(len(budgets) + 1), *bounds["bases"]])[1:]
    best, least = (_matrix(bounds[c], width, 0.0) for c in ("best", "least"))
    place = {budget: i for i, budget in enumerate(budgets)}
    found = []
    for start in range(0, len(asked) if len(bounds) else 0, _CHUNK):
        chunk = asked.iloc[start : start + _CHUNK]
        weights = _matrix(chunk["weights"], width, 0.0)
        base = bases[:, [place.get(b, len(budgets)) for b in chunk["budget"]]].T
        reach = weights @ best.T + base - (weights > 0).astype(float) @ least.T + _SLACK
        floor = np.rint(chunk["floor"].fillna(-np.inf).to_numpy() * 1e4)
        rows, columns = np.nonzero(_half_up_units(reach) >= floor[:, None])
        opened = chunk[["intent", "budget", "weights"]].iloc[rows].reset_index(drop=True)
        found.append(opened.assign(block=bounds["block"].to_numpy()[columns]))
    return pd.concat(found) if found else pd.DataFrame(columns=["intent", "budget", "weights", "block"])


FOUND = "intent string, hotel_id string, composite double, exact double"
ASKED = "traveler_type string, top_dim int, bucket int, intent string, budget string, weights array<double>"


def _renewed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns under fresh identities, for a cogroup of a table with one derived from it."""
    return df.select(*[F.col(c).alias(c) for c in columns])


def _best_of(best: DataFrame, top_n: int) -> DataFrame:
    order_by = W.partitionBy("intent").orderBy(F.col("composite").desc(), F.col("hotel_id"))
    return best.withColumn("rank", F.row_number().over(order_by)).filter(F.col("rank") <= top_n)


def rank_in_blocks(
    wanted: DataFrame,
    cards: DataFrame,
    aspects: tuple[str, ...] = ASPECT_KEYS,
    fits: dict[str, dict[str, float]] = CATEGORY_FIT,
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """The top hotels of each intent (intent, hotel_id, composite, exact, rank), and the work:
    per group the (intent, block) pairs there are and those that were not ruled out.

    A group of the cogroups is one block of hotels and one bucket of intents; a hotel block is copied
    once for each bucket that needs it. Intents, blocks and first results are stored, as
    each is read several times.
    """
    width, top_n, budgets = len(aspects), settings.top_n, list(fits)
    rating_weight, category_weight = settings.rating_weight, settings.category_weight

    def rank_block(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        by_budget = _base_terms(block, fits, rating_weight, category_weight)
        return _rank_block(block, asked, width, by_budget, top_n)

    def open_blocks(bounds: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        opened = _open_blocks(bounds, asked, width, budgets, top_n)
        group = {c: asked[c].iloc[0] if len(asked) else None for c in (*GROUP, "bucket")}
        return opened.assign(**group)[[*group, "intent", "budget", "weights", "block"]]

    def ranked(hotels: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
        needed = _renewed(asked, [*keys, "bucket"]).distinct()
        pairs = hotels.join(needed, keys).groupBy(*keys, "bucket").cogroup(asked.groupBy(*keys, "bucket"))
        return pairs.applyInPandas(rank_block, FOUND)

    asked = materialise(asked_intents(wanted, aspects), "intents")
    hotels = materialise(blocked_hotels(cards, asked, aspects, settings), "blocks")
    first = materialise(
        _best_of(ranked(hotels.filter("block = 0"), asked, GROUP), top_n), "first"
    )
    floors = first.filter(F.col("rank") == top_n).select("intent", F.col("composite").alias("floor"))
    bounds = block_bounds(hotels.filter("block > 0"), aspects, fits, settings)
    buckets = _renewed(asked, [*GROUP, "bucket"]).distinct()
    opened = materialise(
        bounds.join(buckets, GROUP)
        .groupBy(*GROUP, "bucket")
        .cogroup(asked.join(floors, "intent", "left").groupBy(*GROUP, "bucket"))
        .applyInPandas(open_blocks, f"{ASKED}, block int"),
        "opened",
    )
    rest = ranked(hotels.filter("block > 0"), opened, BLOCK)
    best = _best_of(first.drop("rank").unionByName(rest), top_n)
    n = F.count(F.lit(1))
    work = (
        asked.groupBy(*GROUP).agg(n.alias("n_intents"))
        .join(hotels.groupBy(*GROUP).agg(F.count_distinct("block").alias("n_blocks")), GROUP)
        .join(opened.groupBy(*GROUP).agg(n.alias("_opened")), GROUP, "left")
        .select(
            *GROUP,
            "n_intents",
            "n_blocks",
            (F.col("n_intents") * F.col("n_blocks")).alias("n_pairs"),
            (F.col("n_intents") + F.coalesce("_opened", F.lit(0))).alias("n_met"),
        )
    )
    return best, work


def describe_picks(
    picks: DataFrame,
    wanted: DataFrame,
    cards: DataFrame,
    aspects: tuple[str, ...] = ASPECT_KEYS,
) -> DataFrame:
    """Names, display score, per-dimension contributions and penalty of the picked hotels."""
    place = F.create_map(*[x for i, a in enumerate(aspects) for x in (F.lit(a), F.lit(i + 1))])
    at = lambda array, aspect: F.coalesce(
        F.try_element_at(F.col(array), F.try_element_at(place, aspect)), F.lit(0.0)
    )
    dims = F.col("dim_weights")
    shown = cards.select(
        "hotel_id", "traveler_type", "hotel_name", "hotel_category", "scores", "penalties"
    )
    # a hotel may be among the picks of every intent
    joined = skew_safe_left_join(
        materialise(picks.join(wanted, "intent"), "picks"),
        shown,
        ["hotel_id", "traveler_type"],
        ["intent", "rank"],
    )
    return (
        joined.select(
            "intent",
            *INTENT,
            "rank",
            "hotel_id",
            "hotel_name",
            "hotel_category",
            "composite",
            display_score(F.col("exact")).alias("display_score"),
            F.transform(
                dims,
                lambda d: F.struct(
                    d["aspect"].alias("aspect"), at("scores", d["aspect"]).alias("score")
                ),
            ).alias("contributions"),
            rounded(
                F.aggregate(
                    dims, F.lit(0.0), lambda acc, d: acc + at("penalties", d["aspect"])
                ),
                4,
            ).alias("drift_penalty"),
        )
    )


def display_score(composite: Column) -> Column:
    return rounded((composite + 1.0) * 2.5, 3)


def rank_all(
    profiles: DataFrame,
    conditioned: DataFrame,
    hotels: DataFrame,
    drift: DataFrame | None,
    segments: tuple[str, ...],
    aspects: tuple[str, ...] = ASPECT_KEYS,
    fits: dict[str, dict[str, float]] = CATEGORY_FIT,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Described picks per intent: top_n rows for each.

    Intents, cards and the result are stored: each is read more than once.
    """
    wanted = materialise(intents(profiles), "wanted")
    cards = materialise(hotel_cards(conditioned, hotels, drift, segments, aspects), "cards")
    picks, _ = rank_in_blocks(wanted, cards, aspects, fits, settings)
    return materialise(describe_picks(picks, wanted, cards, aspects), "described")


def per_profile(profiles: DataFrame, packed: DataFrame) -> DataFrame:
    """Join one row per intent back to its profiles; a very common intent is no hot key."""
    keyed = profiles.withColumn("intent", intent_key())
    return skew_safe_left_join(keyed, packed, "intent", "profile_id")


def ranked_profiles(profiles: DataFrame, described: DataFrame) -> DataFrame:
    """(profile_id, rank, hotel...) for every profile."""
    fields = [c for c in described.columns if c not in ("intent", *INTENT)]
    packed = described.groupBy("intent").agg(
        F.collect_list(F.struct(*fields)).alias("picks")
    )
    return per_profile(profiles.select("profile_id", *INTENT), packed).select(
        "profile_id", *INTENT, F.inline("picks")
    )


# --- the single steps, on long tables -------------------------------------------------


def eligible_hotels(
    conditioned: DataFrame, wanted: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """(hotel, traveler type, aspect) cells with enough boosted evidence that some intent
    has as its heaviest dimension."""
    needed = wanted.select(
        "traveler_type", F.try_element_at("dim_weights", F.lit(1))["aspect"].alias("aspect")
    ).distinct()
    return conditioned.filter(
        F.col("evidence_weight") >= settings.min_evidence
    ).join(needed, ["traveler_type", "aspect"], "left_semi")


def aspect_pivot(
    conditioned: DataFrame, value: str, aspects: tuple[str, ...] = ASPECT_KEYS
) -> DataFrame:
    columns = [
        F.max(F.when(F.col("aspect") == a, F.col(value))).alias(f"{value}_{a}") for a in aspects
    ]
    return conditioned.groupBy("hotel_id", "traveler_type").agg(*columns)

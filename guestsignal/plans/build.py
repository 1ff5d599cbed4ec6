"""The batch build: raw reviews and profiles to artifact tables and recommendations.

Each table that several later steps read is written once and read back. That is the
only materialisation: a lost executor costs the tasks of one stage, and every consumer
scans just the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, Settings
from guestsignal.functions.taxonomy import (
    ASPECT_KEYS,
    DEFAULT_LEXICON,
    DEFAULT_RULES,
    DISPLAY_NAMES,
    ProfileRules,
)
from guestsignal.operators import contradictions as contra
from guestsignal.operators import evidence, explain, ingest, labels, profiles as people
from guestsignal.operators import ranking, reports, scoring, search, sentences, temporal
from guestsignal.sources import files


def segments_of(rules: ProfileRules) -> tuple[str, ...]:
    """The traveler types a profile can get: what scores have to be conditioned on."""
    return (*[name for name, _ in rules.travelers], rules.default_traveler)


def recommend(
    profiles: DataFrame,
    tables: dict[str, DataFrame],
    rules: ProfileRules = DEFAULT_RULES,
    aspects: tuple[str, ...] = ASPECT_KEYS,
    names: dict[str, str] = DISPLAY_NAMES,
    settings: Settings = DEFAULTS,
    drift_caveats: bool = False,
) -> DataFrame:
    """Enriched profiles + artifact tables -> nested recommendations."""
    segments = segments_of(rules)
    conditioned = scoring.conditioned_scores(
        tables["segment_sums"], tables["priors"], segments, settings
    )
    described = ranking.rank_all(
        profiles,
        conditioned,
        tables["hotels"],
        tables["drift"],
        segments,
        aspects,
        rules.category_fit,
        settings,
    )
    best = explain.best_quotes(tables["instances"], settings)
    quotes = explain.of_picked_hotels(best, described)
    explained = explain.explained_picks(
        described,
        quotes,
        tables["contradictions"],
        names,
        settings,
        tables["drift"] if drift_caveats else None,
    )
    return explain.rich_output(profiles, explained)


def build(
    raw_reviews: DataFrame,
    raw_profiles: DataFrame,
    root: str,
    overrides: DataFrame | None = None,
    scorer: labels.Scorer | None = None,
    descriptors: DataFrame | None = None,
    embedder: Callable[[], Callable] | None = None,
    rules: ProfileRules = DEFAULT_RULES,
    settings: Settings = DEFAULTS,
    drift_caveats: bool = False,
) -> dict[str, DataFrame]:
    """Run everything and leave the artifacts under `root`.

    An embedder (an encoder) sees each sentence that the store of earlier runs lacks, and, if there are
    descriptors (aspect, and vector or phrase), the descriptions of profiles that say too little.
    `drift_caveats` adds what is known about seasons and trends of the asked aspects to the caveats.

    Without a scorer the word-list labeller runs in place. A scorer (a model) sees each
    distinct sentence once, and only those an earlier run has not labelled; the sentences
    are stored then, as four steps read them.
    """
    spark = raw_reviews.sparkSession
    keep = lambda name, df: files.write_artifact(df, root, name)
    tables: dict[str, DataFrame] = {}
    cleaned = ingest.load_reviews(raw_reviews, settings=settings)
    reviews = tables["reviews"] = keep("reviews", cleaned)
    tables["rejected"] = keep("rejected", ingest.rejected_reviews(raw_reviews))
    pieces = sentences.sentence_instances(reviews)
    if scorer is None:
        labelled = evidence.label_in_place(
            pieces, labels.lexicon_scorer(DEFAULT_LEXICON), overrides, settings=settings
        )
    else:
        pieces = keep("sentences", pieces)
        stored = f"{root}/labels_auto"
        known = spark.read.parquet(stored) if files.readable(spark, stored) else None
        missing = (
            sentences.distinct_sentences(pieces)
            if known is None
            else labels.unlabelled_sentences(pieces, known)
        )
        fresh = labels.label_sentences(missing, scorer, settings=settings)
        fresh.write.mode("append").parquet(stored)
        final = labels.apply_overrides(spark.read.parquet(stored), overrides)
        labelled = evidence.join_labels(pieces, keep("labels", final))
    instances = tables["instances"] = keep("instances", evidence.aspect_instances(labelled))

    raw_sums = keep("raw_sums", scoring.raw_segment_sums(instances, settings))
    tables["segment_sums"] = keep("segment_sums", scoring.segment_sums(raw_sums))
    tables["priors"] = keep("priors", scoring.aspect_priors(raw_sums))
    tables["scores"] = keep(
        "scores", scoring.aspect_scores(raw_sums, tables["priors"], settings)
    )
    tables["hotels"] = keep("hotels", scoring.hotel_summary(reviews, settings))
    tables["monthly"] = keep("monthly", temporal.monthly_series(reviews, instances))

    values = temporal.test_values(reviews, instances)
    tests = keep("drift_tests", temporal.drift_tests(values, settings=settings))
    tables["drift"] = keep("drift", temporal.drift_table(tests))
    splits = contra.cell_splits(instances, settings=settings)
    tables["contradictions"] = keep(
        "contradictions", contra.contradictions(splits, settings=settings)
    )
    if embedder is not None:
        tables["embeddings"] = files.add_embeddings(
            spark, f"{root}/embeddings", instances.select("sentence_text"), embedder
        )
    tables["search_index"] = keep("search_index", search.search_index(instances))
    given = ingest.load_profiles(raw_profiles)
    if embedder is not None and descriptors is not None:
        if "vector" not in descriptors.columns:
            descriptors = people.embedded_descriptors(descriptors, embedder)
        given = people.with_vectors(given, embedder, rules, settings)
    enriched = people.enrich_profiles(given, rules, descriptors, settings=settings)
    tables["profiles"] = keep("profiles", enriched)
    files.write_profiles_json(tables["profiles"], f"{root}/profiles_json")
    tables["seasonal_alerts"] = keep(
        "seasonal_alerts", reports.seasonal_alerts(tables["drift"], tables["hotels"])
    )
    rich = recommend(
        tables["profiles"], tables, rules, settings=settings, drift_caveats=drift_caveats
    )
    files.write_outputs(rich, f"{root}/outputs")
    return tables


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of a finished run, as one row."""
    counted = {
        f"n_{name}": df.agg(F.count(F.lit(1)).alias("n")).scalar() for name, df in tables.items()
    }
    one = tables["priors"].agg(F.count(F.lit(1)).alias("_one"))
    return one.select(*[c.alias(n) for n, c in counted.items()])

"""The shapes that leave the pipeline, and the check that runs before they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS, Settings
from guestsignal.operators.scale import materialise


def submission_output(rich: DataFrame) -> DataFrame:
    return rich.select(
        "profile_id",
        "archetype",
        "desired_dims",
        F.transform(
            "recommendations",
            lambda r: F.struct(
                r["rank"].alias("rank"),
                r["hotel_id"].alias("hotel_id"),
                r["hotel_name"].alias("hotel_name"),
                r["hotel_category"].alias("hotel_category"),
                r["score"].alias("score"),
            ),
        ).alias("top_hotels"),
    )


def _rules(settings: Settings) -> dict[str, Column]:
    recs = F.col("recommendations")
    every = lambda test: F.forall(recs, test)
    filled = lambda r: (
        r["hotel_id"].isNotNull()
        & r["hotel_name"].isNotNull()
        & r["hotel_category"].isNotNull()
        & r["score"].isNotNull()
    )
    quoted = lambda r: F.forall(
        r["supporting_evidence"],
        lambda e: e["review_id"].isNotNull()
        & e["quote"].isNotNull()
        & e["aspect"].isNotNull()
        & e["date"].isNotNull()
        & e["verified"].isNotNull()
        & e["sentiment"].isNotNull(),
    )
    return {
        "profile fields missing": F.col("profile_id").isNotNull()
        & F.col("archetype").isNotNull()
        & F.col("profile_summary").isNotNull()
        & F.col("desired_dims").isNotNull(),
        "number of hotels": F.size(recs).between(1, settings.top_n),
        "rank out of range": every(lambda r: r["rank"].between(1, settings.top_n)),
        "hotel fields missing": every(filled),
        "number of quotes": every(
            lambda r: F.size(r["supporting_evidence"]).between(1, settings.quotes)
        ),
        "quote fields missing": every(quoted),
        "justification length": every(
            lambda r: F.length(r["justification"]) <= settings.max_justification
        ),
    }


def contract_violations(
    rich: DataFrame, profiles: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """(profile_id, rule) of every broken rule; with `profiles`, also those without output.

    Records are long and dear to make, so what they break is stored and only ids meet the profiles. Both
    sides are sorted for that: columns of ids take far more memory than their files, by which
    Spark would choose to send one to all tasks.
    """
    checks = F.array(
        *[
            F.when(~F.coalesce(holds, F.lit(False)), rule)
            for rule, holds in _rules(settings).items()
        ]
    )
    checked = rich.select("profile_id", F.array_compact(checks).alias("_broken"))
    if profiles is not None:
        checked = materialise(checked, "checked")
    broken = checked.select("profile_id", F.explode("_broken").alias("rule"))
    if profiles is None:
        return broken
    known = checked.select("profile_id").hint("merge")
    silent = profiles.select("profile_id").join(known, "profile_id", "left_anti").select(
        "profile_id", F.lit("no recommendation").alias("rule")
    )
    return broken.unionByName(silent)


def enforce_contract(rich: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Raise before anything is written; shows a few of the offenders."""
    examples = contract_violations(rich, settings=settings).limit(5).collect()
    if examples:
        raise ValueError(f"output contract broken: {[tuple(r) for r in examples]}")
    return rich

"""Profiles, rankings and explained recommendations.

Parts are the profiles. Rankings go over suppliers (numeric path, with drift); explained
recommendations go over document sources (text path, with quotes).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS
from guestsignal.functions.numbers import rounded
from guestsignal.functions.taxonomy import DISPLAY_NAMES
from guestsignal.operators import contracts, explain, profiles, ranking, reports, scoring
from guestsignal.operators import contradictions as contra
from guestsignal.operators.scale import materialise
from guestsignal.plans import catalog_documents as docs
from guestsignal.plans import catalog_orders as orders
from guestsignal.plans import oracle_views as o
from guestsignal.plans.registry import query, r, signed
from guestsignal.sources import driver_views as v

P = 6
# Mean label vectors of the given embeddings are far from any single vector.
SIMILARITY = 0.30
CLOSE = replace(DEFAULTS, backstop_similarity=SIMILARITY)
# Evidence per supplier and flag lies between about 27 and 53: this floor splits them.
STRICT = replace(DEFAULTS, min_evidence=38.0)


def _weights_text(column="dim_weights"):
    return F.array_join(
        F.transform(
            column, lambda d: F.format_string("%s:%.4f", d["aspect"], d["weight"])
        ),
        "|",
    ).alias("dims")


# --- understanding profiles -----------------------------------------------------------


def order_profiles(spark, sf):
    parts = v.part_profiles(spark, sf).drop("vector")
    return profiles.enrich_profiles(parts, v.ORDER_RULES, names={})


def document_profiles(spark, sf):
    return profiles.enrich_profiles(
        v.part_profiles(spark, sf),
        v.DOCUMENT_RULES,
        v.label_descriptors(spark, sf),
        settings=CLOSE,
    )


ORDER_PROFILES = f"{o.profiles(v.ORDER_RULES)}, {o.weights('rule')}"
DOCUMENT_PROFILES = (
    f"{o.profiles(v.DOCUMENT_RULES)}, {o.backstop(v.DOCUMENT_ASPECTS, SIMILARITY)}, "
    f"{o.weights('dims')}"
)


@query(
    "rule_dims",
    f"with {o.profiles(v.DOCUMENT_RULES)} select profile_id, aspect, weight from rule",
)
def rule_dims(spark, sf):
    found = v.part_profiles(spark, sf).select(
        "profile_id",
        F.inline(profiles.rule_dims(F.col("description"), v.DOCUMENT_RULES)),
    )
    return found.select("profile_id", "aspect", "weight")


@query(
    "traveler_type",
    f"with {o.profiles(v.ORDER_RULES)} select profile_id, traveler_type from prof",
)
def traveler_type(spark, sf):
    rules = v.ORDER_RULES
    kind = profiles.first_match(F.col("description"), rules.travelers, rules.default_traveler)
    return v.part_profiles(spark, sf).select("profile_id", kind.alias("traveler_type"))


@query("budget_band", f"with {o.profiles(v.ORDER_RULES)} select profile_id, budget from prof")
def budget_band(spark, sf):
    rules = v.ORDER_RULES
    band = profiles.first_match(F.col("description"), rules.budgets, rules.default_budget)
    return v.part_profiles(spark, sf).select("profile_id", band.alias("budget"))


@query(
    "descriptor_sim",
    f"""with {o.profiles(v.DOCUMENT_RULES)}, {o.backstop(v.DOCUMENT_ASPECTS, SIMILARITY)}
    select profile_id, aspect, {r('similarity', P)} as similarity from sims""",
)
def descriptor_sim(spark, sf):
    bank = profiles.descriptor_bank(v.label_descriptors(spark, sf))
    similar = profiles.descriptor_similarity(
        F.col("vector"), F.col("_bank"), v.DOCUMENT_ASPECTS
    )
    return (
        v.part_profiles(spark, sf)
        .filter(F.col("vector").isNotNull())
        .withColumn("_bank", bank)
        .select("profile_id", F.inline(similar))
        .withColumn("similarity", rounded(F.col("similarity"), P))
    )


@query(
    "dims_backstop",
    f"""with {o.profiles(v.DOCUMENT_RULES)}, {o.backstop(v.DOCUMENT_ASPECTS, SIMILARITY)}
    select profile_id, aspect from near""",
)
def dims_backstop(spark, sf):
    return document_profiles(spark, sf).select(
        "profile_id", F.explode("embedding_dims").alias("aspect")
    )


@query("dim_weights", f"with {DOCUMENT_PROFILES} select profile_id, dims from want")
def dim_weights(spark, sf):
    return document_profiles(spark, sf).select("profile_id", _weights_text())


_FIT_SQL = " union all ".join(
    f"select profile_id, budget, '{c}' as category, {x}e0 as fit from prof where budget = '{b}'"
    for b, by in v.ORDER_RULES.category_fit.items()
    for c, x in by.items()
)


@query("category_fit", f"with {o.profiles(v.ORDER_RULES)} {_FIT_SQL}")
def category_fit(spark, sf):
    return order_profiles(spark, sf).select(
        "profile_id", "budget", F.explode("category_fit").alias("category", "fit")
    )


def _archetype_sql(rules) -> str:
    themes = " ".join(f"when '{a}' then '{t}'" for a, t in rules.themes.items())
    pattern = rules.female_pattern
    return f"""themed as (
      select *, list_concat(case when traveler_type = '{rules.female_traveler}'
          and regexp_matches(description, '{pattern}') then [traveler_type, 'female']
        else [traveler_type] end, list_filter(list_transform(coalesce(aspects, []),
          lambda a: case a {themes} end), lambda t: t is not null)) as parts from want),
    slugs as (
      select profile_id, array_to_string(list_filter(parts,
        lambda x, i: list_position(parts, x) = i)[1:3], '_') as archetype from themed)"""


def _shown(expression: str) -> str:
    names = " ".join(f"when '{a}' then '{DISPLAY_NAMES[a]}'" for a in v.DOCUMENT_ASPECTS)
    return f"lower(case {expression} {names} end)"


_SUMMARY_SQL = f"""upper(traveler_type[1]) || lower(traveler_type[2:]) || ' traveler ('
  || replace(budget, '_', '-') || ' budget) prioritizing '
  || array_to_string(list_transform(coalesce(aspects, [])[1:3], lambda a: {_shown('a')}), ', ')
  || '.'"""


@query(
    "archetype",
    f"with {DOCUMENT_PROFILES}, {_archetype_sql(v.DOCUMENT_RULES)} select profile_id, archetype from slugs",
)
def archetype(spark, sf):
    return document_profiles(spark, sf).select("profile_id", "archetype")


@query(
    "profile_summary",
    f"with {DOCUMENT_PROFILES} select profile_id, {_SUMMARY_SQL} as profile_summary from want",
)
def profile_summary(spark, sf):
    return document_profiles(spark, sf).select("profile_id", "profile_summary")


@query(
    "enrich_profiles",
    f"""with {ORDER_PROFILES}, {_archetype_sql(v.ORDER_RULES)}
    select profile_id, description, traveler_type, budget, dims,
      array_to_string(coalesce(aspects, []), '|') as desired_dims, archetype
    from want join slugs using (profile_id)""",
)
def enrich_profiles(spark, sf):
    return order_profiles(spark, sf).select(
        "profile_id",
        "description",
        "traveler_type",
        "budget",
        _weights_text(),
        F.array_join("desired_dims", "|").alias("desired_dims"),
        "archetype",
    )


# --- ranking suppliers ----------------------------------------------------------------

NO_PENALTY = "select '' as hotel_id, '' as aspect, 0e0 as penalty where false"
PENALTY = """select hotel_id, aspect, case trend_tier when 'strong' then 0.08e0
    when 'moderate' then 0.05e0 else 0.02e0 end as penalty from drift
  where trend_dir = 'declining' and trend_tier in ('strong', 'moderate', 'weak')"""
RANK_BASE = (
    f"{orders.WITH_SUMS}, {o.conditioned(v.ORDER_SEGMENTS)}, "
    f"{o.HOTELS.format(source='ins')}, {ORDER_PROFILES}"
)
RANK_SQL = f"{RANK_BASE}, {o.ranking(v.ORDER_RULES, STRICT.min_evidence, NO_PENALTY)}"
DRIFT_RANK_SQL = (
    f"{RANK_BASE}, {o.ORDER_VALS}, {o.drift_tests(o.SEASON_PLACE)}, {o.RAW_TIERS}, "
    f"{o.ranking(v.ORDER_RULES, STRICT.min_evidence, PENALTY)}"
)


def supplier_picks(spark, sf, with_drift=True, people=None):
    rows = orders.order_rows(spark, sf)
    return ranking.rank_all(
        people or order_profiles(spark, sf),
        orders.conditioned(spark, sf, rows),
        scoring.hotel_summary(rows),
        orders.drift_of(rows) if with_drift else None,
        v.ORDER_SEGMENTS,
        v.ORDER_ASPECTS,
        v.ORDER_RULES.category_fit,
        STRICT,
    )


INTENT_SQL = "traveler_type, budget, dims"


def _intent():
    return ["traveler_type", "budget", _weights_text()]


@query(
    "aspect_pivot",
    f"""{orders.WITH_SUMS}, {o.conditioned(v.ORDER_SEGMENTS)} select hotel_id, traveler_type, """
    + ", ".join(f"max(score) filter (aspect = '{a}') as \"score_{a}\"" for a in v.ORDER_ASPECTS)
    + " from cond group by hotel_id, traveler_type",
)
def aspect_pivot(spark, sf):
    return ranking.aspect_pivot(orders.conditioned(spark, sf), "score", v.ORDER_ASPECTS)


@query(
    "eligible_hotels",
    f"""{RANK_BASE} select hotel_id, traveler_type, aspect, evidence_weight from cond
    where evidence_weight >= {STRICT.min_evidence} and (traveler_type, aspect) in (
      select (traveler_type, aspects[1]) from want)""",
)
def eligible_hotels(spark, sf):
    wanted = ranking.intents(order_profiles(spark, sf))
    return ranking.eligible_hotels(orders.conditioned(spark, sf), wanted, STRICT).select(
        "hotel_id", "traveler_type", "aspect", "evidence_weight"
    )


@query(
    "fit_score",
    f"""{RANK_SQL} select {INTENT_SQL}, hotel_id, composite as fit,
    array_to_string(list_transform(contributions,
      lambda c: c.aspect || ':' || printf('%.4f', c.score)), '|') as contributions from rank""",
)
def fit_score(spark, sf):
    """Personal fit plus rating and category terms, no drift."""
    shown = F.transform(
        "contributions", lambda c: F.format_string("%s:%.4f", c["aspect"], c["score"])
    )
    return supplier_picks(spark, sf, with_drift=False).select(
        *_intent(),
        "hotel_id",
        F.col("composite").alias("fit"),
        F.array_join(shown, "|").alias("contributions"),
    )


@query(
    "drift_penalty",
    f"{DRIFT_RANK_SQL} select {INTENT_SQL}, hotel_id, {r('penalty', 4)} as drift_penalty from rank",
)
def drift_penalty(spark, sf):
    return supplier_picks(spark, sf).select(*_intent(), "hotel_id", "drift_penalty")


@query(
    "penalty_rows",
    f"{orders.WITH_DRIFT} select hotel_id, aspect, penalty from ({PENALTY})",
)
def penalty_rows(spark, sf):
    return ranking.penalty_rows(orders.raw_tier_drift(spark, sf))


@query(
    "composite_score",
    f"{DRIFT_RANK_SQL} select {INTENT_SQL}, hotel_id, composite, display as display_score from rank",
)
def composite_score(spark, sf):
    return supplier_picks(spark, sf).select(*_intent(), "hotel_id", "composite", "display_score")


@query(
    "rank_hotels",
    f"""{DRIFT_RANK_SQL} select {INTENT_SQL}, cast(place as bigint) as rank, hotel_id, hotel_name,
    hotel_category, composite from rank""",
)
def rank_hotels(spark, sf):
    return supplier_picks(spark, sf).select(
        *_intent(),
        F.col("rank").cast("bigint").alias("rank"),
        "hotel_id",
        "hotel_name",
        "hotel_category",
        "composite",
    )


@query(
    "recommend_all",
    f"""{DRIFT_RANK_SQL} select profile_id, cast(place as bigint) as rank, hotel_id,
    display as display_score from want join rank using (traveler_type, budget, dims)""",
)
def recommend_all(spark, sf):
    people = order_profiles(spark, sf)
    ranked = ranking.ranked_profiles(people, supplier_picks(spark, sf, people=people))
    return ranked.select(
        "profile_id", F.col("rank").cast("bigint").alias("rank"), "hotel_id", "display_score"
    )


# --- explained recommendations of document sources ------------------------------------

CONTRA_GAP = 0.10
SPLIT = replace(DEFAULTS, min_split_gap=CONTRA_GAP)


def explained(spark, sf, people):
    instances = materialise(v.document_instances(spark, sf), "instances")
    raw = materialise(scoring.raw_segment_sums(instances), "sums")
    conditioned = scoring.conditioned_scores(
        scoring.segment_sums(raw), scoring.aspect_priors(raw), v.DOCUMENT_SEGMENTS
    )
    described = ranking.rank_all(
        people,
        conditioned,
        scoring.hotel_summary(v.document_reviews(spark, sf)),
        None,
        v.DOCUMENT_SEGMENTS,
        v.DOCUMENT_ASPECTS,
        v.DOCUMENT_RULES.category_fit,
    )
    contested = contra.contradictions(
        contra.cell_splits(instances, v.DOCUMENT_SEGMENTS), v.DOCUMENT_SEGMENTS, SPLIT
    )
    quotes = explain.of_picked_hotels(explain.best_quotes(instances), described)
    return explain.explained_picks(described, quotes, contested)


def intent_picks(spark, sf):
    return explained(spark, sf, document_profiles(spark, sf))


def rich(spark, sf, profile_ids=None):
    """Records of all profiles, or of some: a profile's record does not depend on the others."""
    people = document_profiles(spark, sf)
    if profile_ids is not None:
        people = people.filter(F.col("profile_id").isin(*profile_ids))
    people = materialise(people, "people")
    return explain.rich_output(people, explained(spark, sf, people))


_STRENGTHS = f"""array_to_string(list_transform(strong[1:3], lambda c: {_shown('c.aspect')} || ' ('
  || {signed('c.score')} || ')'), ', ')"""
EXPLAIN_SQL = f"""{docs.WITH_LABELS}, {docs.QUOTES_SQL},
ins as (select * from dins where not is_general), {o.SUMS},
{o.conditioned(v.DOCUMENT_SEGMENTS)}, {o.HOTELS.format(source='docw')}, {DOCUMENT_PROFILES},
{o.ranking(v.DOCUMENT_RULES, DEFAULTS.min_evidence, NO_PENALTY)},
{o.splits(v.DOCUMENT_SEGMENTS)}, {o.contradictions(v.DOCUMENT_SEGMENTS, CONTRA_GAP)},
ranked as (
  select *, list_filter(contributions, lambda c: c.score > 0.05e0) as strong,
    list_transform(contributions, lambda c: c.aspect) as active from rank),
evid as (
  select * from (
    select *, row_number() over (partition by {INTENT_SQL}, hotel_id order by {docs.QUOTE_ORDER})
      as turn
    from (
      select k.traveler_type, k.budget, k.dims, k.hotel_id, k.place as rank_place, q.aspect,
        q.review_id, q.sentence_text, q.review_date, q.verified, q.polarity, q.quality,
        row_number() over (partition by k.traveler_type, k.budget, k.dims, k.hotel_id,
          q.sentence_text order by {docs.QUOTE_ORDER}) as again
      from ranked k join quotes q on q.hotel_id = k.hotel_id
        and list_contains(k.active, q.aspect))
    where again = 1) where turn <= 3),
cav as (
  select {INTENT_SQL}, k.hotel_id, first('Reviewers are split on ' || {_shown('c.aspect')} || '.'
    || coalesce(' ' || nullif(trim(resolution), ''), '') order by disagreement desc, c.aspect)
    as caveats
  from ranked k join contra c on c.hotel_id = k.hotel_id and list_contains(k.active, c.aspect)
  group by {INTENT_SQL}, k.hotel_id),
ex as (
  select ranked.*, e.n_quotes, e.first_quote, e.quotes, cav.caveats,
    hotel_name || ' ranks #' || place || case when len(strong) > 0
      then ' for this traveler on ' || {_STRENGTHS} || ', weighted by what matters most to them.'
      else ' as a strong all-round match.' end
      || ' Guests note: "' || e.first_quote || '"' as justification
  from ranked join (
    select {INTENT_SQL}, hotel_id, count(*) as n_quotes, list(sentence_text) as quotes,
      first(sentence_text order by turn) as first_quote
    from evid group by all) e using (traveler_type, budget, dims, hotel_id)
    left join cav using (traveler_type, budget, dims, hotel_id))"""


@query(
    "gather_evidence",
    f"""{EXPLAIN_SQL} select {INTENT_SQL}, hotel_id, cast(turn as bigint) as place, review_id,
    sentence_text as quote, aspect, strftime(review_date, '%Y-%m-%d') as date, verified,
    {r('polarity', 3)} as sentiment from evid""",
)
def gather_evidence(spark, sf):
    return (
        intent_picks(spark, sf)
        .select(*_intent(), "hotel_id", F.posexplode("supporting_evidence").alias("p", "e"))
        .select(
            "traveler_type",
            "budget",
            "dims",
            "hotel_id",
            (F.col("p") + 1).cast("bigint").alias("place"),
            "e.*",
        )
    )


@query(
    "contradiction_caveat",
    f"{EXPLAIN_SQL} select {INTENT_SQL}, hotel_id, caveats from ex",
)
def contradiction_caveat(spark, sf):
    return intent_picks(spark, sf).select(*_intent(), "hotel_id", "caveats")


@query(
    "matched_aspects",
    f"""{EXPLAIN_SQL} select {INTENT_SQL}, hotel_id,
    array_to_string(list_transform(strong, lambda c: c.aspect), '|') as matched_aspects from ex""",
)
def matched_aspects(spark, sf):
    return intent_picks(spark, sf).select(
        *_intent(), "hotel_id", F.array_join("matched_aspects", "|").alias("matched_aspects")
    )


@query("justification", f"{EXPLAIN_SQL} select {INTENT_SQL}, hotel_id, justification from ex")
def justification(spark, sf):
    return intent_picks(spark, sf).select(*_intent(), "hotel_id", "justification")


_CANDIDATE_SQL = """case place when 1 then 'Answer: House of choice for ' || traveler_type
  when 2 then 'House with 5 stars' when 3 then 'Nothing about the place'
  when 4 then repeat('House ', 120) else '' end"""


@query(
    "text_guard",
    f"""{EXPLAIN_SQL}, cand as (
      select *, {_CANDIDATE_SQL} as candidate, list_concat(regexp_extract_all(hotel_category, '\\d+'),
        flatten(list_transform(quotes, lambda q: regexp_extract_all(q, '\\d+')))) as allowed from ex)
    select {INTENT_SQL}, hotel_id, case when length(candidate) between 1 and 600
      and contains(lower(candidate), 'house')
      and len(list_filter(regexp_extract_all(candidate, '\\d+'),
        lambda x: not list_contains(allowed, x))) = 0
      then trim(regexp_replace(candidate, '^Answer: ', '')) else justification end as text
    from cand""",
)
def text_guard(spark, sf):
    place = F.col("rank")
    candidate = (
        F.when(place == 1, F.concat(F.lit("Answer: House of choice for "), "traveler_type"))
        .when(place == 2, "House with 5 stars")
        .when(place == 3, "Nothing about the place")
        .when(place == 4, "House " * 120)
        .otherwise("")
    )
    picks = intent_picks(spark, sf).withColumn("candidate", candidate)
    guarded = explain.guard_text(
        F.col("candidate"),
        F.col("hotel_name"),
        F.col("hotel_category"),
        F.transform("supporting_evidence", lambda e: e["quote"]),
        F.col("justification"),
    )
    return picks.select(*_intent(), "hotel_id", guarded.alias("text"))


RICH_SQL = f"""{EXPLAIN_SQL}, {_archetype_sql(v.DOCUMENT_RULES)},
rich as (
  select want.profile_id, archetype, {_SUMMARY_SQL.replace('traveler_type', 'want.traveler_type')
    .replace('budget,', 'want.budget,')} as profile_summary,
    array_to_string(want.aspects, '|') as desired_dims, ex.place as rank, ex.hotel_id,
    ex.hotel_name, ex.hotel_category, ex.display as score,
    array_to_string(list_transform(strong, lambda c: c.aspect), '|') as matched_aspects,
    justification, n_quotes, caveats
  from want join ex using (traveler_type, budget, dims) join slugs using (profile_id))"""
RICH_COLUMNS = """profile_id, archetype, cast(rank as bigint) as rank, hotel_id, score,
  matched_aspects, justification, n_quotes, caveats"""


def _flat(recommendations):
    return recommendations.select(
        "profile_id", "archetype", F.inline("recommendations")
    ).select(
        "profile_id",
        "archetype",
        F.col("rank").cast("bigint").alias("rank"),
        "hotel_id",
        "score",
        F.array_join("matched_aspects", "|").alias("matched_aspects"),
        "justification",
        F.size("supporting_evidence").cast("bigint").alias("n_quotes"),
        "caveats",
    )


@query("rich_output", f"{RICH_SQL} select {RICH_COLUMNS} from rich")
def rich_output(spark, sf):
    return _flat(rich(spark, sf))


@query(
    "submission_output",
    f"""{RICH_SQL} select profile_id, archetype, desired_dims, cast(rank as bigint) as rank,
    hotel_id, hotel_name, hotel_category, score from rich""",
)
def submission_output(spark, sf):
    return contracts.submission_output(rich(spark, sf)).select(
        "profile_id",
        "archetype",
        F.array_join("desired_dims", "|").alias("desired_dims"),
        F.inline("top_hotels"),
    ).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "contract_violations",
    f"""{RICH_SQL}
    select distinct profile_id, 'justification length' as rule from rich
      where length(justification) > 800
    union all
    select profile_id, 'no recommendation' from prof
      where profile_id not in (select profile_id from rich)""",
)
def contract_violations(spark, sf):
    people = document_profiles(spark, sf).select("profile_id")
    return contracts.contract_violations(rich(spark, sf), people)


A_PROFILE = "42"
CHOSEN = ("3", "17", "42", "99")


@query(
    "profile_lookup",
    f"{RICH_SQL} select {RICH_COLUMNS} from rich where profile_id = '{A_PROFILE}'",
)
def profile_lookup(spark, sf):
    return _flat(rich(spark, sf, [A_PROFILE]).filter(F.col("profile_id") == A_PROFILE))


@query(
    "compare_profiles",
    f"""{RICH_SQL} select profile_id, archetype, cast(rank as bigint) as rank, hotel_id, score
    from rich where profile_id in {CHOSEN}""",
)
def compare_profiles(spark, sf):
    return reports.compare_profiles(rich(spark, sf, CHOSEN), list(CHOSEN)).select(
        "profile_id", "archetype", F.col("rank").cast("bigint").alias("rank"), "hotel_id", "score"
    )

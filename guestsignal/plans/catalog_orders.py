"""Numeric path: every line item is a review of its supplier."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from guestsignal.config import DEFAULTS
from guestsignal.functions import bands
from guestsignal.functions.numbers import rounded, weighted_mean
from guestsignal.operators import contradictions as contra
from guestsignal.operators import evidence, ingest, reports, scoring, temporal
from guestsignal.operators.scale import materialise
from guestsignal.plans import oracle_views as o
from guestsignal.plans.registry import query, r
from guestsignal.sources import driver_views as v

WITH = f"with {o.ORDERS}"
WITH_SUMS = f"{WITH}, {o.SUMS}"
WITH_HOTELS = f"{WITH}, {o.HOTELS.format(source='ins')}"
WITH_TESTS = f"{WITH}, {o.ORDER_VALS}, {o.drift_tests(o.SEASON_PLACE)}"
WITH_DRIFT = f"{WITH_TESTS}, {o.RAW_TIERS}"
A_HOTEL = "7"
P = 6


def order_rows(spark, sf):
    """All reviews with their instance, stored once and sorted by hotel: each table of a report
    derives from it, and what asks for one hotel skips the row groups of the others. Reports count and
    sum, so the ids stay behind; the calendar follows from the date."""
    rows = v.order_reviews(spark, sf).drop("review_id", "year", "month", "year_month", "season")
    stored = ingest.add_calendar(materialise(rows.sortWithinPartitions("hotel_id"), "orders"))
    stored = stored.withColumn("is_general", F.lit(False))
    anchor = stored.agg(F.max("review_date").alias("d")).scalar()
    return evidence.add_weight(ingest.add_trust(ingest.add_recency(stored, anchor=anchor)))


def sums(spark, sf):
    return scoring.raw_segment_sums(v.order_instances(spark, sf))


def hotels(spark, sf):
    return scoring.hotel_summary(v.order_reviews(spark, sf))


def values(spark, sf):
    rows = v.order_reviews(spark, sf).withColumn("is_general", F.lit(False))
    return temporal.values_in_one_pass(rows)


def tests(spark, sf):
    return temporal.drift_tests(values(spark, sf), store_ties=True)


def seasonal_tests(spark, sf):
    return temporal.seasonal_tests(values(spark, sf))


def raw_tiers(tested):
    """Tiers of uncorrected p-values, so that reports and penalties have something to show."""
    return tested.withColumns(
        {
            "seasonal_tier": bands.confidence_tier(F.col("kw_p")),
            "trend_tier": bands.confidence_tier(F.col("trend_p")),
        }
    )


def raw_tier_drift(spark, sf):
    return raw_tiers(tests(spark, sf))


def drift_of(rows):
    """The same of stored rows, stored as well: reports read it several times."""
    return materialise(raw_tiers(temporal.drift_tests(temporal.test_values(rows, rows))), "drift")


def splits(spark, sf):
    return contra.cell_splits(v.order_instances(spark, sf), v.ORDER_SEGMENTS)


# --- ingest ---------------------------------------------------------------------------


@query(
    "calendar_features",
    f"""{WITH} select cast(year(review_date) as bigint) as year,
    cast(month(review_date) as bigint) as month, year_month, season, count(*) as n
    from ins group by all""",
)
def calendar_features(spark, sf):
    return (
        v.order_reviews(spark, sf)
        .groupBy(
            F.col("year").cast("bigint").alias("year"),
            F.col("month").cast("bigint").alias("month"),
            "year_month",
            "season",
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "segment_fill",
    """select coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'unknown') as traveler_type,
    count(*) as n from orders group by 1""",
)
def segment_fill(spark, sf):
    given = v.table(spark, sf, "orders").select(
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("traveler_type")
    )
    return ingest.fill_segment(given).groupBy("traveler_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_reviews",
    """select review_id, partkey, suppkey, ship_date from (
      select l_orderkey || '-' || l_linenumber as review_id, l_partkey as partkey,
        l_suppkey as suppkey, strftime(l_shipdate, '%Y-%m-%d') as ship_date,
        row_number() over (partition by l_orderkey, l_linenumber
          order by l_shipdate, l_partkey, l_suppkey) as place
      from lineitem) where place = 1""",
)
def dedupe_reviews(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        "l_shipdate",
    )
    order = [F.col("l_shipdate"), F.col("partkey"), F.col("suppkey")]
    return ingest.dedupe_first(rows, "review_id", order).select(
        "review_id", "partkey", "suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date")
    )


@query(
    "recency_weight",
    f"""{WITH} select strftime(review_date, '%Y-%m-%d') as day, {r('any_value(recency_weight)', P)}
    as recency_weight, count(*) as n from ins group by review_date""",
)
def recency_weight(spark, sf):
    return (
        v.order_instances(spark, sf)
        .groupBy(
            F.date_format("review_date", "yyyy-MM-dd").alias("day"),
            rounded(F.col("recency_weight"), P).alias("recency_weight"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "trust_weight",
    f"""{WITH} select verified, trust_weight, count(*) as n, {r('sum(weight)', 4)} as weight
    from ins group by verified, trust_weight""",
)
def trust_weight(spark, sf):
    return (
        v.order_instances(spark, sf)
        .groupBy("verified", "trust_weight")
        .agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("weight"), 4).alias("weight"))
    )


# --- scores ---------------------------------------------------------------------------


@query(
    "weighted_mean",
    f"""{WITH} select hotel_id, {r('sum(polarity * weight) / sum(weight)', P)} as mean_polarity,
    {r('sum(rating * weight) / sum(weight)', P)} as mean_rating from ins group by hotel_id""",
)
def weighted_mean_query(spark, sf):
    return (
        v.order_instances(spark, sf)
        .groupBy("hotel_id")
        .agg(
            rounded(weighted_mean(F.col("polarity"), F.col("weight")), P).alias("mean_polarity"),
            rounded(weighted_mean(F.col("rating"), F.col("weight")), P).alias("mean_rating"),
        )
    )


@query("aspect_priors", f"{WITH_SUMS} select aspect, {r('prior', P)} as prior from pri")
def aspect_priors(spark, sf):
    priors = scoring.aspect_priors(sums(spark, sf))
    return priors.select("aspect", rounded(F.col("prior"), P).alias("prior"))


def all_scores(spark, sf):
    raw = materialise(sums(spark, sf), "sums")
    return scoring.aspect_scores(raw, scoring.aspect_priors(raw))


SCORES_SQL = f"{WITH_SUMS}, {o.SCORES} select {{columns}} from scores"


@query(
    "hotel_aspect_agg",
    SCORES_SQL.format(columns="hotel_id, aspect, n, evidence_weight, raw_score"),
)
def hotel_aspect_agg(spark, sf):
    return all_scores(spark, sf).select("hotel_id", "aspect", "n", "evidence_weight", "raw_score")


@query("eb_shrink", SCORES_SQL.format(columns="hotel_id, aspect, n, raw_score, score"))
def eb_shrink(spark, sf):
    return all_scores(spark, sf).select("hotel_id", "aspect", "n", "raw_score", "score")


@query("polarity_mass", SCORES_SQL.format(columns="hotel_id, aspect, pos_weight, neg_weight"))
def polarity_mass(spark, sf):
    return all_scores(spark, sf).select("hotel_id", "aspect", "pos_weight", "neg_weight")


@query(
    "segment_sums",
    f"""{WITH_SUMS} select hotel_id, aspect, traveler_type, n, {r('wsum', 4)} as wsum,
    {r('wpol', 4)} as wpol from seg""",
)
def segment_sums(spark, sf):
    return scoring.segment_sums(sums(spark, sf))


ALL_SEGMENTS = (*v.ORDER_SEGMENTS, "unknown")
_WIDE_SQL = ", ".join(
    f"{r(f'''sum(case when traveler_type = '{s}' then {c} else 0e0 end)''', 4)} as \"{c}_{s}\""
    for s in ALL_SEGMENTS
    for c in ("wsum", "wpol")
)


@query(
    "segment_sums_wide",
    f"{WITH_SUMS} select hotel_id, aspect, {_WIDE_SQL} from seg group by hotel_id, aspect",
)
def segment_sums_wide(spark, sf):
    return scoring.segment_sums_wide(sums(spark, sf), ALL_SEGMENTS)


HOTEL_COLUMNS = (
    "hotel_id, hotel_name, hotel_category, city, n_reviews, mean_rating, shrunk_rating, "
    "rating_norm, verified_share"
)


@query("hotel_summary", f"{WITH_HOTELS} select {HOTEL_COLUMNS} from hotels")
def hotel_summary(spark, sf):
    return hotels(spark, sf)


def conditioned(spark, sf, rows=None):
    """Masses take no part in these scores, so they are neither summed nor stored."""
    raw = sums(spark, sf) if rows is None else scoring.raw_segment_sums(rows)
    raw = materialise(raw.drop("pos", "neg"), "sums")
    return scoring.conditioned_scores(
        scoring.segment_sums(raw), scoring.aspect_priors(raw), v.ORDER_SEGMENTS
    )


@query(
    "conditioned_scores",
    f"""{WITH_SUMS}, {o.conditioned(v.ORDER_SEGMENTS)}
    select hotel_id, aspect, traveler_type, n, evidence_weight, score from cond""",
)
def conditioned_scores(spark, sf):
    return conditioned(spark, sf)


# --- series and tests -----------------------------------------------------------------

MONTHLY_SQL = f"""{WITH}, monthly as (
  select hotel_id, 'overall' as aspect, year_month, avg(rating) as value, count(*) as n
  from ins group by all
  union all
  select hotel_id, aspect, year_month, avg(polarity), count(*) from ins group by all)
select hotel_id, aspect, year_month, year_month || '-01' as date, {r('value', P)} as value, n
from monthly"""


def monthly(spark, sf):
    rows = v.order_reviews(spark, sf).withColumn("is_general", F.lit(False))
    return temporal.monthly_series(rows, rows)


@query(
    "monthly_overall",
    f"""{WITH} select hotel_id, year_month, {r('avg(rating)', P)} as value, count(*) as n
    from ins group by all""",
)
def monthly_overall(spark, sf):
    series = temporal.monthly_overall(v.order_reviews(spark, sf))
    return series.withColumn("value", rounded(F.col("value"), P))


@query(
    "monthly_aspect",
    f"""{WITH} select hotel_id, aspect, year_month, {r('avg(polarity)', P)} as value,
    count(*) as n from ins group by all""",
)
def monthly_aspect(spark, sf):
    rows = v.order_reviews(spark, sf).withColumn("is_general", F.lit(False))
    return temporal.monthly_aspect(rows).withColumn("value", rounded(F.col("value"), P))


@query("monthly_series", MONTHLY_SQL)
def monthly_series(spark, sf):
    return monthly(spark, sf).select(
        "hotel_id",
        "aspect",
        "year_month",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        rounded(F.col("value"), P).alias("value"),
        "n",
    )


@query(
    "season_extremes",
    f"{WITH_TESTS} select hotel_id, aspect, best_season, worst_season, season_gap from tests",
)
def season_extremes(spark, sf):
    return seasonal_tests(spark, sf).select(
        "hotel_id", "aspect", "best_season", "worst_season", "season_gap"
    )


def _p(name):
    return rounded(F.col(name), P).alias(name)


KW_SQL = f"select hotel_id, aspect, k, {r('kw_h', P)} as kw_h, {r('kw_p', P)} as kw_p from tests"
SPEARMAN_SQL = (
    f"select hotel_id, aspect, n, trend_rho, {r('trend_p', P)} as trend_p, trend_dir from tests"
)


@query("kruskal_wallis", f"{WITH_TESTS} {KW_SQL}")
def kruskal_wallis(spark, sf):
    return seasonal_tests(spark, sf).select(
        "hotel_id", "aspect", F.col("n_seasons").cast("bigint").alias("k"), _p("kw_h"), _p("kw_p")
    )


@query("spearman_trend", f"{WITH_TESTS} {SPEARMAN_SQL}")
def spearman_trend(spark, sf):
    return tests(spark, sf).select(
        "hotel_id", "aspect", "n", "trend_rho", _p("trend_p"), "trend_dir"
    )


# Small samples, many distinct values, seven weekdays instead of four seasons.
EVENT_VALS = """with vals as (
  select cast(user_id as varchar) as hotel_id, event_type as aspect, value,
    cast(dayofweek(ts) + 1 as varchar) as season, cast(ts as date) as day from events)"""
EVENT_TESTS = f"{EVENT_VALS}, {o.drift_tests('cast(season as int)', minimum=3)}"


def event_tests(spark, sf, tests_of=temporal.drift_tests):
    return tests_of(
        v.event_values(spark, sf),
        v.WEEKDAYS,
        replace(DEFAULTS, min_per_season=3),
        bounded_values=False,
    )


@query("kruskal_wallis_events", f"{EVENT_TESTS} {KW_SQL}")
def kruskal_wallis_events(spark, sf):
    return event_tests(spark, sf, temporal.seasonal_tests).select(
        "hotel_id", "aspect", F.col("n_seasons").cast("bigint").alias("k"), _p("kw_h"), _p("kw_p")
    )


@query("spearman_trend_events", f"{EVENT_TESTS} {SPEARMAN_SQL}")
def spearman_trend_events(spark, sf):
    return event_tests(spark, sf).select(
        "hotel_id", "aspect", "n", "trend_rho", _p("trend_p"), "trend_dir"
    )


BH_SQL = f"""{WITH_TESTS}, {o.adjusted('kw_p', 'tests', 'ka')},
{o.adjusted('trend_p', 'tests', 'ta')},
both_adj as (
  select tests.*, ka.adj as kw_adj_p, ta.adj as trend_adj_p from tests
    left join ka on kw_p = ka.p left join ta on trend_p = ta.p)"""


def drift(spark, sf):
    return temporal.drift_table(materialise(tests(spark, sf)))


@query(
    "bh_fdr",
    f"""{BH_SQL} select hotel_id, aspect, {r('kw_adj_p', P)} as kw_adj_p,
    {r('trend_adj_p', P)} as trend_adj_p from both_adj""",
)
def bh_fdr(spark, sf):
    return drift(spark, sf).select("hotel_id", "aspect", _p("kw_adj_p"), _p("trend_adj_p"))


@query(
    "confidence_tier",
    f"""{WITH_DRIFT}, {o.adjusted('trend_p', 'tests', 'ta')}
    select hotel_id, aspect, seasonal_tier, trend_tier, {o.tier('adj')} as adjusted_tier
    from drift left join ta on trend_p = p""",
)
def confidence_tier(spark, sf):
    both = raw_tier_drift(spark, sf).withColumnRenamed("trend_tier", "raw_trend_tier")
    stored = materialise(both)
    adjusted = temporal.adjust_for_many_tests(stored, "trend_p", "trend_adj_p")
    return adjusted.select(
        "hotel_id",
        "aspect",
        "seasonal_tier",
        F.col("raw_trend_tier").alias("trend_tier"),
        bands.confidence_tier(F.col("trend_adj_p")).alias("adjusted_tier"),
    )


@query(
    "seasonal_caveat",
    f"""{WITH_DRIFT} select hotel_id, aspect,
    aspect || ' varies by season — strongest in ' || best_season || ', weakest in '
      || worst_season || ' (' || seasonal_tier || ' confidence).' as caveat
    from drift where aspect <> 'overall' and seasonal_tier in ('strong', 'moderate', 'weak')""",
)
def seasonal_caveat(spark, sf):
    drifted = raw_tier_drift(spark, sf)
    return drifted.select(
        "hotel_id", "aspect", temporal.seasonal_caveat({}).alias("caveat")
    ).filter("caveat is not null")


@query(
    "trend_caveat",
    f"""{WITH_DRIFT} select hotel_id, aspect,
    case when aspect = 'overall' then 'Overall rating' else aspect end || ' has been '
      || trend_dir || ' over time (' || trend_tier || ' confidence).' as caveat
    from drift where trend_tier in ('strong', 'moderate', 'weak')""",
)
def trend_caveat(spark, sf):
    drifted = raw_tier_drift(spark, sf)
    return drifted.select(
        "hotel_id", "aspect", temporal.trend_caveat({}).alias("caveat")
    ).filter("caveat is not null")


# --- contradictions -------------------------------------------------------------------

CONTRA_SQL = f"{WITH}, {o.splits(v.ORDER_SEGMENTS)}"


@query(
    "disagreement",
    f"{CONTRA_SQL} select hotel_id, aspect, n, pos_share, disagreement from dis",
)
def disagreement(spark, sf):
    return contra.disagreement(splits(spark, sf)).select(
        "hotel_id", "aspect", "n", "pos_share", "disagreement"
    )


@query(
    "verified_split",
    f"{CONTRA_SQL} select hotel_id, aspect, ver_n as n_verified, {r(o.gap('ver'), 4)} as gap from spl",
)
def verified_split(spark, sf):
    return splits(spark, sf).select(
        "hotel_id",
        "aspect",
        F.col("ver_n").alias("n_verified"),
        rounded(contra.split_gap("ver"), 4).alias("gap"),
    )


@query(
    "segment_split",
    CONTRA_SQL
    + " union all ".join(
        f" select hotel_id, aspect, '{s}' as traveler_type, {g}_n as n_segment, "
        f"{r(o.gap(g), 4)} as gap from spl"
        for g, _, s in o.groups(v.ORDER_SEGMENTS)
        if s
    ),
)
def segment_split(spark, sf):
    return contra.segment_gaps(splits(spark, sf), v.ORDER_SEGMENTS)


# A lower gap than the default one, so that several candidates compete.
SPLIT_GAP = 0.15


@query(
    "contradictions",
    f"""{CONTRA_SQL}, {o.contradictions(v.ORDER_SEGMENTS, SPLIT_GAP)}
    select hotel_id, aspect, n, pos_share, disagreement, resolution from contra""",
)
def contradictions(spark, sf):
    return contra.contradictions(
        splits(spark, sf), v.ORDER_SEGMENTS, replace(DEFAULTS, min_split_gap=SPLIT_GAP)
    )


# --- reports --------------------------------------------------------------------------


@query(
    "estate_totals",
    f"""{WITH_HOTELS} select cast(sum(n_reviews) as bigint) as n_reviews, count(*) as n_hotels,
    (select count(distinct aspect) from ins) as n_aspects, (select count(*) from part) as n_profiles
    from hotels""",
)
def estate_totals(spark, sf):
    rows = order_rows(spark, sf)
    cells = scoring.raw_segment_sums(rows)
    return reports.estate_totals(scoring.hotel_summary(rows), cells, v.table(spark, sf, "part"))


@query("hotel_kpis", f"{WITH_HOTELS} select {HOTEL_COLUMNS} from hotels where hotel_id = '{A_HOTEL}'")
def hotel_kpis(spark, sf):
    return reports.hotel_kpis(hotels(spark, sf), A_HOTEL)


@query(
    "hotel_timeline",
    f"""{WITH_DRIFT}, months as (
      select hotel_id, cast(year_month || '-01' as date) as date, avg(rating) as value, count(*) as n
      from ins where hotel_id = '{A_HOTEL}' group by all)
    select months.hotel_id, strftime(date, '%Y-%m-%d') as date, {r('value', P)} as value, months.n,
      case when date = (select max(date) from months)
        and trend_tier not in ('none', 'negligible')
        then trend_dir || ' (' || trend_tier || ')' end as annotation
    from months left join drift on drift.hotel_id = months.hotel_id and aspect = 'overall'""",
)
def hotel_timeline(spark, sf):
    rows = order_rows(spark, sf)
    drifted = raw_tiers(temporal.drift_tests(temporal.test_values(rows, rows)))
    line = reports.hotel_timeline(temporal.monthly_series(rows, rows), drifted, A_HOTEL)
    return line.withColumn("value", rounded(F.col("value"), P)).withColumn(
        "date", F.date_format("date", "yyyy-MM-dd")
    )


@query(
    "aspect_scorecard",
    f"""{WITH_SUMS}, {o.SCORES} select aspect, score, {r('prior', P)} as prior
    from scores join pri using (aspect) where hotel_id = '{A_HOTEL}'""",
)
def aspect_scorecard(spark, sf):
    raw = materialise(sums(spark, sf), "sums")
    priors = scoring.aspect_priors(raw)
    card = reports.aspect_scorecard(scoring.aspect_scores(raw, priors), priors, A_HOTEL)
    return card.withColumn("prior", rounded(F.col("prior"), P))


@query(
    "season_matrix",
    f"""{WITH} select hotel_id, aspect, """
    + ", ".join(
        f"{r(f'''avg(polarity) filter (season = '{s}')''', P)} as {s}"
        for s in ("spring", "summer", "autumn", "winter")
    )
    + " from ins group by hotel_id, aspect",
)
def season_matrix(spark, sf):
    rows = v.order_reviews(spark, sf).withColumn("is_general", F.lit(False))
    return reports.season_matrix(rows)


@query(
    "hotel_contradictions",
    f"""{CONTRA_SQL}, {o.contradictions(v.ORDER_SEGMENTS, DEFAULTS.min_split_gap)}
    select hotel_id, aspect, n, pos_share, disagreement,
      coalesce(resolution, 'Mixed views, no clear driver.') as resolution
    from contra where hotel_id = '{A_HOTEL}'
    order by disagreement desc, aspect limit 5""",
)
def hotel_contradictions(spark, sf):
    found = contra.contradictions(splits(spark, sf), v.ORDER_SEGMENTS)
    return reports.hotel_contradictions(found, A_HOTEL)


SHOWN = "in ('strong', 'moderate')"


@query(
    "signal_counts",
    f"""{WITH_DRIFT} select
    count(*) filter (aspect = 'overall' and trend_dir = 'improving' and trend_tier {SHOWN}) as improving,
    count(*) filter (aspect = 'overall' and trend_dir = 'declining' and trend_tier {SHOWN}) as declining,
    count(*) filter (aspect <> 'overall' and seasonal_tier {SHOWN}) as seasonal from drift""",
)
def signal_counts(spark, sf):
    return reports.signal_counts(raw_tier_drift(spark, sf))


@query(
    "leaderboard",
    f"""{WITH_HOTELS} select row_number() over (order by shrunk_rating desc, hotel_id) as place,
    hotel_id, hotel_name, hotel_category, n_reviews, mean_rating, shrunk_rating from hotels""",
)
def leaderboard(spark, sf):
    return reports.leaderboard(hotels(spark, sf))


def _movers_sql(direction: str, order: str) -> str:
    return f"""(select hotel_id, hotel_name, trend_dir, trend_rho, trend_tier
      from drift join hotels using (hotel_id)
      where aspect = 'overall' and trend_dir = '{direction}' and trend_tier {SHOWN}
      order by trend_rho {order}, hotel_id limit 8)"""


WITH_DRIFT_HOTELS = f"{WITH_DRIFT}, {o.HOTELS.format(source='ins')}"


@query(
    "top_movers",
    f"{WITH_DRIFT_HOTELS} {_movers_sql('improving', 'desc')} union all {_movers_sql('declining', 'asc')}",
)
def top_movers(spark, sf):
    rows = order_rows(spark, sf)
    drifted, named = drift_of(rows), scoring.hotel_summary(rows)
    up = reports.top_movers(drifted, named, "improving")
    return up.unionByName(reports.top_movers(drifted, named, "declining"))


@query(
    "seasonal_alerts",
    f"""{WITH_DRIFT_HOTELS} select hotel_id, hotel_name, aspect, best_season, worst_season,
    season_gap, seasonal_tier from drift join hotels using (hotel_id)
    where aspect <> 'overall' and seasonal_tier {SHOWN}
    order by season_gap desc, hotel_id, aspect limit 12""",
)
def seasonal_alerts(spark, sf):
    rows = order_rows(spark, sf)
    return reports.seasonal_alerts(drift_of(rows), scoring.hotel_summary(rows))


@query(
    "raw_signals",
    f"""{WITH_DRIFT_HOTELS}
    (select 'seasonal' as kind, hotel_id, hotel_name, aspect, best_season as detail,
      season_gap as size, {r('kw_p', P)} as p from drift join hotels using (hotel_id)
      where aspect <> 'overall' and kw_p < 0.05e0 order by kw_p, hotel_id, aspect limit 10)
    union all
    (select 'trend', hotel_id, hotel_name, aspect, trend_dir, trend_rho, {r('trend_p', P)}
      from drift join hotels using (hotel_id)
      where aspect = 'overall' and trend_p < 0.05e0 order by trend_p, hotel_id limit 10)""",
)
def raw_signals(spark, sf):
    rows = order_rows(spark, sf)
    drifted, named = drift_of(rows), scoring.hotel_summary(rows)
    seasonal = reports.raw_seasonal_signals(drifted, named).select(
        F.lit("seasonal").alias("kind"),
        "hotel_id",
        "hotel_name",
        "aspect",
        F.col("best_season").alias("detail"),
        F.col("season_gap").alias("size"),
        rounded(F.col("kw_p"), P).alias("p"),
    )
    trend = reports.raw_trend_signals(drifted, named).select(
        F.lit("trend").alias("kind"),
        "hotel_id",
        "hotel_name",
        F.lit("overall").alias("aspect"),
        F.col("trend_dir").alias("detail"),
        F.col("trend_rho").alias("size"),
        rounded(F.col("trend_p"), P).alias("p"),
    )
    return seasonal.unionByName(trend)


@query(
    "sentiment_band",
    f"""{WITH_SUMS}, {o.SCORES} select hotel_id, aspect, raw_score,
    case when raw_score >= 0.5e0 then 'very_positive' when raw_score >= 0.15e0 then 'positive'
      when raw_score > -0.15e0 then 'neutral' when raw_score > -0.5e0 then 'negative'
      else 'very_negative' end as band from scores""",
)
def sentiment_band(spark, sf):
    return all_scores(spark, sf).select(
        "hotel_id", "aspect", "raw_score", bands.sentiment_band(F.col("raw_score")).alias("band")
    )


@query(
    "star_number",
    f"""{WITH_HOTELS} select hotel_id, hotel_category,
    cast(coalesce(try_cast(trim(string_split(hotel_category, '-')[1]) as int), 3) as bigint) as stars,
    cast(least(greatest(coalesce(try_cast(trim(string_split(city, '_')[2]) as int), 3), 0), 5)
      as bigint) as clamped from hotels""",
)
def star_number(spark, sf):
    return hotels(spark, sf).select(
        "hotel_id",
        "hotel_category",
        bands.star_number(F.col("hotel_category")).cast("bigint").alias("stars"),
        bands.star_number(F.substring_index("city", "_", -1)).cast("bigint").alias("clamped"),
    )

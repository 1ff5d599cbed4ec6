"""Monthly series, seasonal and trend tests, confidence tiers and their caveat texts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestsignal.config import DEFAULTS, OVERALL, SEASON_ORDER, Settings
from guestsignal.functions import wording
from guestsignal.functions.bands import confidence_tier
from guestsignal.functions.numbers import rounded
from guestsignal.functions.tails import chi2_tail_udf, t_two_sided_udf
from guestsignal.functions.taxonomy import DISPLAY_NAMES
from guestsignal.operators.evidence import scored_rows
from guestsignal.operators.scale import RANGE_ROWS, global_step_up, materialise, value_ranges

CELL = ("hotel_id", "aspect")


def monthly_overall(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("hotel_id", "year_month").agg(
        F.avg("rating").alias("value"), F.count(F.lit(1)).alias("n")
    )


def monthly_aspect(instances: DataFrame) -> DataFrame:
    return (
        scored_rows(instances)
        .groupBy("hotel_id", "aspect", "year_month")
        .agg(F.avg("polarity").alias("value"), F.count(F.lit(1)).alias("n"))
    )


def monthly_series(reviews: DataFrame, instances: DataFrame) -> DataFrame:
    """Unordered: sort where it is shown, or by partition where it is written."""
    overall = monthly_overall(reviews).withColumn("aspect", F.lit(OVERALL))
    return overall.unionByName(monthly_aspect(instances)).withColumn(
        "date", F.to_date(F.concat("year_month", F.lit("-01")))
    )


def test_values(reviews: DataFrame, instances: DataFrame) -> DataFrame:
    """Polarity rows and rating rows in one shape."""
    polarity = scored_rows(instances).select(
        *CELL, F.col("polarity").cast("double").alias("value"), "season", "review_date"
    )
    rating = reviews.select(
        "hotel_id",
        F.lit(OVERALL).alias("aspect"),
        F.col("rating").cast("double").alias("value"),
        "season",
        "review_date",
    )
    return polarity.unionByName(rating)


def values_in_one_pass(rows: DataFrame) -> DataFrame:
    """test_values(rows, rows) for rows that are not stored: what makes them runs once."""
    own = F.col("_part") == 0
    return (
        rows.withColumn("_part", F.explode(F.array(F.lit(0), F.lit(1))))
        .filter(~own | ~F.col("is_general"))
        .select(
            "hotel_id",
            F.when(own, F.col("aspect")).otherwise(OVERALL).alias("aspect"),
            F.when(own, F.col("polarity").cast("double"))
            .otherwise(F.col("rating").cast("double"))
            .alias("value"),
            "season",
            "review_date",
        )
    )


def tie_blocks(values: DataFrame, with_day: bool = True) -> DataFrame:
    """Equal (cell, season, day, value) rows as one row with a count.

    The one shuffle of raw rows, with partial aggregation in front of it. All statistics
    below read these blocks; the day fixes the season, so both tests can share them. The
    null filter is the one the later joins imply: with it up here, all readers have the
    same plan below the shuffle and Spark can run it once.
    """
    complete = [F.col(c).isNotNull() for c in (*CELL, "value", "review_date")]
    day = [F.col("review_date").alias("day")] if with_day else []
    return (
        values.filter(reduce(and_, complete))
        .groupBy(*CELL, "season", *day, "value")
        .agg(F.count(F.lit(1)).alias("t"))
    )


def _value_ranks(
    blocks: DataFrame, seasons: tuple[str, ...], minimum: int, bounded: bool, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """One row per (cell, value): counts t_i and cell totals n_i per season, the mid-rank
    among all rows (`mid`) and among rows of seasons with enough of them (`kw_mid`), both
    counted from the middle of the cell.

    With `bounded` a cell has few distinct values (polarity has four decimals, a rating
    is 1..5) and one window per cell ranks them. Without, the values of a large cell are cut
    into ranges at its own quantiles, ranked inside their range and moved up by the rows in
    lower ranges, so that no task holds all values of a hot cell. Both are exact.
    """
    index = range(len(seasons))
    per_season = [
        F.sum(F.when(F.col("season") == s, F.col("t")).otherwise(0)).alias(f"t_{i}")
        for i, s in enumerate(seasons)
    ]
    values = blocks.groupBy(*CELL, "value").agg(*per_season)
    cell = W.partitionBy(*CELL)
    totals = {f"n_{i}": F.sum(f"t_{i}").over(cell) for i in index}
    if bounded:
        up_to = cell.orderBy("value").rowsBetween(W.unboundedPreceding, -1)
        before = {f"b_{i}": _or_zero(F.sum(f"t_{i}").over(up_to)) for i in index}
        ranked = values.withColumns(totals | before)
    else:
        placed = value_ranges(
            materialise(values, "values"), list(CELL), "value", range_rows=range_rows
        )
        sizes = placed.groupBy(*CELL, "_range").agg(
            *[F.sum(f"t_{i}").alias(f"t_{i}") for i in index]
        )
        earlier = cell.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        offsets = {f"o_{i}": _or_zero(F.sum(f"t_{i}").over(earlier)) for i in index}
        inside = W.partitionBy(*CELL, "_range").orderBy("value")
        up_to = inside.rowsBetween(W.unboundedPreceding, -1)
        local = {f"l_{i}": _or_zero(F.sum(f"t_{i}").over(up_to)) for i in index}
        ranked = (
            placed.withColumns(local)
            .join(
                sizes.withColumns(totals | offsets).drop(*[f"t_{i}" for i in index]),
                [*CELL, "_range"],
            )
            .withColumns({f"b_{i}": F.col(f"o_{i}") + F.col(f"l_{i}") for i in index})
        )
    enough = lambda i, c: F.when(F.col(f"n_{i}") >= minimum, F.col(c)).otherwise(0)
    add = lambda columns: sum(columns[1:], columns[0])
    centred = lambda before, ties, n: F.col(before) + (F.col(ties) - F.col(n)) / 2.0
    return ranked.withColumns(
        {
            "tie": add([F.col(f"t_{i}") for i in index]),
            "kw_tie": add([enough(i, f"t_{i}") for i in index]),
            "n": add([F.col(f"n_{i}") for i in index]),
            "kw_n": add([enough(i, f"n_{i}") for i in index]),
            "mid": add([F.col(f"b_{i}") for i in index]),
            "kw_mid": add([enough(i, f"b_{i}") for i in index]),
        }
    ).withColumns(
        {"mid": centred("mid", "tie", "n"), "kw_mid": centred("kw_mid", "kw_tie", "kw_n")}
    )


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def _seasonal(ranks: DataFrame, seasons: tuple[str, ...], minimum: int) -> DataFrame:
    """Kruskal-Wallis over the seasons with enough rows, and the extreme seasons.

    H is the share of the ranks' squares that lies between seasons, times rows less one. Ranks
    counted from the middle keep large cells from cancelling digits, and ties need no correction.
    """
    index = range(len(seasons))
    tested = F.col("kw_tie") > 0
    sums = ranks.groupBy(*CELL).agg(
        F.first("n").alias("n"),
        F.first("kw_n").alias("_total"),
        *[F.first(f"n_{i}").alias(f"n_{i}") for i in index],
        *[F.sum(F.col(f"t_{i}") * F.col("kw_mid")).alias(f"r_{i}") for i in index],
        *[F.sum(F.col(f"t_{i}") * F.col("value")).alias(f"v_{i}") for i in index],
        F.sum(F.col("kw_tie") * F.pow(F.col("kw_mid"), F.lit(2))).alias("_all"),
        (
            F.max(F.when(tested, F.col("value"))) - F.min(F.when(tested, F.col("value")))
        ).alias("_spread"),
        F.count_if((F.col("tie") > 0)).alias("n_values"),
        F.sum(F.col("tie") * F.pow(F.col("mid"), F.lit(2))).alias("value_ss"),
    )
    has = {i: F.col(f"n_{i}") >= minimum for i in index}
    between = sum(
        (
            F.when(has[i], F.pow(F.col(f"r_{i}"), F.lit(2)) / F.col(f"n_{i}")).otherwise(0.0)
            for i in index
        ),
        F.lit(0.0),
    )
    means = F.array_compact(
        F.array(
            *[
                F.when(
                    has[i],
                    F.struct(
                        F.round(F.col(f"v_{i}") / F.col(f"n_{i}"), 10).alias("mean"),
                        F.lit(i).alias("place"),
                        F.lit(s).alias("season"),
                    ),
                )
                for i, s in enumerate(seasons)
            ]
        )
    )
    backwards = F.transform(
        "_means", lambda m: F.struct(m["mean"], -m["place"], m["season"].alias("season"))
    )
    two = F.size("_means") >= 2
    best, worst = F.array_max(backwards), F.array_min("_means")
    gap = best.getField("mean") - worst["mean"]
    varied = two & (F.col("_spread") > 1e-9)
    return (
        sums.withColumns({"_between": between, "_means": means})
        .withColumn("n_seasons", F.size("_means"))
        .withColumn(
            "kw_h", F.when(varied, (F.col("_total") - 1) * F.col("_between") / F.col("_all"))
        )
        .select(
            *CELL,
            "n",
            "n_seasons",
            "kw_h",
            F.when(two, best["season"]).alias("best_season"),
            F.when(two, worst["season"]).alias("worst_season"),
            F.when(two, rounded(gap, 4)).alias("season_gap"),
            "n_values",
            "value_ss",
        )
    )


def _trend(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Sums for Spearman's rho: value ranks first meet the blocks, then add up per day."""
    per_day = (
        blocks.join(ranks.select(*CELL, "value", "mid"), [*CELL, "value"])
        .groupBy(*CELL, "day")
        .agg(F.sum("t").alias("t"), F.sum(F.col("t") * F.col("mid")).alias("ranks"))
    )
    cell = W.partitionBy(*CELL)
    before = _or_zero(
        F.sum("t").over(cell.orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    )
    centre = (F.sum("t").over(cell) + 1) / 2.0
    off_day = F.col("_day_rank") - F.col("_centre")
    return (
        per_day.withColumns(
            {"_day_rank": before + (F.col("t") + 1) / 2.0, "_centre": centre}
        )
        .groupBy(*CELL)
        .agg(
            F.sum(off_day * F.col("ranks")).alias("cross"),
            F.sum(F.col("t") * off_day * off_day).alias("day_ss"),
        )
    )


def _kw_p() -> Column:
    return chi2_tail_udf("kw_h", (F.col("n_seasons") - 1).cast("double"))


def seasonal_tests(
    values: DataFrame,
    seasons: tuple[str, ...] = SEASON_ORDER,
    settings: Settings = DEFAULTS,
    bounded_values: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The seasonal half of drift_tests alone; it does not need the days."""
    blocks = tie_blocks(values, with_day=False)
    ranks = _value_ranks(blocks, seasons, settings.min_per_season, bounded_values, range_rows)
    found = _seasonal(ranks, seasons, settings.min_per_season)
    return found.withColumn("kw_p", _kw_p()).drop("n_values", "value_ss")


def drift_tests(
    values: DataFrame,
    seasons: tuple[str, ...] = SEASON_ORDER,
    settings: Settings = DEFAULTS,
    bounded_values: bool = True,
    range_rows: int = RANGE_ROWS,
    store_ties: bool = False,
) -> DataFrame:
    """Both tests per (hotel, aspect), before correction for their number. With `store_ties` the tie
    blocks, which ranks and days read, are stored: for values that are dear to make twice."""
    blocks = materialise(tie_blocks(values), "ties") if store_ties else tie_blocks(values)
    ranks = _value_ranks(blocks, seasons, settings.min_per_season, bounded_values, range_rows)
    seasonal = _seasonal(ranks, seasons, settings.min_per_season)
    both = seasonal.join(_trend(blocks, ranks), [*CELL])
    enough = (F.col("n") >= settings.min_for_trend) & (F.col("n_values") > 1)
    spread = F.sqrt(F.col("day_ss")) * F.sqrt(F.col("value_ss"))
    clipped = F.greatest(F.least(F.col("cross") / spread, F.lit(1.0)), F.lit(-1.0))
    rho = F.when(enough & (spread > 0), F.round(clipped, 12))
    return (
        both.withColumn("_rho", rho)
        .withColumn("kw_p", _kw_p())
        .withColumn("trend_p", t_two_sided_udf("_rho", F.col("n").cast("double")))
        .select(
            *CELL,
            "n",
            "n_seasons",
            "kw_h",
            "kw_p",
            "best_season",
            "worst_season",
            "season_gap",
            rounded(F.col("_rho"), 4).alias("trend_rho"),
            "trend_p",
            F.when(F.col("_rho") > 0, "improving")
            .when(F.col("_rho").isNotNull(), "declining")
            .alias("trend_dir"),
        )
    )


def adjust_for_many_tests(tests: DataFrame, p: str, name: str) -> DataFrame:
    """Benjamini-Hochberg over the rows whose p is not null."""
    tested = global_step_up(tests.filter(F.col(p).isNotNull()), p, list(CELL), name)
    rest = tests.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    return tested.select(*rest.columns).unionByName(rest)


def drift_table(tests: DataFrame) -> DataFrame:
    """Adjusted p-values and tiers. Give it written or checkpointed tests: it reads them
    several times and the p-values must not change between the reads."""
    adjusted = materialise(adjust_for_many_tests(tests, "kw_p", "kw_adj_p"), "adjusted")
    adjusted = adjust_for_many_tests(adjusted, "trend_p", "trend_adj_p")
    return adjusted.withColumns(
        {
            "seasonal_tier": confidence_tier(F.col("kw_adj_p")),
            "trend_tier": confidence_tier(F.col("trend_adj_p")),
        }
    )


def shown_name(aspect: Column, names: dict[str, str] = DISPLAY_NAMES) -> Column:
    if not names:
        return aspect
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, aspect), aspect)


def seasonal_caveat(names: dict[str, str] = DISPLAY_NAMES) -> Column:
    shown = F.col("seasonal_tier").isin("strong", "moderate", "weak") & (
        F.col("aspect") != OVERALL
    )
    text = F.format_string(
        wording.SEASON_CAVEAT,
        shown_name(F.col("aspect"), names),
        F.col("best_season"),
        F.col("worst_season"),
        F.col("seasonal_tier"),
    )
    return F.when(shown, text)


def trend_caveat(names: dict[str, str] = DISPLAY_NAMES) -> Column:
    shown = (
        F.col("trend_tier").isin("strong", "moderate", "weak") & F.col("trend_dir").isNotNull()
    )
    name = F.when(F.col("aspect") == OVERALL, wording.OVERALL_NAME).otherwise(
        shown_name(F.col("aspect"), names)
    )
    text = F.format_string(
        wording.TREND_CAVEAT,
        name,
        F.col("trend_dir"),
        F.col("trend_tier"),
    )
    return F.when(shown, text)

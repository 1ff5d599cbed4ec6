from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from guestsignal.functions.bands import sentiment_band, star_number
from guestsignal.operators import reports, search, sentences

INSTANCES = ("review_id string, hotel_id string, hotel_name string, sentence_text string, aspect string, "
             "polarity double, review_date date, verified boolean, recency_weight double")


def test_search(spark):
    day = dt.date(2025, 1, 1)
    rows = [("1", "h", "H", "near", "a", 0.1, day, True, 0.5), ("2", "h", "H", "near", "a", 0.1, day, True, 0.9),
            ("3", "g", "G", "near", "b", 0.1, day, True, 0.7), ("4", "h", "H", "far", "general", 0.1, day, True, 1.0),
            ("5", "h", "H", "opposite", "a", 0.1, day, True, 1.0), ("6", "h", "H", "no vector", "a", 0.1, day, True, 1.0)]
    instances = spark.createDataFrame(rows, INSTANCES)
    vectors = spark.createDataFrame([("near", [1.0, 0.0]), ("far", [0.6, 0.8]), ("opposite", [0.0, -1.0])],
                                    "sentence_text string, embedding array<float>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    found = search.search(instances, vectors, query).collect()
    assert [(r.review_id, r.similarity) for r in found] == [("2", 1.0), ("4", 0.6)]
    ids = lambda **f: [r.review_id for r in search.search(instances, vectors, query, **f).collect()]
    index = search.search_index(instances)
    assert index.count() == 5
    for filters in ({}, {"hotel_id": "g"}, {"aspect": "general"}):
        assert search.search(index, vectors, query, **filters).collect() == search.search(
            instances, vectors, query, **filters).collect()
    assert ids(hotel_id="g") == ["3"] and ids(aspect="b") == ["3"] and ids(k=1) == ["2"]


def test_search_widens_until_its_answer_is_proven(spark):
    """Equal similarities beyond the candidates, a filter that only far sentences pass, full similarity in the order."""
    day = dt.date(2025, 1, 1)
    names = [f"s{i:03}" for i in range(200)]
    sims = [1.0 - i * 1e-9 if i < 50 else 0.5 for i in range(200)]
    rows = [(str(i), "rare" if i >= 195 else "h", "H", s, "a", 0.1, day, True, 0.5 + i / 1000) for i, s in enumerate(names)]
    instances = spark.createDataFrame(rows, INSTANCES)
    vectors = spark.createDataFrame([(s, [x, 0.0]) for s, x in zip(names, sims)], "sentence_text string, embedding array<double>")
    query = F.array(F.lit(1.0), F.lit(0.0))
    ids = lambda **f: [int(r.review_id) for r in search.search(instances, vectors, query, **f).collect()]
    assert ids(k=4, candidates=4) == [0, 1, 2, 3]  # would tie if similarity were rounded
    assert ids(k=52, candidates=60) == [*range(50), 199, 198]  # the tie at 0.5 reaches beyond 60 candidates
    assert ids(k=3, candidates=10, hotel_id="rare") == [199, 198, 197]
    assert ids(k=9, hotel_id="nobody") == []


def test_search_by_text(spark):
    day = dt.date(2025, 1, 1)
    rows = [("1", "h", "H", "long sentence", "a", 0.1, day, True, 0.5), ("2", "h", "H", "short", "a", 0.1, day, True, 0.5)]
    instances = spark.createDataFrame(rows, INSTANCES)
    load = lambda: lambda texts: [[float(len(t)), 5.0] for t in texts]
    vectors = search.embed_sentences(instances, load)
    found = search.search_text(instances, vectors, "brief", load, k=1).collect()
    assert [r.review_id for r in found] == ["2"] and found[0].similarity == 1.0


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 7).alias("part"), F.concat(F.lit("s"), F.col("id") % 20_000).alias("sentence_text"))
    sketches = sentences.sentence_sketches(rows, "part")
    merged = sentences.merged_stats(sketches).first()
    assert merged.n_instances == 60_000
    assert abs(merged.n_unique - 20_000) < 3 * 1.04 / 2**6 * 20_000
    exact = sentences.corpus_stats(rows, rows).first()
    assert (exact.n_reviews, exact.n_instances, exact.n_unique) == (60_000, 60_000, 20_000)


def test_bands_and_stars(spark):
    values = [0.5, 0.15, 0.149, -0.149, -0.15, -0.5]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(sentiment_band(F.col("v"))).collect()] == [
        "very_positive", "positive", "neutral", "neutral", "negative", "very_negative"]
    cats = spark.createDataFrame([("4-star",), ("boutique",), ("9-star",), (None,)], "c string")
    assert [r[0] for r in cats.select(star_number(F.col("c"))).collect()] == [4, 3, 5, 3]


DRIFT = ("hotel_id string, aspect string, trend_dir string, trend_rho double, trend_tier string, trend_p double, "
         "seasonal_tier string, season_gap double, best_season string, worst_season string, kw_p double")


def test_signals(spark):
    drift = spark.createDataFrame([
        ("a", "overall", "improving", 0.4, "strong", 0.01, "strong", 0.1, "x", "y", 0.2),
        ("b", "overall", "declining", -0.4, "weak", 0.04, "none", None, None, None, None),
        ("a", "safety", "declining", -0.9, "strong", 0.001, "moderate", 0.7, "x", "y", 0.03)], DRIFT)
    hotels = spark.createDataFrame([("a", "A"), ("b", "B")], "hotel_id string, hotel_name string")
    assert tuple(reports.signal_counts(drift).first()) == (1, 0, 1)
    assert [r.hotel_name for r in reports.top_movers(drift, hotels, "improving").collect()] == ["A"]
    assert reports.top_movers(drift, hotels, "declining").count() == 0
    assert [r.season_gap for r in reports.seasonal_alerts(drift, hotels).collect()] == [0.7]
    assert [r.hotel_id for r in reports.raw_trend_signals(drift, hotels).collect()] == ["a", "b"]
    assert [r.aspect for r in reports.raw_seasonal_signals(drift, hotels).collect()] == ["safety"]


def test_embedding_hook_gives_unit_vectors(spark):
    table = spark.createDataFrame([("ab",), ("abcd",)], "sentence_text string")
    found = search.embed_sentences(table, lambda: lambda texts: [[float(len(t)), 0.0, 2.0] for t in texts])
    for row in found.collect():
        size = len(row.sentence_text)
        assert [round(x, 5) for x in row.embedding] == [
            round(x / (size**2 + 4) ** 0.5, 5) for x in (size, 0, 2)]

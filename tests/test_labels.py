from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from guestsignal.functions.taxonomy import DEFAULT_LEXICON
from guestsignal.functions.text import split_sentences
from guestsignal.operators import evidence, labels, sentences


def split(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(split_sentences(F.col("t"))).first()[0]


def test_sentence_split(spark):
    assert split(spark, "A b.  C? d! e") == ["A b.", "C?", "d!", "e"]
    assert split(spark, "no mark") == ["no mark"]
    assert split(spark, "Only 3.5 stars. Ok") == ["Only 3.5 stars.", "Ok"]
    assert split(spark, "") == [""]


def test_instances_keep_positions(spark):
    reviews = spark.createDataFrame([("r", "One. Two! Three?")], "review_id string, review_text string")
    rows = sentences.sentence_instances(reviews, ("review_id",)).collect()
    assert [(r.sentence_pos, r.sentence_text) for r in rows] == [
        (0, "One."), (1, "Two!"), (2, "Three?")]


def test_threshold_is_inclusive_and_ordered(spark):
    rows = [({"b": 0.50, "a": 0.9},), ({"a": 0.49},), ({},)]
    table = spark.createDataFrame(rows, "s map<string,double>")
    found = table.select(labels.threshold_aspects(F.col("s"), ("a", "b")).alias("x")).collect()
    assert [r.x for r in found] == [["a", "b"], ["general"], ["general"]]


def test_polarity_with_a_missing_side(spark):
    table = spark.createDataFrame([({"positive": 0.7},), ({"negative": 0.2, "positive": 0.1},)],
                                  "s map<string,double>")
    assert [r[0] for r in table.select(labels.polarity_of(F.col("s"))).collect()] == [0.7, -0.1]


LABELS = "sentence_text string, aspects array<string>, polarity double"


def base_labels(spark):
    return spark.createDataFrame(
        [("s1", ["a"], 0.1), ("s2", ["a"], 0.2), ("s3", ["a"], 0.3)], LABELS)


def overrides(spark, rows):
    return spark.createDataFrame(
        rows, "sentence_text string, aspects string, polarity double, reason string")


def test_overrides(spark):
    table = overrides(spark, [("s1", " b|c ", None, "x"), ("s2", " ", -0.5, "y"), ("zz", "b", 1.0, "z")])
    out = {r.sentence_text: (r.aspects, r.polarity, r.overridden)
           for r in labels.apply_overrides(base_labels(spark), table).collect()}
    assert out == {"s1": (["b", "c"], 0.1, True), "s2": (["a"], -0.5, True), "s3": (["a"], 0.3, False)}
    audit = labels.override_audit(labels.apply_overrides(base_labels(spark), table), table)
    assert {r.reason: r.n_overridden for r in audit.collect()} == {"x": 1, "y": 1}


def test_repeated_override_raises(spark):
    table = overrides(spark, [("s1", "b", None, "x"), ("s1", "c", None, "y")])
    with pytest.raises(ValueError, match="s1"):
        labels.apply_overrides(base_labels(spark), table)


def test_overrides_of_instances_need_no_shuffle_and_both_ways_agree(spark):
    texts = ["hot"] * 300 + [f"s{i}" for i in range(40)]
    inst = instances(spark, texts).withColumns({"aspects": F.array(F.lit("a")), "polarity": F.lit(0.1)})
    table = overrides(spark, [("hot", "b", 0.9, "x"), ("s3", None, -0.5, "y"), ("absent", "c", None, "z")])
    key = ["review_id", "sentence_pos"]
    near = labels.apply_overrides(inst, table, key)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    far = labels.apply_overrides(inst, table, key, broadcast_bytes=0)
    columns = ["review_id", "sentence_text", "aspects", "polarity", "overridden"]
    assert sorted(near.select(columns).collect()) == sorted(far.select(columns).collect())
    assert near.filter("overridden").count() == 301


def instances(spark, texts):
    rows = [(f"r{i}", 0, t, 0.5, 0.8) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "review_id string, sentence_pos int, sentence_text string, "
              "recency_weight double, trust_weight double")


def test_unlabelled_sentences_are_found_and_count_as_filler(spark):
    inst = instances(spark, ["s1", "s1", "new"])
    assert [r[0] for r in labels.unlabelled_sentences(inst, base_labels(spark)).collect()] == ["new"]
    rows = evidence.aspect_instances(evidence.join_labels(inst, base_labels(spark))).collect()
    assert sorted((r.sentence_text, r.aspect, r.polarity, r.is_general) for r in rows) == [
        ("new", "general", 0.0, True), ("s1", "a", 0.1, False), ("s1", "a", 0.1, False)]
    assert {round(r.weight, 9) for r in rows} == {0.4}


def test_in_place_labels_equal_joined_labels(spark):
    texts = ["Great staff and a clean room.", "The bar was noisy.", "Hello there.", "Great staff and a clean room."]
    inst = instances(spark, texts)
    scorer = labels.lexicon_scorer(DEFAULT_LEXICON)
    once = labels.label_sentences(sentences.distinct_sentences(inst), scorer)
    columns = ["review_id", "aspect", "polarity"]
    joined = evidence.aspect_instances(evidence.join_labels(inst, once)).select(columns)
    placed = evidence.aspect_instances(evidence.label_in_place(inst, scorer)).select(columns)
    assert sorted(joined.collect()) == sorted(placed.collect())
    assert {r.aspect for r in placed.collect()} >= {"service", "cleanliness", "nightlife", "general"}


def test_model_hook_sees_only_new_sentences(spark):
    def load():
        def predict(texts):
            return pd.DataFrame({"aspect_scores": [{"value": 0.9}] * len(texts),
                                 "sentiment": [{"positive": 0.75, "negative": 0.5}] * len(texts)})
        return predict

    inst = instances(spark, ["s1", "fresh"])
    out = labels.extend_labels(inst, base_labels(spark), labels.pandas_scorer(load))
    rows = {r.sentence_text: (r.aspects, r.polarity) for r in out.collect()}
    assert rows["fresh"] == (["value"], 0.25) and rows["s1"] == (["a"], 0.1)


def test_packed_scores_round_trip(spark):
    table = spark.createDataFrame([({"a": 0.98, "b": 0.01},)], "s map<string,double>")
    packed = table.select(labels.pack_scores(F.col("s"), ("a", "b")).alias("p"))
    assert packed.first().p == "a:0.98;b:0.01"
    assert packed.select(labels.unpack_scores(F.col("p"))).first()[0] == {"a": 0.98, "b": 0.01}

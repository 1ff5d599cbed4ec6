from __future__ import annotations

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from guestsignal.operators import ingest, labels
from guestsignal.plans.build import build, run_summary
from guestsignal.sources import files

GOOD = ["Great staff and excellent service.", "The room was clean and quiet.", "Good value, great breakfast.",
        "We felt safe and the area is central.", "Lovely beach and perfect spa."]
BAD = ["The staff was rude.", "Our room was dirty and noisy.", "Overpriced and slow breakfast.", "The bar was loud."]


def reviews(n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        hotel = rng.randint(1, 6)
        rows.append({
            "review_id": f"r{i}", "hotel_id": f"h{hotel}", "hotel_name": f"Hotel{hotel}, City{hotel % 3}",
            "hotel_category": f"{3 + hotel % 3}-star", "rating": rng.randint(1, 5),
            "review_date": str(dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 700))),
            "review_text": " ".join(rng.sample(GOOD, 2) + rng.sample(BAD, rng.randint(0, 1)) + ["We stayed two nights."]),
            "verified": rng.random() < 0.6, "traveler_type": rng.choice(["solo", "family", None])})
    return rows


PROFILES = [{"profile_id": "P1", "description": "Solo traveler who wants safe, quiet and clean rooms on a tight budget."},
            {"profile_id": "P2", "description": "Couple who love the beach and a spa, no object."},
            {"profile_id": "P3", "description": "Nothing in particular."}]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    (root / "reviews.json").write_text(json.dumps(reviews()))
    (root / "profiles.json").write_text("\n".join(json.dumps(p) for p in PROFILES))
    raw = files.read_reviews(spark, str(root / "reviews.json"), json_array=True)
    people = files.read_profiles(spark, str(root / "profiles.json"))
    out = str(root / "out")
    assert not files.artifacts_exist(spark, out)
    return raw, people, out, build(raw, people, out)


def test_tables_and_reload(spark, world):
    _, _, out, tables = world
    assert files.artifacts_exist(spark, out)
    again = files.load_artifacts(spark, out)
    assert {n: again[n].count() for n in again} == {n: tables[n].count() for n in again}
    assert spark.read.json(out + "/profiles_json").count() == 3
    summary = run_summary(tables).first().asDict()
    assert summary["n_reviews"] == 400 and summary["n_hotels"] == 6 and summary["n_profiles"] == 3
    assert "year" in again["instances"].columns


def test_outputs(spark, world):
    out = world[2] + "/outputs"
    submission = {r.profile_id: r for r in files.load_submission(spark, out).collect()}
    assert set(submission) == {"P1", "P2"}  # without dimensions there are no quotes
    ranks = [h["rank"] for h in submission["P1"].top_hotels]
    assert ranks == sorted(ranks) and 1 <= len(ranks) <= 5
    rich = files.load_rich_output(spark, out, "P1").first()
    assert [r["rank"] for r in rich.recommendations] == ranks
    for r in rich.recommendations:
        assert 1 <= len(r.supporting_evidence) <= 3 and r.hotel_name in r.justification
        assert len({e.quote for e in r.supporting_evidence}) == len(r.supporting_evidence)
    assert files.load_rich_output(spark, out, "P9").count() == 0
    assert files.load_rich_output(spark, world[2] + "/nowhere", "P1").count() == 0


def test_result_does_not_depend_on_the_partitioning(spark, world, tmp_path):
    raw, people, out, tables = world
    other = build(raw.repartition(13), people, str(tmp_path / "again"))
    for name in ("scores", "hotels", "contradictions", "drift"):
        drop = [c for c in ("kw_h", "kw_p", "kw_adj_p", "trend_p", "trend_adj_p") if c in tables[name].columns]
        rows = [sorted(t[name].drop(*drop).collect(), key=str) for t in (tables, other)]
        assert rows[0] == rows[1]


def test_model_scorer_runs_once_per_sentence(spark, world, tmp_path):
    def load():
        def predict(texts):
            scores = [{"service": 0.9} if "staff" in t else {"value": 0.2} for t in texts]
            return pd.DataFrame({"aspect_scores": scores, "sentiment": [{"positive": 0.8}] * len(texts)})
        return predict

    raw, people, root = world[0], world[1], str(tmp_path / "model")
    tables = build(raw, people, root, scorer=labels.pandas_scorer(load))
    stored = spark.read.parquet(root + "/labels_auto")
    assert stored.count() == stored.select("sentence_text").distinct().count() == 10
    assert {r.aspect for r in tables["instances"].select("aspect").distinct().collect()} == {"service", "general"}
    build(raw, people, root, scorer=labels.pandas_scorer(load))
    assert spark.read.parquet(root + "/labels_auto").count() == 10


def test_csv_edges(spark, tmp_path):
    table = spark.createDataFrame([('He said "hi", twice.', ["a", "b"], 0.5, 0.9, {"a": 0.9, "b": 0.6})],
                                  "sentence_text string, aspects array<string>, polarity double, "
                                  "top_aspect_score double, aspect_scores map<string,double>")
    path = str(tmp_path / "labels")
    files.write_labels_csv(table, path, ("a", "b"))
    assert files.read_labels_csv(spark, path).collect() == table.collect()
    assert files.read_overrides(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "o.csv").write_text('sentence_text,aspects,polarity,reason\n"a, b",x|y,,why\nc,,-0.5,tone\n')
    rows = {r.sentence_text: (r.aspects, r.polarity) for r in files.read_overrides(spark, str(tmp_path / "o.csv")).collect()}
    assert rows == {"a, b": ("x|y", None), "c": (None, -0.5)}


def test_reader_names_missing_fields(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"review_id": "1"}))
    with pytest.raises(ValueError, match="hotel_id"):
        files.read_reviews(spark, str(tmp_path / "r.json"))


def test_damaged_records_are_kept_apart(spark, tmp_path):
    """A line cut off in the middle and one that is no JSON are reported with their text."""
    good = reviews(20)
    lines = [json.dumps(r) for r in good]
    cut, noise = lines[7][:60], "no json at all"
    (tmp_path / "r.json").write_text("\n".join([*lines[:7], cut, *lines[8:], noise]))
    raw = files.read_reviews(spark, str(tmp_path / "r.json"))
    assert {r.review_id for r in ingest.clean_reviews(raw).collect()} == {r["review_id"] for r in good} - {"r7"}
    assert "damaged_record" not in ingest.clean_reviews(raw).columns
    rejected = ingest.rejected_reviews(raw).collect()
    assert {(r.damaged_record, r.reject_reason) for r in rejected} == {
        (cut, "damaged record"), (noise, "damaged record")}
    (tmp_path / "p.json").write_text('{"profile_id": "P1", "description": "x"}\n{"profile_id": "P2", "descr')
    assert [r.profile_id for r in ingest.load_profiles(files.read_profiles(spark, str(tmp_path / "p.json"))).collect()] == ["P1"]


def test_missing_fields_are_found_in_one_pass(spark, tmp_path):
    """No record has all fields, but each field is in some record: nothing is missing."""
    one, other = dict(reviews(1)[0]), dict(reviews(1)[0])
    del one["rating"], other["verified"]
    (tmp_path / "r.json").write_text(json.dumps(one) + "\n" + json.dumps(other))
    assert files.read_reviews(spark, str(tmp_path / "r.json")).count() == 2
    del other["rating"]
    (tmp_path / "s.json").write_text(json.dumps(one) + "\n" + json.dumps(other))
    with pytest.raises(ValueError, match=r"\['rating'\]"):
        files.read_reviews(spark, str(tmp_path / "s.json"))


RICH = ("profile_id string, archetype string, profile_summary string, desired_dims array<string>, recommendations "
        "array<struct<rank:int,hotel_id:string,hotel_name:string,hotel_category:string,score:double,"
        "justification:string,supporting_evidence:array<struct<review_id:string,quote:string,aspect:string,"
        "date:string,verified:boolean,sentiment:double>>>>")


def rich(spark, profile_id, justification="j"):
    pick = (1, "h", "H", "3-star", 4.0, justification, [("r", "q", "a", "2025-01-01", True, 0.5)])
    return spark.createDataFrame([(profile_id, "x", "s", ["a"], [pick])], RICH)


def test_publishing_changes_all_outputs_or_none(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    files.write_outputs(rich(spark, "old"), root)
    shown = lambda: (
        files.load_rich_output(spark, root, "old").count(), files.load_rich_output(spark, root, "new").count(),
        [r.profile_id for r in files.load_submission(spark, root).collect()])
    assert shown() == (1, 0, ["old"])
    with pytest.raises(ValueError):  # breaks the contract
        files.write_outputs(rich(spark, "new", "long " * 400), root)
    assert shown() == (1, 0, ["old"])
    with monkeypatch.context() as dies:  # dies between the lookup table and the submission
        dies.setattr(files, "submission_output", lambda stored: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            files.write_outputs(rich(spark, "new"), root)
    assert shown() == (1, 0, ["old"])
    files.write_outputs(rich(spark, "new"), root)
    assert shown() == (0, 1, ["new"])


def counting_embedder(log):
    """Vectors of sentences; each sentence that is encoded leaves a line in a file."""
    def load():
        def encode(texts):
            with open(log, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]
        return encode
    return load


def test_embedding_store_grows_by_new_sentences(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "store")
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "sentence_text string")
    first = files.add_embeddings(spark, root, frame(["a", "bb", "bb"]), counting_embedder(str(log)))
    assert sorted(r.sentence_text for r in first.collect()) == ["a", "bb"]
    files.add_embeddings(spark, root, frame(["bb", "ccc", "a"]), counting_embedder(str(log)))
    assert sorted(log.read_text().split()) == ["a", "bb", "ccc"]
    before = sorted(files.read_embeddings(spark, root).collect(), key=str)
    folder = files.current_version(spark, root)
    spark.read.parquet(folder).write.mode("append").parquet(folder)  # what two runs at once may leave
    assert sorted(files.read_embeddings(spark, root).collect(), key=str) == before
    files.compact_embeddings(spark, root)
    assert files.current_version(spark, root) != folder
    assert spark.read.parquet(files.current_version(spark, root)).count() == 3
    assert sorted(files.read_embeddings(spark, root).collect(), key=str) == before


def test_second_build_embeds_only_new_sentences_and_thin_profiles_get_dims(spark, world, tmp_path):
    """Descriptions and descriptors go through the same encoder; profiles are JSON without vectors."""
    raw, root, log = world[0], str(tmp_path / "run"), tmp_path / "log"

    def load():
        def encode(texts):
            with open(log, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return [[1.0, 0.0] if "stroll" in t or "step" in t else [0.0, 1.0] for t in texts]
        return encode

    (tmp_path / "p.json").write_text(json.dumps({"profile_id": "T1", "description": "Likes to stroll about"}) + "\n"
                                     + json.dumps({"profile_id": "T2", "description": "Wants safe, quiet and clean rooms"}))
    people = files.read_profiles(spark, str(tmp_path / "p.json"))
    phrases = spark.createDataFrame([("location_central", "a step from everything")], "aspect string, phrase string")
    tables = build(raw, people, root, embedder=load, descriptors=phrases)
    found = {r.profile_id: (r.embedding_dims, r.desired_dims) for r in tables["profiles"].collect()}
    assert found["T1"] == (["location_central"], ["location_central"]) and found["T2"][0] == []
    seen = log.read_text().splitlines()
    assert "Likes to stroll about" in seen and not any("Wants safe" in s for s in seen)
    sentences = {r.sentence_text for r in tables["instances"].select("sentence_text").distinct().collect()}
    assert {r.sentence_text for r in tables["embeddings"].collect()} == sentences
    log.write_text("")
    extra = raw.limit(1).withColumns({"review_id": F.lit("fresh"), "review_text": F.lit("A sentence nobody wrote before.")})
    build(raw.unionByName(extra), people, root, embedder=load, descriptors=phrases, drift_caveats=True)
    again = set(log.read_text().splitlines())
    assert again - {"Likes to stroll about", "a step from everything"} == {"A sentence nobody wrote before."}


def test_embeddings_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("s", [0.6, 0.8])], "sentence_text string, embedding array<float>")
    files.write_embeddings(table, str(tmp_path / "e"))
    assert files.read_embeddings(spark, str(tmp_path / "e")).collect() == table.collect()

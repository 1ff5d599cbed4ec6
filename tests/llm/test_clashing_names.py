"""Input columns with the names that operators use inside come back as they were."""

from __future__ import annotations

import random

from guestsignal.llm import op4_decontamination, op5_mixing, op8_ngram_jaccard_join

SCHEMA = "doc_id bigint, text string, source string, _id string, _th bigint, id string, th string, row string, full string"
ODD = ("keepA", 1, "keepB", "keepC", "keepD", "keepE")


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_keep_one_and_decontaminate(spark):
    item = words(1, 40)
    texts = [words(2, 60), words(2, 60), f"{words(3, 30)} {item} {words(4, 30)}", "", None, words(5, 50)]
    docs = spark.createDataFrame([(i, t, "s", *ODD) for i, t in enumerate(texts)], SCHEMA)
    kept = op8_ngram_jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: tuple(r)[3:] for r in kept.collect()}
    assert rows == {i: ODD for i in (0, 2, 3, 4, 5)}
    benchmark = spark.createDataFrame([(1, item, "x")], "item_id bigint, text string, id string")
    clean = op4_decontamination.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id: tuple(r)[3:] for r in clean.collect()} == {i: ODD for i in (0, 1, 3, 4, 5)}
    assert op4_decontamination.decontaminate(docs.limit(0), benchmark).count() == 0
    assert op4_decontamination.decontaminate(docs, benchmark.limit(0)).count() == len(texts)


def test_plan_takes_each_source_up_to_its_target(spark):
    """`taken` of each document, recomputed: hash order within the source, whole passes, then a cut."""
    names = "doc_id bigint, source string, size bigint, _part string, target string, `epochs` string, `a.b` int"
    rows = [(i, f"s{i % 4}" if i % 5 else None, (i * 37) % 200, "p", "t", "e", i) for i in range(120)]
    docs = spark.createDataFrame(rows, names).repartition(5)
    planned = op5_mixing.plan(docs)
    assert planned.columns == ["doc_id", "source", "size", "_part", "a.b", "source_size", "target", "epochs", "taken"]
    found = planned.collect()
    assert {(r.doc_id, r["a.b"], r._part) for r in found} == {(i, i, "p") for i in range(120)}
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        size, target = sum(r.size for r in own), own[0].target
        assert {r.source_size for r in own} == {size} and sum(r.taken for r in own) == int(target + 0.5)
        cut = [r for r in own if r.taken not in (r.size * r.epochs, r.size * (r.epochs + 1))]
        assert len(cut) <= 1 and all(r.taken <= 2 * r.size for r in own)

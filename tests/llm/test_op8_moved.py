"""op8 moves the texts of wanted documents only, and its sketch takes little room."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from guestsignal.llm import op8_ngram_jaccard_join as op8
from guestsignal.llm.shared import with_text_hash


def _documents(spark, n):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=40)) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(n + i, t) for i, t in enumerate(texts[:50])]
    return with_text_hash(spark.createDataFrame([*rows, (3, texts[7]), (None, texts[9])], "doc_id bigint, text string"))


def test_only_wanted_documents_are_moved(spark):
    docs = _documents(spark, 2000)
    places = docs.filter("doc_id % 40 = 0 or doc_id < 0").select("doc_id", "th", F.lit(1).alias("key"))
    kept = op8.may_be_wanted(docs, places)
    assert kept.columns == docs.columns
    found = {(r.doc_id, r.th) for r in kept.collect()}
    wanted = {(r.doc_id, r.th) for r in places.collect()}
    # a copy of a wanted text under another id stays behind
    assert wanted <= found and len(found - wanted) <= 2


def test_a_small_map_keeps_all_wanted_documents(spark, monkeypatch):
    monkeypatch.setattr(op8, "WANTED_BITS", 7)
    docs = _documents(spark, 300)
    places = docs.filter("doc_id % 5 = 0").select("doc_id", "th")
    found = {(r.doc_id, r.th) for r in op8.may_be_wanted(docs, places).collect()}
    assert {(r.doc_id, r.th) for r in places.collect()} <= found


def test_each_verified_set_goes_through_the_map(spark, monkeypatch):
    docs = _documents(spark, 400)
    moved = []

    def watched(docs, places, real=op8.may_be_wanted):
        kept = real(docs, places)
        moved.append((kept.count(), places.count()))
        return kept

    monkeypatch.setattr(op8, "may_be_wanted", watched)
    groups = {r.doc_id: r.component_id for r in op8.grouped(docs.select("doc_id", "text")).collect()}
    assert all(groups[400 + i] == groups[i] for i in range(50) if i not in (3, 7, 9))
    assert len(moved) == 3 and all(kept <= wanted + 2 for kept, wanted in moved)


def test_sketch_counts_come_back_and_are_small():
    counts = np.random.default_rng(8).poisson(1.0, 1 << 16).astype(np.uint32)
    counts[:4] = [255, 256, 65535, 70000]
    packed = op8.packed_counts(counts)
    assert (op8.counts_of(packed) == np.minimum(counts, 65535)).all()
    assert len(packed) * 4 < counts.size * 2

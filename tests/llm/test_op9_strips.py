"""op9: neighbouring windows stay together, and windows are not stored."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from guestsignal.llm import op9_suffix_array_dedup as op9
from guestsignal.llm.shared import shared_folder, with_text_hash


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(900)
    found = [letters(300) + passage[k : k + 650] + letters(200) for k in range(0, 250, 25)]
    return [*found, found[0], passage[:399], "", letters(2000)]


def starts_of(texts):
    places = Counter()
    for t in texts:
        places.update(t[i : i + 400] for i in range(len(t) - 399))
    return {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 399) if places[t[i : i + 400]] > 1}


def test_neighbouring_starts_share_a_row(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    rows = op9.repeated_starts(with_text_hash(docs)).collect()
    new = set(os.listdir(folder)) - before
    expected = starts_of(texts)
    assert {(r.doc_id, r.lo + k) for r in rows for k in range(r.n)} == expected
    assert len(rows) < len(expected) / 10
    assert not [name for name in new if name.startswith("windows")]


def test_rows_that_repeat(spark, texts):
    """Equal rows are places of their own; a repeated id with another text is another document."""
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = op9.dedupe(docs).collect()
    own = [t or "" for _, t in rows]
    removed = [set() for _ in own]
    for d, i in starts_of(own):
        removed[d] |= set(range(i, i + 400))
    expected = sorted((d or -1, len(t), len(gone)) for (d, _), t, gone in zip(rows, own, removed))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in found) == expected

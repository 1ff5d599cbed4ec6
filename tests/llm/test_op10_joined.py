"""Phrases that follow one another are one in the automaton, and nothing is lost by it."""

import random

import pyarrow as pa
import pytest

from guestsignal.llm import op10_substring_dedup as op10
from guestsignal.llm.shared import with_text_hash


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)

    def fresh(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    passages = [fresh(n) for n in (20, 21, 39, 60, 150, 400)]
    out = []
    for doc_id in range(60):
        words = fresh(rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            words += p[a : rng.choice([len(p), len(p), rng.randrange(a, len(p) + 1)])]
            words += fresh(rng.choice([0, 1, 25]))
        out.append((doc_id, " ".join(words)))
    out += [(100, "x " * 70), (101, "y " + "x " * 45), (102, out[7][1]), (103, out[7][1]), (7, out[7][1])]
    return out


def test_equal_to_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window in (1, 2, 5, 20):
        first, want = {}, set()
        keyed = {(r.doc_id, r.th): r.text for r in with_text_hash(docs).collect()}
        for place, text in sorted(keyed.items()):
            words = text.split()
            gone = set()
            for at in range(len(words) - window + 1):
                if first.setdefault(tuple(words[at : at + window]), (place, at)) != (place, at):
                    gone |= set(range(at, at + window))
            want.add((place[0], len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
        got = op10.dedupe(docs, window).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.n_removed, r.kept) for r in got} == want


def test_few_phrases_for_long_copies(spark):
    rng = random.Random(6)
    passage = [f"w{rng.randrange(10**9)}" for _ in range(600)]
    # every copy has other words around it, and the last one is a part
    rows = [(k, " ".join([f"a{k}", *passage, f"b{k}"])) for k in range(4)]
    rows.append((9, " ".join([*passage[100:300], "end"])))
    docs = with_text_hash(spark.createDataFrame(rows, "doc_id bigint, text string"))
    table = docs.drop("shard").toArrow()
    known = op10.phrases(docs, 1).toArrow()
    machine, *_ = op10._compiled(table, known)
    assert known.num_rows > 30
    # the places change where the part begins and ends
    assert 1 <= len(machine) <= 6
    removed = {r["doc_id"]: r["n_removed"] for b in op10._remove(table, known) for r in b.to_pylist()}
    assert removed == {0: 0, 1: 600, 2: 600, 3: 600, 9: 200}


def test_stretches_keep_every_phrase():
    words = [b"%d" % k for k in range(50)]
    for size in (1, 2, 3, 19, 20):
        block = (size + 1) // 2
        for at in range(len(words) - size + 1):
            phrase = words[at : at + size]
            blocks = {b" ".join(phrase[k : k + block]) for k in range(size - block + 1)}
            assert any(a <= at and at + size <= b for a, b in op10._stretches(words, blocks, block))
    assert not list(op10._stretches(words, {b"x"}, 1))


def test_sums_that_differ_are_not_joined():
    known = pa.table({
        "doc_id": [1, 1, 1], "th": [0, 0, 0], "at": [0, 1, 2], "size": [20] * 3, "n": [1] * 3,
        "first_doc": [0] * 3, "first_th": [0] * 3, "first_at": [5, 6, 7],
        "places": [10, 11, 99], "nexts": [11, 12, 13],
    })
    assert list(op10._joined(known)) == [(1, 0, 0, 21, 0, 0, 5), (1, 0, 2, 20, 0, 0, 7)]

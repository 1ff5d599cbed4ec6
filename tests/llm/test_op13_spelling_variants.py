"""Spelling variants against all pairs, with tries opened level by level."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from guestsignal.llm import op13_spelling_variants as op13

SCHEMA = "doc_id bigint, text string, word string, n string, run string, h string"
LOW = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_counts(rows)
    form, out = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = [n, len(close)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w], words.get(form[w]))
    return set(out.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 10))) for _ in range(30)]
    words = list(base)
    for w in base * 6:
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdÿ") + w[k:], w[:k] + "é" + w[k + 1 :]]))
    # ties of the largest n, one word with very many rows, long words
    words += ["tieaaaaa"] * 3 + ["tieaaaab", "tieaaaac"] * 20
    words += ["commonword"] * 4000 + ["longer" * 30] + ["longer" * 29 + "longest"]
    weighted = words + rng.choices(words[:60], k=4000)
    out = []
    for i in range(900):
        some = rng.choices(weighted, k=20)
        shown = [w.title() if rng.random() < 0.2 else w for w in some]
        out.append((i if i % 13 else None, rng.choice([" ", ",\n", "·", " –"]).join(shown)))
    for i, (word, n) in enumerate([("pathaaaa", 8), ("pathaaab", 60), ("pathaabb", 500), ("pathéabb", 6)]):
        out.append((5000 + i, " ".join([word] * n)))
    out += [(1, ""), (2, None), (3, " \n"), (4, "ΑΒΓΔΕΖ"), *out[:5], *out[:5]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(4)


def test_counts(docs, rows):
    got = {r.word: r.n for r in op13.counted_words(docs).filter("n >= 5").collect()}
    assert got == plain_counts(rows)


@pytest.mark.parametrize("groups, levels, node_words", [(16, 3, 20_000), (5, 1, 8), (3, 1, 2), (1, 1, 1)])
def test_variants_equal_all_pairs(docs, rows, groups, levels, node_words):
    """Also with nodes so small that all levels open, and with one leaf for all words of a length."""
    found = op13.variants(docs, groups=groups, levels=levels, node_words=node_words).collect()
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found]
    want = plain_variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[2] != r[1] for r in want if r[1]), "no path of forms in the data"


def test_small_nodes_open(spark):
    words = [("".join(x), 5) for x in {tuple(random.Random(i).choices("abcdef", k=8)) for i in range(3000)}]
    table = spark.createDataFrame(words, "word string, n bigint")
    groups = op13.letter_groups(table, 6)
    routes = op13.routed(table, groups, 2, 40)
    own = {(r.node, r.level): r["count"] for r in routes.filter("spent = 0").groupBy("node", "level").count().collect()}
    assert sum(own.values()) == len(words)
    assert {level for _, level in own} > {2, 3}
    assert all(n <= 40 for (_, level), n in own.items() if level < 6)


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        if len(a) in (len(b), len(b) - 1):
            assert op13.one_edit(a, b) == near(a, b), (a, b)
    both = op13.Words(["abc", "abcd", "xbc", "abc"])
    asks, found = np.array([0, 0, 0]), np.array([1, 2, 3])
    assert op13._verified(both, asks, found).tolist() == [True, True, False]


def test_empty(docs):
    assert op13.variants(docs.limit(0)).count() == 0

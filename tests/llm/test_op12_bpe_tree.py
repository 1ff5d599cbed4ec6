"""Tree concatenation against the tokenizers library, with stretches so short that most tokens are near a cut."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from guestsignal.llm import op12_bpe_tree as op12

ODD = [
    "a", "th", "e", "he", " ", "\n", "'", "'s", "'re", "'LL", "!", "!!", "É", "é", "́", "中文", "ᄒ", "ᅡ", "ᆫ",
    "\xa0", "　", "\x1c", "\x85", "<|endoftext|>", "<|endof", "text|>", "1", "½", "ª", "İ", "ß", "H̱", "😀", "ΑΣ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(op12.default_tokenizer())


def odd_text(rng):
    some = rng.sample(ODD, rng.randrange(1, 8)) if rng.random() < 0.7 else ODD
    return "".join(rng.choice(some) for _ in range(rng.randrange(120)))


@pytest.mark.parametrize("leaf, long", [(1, 2), (3, 5), (7, 9), (16, 1024), (1024, 20)])
def test_odd_texts_equal_the_library(library, leaf, long):
    rng, own = random.Random(leaf * 31 + long), op12.TreeEncoder(op12.default_tokenizer(), leaf, long)
    for _ in range(400):
        text = odd_text(rng)
        got = np.frombuffer(own.encode(text), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("leaf", [2, 33, 128])
def test_unsplit_text_equals_the_library(library, leaf):
    """Runs without any split: mixed letters, and periods for which a cut at the wrong place never heals."""
    rng, own = random.Random(leaf), op12.TreeEncoder(op12.default_tokenizer(), leaf, 10)
    runs = ["".join(rng.choice("abethé") for _ in range(rng.randrange(1, 2500))) for _ in range(20)]
    runs += [p * rng.randrange(1, 900) + "end" for p in ("a", "aa", "aab", "ha", "!", "!?", "é", "ñn") for _ in range(4)]
    for run in runs:
        got = np.frombuffer(own.encode(run), "<u4").tolist()
        assert got == library.encode(run, add_special_tokens=False).ids


def test_windows_grow_until_both_sides_agree():
    own = op12.TreeEncoder(op12.default_tokenizer(), 100, 10)
    halves = [own.encoded(s) for s in op12._halves(op12.PART, "x" + "haha" * 50, 101)]
    widths = []
    window = own._part_window
    own._part_window = lambda a, b, wide: widths.append(wide) or window(a, b, wide)
    joined = own.joined(*halves)
    assert "".join(joined.units) == "x" + "haha" * 50
    assert widths == [2 ** (k + 1) for k in range(len(widths))]


def test_rows_of_all_kinds(spark, library):
    rng = random.Random(5)
    texts = [odd_text(rng) for _ in range(40)] + ["", None, " \n", "one"]
    texts += [" ".join(odd_text(rng) for _ in range(60)), "word" * 3000, "a, b " * 4000, " " * 9000, "é" * 5000 + " x"]
    texts += texts[-6:]
    rows = [(i if i % 7 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded string").repartition(3)
    sizes = {"leaf": 64, "long": 100, "spread": 2000}
    found = op12.decode(op12.encode(docs, **sizes)).collect()
    assert sorted(found, key=str) == sorted(op12.round_trip(docs, **sizes).collect(), key=str)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in found), key=key) == sorted(want, key=key)
    assert op12.decode(op12.encode(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(1, None, "x")], "doc_id bigint, ids array<int>, decoded string")
    assert [tuple(r) for r in op12.decode(nothing).collect()] == [(1, None, "")]


def test_other_kinds_of_tokenizers_are_refused(tmp_path, library):
    own = json.loads(library.to_str())
    own["model"]["merges"].reverse()
    (tmp_path / "reversed.json").write_text(json.dumps(own))
    with pytest.raises(ValueError):
        op12.TreeEncoder(str(tmp_path / "reversed.json"))

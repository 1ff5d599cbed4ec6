"""Fill-in-the-middle samples against a plain script, on odd texts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from guestsignal.llm import op11_fill_in_middle as op11

SCHEMA = "doc_id bigint, text string, form string, n string, h1 string, output string"


def texts():
    rng = random.Random(3)
    some = ["a", "é", "中", "😀", "\n", "\r", " ", "<", "P>", "<S", "<M", "́", "\x0b"]
    out = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(80)]
    out += ["", None, "\n", "\n\n", "no line end", "x<P>y", "<S>", "a<M>\n", "é\n" * 40_000, "a" * 300_000]
    return out + out[:5]


def plain(doc_id, text, unit):
    """n, form, prefix, middle, output of one row as the contract words it."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_samples_equal_the_plain_script(spark, unit):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)
    made = op11.transform(docs.repartition(3), unit).withColumn("again", op11.restored("output", "form"))
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in made.collect()), key=key)
    want = sorted(((d, *plain(d, t, unit), t or "") for d, t in rows), key=key)
    assert got == want


def test_rate_leaves_texts_plain_and_an_empty_table_is_empty(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(300)], "doc_id bigint, text string")
    forms = {r.form: r.n for r in op11.transform(docs, rate=30).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert 180 < forms["plain"] < 240
    assert op11.transform(docs.limit(0)).count() == 0


def test_sparse_index_converts_both_ways():
    text = "aé中😀\n" * 50 + "plain ascii " * 20 + "é"
    index = op11.SparseIndex(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:c].encode()) for c in chars])
    assert (index.bytes(chars) == places).all()
    assert (index.chars(places) == chars).all()
    assert len(index.at) == 151

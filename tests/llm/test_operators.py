"""Operators against brute force on small tables with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from guestsignal.llm import (
    coder,
    op1_line_dedup,
    op2_token_output,
    op3_toxicity,
    op4_decontamination,
    op5_mixing,
    op6_html_extraction,
    op7_topk_search,
    op8_ngram_jaccard_join,
    op9_suffix_array_dedup,
    op10_substring_dedup,
    pages,
)
from guestsignal.llm.components import components

SCHEMA = "doc_id bigint, text string, source string, th string, size string, n_chars bigint"


def words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randrange(400)}é"[: rng.randrange(3, 6)] for _ in range(n)]


def corpus():
    """Random texts, exact and near copies, shared passages, hot texts, empty and null ones."""
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randrange(1, 260))) for _ in range(30)]
    passage = " ".join(words(rng, 150))
    texts = list(base)
    texts += base[:6] + [base[0]] * 12
    for t in base[:8] + [base[1]] * 60:
        w = t.split()
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [f"{' '.join(words(rng, 30))}\n{passage}\n{' '.join(words(rng, 5))}" for _ in range(6)]
    texts += ["", None, " \n\t", "one", "a b c d", "a b c d", "x " * 900, "Ab cD  eF\tgh\x0bIJ kl"]
    return [(i, t, f"s{i % 4}" if i % 9 else None, "clash", "clash", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_op1_removes_later_runs(docs, rows, empty):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in op1_line_dedup.dedupe(docs).collect()}
    lines = {r[0]: [x for x in (r[1] or "").split("\n") if split(x)] for r in rows}
    seen, gone = set(), set()
    for d, own in sorted(lines.items()):
        for size in (1, 2, 3):
            for n in range(len(own) - size + 1):
                key = (size, *own[n : n + size])
                if key in seen and (size == 3 or sum(len(split(x)) for x in key[1:]) >= 50):
                    gone |= {(d, n + k) for k in range(size)}
                seen.add(key)
    for d, own in lines.items():
        kept = [x for n, x in enumerate(own) if (d, n) not in gone]
        assert got[d] == (len(own), len(own) - len(kept), "\n".join(kept))
    assert op1_line_dedup.dedupe(empty).count() == 0


def test_op8_components(docs, rows, empty):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for r in rows:
        w = split((r[1] or "").translate(low))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_ngram_jaccard_join.grouped(docs).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    kept = {r.doc_id for r in op8_ngram_jaccard_join.keep_one(docs).collect()}
    assert kept == {d for d in sets if root(d) == d}
    assert op8_ngram_jaccard_join.keep_one(docs).columns == docs.columns
    assert op8_ngram_jaccard_join.grouped(empty).count() == 0


def test_op9_bytes(docs, rows, empty):
    count = Counter()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for t in texts.values():
        count.update(t[i : i + 400] for i in range(len(t) - 399))
    for r in op9_suffix_array_dedup.dedupe(docs).collect():
        t = texts[r.doc_id]
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                mask[i : i + 400] = True
        kept = bytes(b for b, m in zip(t, mask) if not m)
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(t), int(mask.sum()), kept)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert op9_suffix_array_dedup.dedupe(empty).count() == 0


def test_op10_words(docs, rows, empty):
    got = {r.doc_id: r for r in op10_substring_dedup.dedupe(docs).collect()}
    seen = set()
    for r in sorted(rows):
        w = split(r[1])
        mask = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                mask[i : i + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, m in zip(w, mask) if not m).decode()
        assert (got[r[0]].n_words, got[r[0]].n_removed, got[r[0]].kept) == (len(w), sum(mask), kept)
    assert op10_substring_dedup.dedupe(empty).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    same = spark.createDataFrame([(1, text), (1, text), (None, text), (1, "other")], "doc_id bigint, text string")
    ten = sorted(map(str, op10_substring_dedup.dedupe(same).select("doc_id", "n_removed").collect()))
    assert ten == sorted(["Row(doc_id=None, n_removed=0)", "Row(doc_id=1, n_removed=200)",
                          "Row(doc_id=1, n_removed=200)", "Row(doc_id=1, n_removed=0)"])
    for run in (op1_line_dedup.dedupe, op9_suffix_array_dedup.dedupe, op8_ngram_jaccard_join.grouped):
        assert run(same).count() == 4
    assert op8_ngram_jaccard_join.keep_one(same).count() == 2
    assert op2_token_output.read(op2_token_output.write(same)).count() == 4


def test_op2_round_trip_from_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op2_token_output.default_tokenizer())
    got = {r.doc_id: r for r in op2_token_output.read(op2_token_output.write(docs)).collect()}
    start = 0
    for r in sorted(rows):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(got[r[0]]) == (r[0], start, len(ids), crc)
        start += len(ids)
    assert op2_token_output.read(op2_token_output.write(empty)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 511, 1025, 40_000])
def test_coder_round_trip_and_damage(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 60_000)
    block = coder.encode_block(ids, np.array([n]))
    found, lengths = coder.decode_block(block)
    assert (found == ids).all() and lengths.tolist() == [n]
    if n > 500:
        damaged = bytearray(block)
        damaged[-20] ^= 4
        with pytest.raises(ValueError):
            coder.decode_block(bytes(damaged))


def test_op3_learns_and_ignores_everything_but_text(spark, empty):
    rng = random.Random(3)
    made = []
    for i in range(400):
        w = words(rng, rng.randrange(5, 80))
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["grumblefool", "Nastyhead", "scoundrelly"]))
        made.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([m[:2] for m in made], "doc_id bigint, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made] + [(None, 1), (9999, None)], "doc_id bigint, toxic int")
    model = op3_toxicity.learnt(docs, labels)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "a grumblefool x")], "doc_id bigint, text string")
    scored = {r.doc_id: r.toxic_score for r in op3_toxicity.score(docs.unionByName(odd), model).collect()}
    assert all((scored[i] >= 0.5) == bool(toxic) for i, _, toxic in made)
    assert scored[-1] == scored[-2] < 0.5 <= scored[None]
    assert op3_toxicity.keep_clean(docs, model).count() == 320
    nobody = op3_toxicity.train(empty, labels)
    assert [r.toxic_score for r in op3_toxicity.score(odd, nobody).collect()] == [0.5] * 3


def test_op4_finds_new_numbers_and_names(spark):
    item = "If Tom buys 12 apples for 3 dollars each, how much does Tom pay for all 12 apples in total?"
    turned = item.replace("Tom", "Anna").replace("12", "7").replace("3 ", "5.50 ")
    mixed = item.replace("Tom buys", "Anna buys").replace("does Tom", "does Bert").replace("12 apples for", "7 apples for")
    docs = spark.createDataFrame(
        [(1, f"Before it. {item} After."), (2, f"x y z {turned}"), (3, f"z {mixed}"), (4, "nothing here of it"),
         (5, None), (6, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "short one")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in op4_decontamination.leaks(docs, items).collect()}
    assert {(1, 0), (2, 0)} <= found and not {d for d, _ in found} & {4, 5, 6}
    assert {r.doc_id for r in op4_decontamination.decontaminate(docs, items).collect()} >= {4, 5, 6}


def test_op5_targets_and_exact_cuts(docs, rows):
    sized = docs.drop("size").select("doc_id", "source", op5_mixing.word_count(docs["text"]).alias("size"))
    got = op5_mixing.plan(sized).collect()
    size = {r[0]: len(split(r[1])) for r in rows}
    total = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        total[r.source] += r.taken
    sources = {r.source: (r.target, r.source_size) for r in got}
    for source, (target, own) in sources.items():
        assert abs(total[source] - target) <= 0.5 and target <= 2 * own + 1e-9
    assert abs(sum(t for t, _ in sources.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(str, op5_mixing.plan(sized).collect())) == sorted(map(str, got))
    mixed = op5_mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r.text)) for r in mixed.collect()) == sum(total.values())


def test_op6_blocks_and_text(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><a href='/'>Home</a></nav>"
        "<article><h1>A &amp; B</h1><p>First <b>bo</b>ld.<br>Next&nbsp;line.<p>Second one</article>"
        "<footer>&copy; x</footer></body>"
    )
    assert [b.text for b in pages.blocks(page)] == ["Home", "A & B", "First bold. Next\xa0line.", "Second one", "© x"]
    table = spark.createDataFrame(
        [(i, "u", page) for i in range(8)] + [(8, None, None), (9, "u", ""), (10, "u", "<p"), (11, "u", "&am")],
        "page_id bigint, url string, html string",
    )
    model = op6_html_extraction.train(table)
    got = {r.page_id: r for r in op6_html_extraction.extract(table, model).collect()}
    assert got[0].text == "A & B First bold. Next\xa0line. Second one" and got[0].n_chars == len(got[0].text)
    assert got[8].text == got[9].text == got[10].text == "" and len(got) == 12


def test_op7_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    made = [(i, [float(x) for x in rng.normal(0, 0.1, 8).astype("f4")]) for i in range(300)]
    made += [(i, made[7][1]) for i in range(300, 420)]
    bad = [(1000, None), (1020, [float("nan")] * 8), (1040, [None] * 8), (None, [0.0] * 8), (1060, [float("inf")] * 8)]
    table = spark.createDataFrame(made + bad, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op7_topk_search.search(table).collect()}
    q = np.floor(64 * np.array([np.float32(v) for _, v in made], float)).astype(int)
    for i in range(0, 420, 20):
        scores = sorted((-int(q[i] @ q[j]), j) for j in range(420) if j != i)[:20]
        assert [got[i, k + 1] for k in range(20)] == [(j, -s) for s, j in scores]
    assert len(got) == 21 * 20


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    found = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_pipeline_runs_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]

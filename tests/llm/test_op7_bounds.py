"""The index's proofs: small segments, clustered vectors, repeats, large numbers."""

from __future__ import annotations

import numpy as np
import pytest

from guestsignal.llm import op7_topk_search as op7


def brute(ids, values, count, own, query, k):
    rows = []
    for i, v, n in zip(ids, values, count):
        n -= i == own and (v == query).all()
        rows += [(-int(query.astype(object) @ v.astype(object)), int(i))] * int(n)
    return [(i, -s) for s, i in sorted(rows)[:k]]


@pytest.mark.parametrize("spread, top", [(3, 60), (60, 60), (5, 2**28)])
def test_answers_equal_brute_force_and_proofs_skip_work(monkeypatch, spread, top):
    """Clusters far apart are ruled out; without clusters all is processed; large values stay exact."""
    monkeypatch.setattr(op7, "SEGMENT_ROWS", 32)
    monkeypatch.setattr(op7, "SEGMENT_DIMS", 4)
    rng = np.random.default_rng(spread)
    centre = rng.integers(-top, top, (12, 16))
    values = (centre[rng.integers(0, 12, 900)] + rng.integers(-spread, spread + 1, (900, 16))).astype(np.int64)
    values[50:60] = values[40]
    ids, count = rng.permutation(900).astype(np.int64), np.where(np.arange(900) % 97 == 0, 30, 1)
    asked = op7.Asked(ids[:40], values[:40], 7)
    for part in np.array_split(np.arange(900), 4):
        asked.meet(op7.Index(ids[part], values[part], count[part]))
    got = {}
    for q, rank, row, score in zip(*asked.best()):
        got.setdefault(int(q), []).append((int(row), int(score)))
        assert rank == len(got[int(q)])
    assert got == {int(i): brute(ids, values, count, i, v, 7) for i, v in zip(ids[:40], values[:40])}
    if spread == 3:
        assert asked.processed < 0.7 * asked.postings


def test_repeated_rows_and_few_rows(spark):
    rows = [(0, [0.5, 0.5])] * 30 + [(20, [0.25, -1.0]), (3, [1.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    work = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = {}
    for r in op7.search(table, work=work).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 3, 4096), *[(k, 0, 2048) for k in range(2, 21)]]
    assert sorted(got[20]) == [(k, 0, -1536) for k in range(1, 21)]
    assert 40 not in got  # the only vector of its dimension
    assert 0 < work[0].value <= work[1].value
    assert op7.search(table.limit(0)).count() == 0
    extra = table.selectExpr("vec_id", "embedding", "1 as `count`", "2 as dim", "'x' as `values`")
    assert op7.search(extra).count() == 40

"""op7: query rows that repeat both vec_id and vector take no places from other neighbours."""

from __future__ import annotations

import numpy as np

from guestsignal.llm import op7_topk_search


def test_equal_query_rows(spark):
    rng = np.random.default_rng(4)
    made = [(i, [float(x) for x in rng.normal(0, 0.3, 8).astype("f4")]) for i in range(60)]
    made += [made[20]] * 3 + [(40, made[3][1])]
    table = spark.createDataFrame(made, "vec_id bigint, embedding array<float>")
    got = {}
    for r in op7_topk_search.search(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(64 * np.array([np.float32(v) for _, v in made], float)).astype(int)

    def best(own):
        scores = sorted((-int(q[own] @ q[j]), made[j][0]) for j in range(len(made)) if j != own)[:20]
        return [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]

    assert sorted(got[20]) == best(20) and sorted(got[0]) == best(0)
    assert sorted(got[40]) == sorted(best(40) + best(len(made) - 1))
    assert sum(i == 20 for _, i, _ in got[20]) == 3

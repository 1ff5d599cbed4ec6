"""op3: `sample` bounds the rows that are learnt from, also where labelled ids repeat."""

from __future__ import annotations

from guestsignal.llm import op3_toxicity


def test_repeated_ids_do_not_exceed_the_sample(spark, monkeypatch):
    learnt = []
    fit = op3_toxicity.fit_logistic
    monkeypatch.setattr(op3_toxicity, "fit_logistic", lambda rows, labels, *a: learnt.append(list(labels)) or fit(rows, labels, *a))
    own = [(i, f"plain text number {i}") for i in range(60)]
    docs = own + [(60, f"a grumblefool wrote {i}") for i in range(300)] + [(61, "the same grumblefool")] * 200
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(62)], "doc_id bigint, toxic int")
    model = op3_toxicity.train(table, labels, sample=150)
    again = op3_toxicity.train(table.repartition(3), labels, sample=150)
    op3_toxicity.train(table, labels, sample=1000)
    assert [len(x) for x in learnt] == [150, 150, 361]
    assert sum(learnt[2]) == 301 and 0 < sum(learnt[0]) < 150
    assert (model.weights == again.weights).all() and model.bias == again.bias
    odd = spark.createDataFrame([(1, "what a grumblefool"), (2, "plain text")], "doc_id bigint, text string")
    assert [r.toxic_score >= 0.5 for r in op3_toxicity.score(odd, model).orderBy("doc_id").collect()] == [True, False]

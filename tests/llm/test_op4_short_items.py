"""op4: benchmark items of fewer tokens than a window are found inside longer documents."""

from __future__ import annotations

from guestsignal.llm import op4_decontamination


def test_short_items_inside_longer_documents(spark):
    items = [
        (0, "name the largest moon of saturn"), (1, "what is 12 plus 5?"), (2, "square root"), (3, "photosynthesis"),
        (4, "does Tom walk home with 3 dogs"), (5, "this item is longer than a window by some tokens"),
    ]
    filler = "many words of a longer text that holds nothing else of note"
    docs = [
        (10, f"{filler} name the largest moon of Saturn's {filler}"), (11, f"{filler} name the largest moon of saturn {filler}"),
        (12, f"{filler}: what is 12 plus 5? {filler}"), (13, f"{filler}: what is 13 plus 5? {filler}"),
        (14, f"{filler} square root {filler} square root {filler}"), (15, "Square root"),
        (16, f"{filler} photosynthesis"), (17, f"{filler} square {filler} root photosynthetic"),
        (18, f"{filler} does Anna walk home with 7 dogs {filler}"), (19, "square root"), (20, filler), (21, None),
        (22, "name the largest moon of saturn"), (23, f"{filler} name the largest moon of mars {filler}"),
    ]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = op4_decontamination.leaks(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {
        (11, 0), (22, 0), (12, 1), (14, 2), (15, 2), (19, 2), (16, 3), (18, 4)}
    assert {(r.n_windows, r.coverage, r.consistency) for r in found} == {(1, 1.0, 1.0)}

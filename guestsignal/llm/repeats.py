"""Recurring fixed-length windows of bytes or words: shared by op9 and op10.

A table of all windows would be hundreds of times the text. Instead each window is anchored
at one gram inside it (`vec.anchor_runs`), so that one row stands for a run of about w / 2
windows, and only two small remainders are ever looked at window by window:

1. anchors whose gram occurs once have windows that occur once: they leave;
2. anchors that share all surrounding items (h and c) share all their windows;
3. what shares the gram but not the surroundings is decided by single windows, once for each
   distinct surrounding.

Counts are plain aggregations and joins on the gram: they combine before the shuffle, and
Spark splits the skewed side of such a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestsignal.llm import vec
from guestsignal.llm.shared import stored

#: raw bytes, row offsets -> items and their row bounds
Items = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

RUNS = "doc_id bigint, th bigint, lo bigint, n bigint, h bigint, c bigint"
#: Bytes of text that are turned into items at once.
SLICE = 1 << 18


def byte_items(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One item for the eight bytes from each position on; a row of L bytes has L - 7."""
    items = vec.eight_bytes(raw)
    size = np.maximum(np.diff(offsets) - 7, 0)
    keep = np.ones(len(raw) + 1, np.int64)
    keep[-1] = 0
    drop = np.zeros(len(raw) + 1, np.int64)
    np.add.at(drop, offsets[:-1] + size, 1)
    np.add.at(drop, offsets[1:], -1)
    keep = np.cumsum(drop)[:-1] == 0
    return items[keep], np.concatenate([[0], np.cumsum(size)])


def word_items(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, before = vec.word_spans(raw, offsets)
    return vec.word_hashes(raw, starts, ends), before


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with their bytes, SLICE bytes or one row at a time."""
    raw, offsets = vec.string_buffer(column)
    for a, b in vec.chunks(np.diff(offsets), SLICE):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def run_table(docs: DataFrame, items_of: Items, window: int, gram: int) -> DataFrame:
    """One row for each run of windows of doc_id, th, text (see vec.anchor_runs)."""

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy() for k in ("doc_id", "th"))
            for a, b, raw, offsets in slices(batch.column("text")):
                runs = vec.anchor_runs(*items_of(raw, offsets), window, gram)
                row = runs["row"] + a
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids[row], "th": hashes[row], "lo": runs["lo"], "n": runs["n"],
                    "h": vec.signed(runs["h"]), "c": vec.signed(runs["c"]),
                })

    return docs.mapInArrow(anchor, RUNS)


def recurring(docs: DataFrame, items_of: Items, window: int, gram: int) -> DataFrame:
    """The runs whose anchor gram occurs more than once, stored.

    The table of all runs is made twice rather than stored: it is as large as the text.
    """
    runs = run_table(docs, items_of, window, gram)
    twice = runs.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    return stored(runs.join(twice, "h"), "recurring")


def surroundings(runs: DataFrame) -> DataFrame:
    """One row for each (h, c): k occurrences, `first` the earliest (doc_id, th, lo, n)."""
    return runs.groupBy("h", "c").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "th", "lo", "n")).alias("first")
    )


def undecided(groups: DataFrame) -> DataFrame:
    """Groups that share their gram with another surrounding."""
    several = groups.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    return groups.join(several, "h")


def intervals_of(runs: DataFrame) -> DataFrame:
    """Runs of window starts, one sorted list for each document row."""
    spans = F.sort_array(F.collect_set(F.struct("lo", "n"))).alias("spans")
    return runs.groupBy("doc_id", "th").agg(spans)


def covered(size: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of `size` items lie in a window that starts in one of the spans."""
    steps = np.zeros(size + 1, np.int64)
    if spans:
        lo = np.array([s["lo"] for s in spans], np.int64)
        n = np.array([s["n"] for s in spans], np.int64)
        np.add.at(steps, lo, 1)
        np.add.at(steps, lo + n - 1 + window, -1)
    return np.cumsum(steps)[:size] > 0


def runs_in(mask: np.ndarray) -> int:
    if not len(mask):
        return 0
    return int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))

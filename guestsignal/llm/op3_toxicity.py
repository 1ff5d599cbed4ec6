"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the character n-grams of a text (presence, hashed to FEATURES slots). For each,
r = log of its share in toxic texts over its share in other texts. A logistic regression is
trained on presence times r. Learning uses a sample of labelled rows whose size is bounded by
`sample`; scoring looks at whole texts and nothing but texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from guestsignal.llm import repeats, vec
from guestsignal.llm.shared import stored, table, tasks

GRAMS = (4, 5, 6)
FEATURE_BITS = 19
FEATURES = 1 << FEATURE_BITS
#: At most so many labelled rows are learnt from, and so many n-grams get a weight.
SAMPLE, CHOSEN = 20_000, 6_000
FOLDS = 5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def gram_slots(raw: np.ndarray, n: int) -> np.ndarray:
    """Slot of the n-gram at each position of a text with a space on both sides."""
    if len(raw) < n:
        return np.empty(0, np.int64)
    padded = np.concatenate([raw, np.zeros(7, np.uint8)])
    eight = np.ndarray(len(raw), "<u8", padded.data, 0, (1,))[: len(raw) - n + 1]
    x = eight << np.uint64(64 - 8 * n)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def padded_text(raw: np.ndarray) -> np.ndarray:
    """Lower case (A-Z), white space as spaces, a space before and after."""
    space = np.full(1, 32, np.uint8)
    return np.concatenate([space, _FOLD.take(raw), space])


def slots_of(raw: np.ndarray) -> np.ndarray:
    """Distinct slots of one text."""
    text = padded_text(raw)
    mark = np.zeros(FEATURES, bool)
    for n in GRAMS:
        mark[gram_slots(text, n)] = True
    return np.flatnonzero(mark)


@dataclass
class Classifier:
    """Weight of each slot (0: not used) and bias."""

    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Scores of a string column without nulls."""
        out = np.zeros(len(column))
        used = self.weights != 0
        for a, b, raw, offsets in repeats.slices(column):
            # rows are parted by two spaces: the end of one and the start of the next
            size = np.diff(offsets) + 2
            text = np.full(int(size.sum()), 32, np.uint8)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            inside = np.ones(len(text), bool)
            inside[start] = inside[start + size - 1] = False
            text[inside] = _FOLD.take(raw)
            hits = []
            for n in GRAMS:
                slots = gram_slots(text, n)
                at = np.flatnonzero(used[slots])
                row = np.searchsorted(start, at, side="right") - 1
                whole = at + n <= start[row] + size[row]
                hits.append((row[whole].astype(np.int64) << FEATURE_BITS) | slots[at[whole]])
            distinct = np.unique(np.concatenate(hits))
            row = distinct >> FEATURE_BITS
            values = self.weights[distinct & (FEATURES - 1)]
            out[a:b] = np.bincount(row, weights=values, minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def _counts(rows: DataFrame) -> np.ndarray:
    """For each slot, the toxic and the other texts of `rows` (text, toxic) that have it."""
    parts = 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, FEATURES), np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for a, b, raw, offsets in repeats.slices(batch.column("text")):
                for r in range(a, b):
                    seen[toxic[r], slots_of(raw[offsets[r - a] : offsets[r - a + 1]])] += 1
        cells = np.ascontiguousarray(seen.reshape(2, parts, -1).swapaxes(0, 1))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(parts), pa.int32()), "seen": [c.tobytes() for c in cells],
        })

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in group.column("seen"))
        return pa.table({"part": group.column("part").slice(0, 1), "seen": [total.tobytes()]})

    found = (
        rows.select("text", "toxic").mapInArrow(count, "part int, seen binary")
        .groupBy("part").applyInArrow(add, "part int, seen binary").collect()
    )
    out = np.zeros((parts, 2, FEATURES // parts), np.int64)
    for row in found:
        out[row.part] = np.frombuffer(row.seen, np.int64).reshape(2, -1)
    return out.swapaxes(0, 1).reshape(2, FEATURES)


def log_ratios(counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each slot, and by how many standard errors it differs."""
    share = (counts + 1.0) / (totals[:, None] + 2.0)
    ratio = np.log(share[1] / share[0])
    error = np.sqrt((1 / (counts + 1.0)).sum(axis=0))
    return ratio, np.abs(ratio) / error


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = 0.05,
                 rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression on presence times scale."""
    n, of = len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    values = scale[at]
    weights, bias = np.zeros(len(scale)), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    ahead, ahead_bias, t = weights.copy(), bias, 1.0
    bound = 0.25 * max(1.0, np.bincount(of, weights=values**2, minlength=n).max(initial=0) + 1)
    step = 1.0 / (bound * n / 50 + penalty)
    for _ in range(rounds):
        margin = np.bincount(of, weights=values * ahead[at], minlength=n) + ahead_bias
        wrong = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        slope = np.bincount(at, weights=values * wrong[of], minlength=len(scale)) + penalty * ahead
        new, new_bias = ahead - step * slope, ahead_bias - step * wrong.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - weights)
        ahead_bias = new_bias + (t - 1) / t_new * (new_bias - bias)
        weights, bias, t = new, new_bias, t_new
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learn `toxic` from `docs` (doc_id, text) and `labels` (doc_id, toxic).

    Ids with several labels count as toxic if one says so; rows without a label or id are not
    used. The sample is the `sample` labelled ids of least hash, and of their rows, each (doc_id,
    text) once, again the `sample` of least hash. Without labels all scores are 0.5.
    """
    spark = docs.sparkSession
    clean = labels.filter("doc_id is not null and toxic is not null")
    toxic = (F.max("toxic") > 0).cast("int").alias("toxic")
    chosen = clean.groupBy("doc_id").agg(toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit("")).alias("text")
    # `chosen` has at most `sample` rows, so an id that repeats a lot meets it without a shuffle
    rows = stored(
        docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")
        .withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"])
        .repartition(tasks(spark), "doc_id", "th"),
        "toxicity",
    )
    if rows.count() > sample:
        place = F.struct(F.xxhash64("doc_id", "th").alias("hash"), "doc_id", "th")
        places = rows.select(place.alias("place")).orderBy("place").limit(sample)
        last = places.agg(F.max("place").alias("last")).first().last
        if last is None:
            rows = rows.limit(0)
        else:
            most = F.struct(*(F.lit(v).cast("bigint").alias(c) for c, v in last.asDict().items()))
            rows = rows.filter(place <= most)
    totals = np.zeros(2)
    for row in rows.groupBy("toxic").count().collect():
        totals[row.toxic] = row["count"]
    if not totals.all():
        sure = 0.0 if not totals.sum() else (30.0 if totals[1] else -30.0)
        return Classifier(np.zeros(FEATURES, np.float32), sure)
    counts = _counts(rows)
    ratio, strength = log_ratios(counts, totals)
    best = np.sort(np.argsort(-strength, kind="stable")[:CHOSEN])
    place = np.full(FEATURES, -1, np.int32)
    place[best] = np.arange(len(best))
    shared = spark.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, raw, offsets in repeats.slices(batch.column("text")):
                for r in range(b - a):
                    own = shared.value[slots_of(raw[offsets[r] : offsets[r + 1]])]
                    found.append(own[own >= 0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), batch.column("toxic"),
                 pa.array(found, pa.binary())],
                ["doc_id", "th", "toxic", "found"],
            )

    schema = "doc_id bigint, th bigint, toxic int, found binary"
    known = rows.select("doc_id", "th", "text", "toxic").mapInArrow(features, schema).collect()
    known.sort(key=lambda row: (row.doc_id, row.th))
    weights, bias = fit_logistic(
        [np.frombuffer(row.found, np.int32) for row in known],
        np.array([row.toxic for row in known], float), ratio[best],
    )
    full = np.zeros(FEATURES, np.float32)
    full[best] = weights * ratio[best]
    return Classifier(full, bias)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """`docs` with `toxic_score` from 0 to 1; a null text counts as empty."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((classifier.weights, classifier.bias))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(*shared.value)
        for batch in batches:
            text = batch.column("text").fill_null("")
            yield batch.append_column("toxic_score", pa.array(known.scores(text)))

    base = docs.drop("toxic_score")
    schema = StructType([*base.schema.fields, StructField("toxic_score", DoubleType())])
    return base.mapInArrow(apply, schema)


def keep_clean(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast((classifier.weights, classifier.bias))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(*shared.value)
        for batch in batches:
            scores = known.scores(batch.column("text").fill_null(""))
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(apply, docs.schema)


def learnt(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Train on the rows outside the held-out fold: crc32(doc_id) mod 5 is not 0."""
    return train(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learnt(docs, table(spark, sf_dir, "labels"))).drop("text")
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return scored.select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )

"""Suffix-array dedup by bucket-pointer refinement.

Suffixes that matter are those that agree on their first `window` bytes. They are put into
buckets by their first q bytes (q = window / 2) and refined by the bucket identifiers found at
later offsets: an eight-byte bucket at each position gives the q-gram bucket, q-gram buckets
over the whole surroundings of an anchor refine a bucket in one step for all its suffixes,
and what is still open is refined by the pair (bucket at s, bucket at s + q), which is a bucket
of 2q bytes. Each level reuses the identifiers of the level below. Only agreement is asked for,
so identifiers are 64-bit hashes and Spark's grouping takes the place of sorting ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guestsignal.llm import repeats, vec
from guestsignal.llm.shared import id_again, stored, table, with_text_hash

WINDOW = 400


def _window_buckets(rows: DataFrame, window: int) -> DataFrame:
    """A row for each window of the runs in `spans`: its bucket pair as one identifier, and
    its place, run * window + number within the run."""
    q = window // 2

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for a, b, raw, offsets in repeats.slices(batch.column("text")):
                items, bounds = repeats.byte_items(raw, offsets)
                out: dict[str, list] = {"w": [], "place": [], "open": []}
                total = vec.sums(items)
                for r in range(a, b):
                    own = spans[r].as_py()
                    s = np.concatenate([np.arange(x["lo"], x["lo"] + x["n"]) for x in own])
                    count = [x["n"] for x in own]
                    at = s + bounds[r - a]
                    pair = [vec.span_hash(total, at + d, at + d + q - 7) for d in (0, window - q)]
                    out["w"].append(vec.signed(vec.mix(pair[0] * vec.BASE + pair[1])))
                    base = np.repeat([x["run"] * window for x in own], count)
                    out["place"].append(base + np.concatenate([np.arange(n) for n in count]))
                    out["open"].append(np.repeat([x["k"] == 1 for x in own], count))
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return rows.mapInArrow(buckets, "w bigint, place bigint, open boolean")


def repeated_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, lo, n: starts lo .. lo + n - 1 of windows that also start elsewhere.

    docs: doc_id, th, text of shared.with_text_hash. The window must be even, 32 at least.
    """
    gram = window // 2 - 7
    found = repeats.recurring(docs, repeats.byte_items, window - 7, gram)
    groups = stored(repeats.surroundings(found), "groups")
    same = found.join(groups.filter("k > 1").select("h", "c"), ["h", "c"])
    left = repeats.undecided(groups).select("first.*", "k")
    left = stored(left.withColumn("run", F.monotonically_increasing_id()), "left")
    spans = F.collect_list(F.struct("lo", "n", "k", "run")).alias("spans")
    where = left.groupBy("doc_id", "th").agg(spans).hint("shuffle_hash")
    windows = _window_buckets(docs.join(where, ["doc_id", "th"]), window)
    # windows are many times the text: they are shuffled once, counted there and never stored
    again = F.count(F.lit(1)).over(W.partitionBy("w")) > 1
    run, step = F.expr(f"place div {window}").alias("run"), F.pmod("place", F.lit(window))
    singles = windows.withColumn("again", again).filter("open and again")
    singles = singles.select(run, step.alias("step"))
    # neighbours in a run become one row
    strip = F.col("step") - F.dense_rank().over(W.partitionBy("run").orderBy("step"))
    strips = singles.withColumn("strip", strip).groupBy("run", "strip").agg(
        F.min("step").alias("step"), (F.max("step") - F.min("step") + 1).alias("n")
    )
    starts = strips.join(left.select("doc_id", "th", "lo", "run"), "run").select(
        "doc_id", "th", (F.col("lo") + F.col("step")).alias("lo"), "n"
    )
    return stored(same.select("doc_id", "th", "lo", "n").unionByName(starts), "starts")


def dedupe(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without the bytes of repeated windows.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256, one row for
    each row of `docs` (doc_id, text; other columns are not used). Null and empty texts
    have no bytes. Rows with the same doc_id are separate documents, but rows with the same
    doc_id and text count as one place. Texts shorter than the window keep everything.
    """
    keyed = with_text_hash(docs)
    spans = repeats.intervals_of(repeated_starts(keyed, window)).hint("shuffle_hash")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = vec.string_buffer(batch.column("text"))
            found = batch.column("spans")
            for start in range(0, batch.num_rows, 256):
                rows = []
                for r in range(start, min(start + 256, batch.num_rows)):
                    own = raw[offsets[r] : offsets[r + 1]]
                    spans = found[r].as_py() or []
                    mask = repeats.covered(len(own), spans, window) if spans else None
                    kept = own.tobytes() if mask is None else own[~mask].tobytes()
                    runs = repeats.runs_in(mask) if spans else 0
                    sha = hashlib.sha256(kept).hexdigest()
                    rows.append((len(own), len(own) - len(kept), runs, kept, sha))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, n),
                        *(pa.array([x[k] for x in rows], pa.int64()) for k in range(3)),
                        pa.array([x[3] for x in rows], pa.binary()),
                        pa.array([x[4] for x in rows], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    schema = (
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, "
        "kept_sha256 string"
    )
    out = keyed.join(spans, ["doc_id", "th"], "left").mapInArrow(remove, schema)
    return out.withColumn("doc_id", id_again())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents")).drop("kept")

"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; what remains of a text is a template.
Windows of templates are hashed and joined with the benchmark's windows. For windows that
lie on one diagonal (document place minus item place) the placeholders' values are
compared: each value of the item must stand for one value of the document. So a question with new
numbers or names is found, and a text that merely shares a frame is not.

Documents first meet a bit map of the benchmark's window hashes, of fixed size; only
windows that pass it are shuffled to the join. A larger benchmark lets more pass, never less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm import repeats, vec
from guestsignal.llm.shared import NO_ID, id_again, stored, table, with_text_hash

#: Tokens of a window, and how many of them must be words that are not placeholders.
WINDOW, LITERALS = 8, 4
#: An item is found if this share of its windows is, and this share of its values is consistent.
COVERAGE, CONSISTENCY = 0.5, 0.8
MAP_BITS = 22
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "lb", "lbs",
    "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon",
    "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro",
    "euros", "usd", "eur", "percent", "meter", "meters", "metre", "metres", "kilometer",
    "kilometers", "kilometre", "kilometres", "degree", "degrees", "mph", "kmh", "watt", "watts",
    "volt", "volts",
)

_NUMBER, _NAME, _UNIT = (np.uint64(k) for k in (1, 2, 3))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ".,:/"]] = True


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = vec.word_spans(raw, np.array([0, len(raw)]))
    return np.sort(vec.word_hashes(raw, starts, ends))


def template(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and values of all tokens, and the rows' bounds among them.

    Tokens are runs of letters, digits and non-ASCII bytes. A token with a digit is a number
    (with what follows after one of . , : /), one of UNITS a unit, a capitalised one a
    name; the code of any other is its hash. Values are hashes of the tokens themselves.
    """
    core = np.where(_CORE.take(raw), raw, 32).astype(np.uint8)
    starts, ends, _ = vec.word_spans(core, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    digits = np.concatenate([[0], np.cumsum(_DIGIT.take(raw))])
    number = digits[ends] > digits[starts]
    follows = np.zeros(len(starts), bool)
    follows[1:] = number[1:] & number[:-1] & (starts[1:] == ends[:-1] + 1) & _JOINT[raw[ends[:-1]]]
    head = np.flatnonzero(~follows)
    last = np.append(head[1:], len(starts)) - 1
    starts, ends, number = starts[head], ends[last], number[head]
    lower = _LOWER.take(raw)
    values = vec.word_hashes(lower, starts, ends)
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, values), len(units) - 1)
    first, second = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    codes = np.where(capital, _NAME, values)
    codes = np.where(units[at] == values, _UNIT, codes)
    codes = np.where(number, _NUMBER, codes)
    return codes, values, np.searchsorted(starts, offsets)


WINDOWS = "id bigint, th bigint, at bigint, size bigint, total bigint, h bigint, slots array<bigint>"


def _windows(rows: DataFrame, window: int, known=None, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """Template windows of id, th, text; with `known`, only those whose hash it may have.

    Without `lengths`, a row with fewer tokens than the window has one window, of all its tokens;
    with them, rows have all their windows of each of these lengths too. Shorter windows
    without enough words are hashed by their tokens and have no slots. size: tokens of the
    window; total: windows of the row that count.
    """
    shift = np.uint64(64 - MAP_BITS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy() for k in ("id", "th"))
            for a, b, raw, offsets in repeats.slices(batch.column("text")):
                codes, values, bounds = template(raw, offsets)
                if not len(codes):
                    continue
                size = np.diff(bounds)
                row = np.repeat(np.arange(b - a), size)
                left = bounds[1:][row] - np.arange(len(codes))
                slot = codes <= _UNIT
                before = np.concatenate([[0], np.cumsum(slot)])
                places = np.flatnonzero(slot)
                total, exact = vec.sums(codes), vec.sums(values)
                whole = np.flatnonzero((size > 0) & (size < window)) if lengths is None else []
                for n in (window, *(lengths or ())):
                    long = np.flatnonzero(left >= n)
                    at = np.concatenate([long, bounds[:-1][whole]])
                    end = np.concatenate([long + n, bounds[1:][whole]])
                    words = (end - at) - (before[end] - before[at])
                    enough = words >= np.minimum(LITERALS, end - at)
                    keep = enough | (end - at < window)
                    at, end, enough = at[keep], end[keep], enough[keep]
                    h = np.where(enough, vec.span_hash(total, at, end), vec.span_hash(exact, at, end))
                    count = np.bincount(row[at], minlength=b - a)
                    if known is not None:
                        hit = known.value[(h >> shift).astype(np.int64)]
                        at, end, h, enough = at[hit], end[hit], h[hit], enough[hit]
                    lo, hi = before[at], np.where(enough, before[end], before[at])
                    if n < window:
                        # without slots, the occurrences in a row are all alike
                        bare = np.flatnonzero(lo == hi)
                        bare = bare[np.lexsort((at[bare], h[bare], row[at[bare]]))]
                        fresh = np.ones(len(bare), bool)
                        fresh[1:] = (np.diff(row[at[bare]]) != 0) | (h[bare][1:] != h[bare][:-1])
                        one = np.sort(np.concatenate([bare[fresh], np.flatnonzero(lo < hi)]))
                        at, end, h, lo, hi = at[one], end[one], h[one], lo[one], hi[one]
                    of = row[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[of + a]), pa.array(hashes[of + a]), pa.array(at - bounds[of]),
                            pa.array((end - at).astype(np.int64)),
                            pa.array(count[of].astype(np.int64)), pa.array(vec.signed(h)),
                            pa.array([vec.signed(values[places[x:y]]) for x, y in zip(lo, hi)],
                                     pa.list_(pa.int64())),
                        ],
                        ["id", "th", "at", "size", "total", "h", "slots"],
                    )

    return rows.mapInArrow(cut, WINDOWS)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, item_id, n_windows, coverage, consistency of items found in documents.

    docs: doc_id, text; benchmark: item_id, text. Null and empty texts have no windows. An item of
    fewer tokens than a window is one window and is looked for anywhere in documents; if fewer than
    LITERALS of its tokens (of up to LITERALS tokens: not all) are words, its tokens must be
    the same, numbers and names too. Longer items in which no window has LITERALS words cannot be found.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    wanted = stored(_windows(items, window), "items")
    bits = np.zeros(1 << MAP_BITS, bool)
    place = F.shiftrightunsigned("h", 64 - MAP_BITS).alias("bit")
    marks = wanted.select(place, "size").distinct().collect()
    bits[[row.bit for row in marks]] = True
    lengths = tuple(sorted({row["size"] for row in marks if row["size"] < window}))
    known = spark.sparkContext.broadcast(bits)
    rows = with_text_hash(docs).withColumnRenamed("doc_id", "id")
    found = _windows(rows, window, known, lengths)
    item = wanted.select(
        F.col("id").alias("item_id"), F.col("th").alias("item_th"), F.col("at").alias("item_at"),
        F.col("total").alias("item_total"), "h", F.col("slots").alias("item_slots"),
    )
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    joined = found.join(item, "h").withColumn("pairs", pairs)
    lined = joined.groupBy(
        "id", "th", "item_id", "item_th", "item_total", (F.col("at") - F.col("item_at")).alias("line")
    ).agg(
        F.collect_set("item_at").alias("places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("values"),
    )
    kinds = F.array_distinct(F.transform("values", lambda v: v["a"]))
    consistency = F.when(F.size("values") > 0, F.size(kinds) / F.size("values")).otherwise(1.0)
    good = lined.withColumn("consistency", consistency).filter(F.col("consistency") >= CONSISTENCY)
    return (
        good.groupBy("id", "th", "item_id", "item_th", "item_total")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_windows"),
            F.min("consistency").alias("consistency"),
        )
        .withColumn("coverage", F.col("n_windows") / F.col("item_total"))
        .filter(F.col("coverage") >= COVERAGE)
        .select(F.col("id").alias("doc_id"), "th", "item_id", "n_windows", "coverage", "consistency")
        .groupBy("doc_id", "th", "item_id")
        .agg(*(F.max(c).alias(c) for c in ("n_windows", "coverage", "consistency")))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no benchmark item is found; repeated rows stay or go
    together."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("id"), "th").distinct()
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
    )
    return keyed.join(bad.hint("shuffle_hash"), ["id", "th"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it; clean documents have none."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return leaks(docs, items).select(
        id_again(), id_again("item_id"), "n_windows", "coverage", "consistency"
    )

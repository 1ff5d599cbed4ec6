"""Fill-in-the-middle samples: a text is cut at two places and its parts change places.

Two cuts in units (lines or code points) split a text into prefix, middle and suffix; the sample is
`<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm).

Texts are UTF-8 buffers here, and places in them are wanted both as bytes and as code points. A
SparseIndex keeps an entry for each multibyte character only, its position and its excess bytes:
a place converts by one searchsorted among those entries and one subtraction or addition, so
an ASCII stretch of any length costs nothing. No text is decoded.

Defined cases: a null text is empty; a null doc_id counts as the empty text in the seed hash and comes
back as null; an empty text, one that holds a sentinel or one that the rate leaves out stays plain.
Repeated rows give repeated, equal results (the cuts depend on doc_id and text alone); equal cuts make an
empty middle. A text of any length is one row and is cut whole. Columns other than doc_id and
text are ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm.shared import table
from guestsignal.llm.vec import chunks, string_buffer

SEED = 7
#: Percent of the texts that are cut, and percent of those in the order suffix, prefix, middle.
RATE, SPM_RATE = 100, 50
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that are cut at once.
SLICE = 1 << 23

SAMPLES = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
)


class SparseIndex:
    """Bytes and code points of a UTF-8 buffer by its multibyte characters alone."""

    def __init__(self, raw: np.ndarray) -> None:
        self.at = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: excess bytes of all multibyte characters before each one, and of all
        self.before = np.concatenate([[0], np.cumsum(excess)])
        #: where they stand in code points
        self.at_chars = self.at - self.before[:-1]

    def chars(self, place: np.ndarray) -> np.ndarray:
        """Code points before each byte place; a place is the start of a character or the end."""
        return place - self.before[np.searchsorted(self.at, place)]

    def bytes(self, place: np.ndarray) -> np.ndarray:
        """Bytes before each code-point place."""
        return place + self.before[np.searchsorted(self.at_chars, place)]


class Lines:
    """Units `[^\\n]*\\n|[^\\n]+` of consecutive texts in one buffer."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, index: SparseIndex) -> None:
        self.ends, self.offsets = np.flatnonzero(raw == 10), offsets
        self.first = np.searchsorted(self.ends, offsets)
        self.full = np.diff(self.first)
        last = np.maximum(offsets[1:] - 1, 0)
        open_end = raw[last] != 10 if len(raw) else np.zeros(len(last), bool)
        self.n = self.full + (open_end & (np.diff(offsets) > 0))

    def place(self, units: np.ndarray) -> np.ndarray:
        """Byte place after so many units of each text."""
        out = np.where(units > 0, self.offsets[1:], self.offsets[:-1])
        inside = np.flatnonzero((units > 0) & (units <= self.full))
        out[inside] = self.ends[self.first[inside] + units[inside] - 1] + 1
        return out


class Characters:
    """Code points of consecutive texts in one buffer."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, index: SparseIndex) -> None:
        self.index, self.first = index, index.chars(offsets)
        self.n = np.diff(self.first)

    def place(self, units: np.ndarray) -> np.ndarray:
        return self.index.bytes(self.first[:-1] + units)


UNITS = {"line": Lines, "char": Characters}


def _hash_group(digest: Column, k: int) -> Column:
    """The k-th (from 1) group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def drawn(docs: DataFrame, seed: int, rate: int, spm_rate: int, sentinels: tuple) -> DataFrame:
    """doc_id, text, the two hashes that choose the cuts, and the form of each document."""
    doc_id = F.col("doc_id").cast("bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest")
    )
    marked = reduce(or_, [F.contains("text", F.lit(s)) for s in sentinels])
    plain = (F.col("text") == "") | marked | (F.pmod(_hash_group(F.col("digest"), 3), F.lit(100)) >= rate)
    spm = F.pmod(_hash_group(F.col("digest"), 4), F.lit(100)) < spm_rate
    return rows.select(
        "doc_id", "text", _hash_group(F.col("digest"), 1).alias("h1"),
        _hash_group(F.col("digest"), 2).alias("h2"),
        F.when(plain, "plain").when(spm, "spm").otherwise("psm").alias("form"),
    )


def transform(
    docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE,
    spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One sample for each row of `docs`: doc_id, n (units), form, prefix_chars, middle_chars
    (code points; null if plain) and output, the sample's text."""
    units = UNITS[unit]
    p, s, m = (x.encode() for x in sentinels)

    def samples(rows: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = string_buffer(rows.column("text"))
        h1, h2 = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        form = rows.column("form").to_pylist()
        index = SparseIndex(raw)
        cut = units(raw, offsets, index)
        first, second = h1 % (cut.n + 1), h2 % (cut.n + 1)
        a, b = cut.place(np.minimum(first, second)), cut.place(np.maximum(first, second))
        begin, end = offsets[:-1], offsets[1:]
        whole = memoryview(raw.tobytes())
        output = []
        for kind, i, x, y, j in zip(form, begin.tolist(), a.tolist(), b.tolist(), end.tolist()):
            if kind == "plain":
                output.append(whole[i:j])
            elif kind == "psm":
                output.append(b"".join((p, whole[i:x], s, whole[y:j], m, whole[x:y])))
            else:
                output.append(b"".join((s, whole[y:j], p, whole[i:x], m, whole[x:y])))
        plain = np.array([kind == "plain" for kind in form], bool)
        to_chars = index.chars
        prefix, middle = to_chars(a) - to_chars(begin), to_chars(b) - to_chars(a)
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"), pa.array(cut.n.astype(np.int64)), rows.column("form"),
                pa.array(prefix, mask=plain), pa.array(middle, mask=plain),
                pa.array(output, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(string_buffer(batch.column("text"))[1])
            for start, stop in chunks(lengths, SLICE):
                yield samples(batch.slice(start, stop - start))

    return drawn(docs, seed, rate, spm_rate, sentinels).mapInArrow(run, SAMPLES)


def restored(
    output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS
) -> Column:
    """The text that a sample was made from, by its output and form alone.

    No part holds a sentinel, and no sentinel can begin inside itself, so the first one of each
    kind is the one that was put there.
    """
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    p, s, m = sentinels
    between = lambda text, mark: F.split(text, "\\Q" + mark + "\\E", 2)
    after = lambda text, mark: F.substring(text, F.lit(len(mark) + 1), F.length(text))
    first = between(after(output, p), s)
    psm_rest = between(first[1], m)
    psm = F.concat(first[0], psm_rest[1], psm_rest[0])
    second = between(after(output, s), p)
    spm_rest = between(second[1], m)
    spm = F.concat(spm_rest[0], spm_rest[1], second[0])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored("output", "form")).alias("restored_sha256"),
    )


SQL = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), hashed AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM drawn
), cut AS (
    SELECT *, len(units) AS n,
        least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix,
        array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
    FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

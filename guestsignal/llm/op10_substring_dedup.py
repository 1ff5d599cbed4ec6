"""Substring dedup by repeated-phrase automata.

1. Candidate phrases: runs of windows whose words recur (repeats), each with the place where
   they occur first; these are told apart by 64-bit hashes.
2. Phrases go to the shards of documents that hold a later copy; a shard is a bounded slice of
   the corpus and gets only its own phrases, as places in its own documents.
3. Each shard joins phrases that follow one another at all their places, cuts them out of its
   documents, compiles an Aho-Corasick automaton over word sequences and streams its
   documents through it, but for stretches in which no block of words is a phrase's. The
   automaton compares words; every occurrence after the phrase's first one is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm import repeats, vec
from guestsignal.llm.shared import id_again, stored, table, tasks, with_text_hash

WINDOW = 20
GRAM = 5
#: Shards for each task: an automaton holds the phrases of one shard at a time.
SHARDS_A_TASK = 8


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """A row for each window of the runs in `spans`: hash of its words, and its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy() for k in ("doc_id", "th"))
            spans = batch.column("spans")
            for a, b, raw, offsets in repeats.slices(batch.column("text")):
                items, bounds = repeats.word_items(raw, offsets)
                total = vec.sums(items)
                for r in range(a, b):
                    at = np.concatenate(
                        [np.arange(x["lo"], x["lo"] + x["n"]) for x in spans[r].as_py()]
                    )
                    from_ = at + bounds[r - a]
                    yield pa.RecordBatch.from_pydict({
                        "w": vec.signed(vec.span_hash(total, from_, from_ + window)),
                        "doc_id": np.full(len(at), ids[r]), "th": np.full(len(at), hashes[r]),
                        "at": at,
                    })

    return rows.mapInArrow(cut, "w bigint, doc_id bigint, th bigint, at bigint")


def _shard(shards: int):
    return F.pmod(F.xxhash64("doc_id", "th"), F.lit(shards)).cast("int").alias("shard")


def phrases(docs: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """Recurring phrases for each shard that has to remove a copy.

    A phrase is given by one of its copies in the shard (doc_id, th, at, size) and by its
    first occurrence anywhere (first_doc, first_th, first_at); n is the number of its windows.
    places is a sum of hashes of all its copies' places in the shard, nexts the same of the
    places n words on: places that equal another phrase's nexts are those n words on.
    """
    found = repeats.recurring(docs, repeats.word_items, window, min(GRAM, window))
    groups = stored(repeats.surroundings(found), "groups")
    place = F.struct("doc_id", "th", "at")
    known = groups.filter("k > 1").select(
        "h", "c", F.struct("first.doc_id", "first.th", F.col("first.lo").alias("at")).alias("first")
    )
    copies = found.select("h", "c", "doc_id", "th", F.col("lo").alias("at"), (F.col("n") + window - 1).alias("size"))
    long = copies.join(known, ["h", "c"]).filter(place > F.col("first"))
    left = repeats.undecided(groups).select("first.*")
    spans = F.collect_list(F.struct("lo", "n")).alias("spans")
    where = left.groupBy("doc_id", "th").agg(spans).hint("shuffle_hash")
    windows = stored(_windows(docs.join(where, ["doc_id", "th"]), window), "windows")
    again = (
        windows.groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.min(place).alias("first"))
        .filter("k > 1").select("w", "first")
    )
    short = windows.join(again, "w").filter(place > F.col("first"))
    here = F.min(F.struct("doc_id", "th", "at", "size")).alias("here")
    after = F.col("at") + F.col("size") - (window - 1)
    # room for sums; one that overflows all the same equals no other
    places, nexts = (
        F.coalesce(F.try_sum(F.shiftright(F.xxhash64("doc_id", "th", at), 8)), F.lit(none)).alias(name)
        for name, at, none in (("places", F.col("at"), 1), ("nexts", after, 2))
    )
    long = long.groupBy("h", "c", _shard(shards), "first").agg(here, places, nexts)
    short = (
        short.withColumn("size", F.lit(window).cast("bigint"))
        .groupBy("w", _shard(shards), "first").agg(here, places, nexts)
    )
    names = ("shard", "here", "first", "places", "nexts")
    out = long.select(*names).unionByName(short.select(*names))
    return out.select(
        "shard", "here.*", "places", "nexts", (F.col("here.size") - (window - 1)).alias("n"),
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.th").alias("first_th"), F.col("first.at").alias("first_at"),
    )


def automaton(lines: list[list[bytes]], values: list) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """Automaton over sequences of word numbers, and the numbers of its words (from 1)."""
    numbers: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    first: dict[tuple[int, ...], tuple] = {}
    for words, value in zip(lines, values):
        key = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words])
        first[key] = min(first.get(key, value), value)
    for key, value in first.items():
        machine.add_word(key, (len(key), value))
    if first:
        machine.make_automaton()
    return machine, numbers


def _joined(known: pa.Table) -> Iterator[tuple]:
    """(doc_id, th, at, size, first_doc, first_th, first_at) of a shard's phrases. A phrase that
    follows another one by its number of windows at every place, the first one too, is joined to
    it: the whole then has the places of its beginning."""
    names = ("doc_id", "th", "at", "size", "first_doc", "first_th", "first_at", "n", "places", "nexts")
    own = {k: known.column(k).to_numpy() for k in names}
    order = np.lexsort((own["at"], own["th"], own["doc_id"]))
    own = {k: v[order] for k, v in own.items()}
    follows = np.zeros(len(order), bool)
    follows[1:] = own["places"][1:] == own["nexts"][:-1]
    for k in ("doc_id", "th", "first_doc", "first_th"):
        follows[1:] &= own[k][1:] == own[k][:-1]
    for k in ("at", "first_at"):
        follows[1:] &= own[k][1:] == own[k][:-1] + own["n"][:-1]
    begin = np.flatnonzero(~follows)
    last = np.append(begin[1:], len(order))[: len(begin)] - 1
    size = own["at"][last] + own["size"][last] - own["at"][begin]
    out = {k: own[k][begin] for k in names[:7]} | {"size": size}
    return zip(*(v.tolist() for v in out.values()))


def _compiled(
    docs: pa.Table, known: pa.Table
) -> tuple[ahocorasick.Automaton, dict[bytes, int], set[bytes], int]:
    """The automaton of a shard's phrases, whose words are cut out of the shard's documents, and
    all blocks of words in the phrases, of a length that fits into any phrase from a multiple of
    it on."""
    wanted: dict[tuple[int, int], list[tuple]] = {}
    for doc_id, th, at, size, *first in _joined(known):
        wanted.setdefault((doc_id, th), []).append((at, size, tuple(first)))
    lines, firsts = [], []
    if wanted:
        place = zip(docs.column("doc_id").to_pylist(), docs.column("th").to_pylist())
        for row, key in enumerate(place):
            if spans := wanted.pop(key, None):
                words = docs.column("text")[row].as_py().encode().split()
                lines += [words[at : at + size] for at, size, _ in spans]
                firsts += [first for _, _, first in spans]
    block = (min(map(len, lines), default=1) + 1) // 2
    blocks = {b" ".join(words[k : k + block]) for words in lines for k in range(len(words) - block + 1)}
    return *automaton(lines, firsts), blocks, block


def _stretches(words: list[bytes], blocks: set[bytes], block: int) -> Iterator[tuple[int, int]]:
    """Ranges of words outside which no phrase can lie: blocks at multiples of the length that
    occur in a phrase, neighbours together, and the words of partial blocks beside them."""
    begin = None
    for at in range(0, len(words) - block + 1, block):
        if b" ".join(words[at : at + block]) in blocks:
            if begin is None:
                begin = at
            end = at + block
        elif begin is not None:
            yield max(0, begin - block + 1), end + block - 1
            begin = None
    if begin is not None:
        yield max(0, begin - block + 1), end + block - 1


def _remove(docs: pa.Table, known: pa.Table) -> Iterator[pa.RecordBatch]:
    """Streams one shard's documents through the automaton of its phrases."""
    machine, numbers, blocks, block = _compiled(docs, known)
    number = numbers.get
    rows = []
    for batch in docs.to_batches(max_chunksize=256):
        ids, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
        for doc_id, th, text in zip(ids, hashes, batch.column("text").to_pylist()):
            words = text.encode().split()
            mask = None
            steps = None
            for a, b in _stretches(words, blocks, block) if numbers else ():
                for last, (size, first) in machine.iter(tuple([number(w, 0) for w in words[a:b]])):
                    end = a + last + 1
                    if (doc_id, th, end - size) > first:
                        if steps is None:
                            steps = np.zeros(len(words) + 1, np.int64)
                        steps[end - size] += 1
                        steps[end] -= 1
            if steps is not None:
                mask = np.cumsum(steps)[:-1] > 0
            kept = words if mask is None else [w for w, out in zip(words, mask) if not out]
            joined = b" ".join(kept)
            rows.append((doc_id, len(words), len(words) - len(kept), joined.decode(),
                         hashlib.sha256(joined).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2)],
            ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
        )
        rows = []


def dedupe(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without the words of windows that start earlier somewhere.

    Returns doc_id, n_words, n_removed, kept, kept_sha256, one row for each row of `docs`
    (doc_id, text; other columns are not used). Null, empty and blank texts have no words.
    Earlier is the smaller (doc_id, text hash, start), a null doc_id before all; rows with the
    same doc_id and text count as one place.
    """
    spark = docs.sparkSession
    keyed = with_text_hash(docs)
    parts = tasks(spark)
    shards = parts * SHARDS_A_TASK
    known = stored(phrases(keyed, shards, window), "known")
    dealt = keyed.withColumn("shard", _shard(shards))

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"
    groups = dealt.groupBy("shard").cogroup(known.groupBy("shard"))
    out = groups.applyInArrow(_cogrouped, schema)
    return out.withColumn("doc_id", id_again())


def _cogrouped(docs: pa.Table, known: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept", pa.string()), ("kept_sha256", pa.string())])
    return pa.Table.from_batches(_remove(docs, known), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents")).drop("kept")

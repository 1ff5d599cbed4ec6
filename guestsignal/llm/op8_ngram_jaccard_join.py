"""N-gram Jaccard join with set-relation skipping.

Sets are the distinct 5-word shingles of a text as 64-bit hashes. Equal sets collapse to one
key. The shingles of a set are ordered from rare to frequent; two sets that link share one
of each other's first size - ceil(t * size) + 1 shingles, so only these go into the index.

Index level: a list is cut into blocks of equal size and position, and a pair of blocks is
skipped as a whole when no pair in it can reach the overlap.
Answer level: all sets of a list are first joined with its leader. What is then known about
two sets and their leader settles most of their pairs: same component, overlap too small
(|x & y| <= |y & L| + |x - L|) or large enough (|x & y| >= |x & L| + |y & L| - |L|).
Sets of lists from MAPPED_LIST on also carry a bit map of BITS parities: it differs in no more places
than the sets do, which bounds their overlap. Before all pairs of a long list are looked at, each of
its sets tries a few of the list's HUBS sets of least key that this bound leaves.
Only pairs that are still open are verified on the sets themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm import repeats, vec
from guestsignal.llm.components import components
from guestsignal.llm.shared import NO_ID, id_again, stored, table, tasks, with_text_hash

WORDS = 5
#: Similarity of 0.75 as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Counters of the frequency sketch (fixed size, so that every task can have it) and its chunks.
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Lists of at least this length carry bit maps; have hubs and are cut into blocks.
MAPPED_LIST, LONG_LIST = 8, 48
#: Parities in a set's bit map; sets of a long list that the others try first, and tries for each.
BITS, HUBS, TRIES = 1024, 64, 6
#: Bits of the map that every task has of the wanted documents' hashes (fixed size), 64 to a row.
WANTED_BITS = 24
#: Postings a task packs at once, and index partitions for each shuffle partition.
PACK, PARTS_A_TASK = 400_000, 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    items, bounds = repeats.word_items(_LOWER.take(raw), offsets)
    grams = vec.gram_hashes(items, WORDS)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= WORDS:
            out.append(np.unique(grams[lo : hi - WORDS + 1]))
        elif hi > lo:
            whole = np.zeros(1, np.uint64)
            for item in items[lo:hi]:
                whole = vec.mix(whole * vec.BASE + item)
            out.append(whole + np.uint64(hi - lo))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a sorted set."""
    if not len(tokens):
        return 0
    up, _ = vec.powers(len(tokens))
    total = np.sum(vec.mix(tokens + np.uint64(1)) * up[: len(tokens)])
    return int(vec.mix(np.array([total + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def set_bits(tokens: np.ndarray) -> bytes:
    """For each of BITS classes of shingles, whether the set has an odd number of them."""
    found = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((found & 1).astype(np.uint8)).tobytes()


def packed_counts(counts: np.ndarray) -> bytes:
    """Counters up to 65535, all low bytes before all high ones, deflated: most are small."""
    planes = np.minimum(counts, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T
    return zlib.compress(planes.tobytes(), 1)


def counts_of(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, -1)
    return planes[0] + (planes[1].astype(np.uint64) << np.uint64(8))


def _described(docs: DataFrame) -> DataFrame:
    """A row for each document (size, key and bit map of its set), and rows of sketch counts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for a, b, raw, offsets in repeats.slices(batch.column("text")):
                sets = shingle_sets(raw, offsets)
                tokens = np.concatenate(sets)
                at = (tokens >> shift).astype(np.int64)
                if len(at):
                    where, count = np.unique(at, return_counts=True)
                    sketch[where] += count.astype(np.uint32)
                n = b - a
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, n),
                    "th": batch.column("th").slice(a, n),
                    "size": np.array([len(s) for s in sets], np.int64),
                    "key": np.array([set_key(s) for s in sets], np.int64),
                    "bits": pa.array([set_bits(s) if len(s) else None for s in sets], pa.binary()),
                    "part": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary()),
                })
        if sketch.any():
            n = SKETCH_PARTS
            nothing = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": nothing, "th": nothing, "size": nothing, "key": nothing,
                "bits": pa.nulls(n, pa.binary()),
                "part": pa.array(range(n), pa.int32()),
                "counts": [packed_counts(c) for c in sketch.reshape(n, -1)],
            })

    schema = "doc_id bigint, th bigint, size bigint, key bigint, bits binary, part int, counts binary"
    return docs.mapInArrow(describe, schema)


def _sketch_levels(described: DataFrame) -> np.ndarray:
    """log2 of the summed counters: a fixed number of bytes, whatever the corpus."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
        for counts in group.column("counts"):
            total += counts_of(counts.as_py())
        levels = np.log2(total + np.uint64(1)).astype(np.uint8)
        return pa.table({"part": group.column("part").slice(0, 1), "levels": [levels.tobytes()]})

    rows = (
        described.filter("part is not null").select("part", "counts").groupBy("part")
        .applyInArrow(add, "part int, levels binary").collect()
    )
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for row in rows:
        out[row.part] = np.frombuffer(row.levels, np.uint8)
    return out.ravel()


def prefix_length(size):
    return size - (-(-NUMERATOR * size // DENOMINATOR)) + 1


def needed(x, y):
    """Least overlap of two sets of these sizes that link."""
    return -(-NUMERATOR * (x + y) // (NUMERATOR + DENOMINATOR))


def _postings(docs: DataFrame, levels, parts: int) -> DataFrame:
    """Index entries of the first shingles of each distinct set of a task, packed by part."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value.astype(np.uint64) << np.uint64(58)
        shift = np.uint64(64 - SKETCH_BITS)
        seen: set[int] = set()
        columns: list[list[np.ndarray]] = [[], [], [], []]
        held = 0

        def packed() -> pa.RecordBatch:
            token, key, size, position = map(np.concatenate, columns)
            part = (vec.mix(token.copy()) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            token, key, size, position = (c[order] for c in (token, key, size, position))
            cells = {k: [] for k in ("part", "token", "key", "size", "position")}
            for p in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[p], cuts[p + 1])
                cells["part"].append(int(p))
                cells["token"].append(token[at].astype(np.uint32).tobytes())
                cells["key"].append(key[at].tobytes())
                cells["size"].append(size[at].tobytes())
                cells["position"].append(position[at].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(cells["part"], pa.int32())]
                + [pa.array(cells[k], pa.binary()) for k in ("token", "key", "size", "position")],
                ["part", "token", "key", "size", "position"],
            )

        for batch in batches:
            for _, _, raw, offsets in repeats.slices(batch.column("text")):
                for tokens in shingle_sets(raw, offsets):
                    if not len(tokens) or (key := set_key(tokens)) in seen:
                        continue
                    seen.add(key)
                    n, keep = len(tokens), prefix_length(len(tokens))
                    rank = level[(tokens >> shift).astype(np.int64)] | (tokens >> np.uint64(6))
                    first = np.argpartition(rank, keep - 1)[:keep] if keep < n else np.arange(n)
                    first = first[np.argsort(rank[first], kind="stable")]
                    columns[0].append(tokens[first])
                    columns[1].append(np.full(keep, key, np.int64))
                    columns[2].append(np.full(keep, n, np.uint32))
                    columns[3].append(np.arange(keep, dtype=np.uint32))
                    held += keep
                if held > PACK:
                    yield packed()
                    columns, held = [[], [], [], []], 0
        if held:
            yield packed()

    schema = "part int, token binary, key binary, size binary, position binary"
    return docs.mapInArrow(post, schema)


LISTS = "list bigint, key bigint, size bigint, position bigint, leader bigint, leader_size bigint, members bigint"


def _lists(group: pa.Table) -> pa.Table:
    """The lists with two sets or more of one part, led by their least key."""
    kinds = {"token": np.uint32, "key": np.int64, "size": np.uint32, "position": np.uint32}
    token, key, size, position = (
        np.concatenate([np.frombuffer(x.as_py(), kind) for x in group.column(name)])
        for name, kind in kinds.items()
    )
    order = np.lexsort((key, token))
    token, key, size, position = token[order], key[order], size[order], position[order]
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (key[1:] == key[:-1])
    token, key, size, position = (c[~same] for c in (token, key, size, position))
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(start, len(token)))
    of = np.repeat(np.arange(len(start)), length)
    keep = length[of] > 1
    of, at = of[keep], np.flatnonzero(keep)
    lead = start[of]
    part = group.column("part")[0].as_py() if len(group) else 0
    return pa.table({
        "list": (np.int64(part) << 32) | token[at].astype(np.int64), "key": key[at],
        "size": size[at].astype(np.int64), "position": position[at].astype(np.int64),
        "leader": key[lead], "leader_size": size[lead].astype(np.int64), "members": length[of],
    })


def bit_maps(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps as rows of 64-bit words (zeros where there is none), and which rows have one."""
    has = np.array(column.is_valid().to_pylist(), bool)
    words = b"".join(column.fill_null(bytes(BITS // 8)).to_pylist())
    return np.frombuffer(words, np.uint64).reshape(-1, BITS // 64), has


def unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in which bit maps differ: no more than the sets themselves differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def settled_by_leader(a, b, size, overlap, lead_size):
    """Pairs that their overlaps with a common leader rule out, and those they prove to link."""
    known = (overlap[a] >= 0) & (overlap[b] >= 0)
    least = needed(size[a], size[b])
    most = np.minimum(overlap[b] + size[a] - overlap[a], overlap[a] + size[b] - overlap[b])
    return known & (most < least), known & (overlap[a] + overlap[b] - lead_size[a] >= least)


def short_pairs(of, size, position, side, overlap, lead_size, bits, has):
    """Pairs (indices) of neighbours in lists too short for blocks that may link, and whether it
    is sure; of: sorted."""
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]]
    for step in range(1, LONG_LIST):
        a = np.flatnonzero(of[step:] == of[:-step])
        if not len(a):
            break
        b = a + step
        least = needed(size[a], size[b])
        rest = np.minimum(size[a] - position[a], size[b] - position[b])
        fits = (np.minimum(position[a], position[b]) + rest >= least) & (side[a] != side[b])
        a, b, least = a[fits], b[fits], least[fits]
        fits = ~(has[a] & has[b]) | (size[a] + size[b] - unlike(bits[a], bits[b]) >= 2 * least)
        a, b = a[fits], b[fits]
        none, sure = settled_by_leader(a, b, size, overlap, lead_size)
        for kept, rows in zip(found, (a[~none], b[~none], sure[~none])):
            kept.append(rows)
    return tuple(np.concatenate(kept) for kept in found)


def open_pairs(key, size, position, comp, overlap, lead_size, bits, has):
    """Pairs of one list that may link (indices), and those already known to link.

    comp is 0, overlap is -1 and has is False where nothing is known.
    """
    order = np.lexsort((position, size))
    s, p = size[order], position[order]
    edge = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])))
    stop = np.append(edge[1:], len(s))
    bs, bp = s[edge].astype(np.int64), p[edge].astype(np.int64)
    block = np.repeat(np.arange(len(edge)), stop - edge)
    side = np.where(comp == 0, key, comp)[order]
    found_a, found_b = [], []
    for i in range(len(edge)):
        high = int(np.searchsorted(bs, bs[i] * DENOMINATOR // NUMERATOR, side="right"))
        bound = np.minimum(bp[i], bp[i:high]) + np.minimum(bs[i] - bp[i], bs[i:high] - bp[i:high])
        reach = bound >= needed(bs[i], bs[i:high])
        y = np.flatnonzero(reach[block[edge[i] : stop[high - 1]] - i]) + edge[i]
        for x in range(edge[i], stop[i]):
            b = y[(y > x) & (side[y] != side[x])]
            if len(b) and has[order[x]]:
                far = unlike(bits[order[x]], bits[order[b]])
                b = b[~has[order[b]] | (s[x] + s[b] - far >= 2 * needed(s[x], s[b]))]
            if len(b):
                found_a.append(np.full(len(b), order[x]))
                found_b.append(order[b])
    if not found_a:
        nothing = np.empty(0, np.int64)
        return nothing, nothing, np.empty(0, bool)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    none, sure = settled_by_leader(a, b, size, overlap, lead_size)
    a, b, sure = a[~none], b[~none], sure[~none]
    # one sure link between two components, or a set and a component, makes the others needless
    side = np.where(comp == 0, key, comp)
    low, high = np.minimum(side[a], side[b]), np.maximum(side[a], side[b])
    order = np.lexsort((~sure, high, low))
    low, high = low[order], high[order]
    first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(order)]
    settled = sure[order][first][np.cumsum(first) - 1] if len(order) else first
    keep = np.sort(order[~settled | first])
    return a[keep], b[keep], sure[keep]


def _pairs(group: pa.Table) -> pa.Table:
    """Open pairs of all lists of one part, with the number of lists they were open in."""
    column = lambda name, none: group.column(name).fill_null(none).to_numpy()
    order = np.argsort(column("list", 0), kind="stable")
    names = (("list", 0), ("key", 0), ("size", 0), ("position", 0), ("comp", 0), ("overlap", -1),
             ("leader_size", 0))
    of, key, size, position, comp, overlap, lead_size = (column(*n)[order] for n in names)
    bits, has = (x[order] for x in bit_maps(group.column("bits")))
    side = np.where(comp == 0, key, comp)
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    length = np.diff(np.append(start, len(of)))
    short = np.flatnonzero(np.repeat(length < LONG_LIST, length))
    a, b, sure = short_pairs(*(c[short] for c in (of, size, position, side, overlap, lead_size, bits, has)))
    out = [[short[a]], [short[b]], [sure]]
    for lo, n in zip(start[length >= LONG_LIST], length[length >= LONG_LIST]):
        at = slice(lo, lo + n)
        if comp[lo] and (comp[at] == comp[lo]).all():
            continue
        a, b, sure = open_pairs(key[at], size[at], position[at], comp[at], overlap[at], lead_size[at],
                                bits[at], has[at])
        for k, v in enumerate((a + lo, b + lo, sure)):
            out[k].append(v)
    a, b, sure = (np.concatenate(c) for c in out)
    swap = key[a] > key[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((key[b], key[a]))
    left, right, sure = a[order], b[order], sure[order].astype(np.int64)
    a, b, sa, sb = key[left], key[right], size[left], size[right]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else order
    count = np.diff(np.append(first, len(a)))
    sure = np.maximum.reduceat(sure, first) if len(a) else sure
    return pa.table({"a": a[first], "b": b[first], "sa": sa[first], "sb": sb[first],
                     "shared": count, "sure": sure})


def _may_link() -> Column:
    """Shared first shingles and all others of one set reach the overlap."""
    def rest(s):
        return F.ceil(F.lit(NUMERATOR) * F.col(s) / F.lit(DENOMINATOR)).cast("bigint") - 1

    least = F.ceil(
        F.lit(NUMERATOR) * (F.col("sa") + F.col("sb")) / F.lit(NUMERATOR + DENOMINATOR)
    ).cast("bigint")
    return F.col("shared") + F.greatest(rest("sa"), rest("sb")) >= least


def _first_places(rows: DataFrame) -> DataFrame:
    """doc_id and th of the first document that has each set, stored."""
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("at"))
    return stored(first.select("at.*", "key"), "first")


def may_be_wanted(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The documents whose hash is in a map of those of `places` (doc_id, th): all that are there, and of
    the others a share of no more than places / 2 ** WANTED_BITS, so that few texts are moved for nothing."""
    at = F.shiftrightunsigned(F.xxhash64("doc_id", "th"), 64 - WANTED_BITS)
    word, bit = F.shiftright(at, 6).alias("_word"), at.bitwiseAND(F.lit(63)).cast("int")
    found = places.select(word, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit"))
    words = found.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = docs.select(*docs.columns, word).join(F.broadcast(words), "_word")
    return marked.filter(F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1).select(
        *docs.columns
    )


def _verify(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with their overlap. Each pair moves one of its two texts, from the first
    document that has its set; shingles would take more room."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    texts = may_be_wanted(docs, first.join(keys.distinct(), "key").select("doc_id", "th"))
    placed = pairs.select("a", "b")
    for side in "ab":
        at = (F.col("key").alias(side), F.col("doc_id").alias(f"id_{side}"), F.col("th").alias(f"th_{side}"))
        placed = placed.join(first.select(*at), side)
    for side in "ba":
        own = (F.col("doc_id").alias(f"id_{side}"), F.col("th").alias(f"th_{side}"), F.col("text").alias(f"text_{side}"))
        placed = placed.join(texts.select(*own), [f"id_{side}", f"th_{side}"])
    size = 128

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                n = part.num_rows
                keys = np.concatenate([part.column(k).to_numpy() for k in "ab"])
                _, at, of = np.unique(keys, return_index=True, return_inverse=True)
                texts = pa.concat_arrays([part.column("text_a"), part.column("text_b")]).take(pa.array(at))
                sets = [s for _, _, raw, offsets in repeats.slices(texts) for s in shingle_sets(raw, offsets)]
                found = [
                    len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(of[:n], of[n:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(found, pa.int64())],
                    ["a", "b", "overlap"],
                )

    both = placed.select("a", "b", "text_a", "text_b")
    overlaps = both.mapInArrow(count, "a bigint, b bigint, overlap bigint")
    return pairs.join(overlaps, ["a", "b"])


def _linked() -> Column:
    union = F.col("sa") + F.col("sb") - F.col("overlap")
    return F.col("overlap") * DENOMINATOR >= union * NUMERATOR


PAIRS = "a bigint, b bigint, sa bigint, sb bigint, shared bigint, sure bigint"
TRIED = "a bigint, b bigint, sa bigint, sb bigint"


def _tries(group: pa.Table) -> pa.Table:
    """For each set of one part's long lists, up to TRIES hubs of the list that it may link with."""
    column = lambda name: group.column(name).fill_null(0).to_numpy()
    order = np.lexsort((column("key"), column("list")))
    names = ("list", "key", "size", "position", "comp")
    of, key, size, position, comp = (column(name)[order] for name in names)
    bits = bit_maps(group.column("bits"))[0][order]
    side = np.where(comp == 0, key, comp)
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
    found: list[list[np.ndarray]] = [[], []]
    for lo, hi in zip(cuts, np.append(cuts[1:], len(of)) if len(of) else []):
        hub = np.arange(lo, min(lo + HUBS, hi))
        for start in range(lo, hi, 4096):
            x = np.arange(start, min(start + 4096, hi))[:, None]
            least = needed(size[x], size[hub])
            rest = np.minimum(size[x] - position[x], size[hub] - position[hub])
            fits = np.minimum(position[x], position[hub]) + rest >= least
            far = unlike(bits[x], bits[hub][None])
            fits &= (size[x] + size[hub] - far >= 2 * least) & (side[x] != side[hub])
            at, to = np.nonzero(fits & (np.cumsum(fits, axis=1) <= TRIES))
            found[0].append(x[at, 0])
            found[1].append(hub[to])
    x, y = (np.concatenate(c) if c else np.empty(0, np.int64) for c in found)
    swap = key[x] > key[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    _, once = np.unique(np.stack([key[x], key[y]], axis=1), axis=0, return_index=True)
    x, y = x[once], y[once]
    return pa.table({"a": key[x], "b": key[y], "sa": size[x], "sb": size[y]})


def _with_components(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists with the component of each key (null: none yet) and the part."""
    comps = components(links).withColumnRenamed("node", "key")
    return lists.join(comps, "key", "left").withColumn("part", F.shiftright("list", 32))


def key_links(docs: DataFrame, rows: DataFrame, described: DataFrame) -> DataFrame:
    """Edges (a, b) between keys of sets that connect all linked sets.

    rows: doc_id, th, size, key and bits of the documents that have a set.
    """
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(_sketch_levels(described))
    parts = tasks(spark) * PARTS_A_TASK
    lists = stored(
        _postings(docs, levels, parts).groupBy("part").applyInArrow(_lists, LISTS), "lists"
    )
    led = lists.filter("leader <> key").select(
        F.col("key").alias("a"), F.col("leader").alias("b"),
        F.col("size").alias("sa"), F.col("leader_size").alias("sb"),
    )
    candidates = led.groupBy("a", "b", "sa", "sb").agg(F.count(F.lit(1)).alias("shared"))
    # a leader is not in all lists of a set, so the number of lists proves nothing here
    sizes_fit = F.least("sa", "sb") * DENOMINATOR >= F.greatest("sa", "sb") * NUMERATOR
    led = stored(candidates.filter(sizes_fit & (F.col("shared") > 1)), "led")
    first = _first_places(rows)
    checked = stored(_verify(docs, first, led), "checked")
    early = checked.filter(_linked()).select("a", "b")
    mapped = lists.filter(F.col("members") >= MAPPED_LIST).select("key").distinct()
    maps = rows.join(mapped, "key", "left_semi").groupBy("key").agg(F.first("bits").alias("_bits"))
    maps = stored(maps, "maps")
    long = lists.filter(F.col("members") >= LONG_LIST).join(maps, "key").withColumnRenamed("_bits", "bits")
    tried = _with_components(long, early)
    tried = stored(tried.groupBy("part").applyInArrow(_tries, TRIED).distinct(), "tried")
    more = _verify(docs, first, tried).filter(_linked()).select("a", "b")
    early = stored(early.unionByName(more), "early")
    # all that is known about a set hangs on its key, so that the lists are dealt by key once
    seen = checked.groupBy(F.col("a").alias("key")).agg(
        F.map_from_entries(F.collect_set(F.struct("b", "overlap"))).alias("_seen")
    )
    self_known = F.when(F.col("key") == F.col("leader"), F.col("size"))
    known = _with_components(lists.join(seen, "key", "left").join(maps, "key", "left"), early).select(
        "list", "key", "size", "position", "leader_size", "comp", "part",
        F.coalesce(self_known, F.try_element_at("_seen", F.col("leader"))).alias("overlap"),
        F.when(F.col("members") >= MAPPED_LIST, F.col("_bits")).alias("bits"),
    )
    pairs = (
        known.groupBy("part").applyInArrow(_pairs, PAIRS)
        .groupBy("a", "b", "sa", "sb")
        .agg(F.sum("shared").alias("shared"), F.max("sure").alias("sure"))
    )
    opened = stored(pairs.filter(_may_link() | (F.col("sure") == 1)), "open")
    checked = _verify(docs, first, opened.filter("sure = 0")).filter(_linked()).select("a", "b")
    links = opened.filter("sure = 1").select("a", "b").unionByName(checked)
    return links.unionByName(early)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id for each row of `docs` (doc_id, text).

    Texts without words (null, empty, blank) have an empty set and a component of their own.
    Rows with the same doc_id are separate rows; a null doc_id is before all others.
    A set is known by a 64-bit key.
    """
    keyed = with_text_hash(docs)
    described = stored(_described(keyed), "described")
    rows = described.filter("part is null").select("doc_id", "th", "size", "key", "bits")
    full = rows.filter("size > 0")
    least = full.groupBy("key").agg(F.min("doc_id").alias("least"))
    comps = components(key_links(keyed, full, described))
    member = least.join(comps, least["key"] == comps["node"])
    of_comp = member.groupBy("comp").agg(F.min("least").alias("component"))
    found = stored(member.join(of_comp, "comp").select("key", "component"), "found")
    known = least.join(found, "key", "left").select(
        "key", F.coalesce("component", "least").alias("component_id")
    )
    out = rows.join(known, "key", "left")
    return out.select(
        "doc_id", "th", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those that an earlier row of their group stands for.

    The row of least (doc_id, text hash) stays; of repeated rows, one. All texts without
    words stay.
    """
    groups = grouped(docs).filter("n_shingles > 0")
    kept = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_.alias("id"), F.xxhash64(text).alias("th"),
        text.rlike("[^\\x20\\x09-\\x0D]").alias("full"),
    )
    first = kept.select(F.col("first.doc_id").alias("id"), F.col("first.th").alias("th"))
    stay = own.filter("full").join(first.hint("shuffle_hash"), ["id", "th"])
    once = stay.dropDuplicates(["id", "th"])
    return once.select("row.*").unionByName(own.filter("not full").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select(id_again(), "n_shingles", id_again("component_id"))

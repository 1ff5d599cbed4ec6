"""Exact top-k search on impact-ordered postings, score at a time.

Components are quantised to integers. A shard of vectors is an index of posting segments: the values
that a block of its rows (sorted by their strongest dimension) has in a group of dimensions, with the
least and the greatest value of each dimension. For a block of queries, the impact of a segment is what it can
add to the inner product beyond its least. Row blocks come from high to low bound,
and their segments from high to low impact; what a row has gathered plus what the segments not yet seen can
add at most is its upper bound, and the k-th best score of a query so far is its floor, which is
carried from block to block and from shard to shard. A row block stops on proof: when few of its rows
can reach the floor, only these are rescored exactly; when none can, it is not looked at. Without
that proof all its segments are processed, which makes one exact matrix product in parts.

Equal rows (id and vector) are one row with a count, so no id or vector makes a shard larger than others.
A task owns a block of queries and streams all shards past it; it keeps k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestsignal.llm.shared import stored, table, tasks

K, SCALE, EVERY = 20, 64, 20
#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 4096, 512
#: Rows and dimensions of a segment; the share of rows that is rescored rather than gathered further.
SEGMENT_ROWS, SEGMENT_DIMS, FEW = 1024, 16, 1 / 64


class Index:
    """Posting segments of one shard."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, count: np.ndarray) -> None:
        strong = np.abs(values).argmax(axis=1) if values.shape[1] else np.zeros(len(ids), np.int64)
        most = np.take_along_axis(values, strong[:, None], 1)[:, 0] if values.shape[1] else strong
        order = np.lexsort((most, strong))
        self.ids, self.values, self.count = ids[order], values[order], count[order]
        starts = np.arange(0, len(ids), SEGMENT_ROWS)
        self.blocks = [slice(i, i + SEGMENT_ROWS) for i in starts]
        self.low = np.array([self.values[b].min(axis=0) for b in self.blocks])
        self.high = np.array([self.values[b].max(axis=0) for b in self.blocks])
        self.by_id = np.argsort(self.ids, kind="stable")

    def twins(self, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs equal in id and vector; there is at most one row for each query."""
        known = self.ids[self.by_id]
        low, high = np.searchsorted(known, ids), np.searchsorted(known, ids, "right")
        query = np.repeat(np.arange(len(ids)), high - low)
        shift = np.arange(len(query)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        row = self.by_id[np.repeat(low, high - low) + shift]
        same = (self.values[row] == queries[query]).all(axis=1)
        return query[same], row[same]


class Asked:
    """A block of queries and the best rows they have met."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.floor = np.full(len(ids), -np.inf)
        nothing = np.empty(0, np.int64)
        self.query = self.row_id = self.score = self.count = nothing
        self.processed = self.postings = 0

    def meet(self, index: Index) -> None:
        """One shard: row blocks by descending bound."""
        kind = _exact_kind(self.queries, index.values)
        queries, values = self.queries.astype(kind), index.values.astype(kind)
        ends = queries[:, None] * index.low, queries[:, None] * index.high
        least, most = np.minimum(*ends), np.maximum(*ends)
        reach = most.sum(axis=2)
        twin_query, twin_row = index.twins(self.ids, self.queries)
        self.postings += len(queries) * values.size
        for b in np.argsort(-reach.mean(axis=0), kind="stable"):
            live = np.flatnonzero(reach[:, b] >= self.floor)
            if not len(live):
                continue
            rows = index.blocks[b]
            who, row, score = self._members(
                queries[live], values[rows], least[live, b], most[live, b], self.floor[live]
            )
            who, row = live[who], row + rows.start
            count = index.count[row].copy()
            # the row that asks is no answer, its repeats are
            own = np.isin(who * len(index.ids) + row, twin_query * len(index.ids) + twin_row)
            count[own] -= 1
            self._keep(who[count > 0], index.ids[row[count > 0]], score[count > 0], count[count > 0])

    def _members(self, queries, values, least, most, floor) -> tuple:
        """(query, row, exact score) of all rows of one block that reach the floor, and others."""
        impact = (most - least).sum(axis=0)
        order = np.argsort(-impact, kind="stable")
        gathered = np.zeros((len(queries), len(values)), queries.dtype)
        rest = most.sum(axis=1)
        for start in range(0, len(order), SEGMENT_DIMS):
            dims = order[start : start + SEGMENT_DIMS]
            gathered += queries[:, dims] @ values[:, dims].T
            rest -= most[:, dims].sum(axis=1)
            self.processed += len(queries) * len(values) * len(dims)
            if start + SEGMENT_DIMS < len(order):
                may = gathered >= (floor - rest)[:, None]
                if np.count_nonzero(may) <= FEW * may.size:
                    who, row = np.nonzero(may)
                    return who, row, (queries[who] * values[row]).sum(axis=1)
        # the query itself may be among the best: one more than k
        if len(values) > self.k + 1 and np.isneginf(floor).any():
            kth = np.partition(gathered, len(values) - self.k - 1, axis=1)[:, len(values) - self.k - 1]
            floor = np.maximum(floor, kth)
        who, row = np.nonzero(gathered >= floor[:, None])
        return who, row, gathered[who, row]

    def _keep(self, query, row_id, score, count) -> None:
        query, row_id = np.append(self.query, query), np.append(self.row_id, row_id)
        score, count = np.append(self.score, score.astype(np.int64)), np.append(self.count, count)
        order = np.lexsort((row_id, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.query, self.row_id = query[place < self.k], row_id[order]
        self.score, self.count = score[order], count[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[self.query[last]] = self.score[last]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ranks, row ids and scores, repeats of equal rows one by one."""
        times = np.minimum(self.count, self.k)
        query, row_id, score = (np.repeat(c, times) for c in (self.query, self.row_id, self.score))
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        keep = rank <= self.k
        return self.ids[query[keep]], rank[keep], row_id[keep], score[keep]


def _exact_kind(*parts: np.ndarray) -> type:
    """The fastest number type in which all sums of products are exact."""
    most = [float(np.abs(p).max(initial=0)) for p in parts]
    bound = most[0] * most[1] * max(1, parts[0].shape[1])
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, values (floor(scale * x) of each component), dim; unusable rows are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    values = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint"))
    usable = vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull()).filter(~bad)
    return usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), values.alias("values"),
                         F.size(x).alias("dim"))


def _packed(rows: DataFrame, groups: int, name: str) -> DataFrame:
    """One row for each dim and group: ids, values and counts as bytes."""

    def pack(group: pa.Table) -> pa.Table:
        values = group.column("values").combine_chunks()
        flat = np.concatenate([np.empty(0, np.int64), *(
            c.flatten().to_numpy() for c in (values.chunks if hasattr(values, "chunks") else [values]))])
        return pa.table({
            "dim": group.column("dim").slice(0, 1), name: group.column(name).slice(0, 1),
            f"{name}_ids": [group.column("vec_id").to_numpy().tobytes()],
            f"{name}_counts": [group.column("count").to_numpy().tobytes()],
            f"{name}_values": [flat.astype(np.int64).tobytes()],
        })

    place = F.pmod(F.xxhash64(F.lit(3), "vec_id", "values"), F.lit(groups)).cast("int")
    schema = f"dim int, {name} int, {name}_ids binary, {name}_counts binary, {name}_values binary"
    return rows.withColumn(name, place).groupBy("dim", name).applyInArrow(pack, schema)


def search(
    vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE,
    work: tuple[Accumulator, Accumulator] | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all other rows for each query row.

    vectors: vec_id, embedding; queries are the rows whose vec_id is divisible by `every`.
    Rows without id or vector, or with a null or non-finite component, take no part; vectors of
    different dimensions are not compared. A row that repeats a vec_id is a row of its own;
    query rows equal in vec_id and quantised vector are asked once, and are candidates for each
    other. Scores must fit 64 bits. An empty table gives an empty one. `work` counts the
    (query, posting) pairs that were processed and those there are.
    """
    spark = vectors.sparkSession
    usable = quantised(vectors, scale)
    rows = stored(usable.groupBy("vec_id", "values", "dim").agg(F.count(F.lit(1)).alias("count")), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n, q = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // BLOCK))
    right = _packed(asked, blocks, "block")
    cells = (
        _packed(rows, shards, "shard")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .join(right.select("dim", "block"), ["dim", "block"], "left_semi")
        .select("dim", "block", "shard_ids", "shard_counts", "shard_values", F.lit(None).cast("binary").alias("ids"),
                F.lit(None).cast("binary").alias("values"))
    )
    heads = right.select(
        "dim", "block", *[F.lit(None).cast("binary").alias(f"shard_{c}") for c in ("ids", "counts", "values")],
        F.col("block_ids").alias("ids"), F.col("block_values").alias("values"),
    )
    # the queries of a block come first, then the shards, one at a time
    streamed = (
        heads.unionByName(cells)
        .repartition(max(tasks(spark), min(blocks, 4 * tasks(spark))), "dim", "block")
        .sortWithinPartitions("dim", "block", F.col("ids").isNull())
        .select("dim", "shard_ids", "shard_counts", "shard_values", "ids", "values")
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None

        def answer() -> pa.RecordBatch:
            if work is not None:
                work[0].add(block.processed)
                work[1].add(block.postings)
            columns = [c.astype(np.int64) for c in block.best()]
            columns[1] = columns[1].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                read = lambda c: np.frombuffer(batch.column(c)[at].as_py(), np.int64)  # noqa: B023, E731
                dim = batch.column("dim")[at].as_py()
                if batch.column("ids")[at].is_valid:
                    if block is not None:
                        yield answer()
                    ids = read("ids")
                    block = Asked(ids, read("values").reshape(len(ids), dim), k)
                else:
                    ids = read("shard_ids")
                    block.meet(Index(ids, read("shard_values").reshape(len(ids), dim), read("shard_counts")))
        if block is not None:
            yield answer()

    return streamed.mapInArrow(find, "query_id bigint, rank int, vec_id bigint, score bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q),
    lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
    vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

"""Line dedup: a suffix array over line ids, built by distributed prefix doubling.

Every line that has a word is a suffix of its document's line sequence. Level 1 ranks the
suffixes by their first line; each level after it ranks pairs (own rank, rank of the suffix
that starts where the prefix ends), which doubles the compared prefix, until it has `min_lines`
lines. Ranks are places in a range-partitioned order of the distinct pairs. Suffixes whose
prefix is unique leave after each level: nothing can be found for them any more.

Suffixes of equal rank are the intervals in which neighbours in the suffix array have a common
prefix of at least the level's length. Within an interval all but the first suffix start a later
copy; overlapping and adjoining copies join to maximal runs. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from guestsignal.llm.shared import WORD, id_again, stored, table, with_text_hash
from guestsignal.operators.scale import global_row_number

#: A run is deleted if it has so many lines, or fewer with so many words.
MIN_LINES, MIN_WORDS = 3, 50


def full_lines(text: Column) -> Column:
    """The lines of a text that have a word, without their line feeds."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def _ranked(suffixes: DataFrame, rank: bool) -> DataFrame:
    """Suffixes (doc_id, th, n, words, a, b) whose pair (a, b) occurs again.

    `later` tells whether an earlier suffix has the pair; `rank` is the pair's place in order.
    """
    pairs = suffixes.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "th", "n")).alias("first")
    )
    repeated = pairs.filter("k > 1").drop("k")
    if rank:
        repeated = global_row_number(repeated, [F.col("a"), F.col("b")], "rank")
    else:
        repeated = repeated.withColumn("rank", F.lit(None).cast("bigint"))
    later = F.struct("doc_id", "th", "n") > F.col("first")
    return suffixes.join(repeated, ["a", "b"]).select(
        "doc_id", "th", "n", "words", "rank", later.alias("later")
    )


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, n of every line (from 0) that lies in a later copy of a run of lines.

    docs: doc_id, th, text of shared.with_text_hash.
    """
    line = F.posexplode(full_lines(F.col("text"))).alias("n", "line")
    suffixes = docs.select("doc_id", "th", line).select(
        "doc_id", "th", F.col("n").cast("bigint").alias("n"),
        F.regexp_count("line", F.lit(WORD)).cast("bigint").alias("words"),
        F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"),
    )
    suffixes, length, marks = stored(suffixes, "lines"), 1, None
    while True:
        last = length >= min_lines
        level = stored(_ranked(suffixes, rank=not last), "level")
        enough = F.lit(True) if last else F.col("words") >= min_words
        found = level.filter(F.col("later") & enough).select(
            "doc_id", "th", F.explode(F.sequence("n", F.col("n") + (length - 1))).alias("n")
        )
        marks = found if marks is None else marks.unionByName(found)
        if last:
            return marks.distinct()
        step = min(length, min_lines - length)
        ahead = W.partitionBy("doc_id", "th").orderBy("n").rangeBetween(step, step)
        shared = length - step
        suffixes = (
            level.withColumn("b", F.max("rank").over(ahead))
            .withColumn("more", F.max("words").over(ahead))
            .filter("b is not null")
            .select("doc_id", "th", "n", F.col("rank").alias("a"), "b",
                    (F.col("words") + (F.col("more") if not shared else F.lit(0))).alias("words"))
        )
        length += step


def dedupe(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept, kept_sha256 for each row of `docs`.

    docs: doc_id, text; other columns are not used. Lines end at line feeds; lines without a
    word are not lines and are left out of `kept`, which joins the others by line feeds.
    Null, empty and blank texts have no lines. Earlier is the smaller (doc_id, text hash,
    line), a null doc_id before all; rows that repeat doc_id and text count as one place.
    Lines are compared by two 64-bit hashes.
    """
    keyed = with_text_hash(docs)
    gone = stored(later_copies(keyed, min_lines, min_words), "gone")
    place = W.partitionBy("doc_id", "th").orderBy("n")
    starts = F.coalesce(F.col("n") - F.lag("n").over(place) > 1, F.lit(True)).cast("bigint")
    runs = (
        gone.withColumn("start", starts).groupBy("doc_id", "th")
        .agg(F.count(F.lit(1)).alias("n_removed"), F.sum("start").alias("n_runs"))
    )
    some = keyed.dropDuplicates(["doc_id", "th"]).join(runs.select("doc_id", "th").hint("shuffle_hash"), ["doc_id", "th"])
    line = F.posexplode(full_lines(F.col("text"))).alias("n", "line")
    left = (
        some.select("doc_id", "th", line)
        .withColumn("n", F.col("n").cast("bigint"))
        .join(gone, ["doc_id", "th", "n"], "left_anti")
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("left"))
        .select("doc_id", "th", F.col("left.line").alias("left"))
    )
    facts = runs.join(left, ["doc_id", "th"], "left").hint("shuffle_hash")
    full = full_lines(F.col("text"))
    out = keyed.join(facts, ["doc_id", "th"], "left").select(
        id_again(), F.size(full).cast("bigint").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).cast("bigint").alias("n_runs"),
        F.when(F.col("n_removed").isNull(), F.array_join(full, "\n"))
        .otherwise(F.coalesce(F.array_join("left", "\n"), F.lit(""))).alias("kept"),
    )
    return out.withColumn("kept_sha256", F.sha2("kept", 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
with lines as (
  select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as n from (
    select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents)),
suffixes as (
  select doc_id, n, line as k1, line || chr(10) || lead(line, 1) over w as k2,
    line || chr(10) || lead(line, 1) over w || chr(10) || lead(line, 2) over w as k3,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w1,
    len(regexp_extract_all(lead(line, 1) over w, '[^\x20\x09-\x0D]+')) as w2
  from lines window w as (partition by doc_id order by n)),
marked as (
  select doc_id, n,
    w1 >= 50 and row_number() over (partition by k1 order by doc_id, n) > 1 as m1,
    k2 is not null and w1 + w2 >= 50
      and row_number() over (partition by k2 order by doc_id, n) > 1 as m2,
    k3 is not null and row_number() over (partition by k3 order by doc_id, n) > 1 as m3
  from suffixes),
gone as (
  select distinct doc_id, n from (
    select doc_id, n from marked where m1 or m2 or m3
    union all select doc_id, n + 1 from marked where m2 or m3
    union all select doc_id, n + 2 from marked where m3)),
flagged as (
  select l.doc_id, l.n, l.line, g.n is not null as out,
    coalesce(lag(g.n is not null) over (partition by l.doc_id order by l.n), false) as before
  from lines l left join gone g on l.doc_id = g.doc_id and l.n = g.n),
summed as (
  select doc_id, count(*) as n_lines, count(*) filter (where out) as n_removed,
    count(*) filter (where out and not before) as n_runs,
    coalesce(string_agg(line, chr(10) order by n) filter (where not out), '') as kept
  from flagged group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(n_runs, 0)::bigint as n_runs, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join summed s on d.doc_id = s.doc_id
"""

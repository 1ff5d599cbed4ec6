"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default the headline list), BENCH_RUNS (default 3; the median counts).
The given tables are one file with one row group each, which one task would have to read alone; the
queries are timed on a copy, made once before, of BENCH_CPUS files for each table (BENCH_COPY=0:
on the given files). One untimed query first starts the JVM, the tables' footers and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from guestsignal.plans.catalog import QUERIES

HEADLINE = (
    "reviews_clean",
    "dedupe_reviews",
    "sentence_instances",
    "distinct_sentences",
    "label_sentences",
    "label_join",
    "aspect_instances",
    "eb_shrink",
    "segment_sums",
    "conditioned_scores",
    "hotel_summary",
    "monthly_series",
    "kruskal_wallis",
    "spearman_trend",
    "bh_fdr",
    "contradictions",
    "enrich_profiles",
    "rank_hotels",
    "recommend_all",
    "best_quotes",
    "rich_output",
    "semantic_search",
    "leaderboard",
    "season_matrix",
)


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("guestsignal-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def copied(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The tables again, each in `files` files, in a scratch folder of this run."""
    folder = tempfile.mkdtemp(prefix="guestsignal-bench-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            table = spark.read.parquet(os.path.join(sf_dir, name))
            table.repartition(files).write.parquet(os.path.join(folder, name))
    return folder


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    """Build the query and write every row of its result to nowhere."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if chosen is None else QUERIES if chosen == "all" else chosen.split(",")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    copy = os.environ.get("BENCH_COPY", "1") != "0"
    tables = copied(spark, sf_dir, int(cpus)) if copy else sf_dir
    run(spark, "spearman_trend", tables)
    seconds = {n: round(median(run(spark, n, tables) for _ in range(runs)), 3) for n in names}
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": total,
                "unit": "sec",
                "input": f"copy of {sf_dir}, {cpus} files a table" if copy else sf_dir,
                "runs": runs,
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Texts are trimmed, cut and searched once each."""

from __future__ import annotations

from pyspark.sql import functions as F

from guestsignal.functions.text import WHITESPACE, WHITESPACE_CHARACTERS, clean_text, split_sentences, words


def test_words_are_found_without_empty_ones(spark):
    rows = [("Été ok, the-The 4x",), ("",), ("ñ!",), (None,)]
    found = spark.createDataFrame(rows, "t string").select(words(F.col("t")).alias("w")).collect()
    assert [r.w for r in found] == [["t", "ok", "the", "the", "x"], [], [], None]


def test_text_is_cut_once_and_trimmed_of_all_white_space(spark):
    every = WHITESPACE_CHARACTERS
    rows = [(f"{every}A b.{every}C?{every}",), (every,), (". . !",), (".",), ("a.b", ), ("a. ",), (None,)]
    table = spark.createDataFrame(rows, "t string")
    assert table.select(F.regexp_count("t", F.lit(f"^{WHITESPACE}+$")).alias("n")).collect()[1].n == 1
    cut = table.select(split_sentences(F.col("t")).alias("s"))
    assert [r.s for r in cut.collect()] == [
        ["A b.", "C?"], [""], [".", ".", "!"], ["."], ["a.b"], ["a."], None]
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_broken_dashes_are_replaced(spark):
    row = spark.createDataFrame([("a\u0097b��  c ",)], "t string").select(clean_text(F.col("t"))).first()
    assert row[0] == "a—b—— c"

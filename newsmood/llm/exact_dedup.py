"""Exact dedup by two-pass Bloom filtering: only rows whose hash may repeat are shuffled.

Pass 1 reads one 64-bit hash per text. A hash owns three bits of one 64-bit word of the filter; a bit is kept
when at least two rows set it. Pass 2 tests every row: a row whose three bits are not all kept is unique
for certain and passes straight through; the others are grouped by SHA-256.

The filter is broadcast. It has at most `max_words` words (16 bytes each as a row), whatever the input; words in which no
bit repeats are not stored. Beyond that size more unique rows join the shuffle, and the result stays the same. Rows of
large groups get their decision from a broadcast of fewer than 2000 groups, the others by a join.

Edge cases: null text counts as empty and equals other empty texts. A null id is smaller than any id. Rows that
repeat both id and text are one document: they carry the same decision, and `keep_rows` returns one of them.
Empty input gives an empty result. Other columns are never looked at and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import join_groups, power_of_two, stage, whole_text

BITS_PER_ROW = 16
MAX_WORDS = 1 << 21


def _place(text: Column, words: int) -> Column:
    """The filter word of a text and its three-bit pattern."""
    first = F.xxhash64(text)
    second = F.xxhash64(first)
    bits = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(3)]
    return F.struct(F.pmod(first, F.lit(words)).alias("word"), F.array(*bits).alias("bits"))


def _pattern(bits: Column) -> Column:
    one = F.lit(1).cast("long")
    parts = [F.call_function("shiftleft", one, bits[i]) for i in range(3)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def repeat_filter(docs: DataFrame, text: Column, bits_per_row: int = BITS_PER_ROW, max_words: int = MAX_WORDS):
    """Pass 1: (number of words, table of `word`, `mask`) with the bits that two or more rows set."""
    words = min(max_words, max(1024, power_of_two(docs.count() * bits_per_row // 64)))
    place = docs.select(_place(text, words).alias("p"))
    slots = place.select(F.explode(F.array_distinct("p.bits")).alias("bit"), F.col("p.word").alias("word"))
    twice = slots.groupBy("word", "bit").agg(F.count("*").alias("n")).where("n >= 2")
    masks = twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    return words, masks


def flag_repeats(docs: DataFrame, text: Column, bits_per_row: int = BITS_PER_ROW, max_words: int = MAX_WORDS) -> DataFrame:
    """Pass 2: `row` (all columns of `docs`) and `maybe`, false only for texts that occur once."""
    words, masks = repeat_filter(docs, text, bits_per_row, max_words)
    placed = docs.select(F.struct("*").alias("row"), _place(text, words).alias("p"))
    tested = placed.join(F.broadcast(stage(masks, "bloom")), F.col("p.word") == F.col("word"), "left")
    pattern = _pattern(F.col("p.bits"))
    hit = F.coalesce(F.col("mask").bitwiseAND(pattern) == pattern, F.lit(False))
    return tested.select("row", hit.alias("maybe"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """One row per input row: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Of equal texts the row with the largest id stays.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    flagged = flag_repeats(narrow, F.col("text"), **sizes)
    rows = stage(
        flagged.select("row.doc_id", F.unhex(F.sha2(F.col("row.text").cast("binary"), 256)).alias("sha"), "maybe"), "exact"
    )
    once = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    several = rows.where("maybe")
    groups = several.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    placed = join_groups(several.select("doc_id", "sha"), stage(groups, "groups"), "sha", "group_size", rows.count())
    both = once.unionByName(placed.select("doc_id", "keep_id", "group_size", "sha"))
    return both.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The rows that stay, with all their columns. Only rows that may repeat are shuffled, spread over id and hash."""
    flagged = flag_repeats(docs, whole_text(docs[text_col]), **sizes)
    several = flagged.where("maybe").select(
        "row", F.col(f"row.`{id_col}`").alias("id"),
        F.unhex(F.sha2(whole_text(F.col(f"row.`{text_col}`")).cast("binary"), 256)).alias("sha"),
    )
    stay = several.groupBy("sha").agg(F.max("id").alias("id"))
    on = [F.col("t.sha") == F.col("s.sha"), F.col("t.id").eqNullSafe(F.col("s.id"))]
    kept = several.alias("t").join(stay.alias("s"), on, "left_semi").dropDuplicates(["sha", "id"])
    return flagged.where("not maybe").select("row").unionByName(kept.select("row")).select("row.*")

"""Exact copies: two passes over a blocked Bloom filter find what may repeat; only such rows shuffle, all others pass straight through."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import name, saved

PLACES = 1 << 16  # bits of a slice of the filter; a text's four bits lie in one slice, 16 bits of a hash each
PER_TEXT = 16  # bits of the filter a text: one other text in 400 then looks repeated
MOST = 1 << 14  # slices at most, of 8 KB each: what is broadcast stays below 128 MB. A fuller filter lets more rows shuffle, never fewer
_WORD = 64


def digest(text: Column) -> Column:
    """SHA-256 of a text with A-Z lowered, null as empty."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(lowered.cast("binary"), 256)


def _places(key: Column) -> list[Column]:
    hashed = F.xxhash64(key)
    return [F.shiftrightunsigned(hashed, 16 * k).bitwiseAND(F.lit(PLACES - 1)).cast("int") for k in range(4)]


def _repeated(hashed: DataFrame, slices: int) -> DataFrame:
    """First pass: slice, words (its 65,536 bits as longs). A bit is set where two rows or more fall on its place.

    All copies of a text fall on the same four places, so every repeated text has all of its bits set. Rows of a task
    that share a place are counted there before anything is shuffled, and a table of one row a place is all that is.
    """
    at = hashed.select("slice", F.explode(F.array(*_places(F.col("text_sha256")))).alias("place"))
    twice = at.groupBy("slice", "place").agg(F.count("*").alias("n")).filter("n > 1")
    bit = F.expr(f"shiftleft(1L, place % {_WORD})")
    ones = twice.select("slice", F.floor(F.col("place") / _WORD).cast("int").alias("word"), bit.alias("bits"))
    per = PLACES // _WORD
    none = hashed.sparkSession.range(slices * per).select(F.floor(F.col("id") / per).cast("int").alias("slice"), (F.col("id") % per).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = ones.union(none).groupBy("slice", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))  # 1,024 words a slice


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, most: int = MOST) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and with carry a struct "carried" of those columns.

    Texts are equal when identical once A-Z are lowered; of equal ones the row with the largest id stays, of rows that
    repeat that id the last by place in the scan, and a null id is smaller than any other. Null text counts as empty.
    The second pass tests each row's bits in a filter that is broadcast, of at most most slices: rows without all bits
    are the only ones of their text and end there. The others are counted by digest, combined before the shuffle, and
    joined back: digests that hold a thousandth of these rows (a thousand digests at most) by a broadcast, the rest by
    key. False alarms of the filter are groups of one.
    An empty table gives an empty result; other columns may have any names.
    """
    carry = carry or []
    rest = F.struct(F.lit(None).cast("int").alias("none"), *(F.col(name(c)).alias(c) for c in carry))
    rows = docs.select(F.col(name(id_col)).alias("doc_id"), digest(F.col(name(text_col))).alias("text_sha256"), F.monotonically_increasing_id().alias("uid"), rest.alias("carried"))
    rows = saved(rows, "digests")
    slices = min(most, 1 << max(0, (rows.count() * PER_TEXT // PLACES).bit_length()))
    rows = rows.withColumn("slice", F.pmod(F.hash("text_sha256"), F.lit(slices)))
    marked = F.broadcast(saved(_repeated(rows, slices), "filter"))  # most slices at most
    is_set = lambda p: F.getbit(F.get("words", F.floor(p / _WORD).cast("int")), p % _WORD) == 1
    maybe = reduce(lambda a, b: a & b, map(is_set, _places(F.col("text_sha256"))))
    tested = rows.join(marked, "slice").select("doc_id", "text_sha256", "uid", "carried", maybe.alias("maybe"))

    once, some = tested.filter(~F.col("maybe")).drop("maybe"), tested.filter("maybe").drop("maybe")
    groups = saved(some.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "uid")).alias("last"), F.count("*").alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * 1000 >= total
    hot, cold = F.broadcast(groups.filter(large)), groups.filter(~large)  # a thousand rows at most
    found = some.join(hot, "text_sha256").union(some.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(cold, "text_sha256").select("text_sha256", *rows.drop("text_sha256", "slice").columns, "last", "group_size"))
    stays = F.col("doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("uid") == F.col("last.uid"))
    decided = found.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256", "carried")
    alone = once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "carried")
    out = alone.union(decided)
    return out.withColumn("carried", F.col("carried").dropFields("none")) if carry else out.drop("carried")

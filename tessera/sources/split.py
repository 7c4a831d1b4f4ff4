"""Large single files read by many tasks: JSON arrays and numbered lines. Blocks of a file are scanned apart, and small tables of block states join them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.shared import saved

_SIGNS = re.compile(r'\\.|["\[\]{}]', re.DOTALL)
_FILE = ["file", "block"]


def _state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: whether it changes between string and not, and how deep it nests, if it begins outside of a string or in one."""
    at, flips, deep = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([flips], pa.int32()), pa.array([deep[0]], pa.int64()), pa.array([deep[1]], pa.int64())], [*_FILE, "flips", "out", "inside"])

    for batch in batches:
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                if at:
                    yield row()
                at, flips, deep = (file, block), 0, [0, 0]
            for sign in _SIGNS.findall(text):
                if sign == '"':
                    flips ^= 1
                elif len(sign) == 1:
                    deep[flips] += 1 if sign in "[{" else -1
    if at:
        yield row()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, text, inside, depth) in order to pieces of elements: file, block, place, begins, ends, text.

    A comma outside of strings at depth 1 parts elements. An element that lies in one block begins and ends there.
    """
    at, inside, depth = None, False, 0
    parts: list[str] = []
    begins, place = True, 0
    out: list[tuple] = []

    def piece(ends: bool) -> None:
        nonlocal place, parts
        out.append((*at, place, begins, ends, ",".join(parts)))
        place, parts = place + 1, []

    def handed() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], [*_FILE, "place", "begins", "ends", "text"])
        out.clear()
        return made

    for batch in batches:
        for file, block, text, in_string, deep in zip(*(c.to_pylist() for c in batch.columns)):
            parted = depth == 1 and not inside
            if (file, block) != at:
                if at:
                    piece(ends=False)
                at, inside, depth, place = (file, block), in_string, deep, 0
                begins = block == 0 or (depth == 1 and not inside)
            elif parted:
                piece(ends=True)
                begins = True
            first, last = 0, len(text)
            for m in _SIGNS.finditer(text):
                sign = m.group()
                if sign == '"':
                    inside = not inside
                elif inside or len(sign) > 1:
                    continue
                elif sign in "[{":
                    if depth == 0:
                        if sign == "{" or text[: m.start()].strip("\ufeff \t\r\n"):
                            raise ValueError(f"{file} is no JSON array")
                        first = m.end()
                    depth += 1
                else:
                    depth -= 1
                    if depth == 0:
                        last = m.start()
            parts.append(text[first:last])
        yield handed()
    if at:
        piece(ends=False)
        yield handed()


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row an element of the JSON arrays in the files of path, as schema. A file may be of any size: tasks read blocks of it.

    Files are read as texts that commas end, which Spark splits anywhere. One pass sums up each block by what it does to
    being in a string and to the depth; running sums over that table (a row a block) give the state that each block
    begins with, and a second pass cuts out the elements. Only pieces at the ends of blocks, two a block, are shuffled.
    Elements that are no objects of this form are null in all columns, an empty array has no row, another value raises.
    Compressed files are one block.
    """
    raw = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    states = saved(raw.mapInArrow(_state, "file string, block bigint, flips int, out bigint, inside bigint"), "states")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = states.withColumn("in_string", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("deep", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("out")))
    begun = begun.select(*_FILE, "in_string", F.coalesce(F.sum("deep").over(before), F.lit(0)).alias("depth"))
    pieces = raw.join(F.broadcast(begun), _FILE).select(*_FILE, "text", "in_string", "depth").mapInArrow(_elements, "file string, block bigint, place bigint, begins boolean, ends boolean, text string")  # a row a block
    pieces = saved(pieces, "pieces")
    whole, cut = pieces.filter("begins and ends").select("text"), pieces.filter("not (begins and ends)")
    number = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("block", "place"))
    joined = cut.withColumn("number", number).groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), ",").alias("text"))
    each = whole.union(joined.select("text")).filter(F.trim(F.translate("text", "\t\r\n", "   ")) != "")
    return each.select(F.from_json("text", schema).alias("x")).select("x.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line of text files. Tasks read blocks of a file; a table of the blocks' counts tells each where its lines begin."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    raw = saved(raw, "lines")
    counts = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("start"))
    return raw.join(F.broadcast(starts), _FILE).select("file", (F.col("start") + F.col("id") - F.col("first")).alias("line_no"), "line")  # a row a block

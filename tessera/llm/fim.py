"""Fill-in-middle: texts cut into prefix, middle and suffix, with an index of the exceptions (multibyte characters) alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tessera.llm.shared import chunks, name

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class Exceptions:
    """The multibyte characters of a UTF-8 text: their positions in code points and the bytes in excess of one, summed up.

    Between two of them a place in bytes and one in code points differ by a constant, so either is found from the other
    by one search among the exceptions; a text without any needs none.
    """

    def __init__(self, raw: np.ndarray) -> None:
        lead = np.flatnonzero(raw >= 0xC0)
        kind = raw[lead]
        excess = 1 + (kind >= 0xE0).astype(np.int64) + (kind >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.points = lead - self.excess[:-1]
        self.bytes = lead
        self.n_points = len(raw) - int(self.excess[-1])

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.points, points)]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Of places between characters."""
        return places - self.excess[np.searchsorted(self.bytes, places)]


def _cuts(raw: np.ndarray, index: Exceptions, unit: str, h1: int, h2: int) -> tuple[int, np.ndarray]:
    """Number of units, and where prefix and middle end: in bytes and, below, in code points."""
    if unit == "char":
        n = index.n_points
        points = np.array(sorted((h1 % (n + 1), h2 % (n + 1))), np.int64)
        return n, np.stack([index.to_bytes(points), points])
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and raw[-1] != 10:
        ends = np.append(ends, len(raw))
    n = len(ends)
    places = np.concatenate([[0], ends])[sorted((h1 % (n + 1), h2 % (n + 1)))]
    return n, np.stack([places, index.to_points(places)])


def _formatted(unit: str, marks: tuple[str, str, str], rate: int, spm: int):
    p, s, m = (x.encode() for x in marks)

    def one(text: bytes, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
        raw = np.frombuffer(text, np.uint8)
        n, ((a, b), (first, second)) = _cuts(raw, Exceptions(raw), unit, h[0], h[1])
        if not text or p in text or s in text or m in text or h[2] % 100 >= rate:
            return n, "plain", None, None, text
        a, b, first, second = int(a), int(b), int(first), int(second)
        if h[3] % 100 < spm:
            return n, "spm", first, second - first, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "psm", first, second - first, b"".join((p, text[:a], s, text[b:], m, text[a:b]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = batch.column(0).to_pylist(), list(zip(*(batch.column(k).to_pylist() for k in range(1, 5))))
            for lo, hi in chunks(texts, 1 << 23):
                n, form, prefix, middle, output = zip(*map(one, texts[lo:hi], hashes[lo:hi]))
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(5).slice(lo, hi - lo), *made], ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    return of


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks are found again only if none can begin inside another one or inside itself."""
    for a in marks:
        for b in marks:
            if not a or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or (a is not b and a in b):
                raise ValueError(f"marks must be three texts that don't overlap: {marks}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: str = "7", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars (code points) and output; columns of docs so named are overwritten.

    A text is cut into n units, lines with their \\n or code points (unit "char"). A row's draws are the first four
    groups of eight digits of the SHA-256 of seed, a colon and its id: the smaller and the larger of the first two,
    modulo n + 1, are the units before the middle and before the suffix; the third modulo 100 makes the text plain from
    rate on, the fourth suffix-first ("spm") below spm, else prefix-first ("psm"). Texts that hold a mark, and empty
    ones, are plain: the output is the text, and both lengths are null.
    Null text counts as empty, a null id as an empty one. Nothing is shuffled; a task holds a batch of texts and the
    outputs of about 8 MB of them, or one longer text. Repeated rows are each returned, an empty table gives none, and
    other columns may have any names.
    """
    _checked(marks)
    text = F.coalesce(F.col(name(text_col)).cast("string"), F.lit("")).cast("binary")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name(id_col)).cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    old = [c for c in docs.columns if c not in new]
    row = F.struct(F.lit(None).cast("int").alias("none"), *(F.col(name(c)).alias(f"c{i}") for i, c in enumerate(old)))
    rows = docs.select(text.alias("text"), *drawn, row.alias("row"))
    kind = StructType([rows.schema["row"], StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", BinaryType())])
    made = rows.mapInArrow(_formatted(unit, marks, rate, spm), kind).withColumn("output", F.col("output").cast("string"))
    return made.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(old)), *new)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    last = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), last, between(s, m))).when(form == "spm", F.concat(between(p, m), last, between(s, p))).otherwise(output)


def report(made: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))

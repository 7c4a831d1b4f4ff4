"""What the operators of this subpackage share: tables kept in the cluster's shared folder, words of texts as arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

#: A-Z to a-z, everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and whatever is neither an ASCII letter or digit nor beyond ASCII becomes a space.
LOWER_ALNUM = bytes(x if chr(x).isalnum() or x > 127 else 32 for x in LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one of the session if Spark runs in one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("tessera.shared.dir", None) or f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("tessera.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again. A lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def name(column: str) -> str:
    """column as one name, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a worker holds few of their texts as Python's own."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Told by owner's tasks: what other operators have kept in this worker goes, as Spark uses it for one after another."""
    others = [k for k in _kept if k != owner]
    for k in others:
        _kept.pop(k)()
    _kept[owner] = clear
    if others:
        pa.default_memory_pool().release_unused()


def sent_once(docs: DataFrame, carry: list[str]) -> bool:
    """Whether the text that a task reads can stand for the one in carry, so that it is not sent twice."""
    return "text" in carry and docs.schema["text"].dataType == StringType()


def chunks(values: list, limit: int = 1 << 20):
    """(first, last) of runs of texts with about limit bytes each; a longer text is a run of its own."""
    first, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield first, i
            first, held = i, 0
        held += len(v)
    if first < len(values):
        yield first, len(values)

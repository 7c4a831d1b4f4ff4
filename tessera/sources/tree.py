"""Files that tasks list, read, write and copy themselves: every name counts, and each effect may be repeated."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tessera.functions import keys as K
from tessera.sources.shared import saved

STEP = 1 << 22  # bytes that a copy holds at a time
_ENTRIES = "path string, name string, length bigint, is_dir boolean"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI and the path in it; s3a and s3n are s3 there."""
    scheme = uri.partition(":")[0]
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if scheme in ("s3a", "s3n"):
        uri = "s3" + uri[len(scheme) :]
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = opened(uri)
            rows: list[tuple] = []
            if isinstance(store, fs.LocalFileSystem):
                try:
                    with os.scandir(path) as entries:
                        rows = [(e.name, e.stat().st_size if e.is_file() else None, e.is_dir(follow_symlinks=False)) for e in entries if e.is_file() or e.is_dir(follow_symlinks=False)]
                except (FileNotFoundError, NotADirectoryError):
                    pass
            else:
                rows = [(i.base_name, i.size if i.is_file else None, not i.is_file) for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
            names, sizes, dirs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([f"{uri.rstrip('/')}/{n}" for n in names], pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(dirs, pa.bool_())], ["path", "name", "length", "is_dir"])


def walk(spark: SparkSession, roots: str | list[str], recursive: bool = True) -> DataFrame:
    """path, name, length of every file below roots, also of names that begin with "_" or "." which Spark's own index leaves out.

    Directories are rows: tasks list those of a level, whose directories are the next level, so no process holds the
    tree. Links to directories are not followed, a root that isn't there has no files. Unordered.
    """
    level = spark.createDataFrame([(r,) for r in ([roots] if isinstance(roots, str) else roots)], "path string")
    found: list[DataFrame] = []
    while True:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found.append(saved(level.repartition(width, "path").mapInArrow(_listed, _ENTRIES), "listed"))
        level = found[-1].filter("is_dir").select("path")
        if not recursive or level.isEmpty():
            return reduce(DataFrame.union, found).filter("not is_dir").drop("is_dir")


def of_type(files: DataFrame, extensions: tuple[str, ...], any_case: bool = True) -> DataFrame:
    """The files whose name, after its last dot, is one of extensions. A name without a dot is its own extension."""
    own = F.substring_index("name", ".", -1)
    return files.filter((F.lower(own) if any_case else own).isin(*extensions))


def parent(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"/[^/]*$", ""), "/", -1)


def named_images(files: DataFrame) -> DataFrame:
    """split (the directory), image_name, metadata_id, frame_index, full_path of images; ids are null where the name tells none."""
    found = files.select(parent(F.col("path")).alias("split"), F.col("name").alias("image_name"), K.image_id(F.col("name")).alias("id"), F.col("path").alias("full_path"))
    return found.select("split", "image_name", "id.metadata_id", "id.frame_index", "full_path")


def video_tasks(spark: SparkSession, root: str, out: str, extensions: tuple[str, ...], labels: dict[str, int]) -> DataFrame:
    """The work list of a data set: path, name, label and out_dir of the videos right in its label directories. A missing directory has none."""
    root, out = root.rstrip("/"), out.rstrip("/")
    files = of_type(walk(spark, [f"{root}/{d}" for d in labels], recursive=False), extensions)
    label = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[parent(F.col("path"))]
    return files.select("path", "name", label.alias("label"), F.concat(F.lit(out + "/"), parent(F.col("path"))).alias("out_dir"))


def texts(files: DataFrame, path: str = "path") -> DataFrame:
    """files with content, each file's text, and error where it can't be read. A task holds one file at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column(batch.schema.get_field_index(path)).to_pylist()):
                content, error = None, None
                try:
                    store, at = opened(uri)
                    with store.open_input_stream(at) as stream:
                        content = stream.read().decode("utf-8-sig")
                except (OSError, UnicodeDecodeError) as e:
                    error = type(e).__name__
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.string()), pa.array([error], pa.string())], [*batch.schema.names, "content", "error"])

    return files.mapInArrow(of, StructType([*files.schema.fields, *StructType().add("content", StringType()).add("error", StringType()).fields]))


def metadata(spark: SparkSession, root: str, schema: str, frames: str = "frames", name: str = "metadata.json", directories: list[str] | None = None) -> DataFrame:
    """Every metadata file below root, none left out: path, sample (its directory), status and its record as a struct "meta".

    status: unreadable (the file can't be opened or is no UTF-8), invalid (no JSON object of this form), no_frames, ok.
    The first two are what a reader that skips broken files would hide; directories lists where to look, root otherwise.
    """
    files = walk(spark, directories or root).filter(F.col("name") == name)
    parsed = texts(files).withColumn("meta", F.from_json("content", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("meta").isNull() | F.col("meta._broken").isNotNull() | ~F.coalesce(F.trim("content").startswith("{"), F.lit(False))
    status = F.when(F.col("error").isNotNull(), "unreadable").when(bad, "invalid").when(F.coalesce(F.size(f"meta.{frames}"), F.lit(0)) <= 0, "no_frames").otherwise("ok")
    return parsed.select("path", parent(F.col("path")).alias("sample"), status.alias("status"), F.when(status.isin("ok", "no_frames"), F.col("meta").dropFields("_broken")).alias("meta"))


def _placed(store: fs.FileSystem, path: str, fill) -> None:
    """fill(stream) writes a file of another name, which then takes the place of path: a reader never sees half of it, a repeated task replaces it."""
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(draft) as stream:
            fill(stream)
        if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)
        store.move(draft, path)
    except BaseException:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
        raise


def write_each(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Writes a text file a row, and returns the manifest: path and bytes of each, a table that is there once all files are.

    Paths must differ. Tasks may be repeated: a file is written under another name and moved.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for uri, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                store, at = opened(uri)
                _placed(store, at, lambda stream, raw=raw: stream.write(raw))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return saved(rows.select(F.col(path).cast("string"), F.col(content).cast("string")).mapInArrow(of, "path string, bytes bigint"), "manifest")


def copy_files(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """What became of each row of a copy plan (path, target): path, target, action and bytes.

    action: missing (no path, or no such file), existing (the target has as many bytes), else copied, or in a dry run,
    the default, copy. Copies go on in tasks, STEP bytes at a time, to another name that is then moved; a repeated task
    finds its targets existing. The manifest is a table that is there once all copies are.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(path: str | None, target: str | None) -> tuple[str, int | None]:
            if path is None or target is None:
                return "missing", None
            (source, at), (sink, to) = opened(path), opened(target)
            info = source.get_file_info(at)
            if info.type != fs.FileType.File:
                return "missing", None
            there = sink.get_file_info(to)
            if there.type == fs.FileType.File and there.size == info.size:
                return "existing", info.size
            if dry_run:
                return "copy", info.size

            def fill(stream) -> None:
                with source.open_input_stream(at) as read:
                    while part := read.read(STEP):
                        stream.write(part)

            _placed(sink, to, fill)
            return "copied", info.size

        for batch in batches:
            done = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "target", "action", "bytes"])

    width = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = plan.select(F.col("path").cast("string"), F.col("target").cast("string")).distinct().repartition(width, "target")
    return saved(wanted.mapInArrow(of, "path string, target string, action string, bytes bigint"), "copies")

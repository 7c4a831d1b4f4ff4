"""Sinks: tables, indexes, predictions, lists, summaries; and plans of file operations, which are tables and change no file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import normal_root


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """Part files with a header and no byte order mark. An existing path raises unless mode says otherwise."""
    df.write.mode(mode).csv(path, header=True, sep=sep, quoteAll=False, escape='"')


def write_clip_index(clips: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated, sorted by label and sample over all part files: a range shuffle, no single task."""
    write_csv(clips.orderBy("label", "sample_name"), path, mode, "\t")


def write_predictions(scored: DataFrame, path: str, p: str = "prob_fake", mode: str = "errorifexists") -> None:
    """Tab-separated, probabilities with eight decimals."""
    write_csv(scored.withColumn(p, F.format_string("%.8f", p)), path, mode, "\t")


def write_lines(values: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    values.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_summary(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of a summary as indented JSON texts."""
    row.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def removal_plan(selected: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """path, action for distinct selected paths: blocked outside root, missing without such a file, else delete. Deletes nothing."""
    there = files.select("path", F.lit(True).alias("_there")).distinct()
    found = selected.select("path").distinct().join(there, "path", "left")
    return found.select("path", F.when(~normal_root(F.col("path"), root), "blocked").when(F.col("_there").isNull(), "missing").otherwise("delete").alias("action"))


def copy_plan(ids: DataFrame, files: DataFrame, key, target: str) -> DataFrame:
    """id, path, target for files whose key is a wanted id, and a row with null path for an id without any. Copies nothing."""
    named = files.select("path", "name", key.alias("id"))
    return ids.select("id").distinct().join(named, "id", "left").select("id", "path", F.when(F.col("path").isNotNull(), F.concat(F.lit(target.rstrip("/") + "/"), "name")).alias("target"))


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))

"""Manifests: strata and their first samples, manifests against directories, lists against files, totals, quotas, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import running_sums


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by order of each group of keys: one aggregate, combined before the shuffle. Null keys are a group."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their place in order from 1, without gaps: counted by ranges of the data, so no task sorts the table. order tells rows apart."""
    return running_sums(rows.withColumn("_one", F.lit(1)), [], F.struct(*order), {"_one": name}).drop("_one")


def planned_samples(plan: DataFrame, rows: DataFrame, keys: list[str], place: list[str], order: list[str], id_format: str = "S%04d") -> DataFrame:
    """The strata of plan that rows fill, each with its first row by order and a gapless sample_id in the order of place."""
    found = plan.join(first_of(rows, keys, order), keys)
    return numbered(found, place).withColumn("sample_id", F.format_string(id_format, "number")).drop("number")


def against_directories(manifest: DataFrame, key: str, directories: DataFrame, frames: DataFrame) -> DataFrame:
    """manifest with frames, their number, and status: missing_dir (no directory of that key), empty_dir (no frame in it), else matched.

    directories and frames have key; both are counted before anything is joined.
    """
    seen = directories.select(F.col(key).alias("_k"), F.lit(0).alias("_n")).union(frames.select(F.col(key).alias("_k"), F.lit(1))).groupBy("_k").agg(F.sum("_n").alias("_n"))
    joined = manifest.join(seen, F.col(key) == F.col("_k"), "left")
    return joined.select(*manifest.columns, F.coalesce("_n", F.lit(0)).alias("frames"), F.when(F.col("_n").isNull(), "missing_dir").when(F.col("_n") == 0, "empty_dir").otherwise("matched").alias("status"))


def present(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The wanted rows whose key files has."""
    return wanted.join(files.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def absent(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The wanted rows whose key files lacks; a null key is nowhere."""
    return wanted.join(files.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def paired_tracks(videos: DataFrame, audios: DataFrame, keys: list[str]) -> DataFrame:
    """Videos and their audio tracks by keys; one without the other goes."""
    return videos.join(audios, keys)


def group_totals(rows: DataFrame, key: str, least: int) -> DataFrame:
    """One row: videos and images, groups kept and dropped by a least size, and the sizes' minimum, maximum and mean; zeros if there is none."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("k"))
    zero = lambda c, z: F.coalesce(c, F.lit(z))
    return sizes.agg(
        F.count("*").alias("videos"), zero(F.sum("k"), 0).alias("images"), F.count_if(F.col("k") >= least).alias("kept"), F.count_if(F.col("k") < least).alias("dropped"),
        zero(F.min("k"), 0).alias("min_frames"), zero(F.max("k"), 0).alias("max_frames"), F.round(zero(F.avg("k"), 0.0), 6).alias("mean_frames"),
    )


def status_totals(rows: DataFrame, keys: list[str], good: Column, value: str) -> DataFrame:
    """Per group: n, ok (how many are good) and total of value. Rows with a null key belong to no group."""
    known = rows
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(good).alias("ok"), F.round(F.sum(value), 2).alias("total"))


def counts(rows: DataFrame, *by: str | Column) -> DataFrame:
    """How many rows each value of by has."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def top(rows: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group by order: a quota, a retention, the best of each. Tasks cut their own rows to k a group before they are shuffled."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def labelled_union(real: DataFrame, fake: DataFrame, path: str) -> DataFrame:
    """path and label of two lists; a path that is in both is forged."""
    both = real.select(path, F.lit(0).alias("label")).unionAll(fake.select(path, F.lit(1)))
    return both.groupBy(path).agg(F.max("label").alias("label"))


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids, each once, that both splits have."""
    return left.intersect(right)


def unshared(split: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Ids, each once, of split that no other split has."""
    out = split.distinct()
    for o in others:
        out = out.subtract(o)
    return out


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight, one over the size of their class. A row without a label has none and goes."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_k"))
    return rows.join(sizes, label).withColumn("weight", F.lit(1.0) / F.col("_k")).drop("_k")


def complete_sequences(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Per key: complete, whether its indexes are all whole numbers from 0 to the largest. Repeated ones count once."""
    seen = rows.groupBy(key).agg(F.count_distinct(index).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"))
    return seen.select(key, F.coalesce((F.col("first") == 0) & (F.col("n") == F.col("last") + 1), F.lit(False)).alias("complete"))

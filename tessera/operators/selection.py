"""Selection of samples, faces and frames, and reports on what was selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import keys as K


def largest_detection(detections: DataFrame, frame: list[str], score: str, box: list[str], order: list[str], threshold: float = 0.5) -> DataFrame:
    """Per frame the detection of largest area among those with score >= threshold, the first by order on a tie, with its area.

    One aggregate, combined before the shuffle; frames without such a detection have no row.
    """
    able = detections.filter(F.col(score) >= threshold).withColumn("area", K.box_area(*(F.col(c) for c in box)))
    rest = [c for c in able.columns if c not in frame]
    first = F.struct(F.col("area").alias("a"), F.struct(*((-F.col(c)).alias(c) for c in order)).alias("o"))
    return able.groupBy(*frame).agg(F.max_by(F.struct(*rest), first).alias("r")).select(*frame, "r.*")


def segments(videos: DataFrame, key: str, periods: str) -> DataFrame:
    """A row per valid period of a video (two bounds or more that are numbers, the second larger): key, ordinal from 0 in the whole list, t0, t1."""
    each = videos.select(key, F.posexplode(periods).alias("ordinal", "p"))
    bound = lambda i: F.get("p", F.lit(i)).cast("string").try_cast("double")
    return each.select(key, "ordinal", bound(0).alias("t0"), bound(1).alias("t1"), F.size("p").alias("n")).filter("n >= 2 and t1 > t0").drop("n")


def without_audio_only(samples: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The samples of a visual task (audio-only forgeries left out), and one row with how many stay and how many go."""
    only = F.coalesce(F.col(kind) == "RF", F.lit(False))
    return samples.filter(~only), samples.agg(F.count_if(~only).alias("kept"), F.count_if(only).alias("excluded"))


def choose_methods(plan: DataFrame, rows: DataFrame, keys: list[str], kind: str, method: str, allowed: dict[str, list[str]], optional: list[str], order: str) -> DataFrame:
    """Per cell of plan (keys and kind) its first row by order whose method its kind allows, and a status.

    Kinds without an entry allow every method. status: ok, skipped (none, but the kind is optional) or error (none).
    """
    able = reduce_or(F.col(kind).isin(*allowed), [(F.col(kind) == k) & F.col(method).isin(*ms) for k, ms in allowed.items()])
    first = rows.filter(able).groupBy(*keys, kind).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in (*keys, kind))), order).alias("r"))
    status = F.when(F.col("r").isNotNull(), "ok").when(F.col(kind).isin(*optional), "skipped").otherwise("error")
    return plan.join(first, [*keys, kind], "left").select(*plan.columns, status.alias("status"), "r.*")


def reduce_or(listed: Column, rules: list[Column]) -> Column:
    """Any of the rules, or not listed by them at all."""
    out = ~listed
    for r in rules:
        out = out | r
    return out


def flag_groups(rows: DataFrame, key: str, least: int) -> DataFrame:
    """rows with group_size and kept (the group has least rows or more); those of a null key form a group."""
    sizes = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("group_size"))
    return rows.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).drop("_k").withColumn("kept", F.col("group_size") >= least)


def index_lists(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Per group: how many rows, and their indexes in order. A group's indexes are one array."""
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.sort_array(F.collect_list(index)).alias("indexes"))


def label_totals(frames: DataFrame, label: str, folder: str) -> DataFrame:
    """Per label: how many folders and frames."""
    return frames.groupBy(label).agg(F.count_distinct(folder).alias("folders"), F.count("*").alias("frames"))


def complete(samples: DataFrame, frames: DataFrame, files: DataFrame, key: str, path: str) -> DataFrame:
    """Per sample: whether its metadata could be read (it is in samples), lists a frame, and all listed files exist."""
    have = files.select(path).distinct().withColumn("_there", F.lit(True))
    seen = frames.join(have, path, "left").groupBy(key).agg(F.count("*").alias("n_frames"), F.count_if(F.col("_there").isNull()).alias("n_missing"))
    n, missing = F.coalesce("n_frames", F.lit(0)), F.coalesce("n_missing", F.lit(0))
    return samples.select(key).join(seen, key, "left").select(key, n.alias("n_frames"), missing.alias("n_missing"), ((n > 0) & (missing == 0)).alias("complete"))


def running_index(rows: DataFrame, group: list[str], order: list[str], ok: Column) -> DataFrame:
    """The rows that succeed, numbered from 0 within their group in order."""
    return rows.filter(ok).withColumn("index", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def needed_frames(frames: DataFrame, key: str, index: str, starts: DataFrame, start: str, length: int) -> DataFrame:
    """The frames that some window of length frames from a start needs; each once, whatever windows overlap there.

    Indexes fall into bins of length frames. A window lies in two of them at most: it covers the end of the one it
    starts in, and the beginning of the next. So all windows of a bin come down to two bounds, the least start in it
    and the farthest end that reaches into it, and a frame is compared with one row. Nothing is exploded by length.
    """
    first = lambda x: x - F.pmod(x, F.lit(length))
    s, none = F.col(start).cast("long"), F.lit(None).cast("long")
    parts = F.array(F.struct(first(s).alias("_bin"), s.alias("_from"), none.alias("_end")), F.struct((first(s) + length).alias("_bin"), none.alias("_from"), (s + length).alias("_end")))
    bounds = starts.filter(F.col(start).isNotNull()).select(F.col(key).alias("_key"), F.inline(parts)).groupBy("_key", "_bin").agg(F.min("_from").alias("_from"), F.max("_end").alias("_end"))
    same = (F.col(key) == F.col("_key")) & (first(F.col(index).cast("long")) == F.col("_bin")) & ((F.col(index) >= F.col("_from")) | (F.col(index) < F.col("_end")))
    return frames.join(bounds, same, "left_semi")


def split_counts(images: DataFrame, split: str = "split", key: str = "metadata_id", index: str = "frame_index") -> DataFrame:
    """Per split and id: n, and indexes in order. Images without an id (names that tell none) are left out."""
    return images.filter(F.col(key).isNotNull()).groupBy(split, key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(index)).alias("indexes"))


def split_sharing(counts: DataFrame, n_splits: int, split: str = "split", key: str = "metadata_id") -> DataFrame:
    """Per id: n_splits it is in, shared (it is in all of them), only_in (the split, where it is in one).

    Of fewer than two splits nothing is shared or unique. Splits without an image count too, so their number is given.
    Any number of splits costs one aggregate, as an id's splits are rows already.
    """
    k = F.count("*")
    both = F.lit(n_splits >= 2)
    return counts.groupBy(key).agg(k.alias("n_splits"), (both & (k == n_splits)).alias("shared"), F.when(both & (k == 1), F.min(split)).alias("only_in"))


def split_summary(images: DataFrame, splits: list[str], split: str = "split", key: str = "metadata_id", index: str = "frame_index", name: str = "image_name") -> DataFrame:
    """A row a split, also of those without an image: image_count, unique_metadata_count, metadata_ids, images_per_metadata,
    frame_indices_per_metadata, skipped_files (names without an id), unique (ids of this split alone), shared_metadata_ids.

    This is the report of a set that people look through: a split's ids are one array. split_counts and split_sharing
    give the same as rows, for sets of any size. Arrays and maps have their ids in order: who needs all entries of a map
    goes over map_entries, as a look-up by key goes over the map.
    """
    counts = split_counts(images, split, key, index)
    sharing = split_sharing(counts, len(splits), split, key)
    each = counts.join(sharing, key)
    ids, names = F.struct(F.col(key).alias("key"), "n", "indexes", "only_in"), F.lit(None).cast("string")
    rows = each.select(split, ids.alias("id"), names.alias("skipped"))
    rows = rows.unionByName(images.filter(F.col(key).isNull()).select(split, F.col(name).alias("skipped")), allowMissingColumns=True)
    rows = rows.filter(F.col(split).isin(*splits)).unionByName(images.sparkSession.createDataFrame([(x,) for x in splits], f"`{split}` string"), allowMissingColumns=True)
    # one sorted array of ids a split, from which all columns come; nothing is joined to such rows but shared ids
    own = rows.groupBy(split).agg(F.coalesce(F.sum("id.n"), F.lit(0)).alias("image_count"), F.count("id").alias("unique_metadata_count"), F.sort_array(F.collect_list("id")).alias("ids"), F.sort_array(F.collect_list("skipped")).alias("skipped_files"))
    shared = sharing.filter("shared").agg(F.sort_array(F.collect_list(key)).alias("shared_metadata_ids"))  # one row
    return own.join(F.broadcast(shared)).select(
        split, "image_count", "unique_metadata_count", F.col("ids.key").alias("metadata_ids"),
        F.map_from_arrays("ids.key", "ids.n").alias("images_per_metadata"), F.map_from_arrays("ids.key", "ids.indexes").alias("frame_indices_per_metadata"),
        F.filter("ids", lambda i: i["only_in"].isNotNull())["key"].alias("unique"), "skipped_files", "shared_metadata_ids",
    )


def positional_join(left: DataFrame, right: DataFrame, position: str, on_mismatch: str = "none", placeholder: Column | None = None) -> DataFrame:
    """Rows of two tables that carry their position, side by side; row order is never used.

    Where the tables differ in length: "none" gives no row, "truncate" those of both, "placeholder" all of left, the
    first column of right filled.
    """
    if on_mismatch == "truncate":
        return left.join(right, position)
    if on_mismatch == "placeholder":
        name = next(c for c in right.columns if c != position)
        return left.join(right, position, "left").withColumn(name, F.coalesce(F.col(name), placeholder))
    sizes = left.agg(F.count("*").alias("_l")).join(F.broadcast(right.agg(F.count("*").alias("_r"))))  # one row each
    return left.join(right, position).join(F.broadcast(sizes.filter("_l = _r"))).drop("_l", "_r")


def find_by_basename(names: DataFrame, name: str, listing: DataFrame, path: str) -> DataFrame:
    """names with found: the first path of the listing whose last part equals the name, letter case aside; null if none."""
    first = listing.groupBy(F.lower(F.element_at(F.split(path, "/"), -1)).alias("_n")).agg(F.min(path).alias("found"))
    return names.join(first, F.lower(name) == F.col("_n"), "left").drop("_n")


def seeded_sample(rows: DataFrame, group: str, key: str, seed: int, count: int | None = None, ratio: float | None = None) -> DataFrame:
    """A sample without replacement of each group: count rows, else max(1, int(n * ratio)); the first by seeded hash.

    Hashes are counted in 4,096 cells a group; cells below the cut are taken whole, and only rows of the cell that the
    cut goes through are ranked, so no task sorts a group.
    """
    hashed = rows.withColumn("_h", K.seeded(F.col(key), seed)).withColumn("_cell", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    cells = hashed.groupBy(group, "_cell").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(group)
    upto = F.sum("_k").over(w.orderBy("_cell")) - F.col("_k")
    total = F.sum("_k").over(w)
    wanted = F.lit(count) if count is not None else F.greatest(F.lit(1), F.floor(total * F.lit(float(ratio))))
    cut = cells.select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), (wanted - upto).alias("_room"), F.col("_k")).filter("_room > 0")
    near = hashed.join(cut, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")))
    rank = F.row_number().over(Window.partitionBy("_g", "_c").orderBy("_h", key))
    part = near.filter("_k > _room").withColumn("_rank", rank).filter("_rank <= _room")
    return near.filter("_k <= _room").select(*rows.columns).union(part.select(*rows.columns))


def paired_samples(real: DataFrame, fake: DataFrame, group: str, key: str, seed: int, count: int | None = None, ratio: float | None = None) -> DataFrame:
    """seeded_sample of the real rows by seed, and of the fake ones by seed + 1."""
    return seeded_sample(real, group, key, seed, count, ratio).union(seeded_sample(fake, group, key, seed + 1, count, ratio))


def best_epoch(epochs: DataFrame, epoch: str, ranks: list[str]) -> DataFrame:
    """The epoch that is best by ranks one after the other, the earliest of equals; none if all of every epoch's are zero or less."""
    up = F.struct(*(F.col(c) for c in ranks)) > F.struct(*(F.lit(0).cast(epochs.schema[c].dataType).alias(c) for c in ranks))
    return epochs.filter(up).agg(F.max_by(epoch, F.struct(*ranks, (-F.col(epoch)).alias("_first"))).alias("best_epoch"))


def pair_with_original(fakes: DataFrame, reals: DataFrame, original: str, name: str, order: list[str]) -> DataFrame:
    """fakes with source, the real row that their original names: of rows that repeat a name the last by order. Fakes without one go."""
    last = reals.groupBy(F.col(name).alias("_n")).agg(F.max_by(F.struct(*reals.columns), F.struct(*order)).alias("source"))
    return fakes.join(last, F.col(original) == F.col("_n")).drop("_n")


def pair_names(pairs: DataFrame, first: str, second: str, originals: bool = False, both_orders: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """name of each file that pairs ask for: both members for originals, else a_b and, with both_orders, b_a; those in existing (name) go."""
    orders = [F.concat_ws("_", first, second), F.concat_ws("_", second, first)][: 2 if both_orders else 1]
    wanted = pairs.select(F.explode(F.array(first, second) if originals else F.array(*orders)).alias("name"))
    return wanted if existing is None else wanted.join(existing.select("name"), "name", "left_anti")


def balanced_draws(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, weighted by inverse class frequency: draw (0 to n - 1) and the row drawn.

    Every class is as likely as any other, and so are the rows of a class. Rows have ranks by seeded hash, counted in
    4,096 cells a class, so no task sorts a class. Rows without a label are never drawn; classes are few (one task numbers them).
    """
    hashed = rows.filter(F.col(label).isNotNull()).withColumn("_h", K.seeded(F.col(key), seed)).withColumn("_cell", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    cells = hashed.groupBy(label, "_cell").agg(F.count("*").alias("_k"))
    before = cells.select(label, "_cell", (F.sum("_k").over(Window.partitionBy(label).orderBy("_cell")) - F.col("_k")).alias("_before"))
    ranked = hashed.join(before, [label, "_cell"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_h", key)) - 1)
    sizes = cells.groupBy(label).agg(F.sum("_k").alias("_size"))
    classes = sizes.withColumn("_number", F.row_number().over(Window.orderBy(label)) - 1)
    number = lambda part: F.conv(F.substring(K.seeded(F.concat(F.lit(f"{part}|"), F.col("draw").cast("string")), seed), 1, 15), 16, 10).cast("long")
    count = F.broadcast(sizes.agg(F.count("*").alias("_classes")))  # one row
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").join(count).filter("_classes > 0").withColumn("_number", F.pmod(number("class"), F.col("_classes")))
    drawn = draws.join(classes, "_number").withColumn("_rank", F.pmod(number("row"), F.col("_size")))
    return drawn.join(ranked, [label, "_rank"]).select("draw", *rows.columns)

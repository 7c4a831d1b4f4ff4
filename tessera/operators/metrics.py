"""Binary-classification metrics and group scores; every metric takes grouping columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.sources.shared import saved

METHODS = ["max", "mean", "median", "top3_mean", "top5_mean"]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def group_scores(frames: DataFrame, key: str, p: str = "p", y: str = "y", block: int | None = None) -> DataFrame:
    """Per video: n, label by majority (ties: 0), mixed, and the five scores. Null scores count as frames only.

    A video's frames meet in one task. With block, only those of videos with up to so many do; scores of longer ones
    are ranked by ranges of the data (medians) or cut to five a task before they meet (best ones).
    """
    if block is not None:
        large = saved(frames.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select(key), "large")
        if not large.isEmpty():
            return group_scores(frames.join(large, key, "left_anti"), key, p, y).union(_long_scores(frames.join(large, key, "left_semi"), key, p, y))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(p)))
    f = frames.withColumn("rn", rn)
    return f.groupBy(key).agg(
        F.count("*").alias("n"), F.when(F.sum(y) * 2 > F.count("*"), 1).otherwise(0).alias("y"), (F.min(y) != F.max(y)).alias("mixed"),
        F.avg(p).alias("mean"), F.max(p).alias("max"), F.median(p).alias("median"),
        F.avg(F.when(F.col("rn") <= 3, F.col(p))).alias("top3_mean"), F.avg(F.when(F.col("rn") <= 5, F.col(p))).alias("top5_mean"),
    )


def _long_scores(frames: DataFrame, key: str, p: str, y: str) -> DataFrame:
    base = frames.groupBy(key).agg(
        F.count("*").alias("n"), F.when(F.sum(y) * 2 > F.count("*"), 1).otherwise(0).alias("y"), (F.min(y) != F.max(y)).alias("mixed"),
        F.avg(p).alias("mean"), F.max(p).alias("max"), F.count(p).alias("_k"),
    )
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(p)))
    best = frames.select(key, p).withColumn("rn", rn).filter("rn <= 5").groupBy(key).agg(F.avg(F.when(F.col("rn") <= 3, F.col(p))).alias("top3_mean"), F.avg(p).alias("top5_mean"))
    cells = frames.filter(F.col(p).isNotNull()).groupBy(key, p).agg(F.count("*").alias("_c"))
    ranked = running_sums(cells, [key], F.col(p), {"_c": "_upto"}).join(base.select(key, "_k"), key)
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(p)))
    middle = ranked.groupBy(key).agg(((at(F.floor((F.col("_k") + 1) / 2)) + at(F.floor(F.col("_k") / 2) + 1)) / 2).alias("median"))
    return base.join(best, key).join(middle, key, "left").select(key, "n", "y", "mixed", "mean", "max", "median", "top3_mean", "top5_mean")


def by_method(scores: DataFrame) -> DataFrame:
    return scores.select("y", F.explode(F.map_from_arrays(F.array(*map(F.lit, METHODS)), F.array(*METHODS))).alias("method", "p"))


def _running(sums: int):
    """Rows sorted by their first columns to rows with running sums of the last ones, begun anew where a group begins."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, carried = None, np.zeros(sums, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            new = np.ones(len(key), bool)
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            new[0] = key[0].as_py() != at
            starts = np.flatnonzero(np.append(True, new[1:]))
            size = np.diff(np.append(starts, len(key)))
            out = []
            for i in range(sums):
                run = np.cumsum(batch.column(batch.num_columns - sums + i).to_numpy(zero_copy_only=False))
                base = np.where(starts > 0, run[starts - 1], 0)
                if not new[0]:
                    base[0] -= carried[i]
                out.append(run - np.repeat(base, size))
            at, carried = key[len(key) - 1].as_py(), np.array([x[-1] for x in out])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, *(f"_run{i}" for i in range(sums))])

    return of


def running_sums(cells: DataFrame, groups: list[str], by: Column, sums: dict[str, str]) -> DataFrame:
    """cells with running sums within each group in the order of by: sums names the new column of each summed one.

    Rows are dealt by ranges of group and by, which Spark draws from the data, so any distribution spreads over the
    tasks and none holds a group; each task sums what it holds, and a row a group and task tells what came before. by
    must tell the rows of a group apart.
    """
    own = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")
    rows = cells.select(own.alias("_group"), by.alias("_by"), F.struct(*cells.columns).alias("_row"), *(F.col(c).cast("long").alias(f"_s{i}") for i, c in enumerate(sums)))
    dealt = rows.repartitionByRange("_group", "_by").sortWithinPartitions("_group", "_by").withColumn("_part", F.spark_partition_id())
    dealt = dealt.select("_group", "_by", "_part", "_row", *(f"_s{i}" for i in range(len(sums))))
    more = [StructField(f"_run{i}", LongType()) for i in range(len(sums))]
    summed = saved(dealt.mapInArrow(_running(len(sums)), StructType([*dealt.schema.fields, *more])), "running")
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = summed.groupBy("_group", "_part").agg(*(F.sum(f"_s{i}").alias(f"_p{i}") for i in range(len(sums))))
    offsets = parts.select("_group", "_part", *(F.coalesce(F.sum(f"_p{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))))
    return summed.join(offsets, ["_group", "_part"]).select("_row.*", *((F.col(f"_run{i}") + F.col(f"_o{i}")).alias(n) for i, n in enumerate(sums.values())))


def binary_metrics(scored: DataFrame, groups: list[str], y: str = "y", p: str = "p", one_class: str = "zeros") -> DataFrame:
    """AUC, average precision, Youden threshold and what it decides, best F1: one row a group.

    Scores of any range are counted first, so running sums go over distinct scores; no task takes a whole group. The
    threshold is the highest of those with the largest tp * N - fp * P; none above zero gives infinity, by which
    everything is negative. A group of one class: "zeros" gives zeros, "null" nulls, "half" zero areas and what a
    threshold of 0.5 decides. A score or label that is null, or a score that is no number, raises; a null group is one
    of its own; an empty table gives no row.
    """
    score, yes = F.col(p).cast("double"), F.col(y).cast("int")
    wrong = score.isNull() | F.isnan(score) | yes.isNull()
    sound = scored.withColumn(p, F.when(wrong, F.raise_error(F.lit("a score or label is missing or no number")).cast("double")).otherwise(score))
    cells = sound.groupBy(*groups, p).agg(F.sum(yes).cast("long").alias("dtp"), F.sum(1 - yes).cast("long").alias("dfp"))
    totals = cells.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups))).agg(F.sum("dtp").alias("pos"), F.sum("dfp").alias("neg"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    run = running_sums(cells, groups, -F.col(p), {"dtp": "tp", "dfp": "fp"})
    c = (run.join(totals, same) if groups else run.join(F.broadcast(totals))).select(*groups, p, "dtp", "dfp", "pos", "neg", "tp", "fp")  # without groups, one row
    j = F.col("tp") * F.col("neg") - F.col("fp") * F.col("pos")
    prec, rec = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif(F.col("pos"), F.lit(0))
    best = F.max(F.struct(j.alias("j"), F.col(p).alias("t"), F.col("tp"), F.col("fp")))
    out = c.groupBy(*groups).agg(
        F.max("pos").alias("pos"), F.max("neg").alias("neg"), best.alias("b"),
        F.sum(F.col("dfp") * (F.col("tp") - F.col("dtp") / 2)).alias("area"), F.sum(F.col("dtp") * prec).alias("ap"),
        F.max(2 * prec * rec / (prec + rec + 1e-10)).alias("best_f1"),
        *(F.coalesce(F.sum(F.when(F.col(p) >= 0.5, F.col(c))), F.lit(0)).alias(a) for c, a in (("dtp", "half_tp"), ("dfp", "half_fp"))),
    )
    if one_class == "half":
        alone, tp, fp = (F.col("pos") == 0) | (F.col("neg") == 0), F.col("half_tp"), F.col("half_fp")
        hp, hr = ratio(tp, tp + fp), ratio(tp, F.col("pos"))
        decided = F.struct(F.lit(1).cast("long").alias("j"), F.lit(0.5).alias("t"), tp.alias("tp"), fp.alias("fp"))
        out = out.withColumn("b", F.when(alone, decided).otherwise(F.col("b"))).withColumn("best_f1", F.when(alone, 2 * hp * hr / (hp + hr + 1e-10)).otherwise(F.col("best_f1")))
    two, up = (F.col("pos") > 0) & (F.col("neg") > 0), F.col("b.j") > 0
    tp, fp = F.when(up, F.col("b.tp")).otherwise(0), F.when(up, F.col("b.fp")).otherwise(0)
    area, ap = F.when(two, F.col("area") / (F.col("pos") * F.nullif(F.col("neg"), F.lit(0)))).otherwise(0.0), F.when(two, F.col("ap") / F.nullif(F.col("pos"), F.lit(0))).otherwise(0.0)
    other = F.lit(None) if one_class == "null" else F.lit(0)
    two = F.lit(True) if one_class == "half" else two
    z = lambda c: F.round(F.when(two, c).otherwise(other.cast("double")), 6)
    k = lambda c: F.when(two, c).otherwise(other).cast("long")
    return out.filter("pos is not null").select(
        *groups, z(area).alias("auc"), z(ap).alias("ap"), z((tp + F.col("neg") - fp) / (F.col("pos") + F.col("neg"))).alias("acc"),
        z(F.col("best_f1")).alias("best_f1"), z(ratio(fp, F.col("neg"))).alias("fpr"), z(ratio(F.col("pos") - tp, F.col("pos"))).alias("fnr"),
        z(F.when(up, F.col("b.t")).otherwise(F.lit(float("inf")))).alias("threshold"),
        k(F.col("neg") - fp).alias("tn"), k(fp).alias("fp"), k(F.col("pos") - tp).alias("fn"), k(tp).alias("tp"),
    )


def confusion(scored: DataFrame, threshold: float, groups: list[str], y: str = "y", p: str = "p") -> DataFrame:
    up, yes = F.col(p) >= threshold, F.col(y) == 1
    c = scored.groupBy(*groups).agg(F.count_if(~up & ~yes).alias("tn"), F.count_if(up & ~yes).alias("fp"), F.count_if(~up & yes).alias("fn"), F.count_if(up & yes).alias("tp"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    tp = F.col("tp")
    return c.select("*", *(F.round(x, 6).alias(a) for a, x in (("acc", ratio(F.col("tn") + tp, n)), ("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn"))), ("fnr", ratio(F.col("fn"), F.col("fn") + tp)), ("precision", ratio(tp, tp + F.col("fp"))), ("recall", ratio(tp, tp + F.col("fn"))), ("f1", ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))))))


def error_type(y: Column, p: Column, threshold: float) -> Column:
    up = p >= threshold
    return F.when((y == 0) & up, "real_as_fake").when((y == 1) & ~up, "fake_as_real").otherwise("correct")

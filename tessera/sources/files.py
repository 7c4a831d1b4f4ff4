"""Sources: file listings, delimited and JSON tables, lists of paths and ids. All are lazy scans by Spark's readers."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import keys as K
from tessera.sources import split

IMAGES = ("png", "jpg", "jpeg")
PICTURES = (*IMAGES, "bmp", "webp")
VIDEOS = ("mp4", "avi", "mov", "mkv")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGES, recursive: bool = True, any_case: bool = True) -> DataFrame:
    """path, name, length of the files below root whose suffix is one of extensions; contents are never read.

    Names that begin with "_" or "." are left out, as Spark's file index does; tree.walk lists them too. Unordered: sort by path where order counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return files.filter(F.col("name").rlike(rf"{'(?i)' if any_case else ''}\.({'|'.join(extensions)})$"))


def counted(files: DataFrame, *by: Column) -> DataFrame:
    """Number of files, a row for each value of by."""
    return files.groupBy(*by).agg(F.count("*").alias("n"))


def labelled(files: DataFrame, real: tuple[str, ...] = ("0_real", "real"), fake: tuple[str, ...] = ("1_fake", "fake")) -> DataFrame:
    """files with label (0, 1, or null without a label directory) and split, the directory above the label's.

    The label directory nearest to the file counts, in any case; so one listing serves every accepted layout.
    """
    parts = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    numbered = F.transform(parts, lambda x, i: F.struct(i.alias("at"), F.lower(x).alias("dir")))
    last = F.element_at(F.filter(numbered, lambda x: x["dir"].isin(*real, *fake)), -1)
    found = files.withColumn("_last", F.when(F.size(F.filter(numbered, lambda x: x["dir"].isin(*real, *fake))) > 0, last))
    label = F.when(F.col("_last.dir").isin(*real), 0).when(F.col("_last.dir").isin(*fake), 1)
    split = F.when(F.col("_last.at") > 0, F.get(parts, F.col("_last.at") - 1))
    return found.select("*", label.alias("label"), split.alias("split")).drop("_last")


def table_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """A delimited file with a header, all columns strings, their names and values trimmed; a byte order mark is gone.

    The last column with a blank name is folder (an empty folder is added where there is none), path is filename where
    that is missing. A missing required column raises at once.
    """
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"')
    names = [c.strip().lstrip("\ufeff") for c in df.columns]
    blank = [i for i, c in enumerate(names) if not c or c.startswith("Unnamed") or c.startswith("_c") and c[2:].isdigit()]
    if blank and "folder" not in names:
        names[blank[-1]] = "folder"
    if "path" in names and "filename" not in names:
        names[names.index("path")] = "filename"
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    df = df.toDF(*names).select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in names))
    return df if "folder" in names else df.withColumn("folder", F.lit(""))


def with_status(manifest: DataFrame, allowed: tuple[str, ...] = ("ok", "skipped_existing")) -> DataFrame:
    """Rows of an allowed status; all of them where the manifest has no status or nothing is named."""
    return manifest.filter(F.trim("status").isin(*allowed)) if allowed and "status" in manifest.columns else manifest


def records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Elements of JSON arrays, or objects over several lines, one row each. A file is one task's work; split.json_array reads large arrays by blocks."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def frame_records(spark: SparkSession, root: str, schema: StructType | str, frames: str = "frames", name: str = "metadata.json") -> DataFrame:
    """One row for each metadata file below root that parses and has a frame; others are skipped."""
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return found.filter(F.size(frames) > 0)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, trimmed, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def resolved(path: Column, base: str = "") -> Column:
    """Relative paths below base; empty and "." parts gone, ".." takes the part before it with it."""
    whole = F.when(path.startswith("/") | F.lit(not base), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    none = F.expr("cast(array() as array<string>)")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))))
    return F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def parsed_paths(lines: DataFrame, base: str = "", at: str = "line_no", text: str = "line") -> DataFrame:
    """line_no, path of numbered lines of a list: the first tab field, unquoted and resolved; of equal paths the first.

    Blank lines, comments (#) and a header (path, image_path) are skipped.
    """
    field = F.regexp_replace(F.regexp_replace(F.trim(F.get(F.split(F.trim(text), "\t"), F.lit(0))), '^"+|"+$', ""), "^'+|'+$", "")
    used = lines.filter(~F.trim(text).startswith("#")).select(at, field.alias("f")).filter("f <> '' and lower(f) not in ('path', 'image_path')")
    return used.groupBy(resolved(F.col("f"), base).alias("path")).agg(F.min(at).alias(at)).select(at, "path")


def path_list(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """parsed_paths of a list file of any length; line_no counts its lines from 0."""
    return parsed_paths(split.numbered_lines(spark, path), base)


def resolve_metadata(spark: SparkSession, root: str, name: str, explicit: str | None = None, below: tuple[str, ...] = ()) -> str | None:
    """The metadata file of a data set: explicit if it is there, else name in root, else in one of its directories below; None if there is none."""
    for path in [*([explicit] if explicit else []), f"{root.rstrip('/')}/{name}", *(f"{root.rstrip('/')}/{d}/{name}" for d in below)]:
        try:
            if not spark.read.format("binaryFile").load(path).select("path").isEmpty():
                return path
        except AnalysisException:
            continue
    return None


def first_existing(candidates: list[Column], rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """rows with found: of their candidate paths the first that files has, else null."""
    each = rows.select(key, F.posexplode(F.array(*candidates)).alias("at", "path"))
    found = each.join(files.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "at").alias("found"))
    return rows.join(found, key, "left")


def union_of(listings: list[DataFrame]) -> DataFrame:
    """Distinct files of several listings."""
    return reduce(DataFrame.unionByName, listings).dropDuplicates(["path"])


def normal_root(path: Column, root: str) -> Column:
    """Does path lie in root, or is it root itself? A sibling with root as its prefix does not."""
    p, r = K.normal_path(path), root.replace("\\", "/").rstrip("/")
    return (p == r) | p.startswith(f"{r}/")

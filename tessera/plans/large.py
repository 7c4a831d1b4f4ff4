"""Queries of operators that cut large groups, windows and files into parts: budgets, needed frames, audits, sources."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import json
from tessera.functions import keys as K
from tessera.functions import vectors as V
from tessera.operators import budget, metrics, selection
from tessera.plans.catalogue import _SCORES, _frames, query
from tessera.sources import files, shared, sinks, split, tree


@query("""WITH RECURSIVE t AS (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) % 1000 AS cost, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer),
g AS (SELECT c_custkey, rn, cost <= 90000 AS taken, 90000 - cost AS room FROM t WHERE rn = 1
 UNION ALL SELECT t.c_custkey, t.rn, t.cost <= g.room AND g.room > 0, CASE WHEN t.cost <= g.room THEN g.room - t.cost ELSE g.room END FROM g JOIN t ON t.rn = g.rn + 1)
SELECT c_custkey, taken FROM g""")
def budget_one_group(t):
    """All tasks share one budget; blocks of 512 rows, so that the tables given span some."""
    tasks = t("customer").select("c_custkey", (F.floor(F.abs("c_acctbal")) % 1000).alias("cost"))
    return budget.greedy(tasks, [], ["c_custkey"], "cost", 90000, block=512).select("c_custkey", "taken")


_PHASES = """WITH RECURSIVE x AS (SELECT c_mktsegment AS g, c_custkey AS i, CASE WHEN c_nationkey % 2 = 0 THEN 'fake' ELSE 'real' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS phase,
 CASE WHEN c_nationkey % 2 = 0 THEN 1 + c_custkey % 90 WHEN c_custkey % 16 = 1 THEN 30 WHEN c_custkey % 3 = 0 THEN 20 ELSE 0 END AS cost FROM customer),
t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY phase, i) AS rn FROM x WHERE phase = 1 OR kind = 'real'),
d AS (SELECT g, i, 0 AS rn, 1 AS phase, false AS taken, 700 AS lf, 900 AS lr, 0 AS idle, false AS stopped FROM t WHERE rn = 1
 UNION ALL SELECT g, i, rn, phase, ok, CASE WHEN ok AND kind = 'fake' THEN lf - cost ELSE lf END, CASE WHEN ok AND kind = 'real' THEN lr - cost ELSE lr END, CASE WHEN ok AND cost > 0 THEN 0 ELSE idle + 1 END, phase = 1 AND (stopped OR (room <= 0 AND idle + 1 >= 12))
 FROM (SELECT t.*, d.lf, d.lr, d.idle, d.stopped, CASE WHEN t.kind = 'fake' THEN d.lf ELSE d.lr END AS room, NOT (d.stopped AND t.phase = 1) AND CASE WHEN t.kind = 'fake' THEN d.lf ELSE d.lr END > 0 AND t.cost <= CASE WHEN t.kind = 'fake' THEN d.lf ELSE d.lr END AS ok FROM d JOIN t ON t.g = d.g AND t.rn = d.rn + 1))
SELECT g, i, taken FROM d WHERE rn > 0"""


@query(_PHASES)
def budget_phases_idle(t):
    """Two phases over budgets of two kinds, the first ended by an idle stop; blocks of 128 rows."""
    fake, key = F.col("c_nationkey") % 2 == 0, F.col("c_custkey")
    cost = F.when(fake, 1 + key % 90).when(key % 16 == 1, 30).when(key % 3 == 0, 20).otherwise(0)
    tasks = t("customer").select(F.col("c_mktsegment").alias("g"), key.alias("i"), F.when(fake, "fake").otherwise("real").alias("kind"), F.when(key % 3 == 0, 2).otherwise(1).alias("phase"), cost.alias("cost"))
    return budget.two_phase(tasks, ["g"], "kind", "phase", ["i"], "cost", {"fake": 700, "real": 900}, idle_stop=12, block=128).select("g", "i", "taken")


_SPLITS = """WITH x AS (SELECT o_orderstatus AS split, CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS i, CASE WHEN o_orderkey % 50 = 0 THEN 'cover.png' ELSE o_custkey || '_' || o_orderkey || '.png' END AS name FROM orders)"""


def _images(t):
    key = F.col("o_orderkey")
    name = F.when(key % 50 == 0, "cover.png").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("_"), key.cast("string"), F.lit(".png")))
    return t("orders").select(F.col("o_orderstatus").alias("split"), name.alias("image_name"), K.image_id(name).alias("x")).select("split", "image_name", "x.*")


@query(f"""{_SPLITS}, c AS (SELECT DISTINCT split, id FROM x WHERE name <> 'cover.png'), k AS (SELECT id, count(*) AS n, min(split) AS one FROM c GROUP BY 1)
SELECT id AS metadata_id, n AS n_splits, n = 3 AS shared, CASE WHEN n = 1 THEN one END AS only_in FROM k""")
def split_sharing(t):
    return selection.split_sharing(selection.split_counts(_images(t)), 3)


@query(f"""{_SPLITS}, c AS (SELECT split, id, count(*) AS n, string_agg(i, ' ' ORDER BY i) AS places FROM x WHERE name <> 'cover.png' GROUP BY ALL), k AS (SELECT id, count(*) AS in_splits FROM c GROUP BY 1),
s AS (SELECT split, CAST(sum(n) AS BIGINT) AS image_count, count(*) AS unique_metadata_count, string_agg(id || ':' || n || ':' || places, ',' ORDER BY id) AS listed, coalesce(string_agg(CASE WHEN in_splits = 1 THEN id END, ',' ORDER BY id), '') AS only_here FROM c JOIN k USING (id) GROUP BY 1)
SELECT split, coalesce(image_count, 0) AS image_count, coalesce(unique_metadata_count, 0) AS unique_metadata_count, coalesce(listed, '') AS listed, coalesce(only_here, '') AS only_here, (SELECT count(*) FROM x WHERE name = 'cover.png' AND x.split = v.split) AS skipped,
 (SELECT count(*) FROM k WHERE in_splits = 4) AS shared FROM (VALUES ('F'), ('O'), ('P'), ('none')) AS v(split) LEFT JOIN s USING (split)""")
def split_summary(t):
    """The report over four splits, one of them without an image; its arrays and maps as texts."""
    out = selection.split_summary(_images(t), ["F", "O", "P", "none"])
    entry = lambda n, places: F.concat_ws(":", n["key"], n["value"].cast("string"), F.array_join(places["value"].cast("array<string>"), " "))
    listed = F.zip_with(F.map_entries("images_per_metadata"), F.map_entries("frame_indices_per_metadata"), entry)  # both by id in order
    return out.select("split", "image_count", "unique_metadata_count", F.array_join(listed, ",").alias("listed"), F.array_join("unique", ",").alias("only_here"), F.size("skipped_files").cast("long").alias("skipped"), F.size("shared_metadata_ids").cast("long").alias("shared"))


@query("SELECT o_orderkey, CAST(least(greatest(round_even(o_custkey * CAST(0.35 AS DOUBLE), 0), 0), 499) AS BIGINT) AS first, CAST(greatest(least(greatest(round_even(o_custkey * CAST(0.35 AS DOUBLE), 0), 0), 499) + 1, least(round_even((o_custkey + 5) * CAST(0.35 AS DOUBLE), 0), 500)) AS BIGINT) AS stop FROM orders")
def column_spans(t):
    first, stop = K.column_span(F.col("o_custkey"), 5, F.lit(0.35), F.lit(500))
    return t("orders").select("o_orderkey", first.alias("first"), stop.alias("stop"))


@query("SELECT page_id, regexp_matches(p, '^[A-Za-z]:[/\\\\]') AS absolute FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C:\\data\\' || page_id WHEN 1 THEN '/data/' || page_id WHEN 2 THEN 'd:/x' ELSE 'C:x' END AS p FROM pages)")
def windows_paths(t):
    n = F.col("page_id") % 4
    path = F.when(n == 0, F.concat(F.lit(' "C:\\data\\'), F.col("page_id").cast("string"), F.lit('"'))).when(n == 1, F.concat(F.lit("/data/"), F.col("page_id").cast("string"))).when(n == 2, "d:/x").otherwise("C:x")
    return t("pages").select("page_id", K.is_windows_absolute(path).alias("absolute"))


def _folder(df, name):
    return f"{shared.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


_TREE = """WITH f AS (SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS dir, CASE s_suppkey % 5 WHEN 0 THEN '_clip_' || s_suppkey || '.png' WHEN 1 THEN '.hidden_' || s_suppkey || '.PNG' WHEN 2 THEN 'cover.' || s_suppkey || '.jpg' WHEN 3 THEN 'c_' || s_suppkey || '.mp4' ELSE 'a.b_' || s_suppkey || '.jpeg' END AS name FROM supplier)"""


def _tree(t):
    """A small tree of files named by suppliers, written by tasks: root and manifest."""
    k, s = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("_clip_"), s, F.lit(".png"))).when(k == 1, F.concat(F.lit(".hidden_"), s, F.lit(".PNG"))).when(k == 2, F.concat(F.lit("cover."), s, F.lit(".jpg"))).when(k == 3, F.concat(F.lit("c_"), s, F.lit(".mp4"))).otherwise(F.concat(F.lit("a.b_"), s, F.lit(".jpeg")))
    root = _folder(t("supplier"), "tree")
    rows = t("supplier").select(F.concat(F.lit(f"{root}/"), F.col("s_nationkey").cast("string"), F.lit("/"), name).alias("path"), F.repeat(F.lit("x"), (F.col("s_suppkey") % 7).cast("int")).alias("content"))
    return root, tree.write_each(rows)


@query(f"""{_TREE}, x AS (SELECT *, regexp_extract(regexp_replace(name, '[.][^.]*$', ''), '^(.+)_([0-9]+)$', ['id', 'i']) AS x FROM f WHERE name NOT LIKE '%.mp4')
SELECT dir AS split, name AS image_name, nullif(x.id, '') AS metadata_id, CASE WHEN x.id <> '' THEN TRY_CAST(x.i AS BIGINT) END AS frame_index, k % 7 AS length FROM x""")
def tree_listing(t):
    """Images of a written tree, hidden names too, with what their names tell."""
    root, _ = _tree(t)
    files_ = tree.of_type(tree.walk(t("supplier").sparkSession, root), files.IMAGES)
    return tree.named_images(files_).join(files_.select(F.col("path").alias("full_path"), "length"), "full_path").drop("full_path")


@query("SELECT CASE s_suppkey % 2 WHEN 0 THEN 'v' || s_suppkey || '.MP4' ELSE '_v' || s_suppkey || '.mkv' END AS name, CAST(s_suppkey % 2 AS INT) AS label, CASE s_suppkey % 2 WHEN 0 THEN '0_real' ELSE '1_fake' END AS dir FROM supplier WHERE s_suppkey % 3 > 0")
def video_task_list(t):
    """The work list of two label directories; other directories, deeper ones and other files are no part of it."""
    odd, s = F.col("s_suppkey") % 2, F.col("s_suppkey").cast("string")
    root = _folder(t("supplier"), "videos")
    name = F.when(odd == 0, F.concat(F.lit("0_real/v"), s, F.lit(".MP4"))).otherwise(F.concat(F.lit("1_fake/_v"), s, F.lit(".mkv")))
    other = F.when(odd == 0, F.concat(F.lit("0_real/deep/"), s, F.lit(".mp4"))).otherwise(F.concat(F.lit("notes/"), s, F.lit(".mp4")))
    path = F.when(F.col("s_suppkey") % 3 > 0, name).otherwise(other)
    tree.write_each(t("supplier").select(F.concat(F.lit(f"{root}/"), path).alias("path"), F.lit("").alias("content")))
    tasks = tree.video_tasks(t("supplier").sparkSession, root, "/out", files.VIDEOS, {"0_real": 0, "1_fake": 1})
    return tasks.select("name", "label", F.element_at(F.split("out_dir", "/"), -1).alias("dir"))


@query("""SELECT 's' || s_suppkey AS sample, CASE s_suppkey % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'no_frames' WHEN 2 THEN 'invalid' WHEN 3 THEN 'ok' ELSE 'no_frames' END AS status, CASE WHEN s_suppkey % 5 = 3 THEN 'frame_' || s_suppkey || '.png' END AS first, CASE WHEN s_suppkey % 5 IN (1, 3) THEN s_nationkey END AS fps FROM supplier""")
def metadata_audit(t):
    """Metadata files, written and read again: broken ones are rows with a status, not gaps."""
    k, s, fps = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    content = F.when(k == 0, '{"frames": [').when(k == 1, F.concat(F.lit('{"frames": [], "fps": '), fps, F.lit("}"))).when(k == 2, "[1, 2]").when(k == 3, F.concat(F.lit('{"fps": '), fps, F.lit(', "frames": [{"file_path": "frame_'), s, F.lit('.png"}]}'))).otherwise("{}")
    root = _folder(t("supplier"), "metadata")
    tree.write_each(t("supplier").select(F.concat(F.lit(f"{root}/_set/s"), s, F.lit("/metadata.json")).alias("path"), content.alias("content")))
    found = tree.metadata(t("supplier").sparkSession, root, "fps int, frames array<struct<file_path string>>")
    return found.select("sample", "status", F.get("meta.frames.file_path", F.lit(0)).alias("first"), F.col("meta.fps").alias("fps"))


@query(f"""{_TREE}, a AS (SELECT k, name, 'copied' AS action, k % 7 AS bytes FROM f WHERE k % 2 = 0 UNION ALL SELECT k, name, 'existing', k % 7 FROM f WHERE k % 2 = 0 UNION ALL SELECT k, name, 'copy', k % 7 FROM f WHERE k % 2 = 1)
SELECT action, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM a GROUP BY 1 UNION ALL SELECT 'missing', count(*), NULL FROM f""")
def copy_manifest(t):
    """A copy, the same once more, a dry run, and a plan for files that aren't there."""
    root, manifest = _tree(t)
    target = _folder(manifest, "copies")
    even = F.regexp_extract("path", r"(\d+)\.[^.]*$", 1).cast("long") % 2 == 0
    plan = manifest.select("path", F.concat(F.lit(target), F.expr(f"substring(path, {len(root) + 1})")).alias("target"), even.alias("even"))
    done = [tree.copy_files(plan.filter("even"), dry_run=False), tree.copy_files(plan.filter("even"), dry_run=False), tree.copy_files(plan.filter("not even")), tree.copy_files(plan.select(F.concat("path", F.lit(".none")).alias("path"), "target"))]
    return reduce(DataFrame.union, done).groupBy("action").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_array_rows(t):
    """Conversations as JSON arrays, written and read again element by element."""
    c = t("conversations")
    root = _folder(c, "arrays")
    arrays = c.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "conv_id", "role", "text"))), {"pretty": "true"}).alias("content"))
    tree.write_each(arrays.select(F.concat(F.lit(f"{root}/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), "content"))
    return split.json_array(c.sparkSession, root, c.select("conv_id", "turn", "role", "text").schema)


@query("SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS line_no, 'order ' || l_orderkey || '/' || l_linenumber AS line FROM lineitem WHERE l_suppkey % 3 = 0")
def numbered_lines(t):
    """Lists of lines, a file each, written and read again with the places of their lines."""
    rows = t("lineitem").filter("l_suppkey % 3 = 0")
    root = _folder(rows, "lines")
    line = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    lists = rows.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    tree.write_each(lists.select(F.concat(F.lit(f"{root}/"), F.col("l_suppkey").cast("string"), F.lit(".txt")).alias("path"), "content"))
    return split.numbered_lines(rows.sparkSession, root).select(F.regexp_extract("file", r"(\d+)\.txt$", 1).cast("long").alias("l_suppkey"), "line_no", "line")


_PROPS = "CASE event_id % 7 WHEN 0 THEN substr(props, 1, 4) WHEN 1 THEN '{\"k\": null}' WHEN 2 THEN '{}' WHEN 3 THEN NULL ELSE props END"


@query(f"WITH x AS (SELECT event_id, {_PROPS} AS p FROM events), y AS (SELECT event_id, p, TRY_CAST(p AS JSON) AS j FROM x) SELECT event_id, CASE WHEN event_id % 7 = 1 THEN NULL WHEN j IS NULL OR event_id % 7 = 2 THEN -1 ELSE CAST(json_extract_string(j, '$.k') AS BIGINT) END AS k, coalesce(p IS NOT NULL AND j IS NULL, false) AS broken FROM y")
def json_defaults(t):
    """A value of a JSON column with a default, where texts are broken, empty, null or lack it."""
    k = F.col("event_id") % 7
    props = F.when(k == 0, F.substring("props", 1, 4)).when(k == 1, '{"k": null}').when(k == 2, "{}").when(k == 3, F.lit(None)).otherwise(F.col("props"))
    return t("events").select("event_id", json.value(json.parsed(props), "$.k", "bigint", -1).alias("k"), json.broken(props).alias("broken"))


@query("SELECT s_suppkey, s_name || ' \"q\", ' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'ok' ELSE 'skipped_existing' END AS status FROM supplier WHERE s_suppkey % 3 < 2")
def csv_round_trip(t):
    """A manifest with quotes and commas, written, read by its header, and cut to two statuses."""
    k = F.col("s_suppkey")
    out = t("supplier").select(k.cast("string").alias("id"), F.concat("s_name", F.lit(' "q", '), F.col("s_nationkey").cast("string")).alias("path"), F.when(k % 3 == 2, "error: none").when(k % 2 == 0, " ok ").otherwise("skipped_existing").alias("status"))
    path = _folder(out, "manifest-csv")
    sinks.write_csv(out, path)
    back = files.with_status(files.table_csv(out.sparkSession, path, required=("id", "filename", "status")))
    return back.select(F.col("id").cast("long").alias("s_suppkey"), F.col("filename").alias("name"), "status")


@query("SELECT doc_id, printf('%.8f', n_chars % 1000 / CAST(1000 AS DOUBLE)) AS prob_fake FROM documents")
def predictions_round_trip(t):
    scored = t("documents").select("doc_id", (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("prob_fake"))
    path = _folder(scored, "predictions")
    sinks.write_predictions(scored, path)
    return files.table_csv(scored.sparkSession, path, sep="\t").select(F.col("doc_id").cast("long").alias("doc_id"), "prob_fake")


@query("SELECT label, sample_name, row_number() OVER (ORDER BY label, sample_name) AS place FROM (SELECT CAST(c_custkey % 2 AS INT) AS label, c_name AS sample_name FROM customer)")
def clip_index_order(t):
    """The rows of a written index in the order of its part files and lines: sorted without a single task."""
    clips = t("customer").select((F.col("c_custkey") % 2).cast("int").alias("label"), F.col("c_name").alias("sample_name"))
    path = _folder(clips, "index")
    sinks.write_clip_index(clips, path)
    lines = split.numbered_lines(clips.sparkSession, path).filter("line_no > 0 and line <> ''")
    parts = lines.groupBy("file").agg(F.count("*").alias("n"))  # a row a part file
    starts = parts.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    cell = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    return lines.join(F.broadcast(starts), "file").select(cell(0).cast("int").alias("label"), cell(1).alias("sample_name"), (F.col("before") + F.col("line_no")).alias("place"))


@query("SELECT DISTINCT s_name AS id FROM supplier")
def id_list_round_trip(t):
    names = t("supplier").select(F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("id")).union(t("supplier").select(F.lit(" ")).limit(3))
    path = _folder(names, "ids")
    sinks.write_lines(names, "id", path)
    return files.id_list(names.sparkSession, path)


@query("WITH x AS (SELECT o_custkey, list(o_orderkey % 40 ORDER BY o_orderkey) AS starts FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_sort(list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 5))))), ' ') AS frames FROM x")
def window_frames(t):
    """The frames of a video's windows, in order and each once, as an array."""
    starts = t("orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey") % 40).alias("starts"))
    return starts.select("o_custkey", F.array_join(V.frames_of(F.col("starts"), 5).cast("array<string>"), " ").alias("frames"))


@query(_SCORES + " SELECT video, n, CAST(y AS INT) AS y, mixed, round(mean, 6) AS mean, round(max, 6) AS max, round(median, 6) AS median, round(top3_mean, 6) AS top3_mean, round(top5_mean, 6) AS top5_mean FROM s")
def long_video_scores(t):
    """Scores of videos, those of more than 66 frames by ranges of their scores."""
    s = metrics.group_scores(_frames(t), "video", block=66)
    return s.select("video", "n", "y", "mixed", *(F.round(m, 6).alias(m) for m in metrics.METHODS))


from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import vectors as V
from tessera.operators import budget, manifests, metrics, selection
from tessera.sources import files
from tessera.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def named(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return named


def _frames(t):
    return t("events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), F.col("value").alias("p"), (F.col("event_type") == "error").cast("int").alias("y"))


def _samples(t):
    return t("labels").join(t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), (F.col("n_chars") % 1000 / 1000.0).alias("p"))


_FRAMES = "WITH f AS (SELECT user_id AS video, event_id AS frame, value AS p, CAST(event_type = 'error' AS INT) AS y FROM events)"
_SCORES = _FRAMES + """, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY p DESC) AS rn FROM f),
s AS (SELECT video, count(*) AS n, CASE WHEN sum(y) * 2 > count(*) THEN 1 ELSE 0 END AS y, min(y) <> max(y) AS mixed, avg(p) AS mean, max(p) AS max, median(p) AS median,
  avg(CASE WHEN rn <= 3 THEN p END) AS top3_mean, avg(CASE WHEN rn <= 5 THEN p END) AS top5_mean FROM r GROUP BY video)"""
_SAMPLES = "WITH x AS (SELECT doc_id, lang, source, quality AS y, n_chars % 1000 / CAST(1000 AS DOUBLE) AS p FROM labels JOIN documents USING (doc_id))"


def _metric_sql(source: str, groups: str) -> str:
    g, on = (groups + ", ", f"PARTITION BY {groups} ") if groups else ("", "")
    by = f"GROUP BY {groups}" if groups else ""
    return f"""{source}, cells AS (SELECT {g} p, sum(y) AS dtp, sum(1 - y) AS dfp FROM x GROUP BY {g} p),
c AS (SELECT *, sum(dtp) OVER ({on}ORDER BY p DESC) AS tp, sum(dfp) OVER ({on}ORDER BY p DESC) AS fp, sum(dtp) OVER ({on}) AS pos, sum(dfp) OVER ({on}) AS neg FROM cells),
d AS (SELECT *, tp::DOUBLE / (tp + fp) AS prec, tp::DOUBLE / nullif(pos, 0) AS rec, tp * neg - fp * pos AS j FROM c),
m AS (SELECT {g} max(pos) AS pos, max(neg) AS neg, max(struct_pack(j := j, t := p, tp := tp, fp := fp)) AS b, sum(dfp * (tp - dtp / CAST(2 AS DOUBLE))) AS area, sum(dtp * prec) AS ap, max(2 * prec * rec / (prec + rec + CAST(1e-10 AS DOUBLE))) AS f1 FROM d {by}),
n AS (SELECT *, pos > 0 AND neg > 0 AS two, CASE WHEN b.j > 0 THEN b.tp ELSE 0 END AS tp, CASE WHEN b.j > 0 THEN b.fp ELSE 0 END AS fp FROM m)
SELECT {g} round(CASE WHEN two THEN area / (pos::DOUBLE * neg) ELSE 0 END, 6) AS auc, round(CASE WHEN two THEN ap / pos ELSE 0 END, 6) AS ap, round(CASE WHEN two THEN (tp + neg - fp)::DOUBLE / (pos + neg) ELSE 0 END, 6) AS acc,
 round(CASE WHEN two THEN f1 ELSE 0 END, 6) AS best_f1, round(CASE WHEN two THEN fp::DOUBLE / neg ELSE 0 END, 6) AS fpr, round(CASE WHEN two THEN (pos - tp)::DOUBLE / pos ELSE 0 END, 6) AS fnr,
 CASE WHEN two THEN CASE WHEN b.j > 0 THEN round(b.t, 6) ELSE CAST('inf' AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END AS threshold,
 CAST(CASE WHEN two THEN neg - fp ELSE 0 END AS BIGINT) AS tn, CAST(CASE WHEN two THEN fp ELSE 0 END AS BIGINT) AS fp, CAST(CASE WHEN two THEN pos - tp ELSE 0 END AS BIGINT) AS fn, CAST(CASE WHEN two THEN tp ELSE 0 END AS BIGINT) AS tp FROM n"""


_METHODS = _SCORES + ", x AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, y, {m} AS p FROM s WHERE n >= 10" for m in metrics.METHODS) + ")"


@query(_SCORES + " SELECT video, n, CAST(y AS INT) AS y, mixed, round(mean, 6) AS mean, round(max, 6) AS max, round(median, 6) AS median, round(top3_mean, 6) AS top3_mean, round(top5_mean, 6) AS top5_mean FROM s WHERE n >= 10")
def video_scores(t):
    s = metrics.group_scores(_frames(t), "video").filter("n >= 10")
    return s.select("video", "n", "y", "mixed", *(F.round(m, 6).alias(m) for m in ("mean", "max", "median", "top3_mean", "top5_mean")))


@query(_metric_sql(_METHODS, "method"))
def video_metrics_by_agg(t):
    return metrics.binary_metrics(metrics.by_method(metrics.group_scores(_frames(t), "video").filter("n >= 10")), ["method"])


@query(_metric_sql(_SAMPLES, ""))
def frame_metrics(t):
    return metrics.binary_metrics(_samples(t), [])


@query(_metric_sql(_SAMPLES, "lang"))
def metrics_by_stratum(t):
    return metrics.binary_metrics(_samples(t), ["lang"])


_COUNTS = "count_if(p < 0.5 AND y = 0) AS tn, count_if(p >= 0.5 AND y = 0) AS fp, count_if(p < 0.5 AND y = 1) AS fn, count_if(p >= 0.5 AND y = 1) AS tp"


@query(_SAMPLES + f""", c AS (SELECT lang, {_COUNTS} FROM x GROUP BY lang) SELECT lang, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
 round(coalesce((tn + tp)::DOUBLE / nullif(tn + fp + fn + tp, 0), 0), 6) AS acc, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0), 6) AS fnr,
 round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion_at_threshold(t):
    return metrics.confusion(_samples(t), 0.5, ["lang"])


_ERR = "CASE WHEN y = 0 AND p >= 0.5 THEN 'real_as_fake' WHEN y = 1 AND p < 0.5 THEN 'fake_as_real' ELSE 'correct' END"


@query(_SAMPLES + f" SELECT doc_id, lang, y, printf('%.8f', p) AS prob_fake, {_ERR} AS error_type FROM x WHERE {_ERR} <> 'correct'")
def error_report(t):
    return _samples(t).withColumn("error_type", metrics.error_type(F.col("y"), F.col("p"), 0.5)).filter("error_type <> 'correct'").select("doc_id", "lang", "y", F.format_string("%.8f", "p").alias("prob_fake"), "error_type")


@query(_SAMPLES + f" SELECT lang, count(*) AS n, count_if({_ERR} = 'real_as_fake')::BIGINT AS real_as_fake, count_if({_ERR} = 'fake_as_real')::BIGINT AS fake_as_real FROM x GROUP BY lang")
def error_summary(t):
    e = metrics.error_type(F.col("y"), F.col("p"), 0.5)
    return _samples(t).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(e == "real_as_fake").alias("real_as_fake"), F.count_if(e == "fake_as_real").alias("fake_as_real"))


@query("WITH e AS (SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch, avg(value) AS auc, max(value) AS ap, count(*) AS acc FROM events GROUP BY 1) SELECT CAST(arg_max(epoch, struct_pack(a := round(auc, 2), b := ap, c := acc, d := -epoch)) AS INT) AS best_epoch FROM e")
def best_epoch(t):
    e = t("events").groupBy(F.unix_date(F.to_date("ts")).alias("epoch")).agg(F.avg("value").alias("auc"), F.max("value").alias("ap"), F.count("*").alias("acc"))
    return selection.best_epoch(e.withColumn("auc", F.round("auc", 2)), "epoch", ["auc", "ap", "acc"])


@query("WITH g AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) SELECT count(*) AS videos, CAST(sum(k) AS BIGINT) AS images, count_if(k >= 10)::BIGINT AS kept, count_if(k < 10)::BIGINT AS dropped, min(k) AS min_frames, max(k) AS max_frames, round(coalesce(avg(k), 0), 6) AS mean_frames FROM g")
def min_group_filter(t):
    return manifests.group_totals(t("orders"), "o_custkey", 10)


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n, count_if(o_orderstatus IN ('O', 'P'))::BIGINT AS ok, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def group_summary(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return manifests.status_totals(j, ["n_regionkey", "c_mktsegment"], F.col("o_orderstatus").isin("O", "P"), "o_totalprice")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t):
    return manifests.counts(t("events"), "event_type")


@query("SELECT (CASE WHEN l_returnflag = 'R' THEN 'F' ELSE 'R' END) || (CASE WHEN l_linestatus = 'O' THEN 'F' ELSE 'R' END) AS type, count(*) AS n FROM lineitem GROUP BY 1")
def type_counts(t):
    return manifests.counts(t("lineitem"), K.pair_type(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O").alias("type"))


_LABEL = "CASE o_orderstatus WHEN 'O' THEN ' Real ' WHEN 'F' THEN 'TRUE' ELSE '' END"


@query(f"WITH x AS (SELECT o_orderkey, lower(trim({_LABEL})) AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'realvideo-realaudio' ELSE 'fakevideo-realaudio' END AS o FROM orders) SELECT o_orderkey, CASE WHEN s IN ('real', '0', 'false') THEN 0 WHEN s IN ('fake', '1', 'true') THEN 1 WHEN o = 'realvideo-realaudio' THEN 0 ELSE 1 END AS label FROM x")
def label_parse(t):
    label = F.expr(_LABEL)
    return t("orders").select("o_orderkey", K.parse_label(label, F.when(F.col("o_orderkey") % 2 == 0, "realvideo-realaudio").otherwise("fakevideo-realaudio")).alias("label"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN true WHEN 'click' THEN true ELSE false END AS flag FROM events")
def to_bool(t):
    raw = F.when(F.col("event_type") == "error", " Yes ").when(F.col("event_type") == "click", "2").otherwise("no")
    return t("events").select("event_id", K.to_bool(raw).alias("flag"))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' WHEN p_size % 3 = 1 THEN p_brand END), ''), 'Unknown') AS race FROM part")
def default_fill(t):
    return t("part").select("p_partkey", K.filled(F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 3 == 1, F.col("p_brand")), "Unknown").alias("race"))


@query("SELECT c_custkey, regexp_extract(c_name, '^(.+)#([0-9]+)$', 1) AS metadata_id, CAST(regexp_extract(c_name, '^(.+)#([0-9]+)$', 2) AS BIGINT) AS frame_index FROM customer WHERE regexp_matches(c_name, '^(.+)#([0-9]+)$')")
def name_parse(t):
    name = F.translate(F.concat("c_name", F.lit(".png")), "#", "_")
    return t("customer").select("c_custkey", K.image_id(name).alias("id")).filter("id is not null").select("c_custkey", "id.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0_real/X_' || o_custkey WHEN 1 THEN '1_fake/' || o_custkey WHEN 2 THEN '0_real/' || o_custkey || '_pair_7' ELSE CAST(o_custkey AS VARCHAR) END AS video FROM orders""")
def video_key(t):
    c = F.col("o_custkey").cast("string")
    n = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("d/0_real/X_"), c, F.lit("/group_"), n, F.lit(".png"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("1_fake/"), c, F.lit("_seg0_"), n, F.lit(".png"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("0_real/"), c, F.lit("_pair_7_seg1_"), n, F.lit(".jpg"))).otherwise(F.concat(c, F.lit("_"), n, F.lit(".jpg")))
    return t("orders").select("o_orderkey", K.video_key(path).alias("video"))


@query("SELECT page_id, regexp_replace(replace(' \"' || url || '\"', '\"', ''), '//+', '/', 'g') AS x FROM pages".replace("AS x", "AS path").replace("' \"' || url || '\"'", "trim(' \"' || url || '\" ')"))
def path_normalize(t):
    return t("pages").select("page_id", K.normal_path(F.concat(F.lit(' "'), F.col("url"), F.lit('" '))).alias("path"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}._-]', '_', 'g') AS safe_name FROM part")
def sanitize(t):
    return t("part").select("p_partkey", K.sanitized(F.col("p_name")).alias("safe_name"))


@query("SELECT p_partkey, 'v_' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS renamed, 'conv1.' || p_brand AS key FROM part")
def legacy_rename(t):
    old = F.concat(F.lit("v_sf"), F.format_string("%03d", "p_size"))
    return t("part").select("p_partkey", K.without_suffix_mark(old).alias("renamed"), K.without_prefixes(F.concat(F.lit("module._orig_mod.conv1."), F.col("p_brand"))).alias("key"))


@query("SELECT s_suppkey, printf('S%04d', s_suppkey) AS sample_id, printf('frame_%06d', s_suppkey) AS frame_name FROM supplier")
def format_ids(t):
    return t("supplier").select("s_suppkey", F.format_string("S%04d", "s_suppkey").alias("sample_id"), F.format_string("frame_%06d", "s_suppkey").alias("frame_name"))


@query("""WITH f AS (SELECT o_custkey, min(struct_pack(d := o_orderdate, k := o_orderkey, p := o_totalprice)) AS f FROM orders GROUP BY 1)
SELECT o_orderkey, f.k AS pair_from, round(1 / greatest(o_totalprice, 1e-8) * f.p, 6) AS t0 FROM orders JOIN f USING (o_custkey)""")
def pair_join(t):
    o = t("orders")
    first = manifests.first_of(o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("pair_from"), F.col("o_totalprice").alias("real")), ["o_custkey"], ["o_orderdate", "pair_from"])
    return o.select("o_custkey", "o_orderkey", "o_totalprice").join(first, "o_custkey").select("o_orderkey", "pair_from", F.round(K.aligned_begin(F.lit(1.0), F.col("o_totalprice"), F.col("real")), 6).alias("t0"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name) AS rn FROM customer)
SELECT n_name, c_mktsegment, c_name, printf('S%04d', row_number() OVER (ORDER BY n_nationkey, c_mktsegment)) AS sample_id FROM m JOIN nation ON c_nationkey = n_nationkey WHERE rn = 1""")
def plan_join(t):
    rows = t("customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment", "c_name")
    plan = t("nation").select("n_nationkey", "n_name").join(rows.select("n_nationkey", "c_mktsegment").distinct(), "n_nationkey")
    return manifests.planned_samples(plan, rows, ["n_nationkey", "c_mktsegment"], ["n_nationkey", "c_mktsegment"], ["c_name"]).drop("n_nationkey")


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def first_per_group(t):
    return manifests.first_of(t("orders").select("o_custkey", F.col("o_orderkey").alias("first_order")), ["o_custkey"], ["first_order"])


@query("""WITH f AS (SELECT o_custkey, count(*) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), a AS (SELECT DISTINCT o_custkey FROM orders)
SELECT c_custkey, coalesce(k, 0) AS frames, CASE WHEN a.o_custkey IS NULL THEN 'missing_dir' WHEN k IS NULL THEN 'empty_dir' ELSE 'matched' END AS status FROM customer LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN f ON c_custkey = f.o_custkey""")
def manifest_outer(t):
    orders = t("orders").withColumn("c_custkey", F.col("o_custkey"))
    return manifests.against_directories(t("customer").select("c_custkey"), "c_custkey", orders, orders.filter("o_orderkey % 3 = 0"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_exists(t):
    return manifests.present(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_missing(t):
    return manifests.absent(t("customer").select("c_custkey"), t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def video_audio_inner(t):
    tracks = t("customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("s_suppkey"))
    return manifests.paired_tracks(t("supplier"), tracks, ["s_nationkey", "s_suppkey"]).select("s_suppkey", "c_custkey")


@query("""WITH c AS (SELECT s_suppkey, unnest([s_suppkey * 1000, s_suppkey * 7, s_suppkey]) AS cand, unnest([0, 1, 2]) AS pos FROM supplier)
SELECT s_suppkey, arg_min(cand, pos) AS chosen FROM c JOIN orders ON cand = o_orderkey GROUP BY 1""")
def resolve_candidates(t):
    c = t("supplier").select("s_suppkey", F.posexplode(F.array(F.col("s_suppkey") * 1000, F.col("s_suppkey") * 7, F.col("s_suppkey"))).alias("pos", "cand"))
    return c.join(t("orders"), F.col("cand") == F.col("o_orderkey")).groupBy("s_suppkey").agg(F.min_by("cand", "pos").alias("chosen"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(greatest(0, floor(l_discount * 250)), CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, CAST(least(greatest(ceil((l_discount + l_tax) * 250), 0), CAST(l_quantity AS BIGINT)) AS BIGINT) AS e FROM lineitem")
def frame_range(t):
    s, e = K.frame_range(F.col("l_discount"), F.col("l_discount") + F.col("l_tax"), F.lit(250.0), F.col("l_quantity").cast("long"))
    return t("lineitem").select("l_orderkey", "l_linenumber", s.alias("s"), e.alias("e"))


def _window_sql(variant: int) -> str:
    guard = {1: "n <= 5", 2: "n <= 0", 3: "n - 5 < 1", 4: "n - 4 < 1"}[variant]
    stop = {1: "n - 6", 2: "greatest(n - 6, 0)", 3: "n - 6", 4: "n - 5"}[variant]
    k = {1: "10", 2: "10", 3: "least(10, n - 5)", 4: "least(10, n - 4)"}[variant]
    each = f"unnest(list_transform(range(0, {k}), lambda i: CASE WHEN i = {k} - 1 AND {k} > 1 THEN {stop} ELSE CAST(floor(i * (CASE WHEN {k} > 1 THEN CAST({stop} AS DOUBLE) / ({k} - 1) ELSE CAST(0 AS DOUBLE) END)) AS BIGINT) END))"
    if variant == 2:
        each = f"unnest(CASE WHEN n <= 5 THEN list_transform(range(0, 10), lambda i: CAST(0 AS BIGINT)) ELSE {each[7:-1]} END)"
    return f"WITH x AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT o_custkey, {each} AS start FROM x WHERE NOT ({guard})) SELECT {'DISTINCT' if variant > 2 else ''} o_custkey, CAST(start AS BIGINT) AS start FROM w"


def _windowed(variant):
    def of(t):
        n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
        return n.select("o_custkey", F.explode(K.windows(variant, F.lit(0).cast("long"), F.col("n"), 5, 10)).alias("start"))

    of.__name__ = f"frame_windows_v{variant}"
    return of


for _v in (1, 2, 3, 4):
    query(_window_sql(_v))(_windowed(_v))


@query("SELECT o_orderkey, CAST(least(greatest(round_even(o_custkey * 500.0 / 1500, 0), 0), 499) AS BIGINT) AS b FROM orders".replace("500.0 / 1500", "CAST(500 AS DOUBLE) / 1500"))
def mel_map(t):
    return t("orders").select("o_orderkey", F.least(F.greatest(F.rint(F.col("o_custkey") * F.lit(500.0) / 1500), F.lit(0)), F.lit(499)).cast("long").alias("b"))


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM orders) SELECT o_orderstatus, o_orderkey FROM h WHERE rn <= 50")
def sample_seeded(t):
    w = Window.partitionBy("o_orderstatus").orderBy(K.seeded(F.col("o_orderkey"), 42), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 50").select("o_orderstatus", "o_orderkey")


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, c_custkey FROM h WHERE rn <= greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT))")
def sample_ratio(t):
    return selection.seeded_sample(t("customer"), "c_mktsegment", "c_custkey", 7, ratio=0.1).select("c_mktsegment", "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5('5|' || o_orderkey), o_orderkey LIMIT 100")
def shuffle_limit(t):
    return t("orders").orderBy(K.seeded(F.col("o_orderkey"), 5), "o_orderkey").limit(100).select("o_orderkey")


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) SELECT event_type, event_id FROM h WHERE rn <= 200")
def quota_unit(t):
    return manifests.top(t("events"), ["event_type"], ["ts", "event_id"], 200).select("event_type", "event_id")


_GREEDY = """WITH RECURSIVE t AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS BIGINT) % 1000 AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
g AS (SELECT o_custkey, o_orderkey, rn, cost <= 1500 AS taken, CASE WHEN cost <= 1500 THEN 1500 - cost ELSE 1500 END AS room FROM t WHERE rn = 1
 UNION ALL SELECT t.o_custkey, t.o_orderkey, t.rn, t.cost <= g.room AND g.room > 0, CASE WHEN t.cost <= g.room THEN g.room - t.cost ELSE g.room END FROM g JOIN t ON t.o_custkey = g.o_custkey AND t.rn = g.rn + 1)
SELECT o_custkey, o_orderkey, taken FROM g"""


def _tasks(t):
    return t("orders").select("o_custkey", "o_orderkey", (F.floor("o_totalprice") % 1000).alias("cost"))


@query(_GREEDY.replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"))
def budget_greedy(t):
    return budget.greedy(_tasks(t), ["o_custkey"], ["o_orderkey"], "cost", 1500).select("o_custkey", "o_orderkey", "taken")


_IDLE = """WITH RECURSIVE t AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS cost, o_orderstatus = 'F' AS fake, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
d AS (SELECT o_custkey, o_orderkey, 0 AS rn, false AS taken, 900 AS lf, 900 AS lr, 0 AS idle, false AS stopped FROM t WHERE rn = 1
 UNION ALL SELECT o_custkey, o_orderkey, rn, ok, CASE WHEN ok AND fake THEN lf - cost ELSE lf END, CASE WHEN ok AND NOT fake THEN lr - cost ELSE lr END, CASE WHEN ok AND cost > 0 THEN 0 ELSE idle + 1 END, stopped OR (room <= 0 AND idle + 1 >= 2)
 FROM (SELECT t.*, d.lf, d.lr, d.idle, d.stopped, CASE WHEN t.fake THEN d.lf ELSE d.lr END AS room, NOT d.stopped AND CASE WHEN t.fake THEN d.lf ELSE d.lr END > 0 AND t.cost <= CASE WHEN t.fake THEN d.lf ELSE d.lr END AS ok FROM d JOIN t ON t.o_custkey = d.o_custkey AND t.rn = d.rn + 1))
SELECT o_custkey, o_orderkey, taken FROM d WHERE rn > 0"""


@query(_IDLE.replace("% 1000 AS cost", "% 10 * 100 AS cost"))
def budget_idle_stop(t):
    tasks = t("orders").select("o_custkey", "o_orderkey", (F.floor("o_totalprice") % 10 * 100).alias("cost"), (F.col("o_orderstatus") == "F").alias("fake"))
    return budget.greedy(tasks, ["o_custkey"], ["o_orderkey"], "cost", 900, 2, "fake").select("o_custkey", "o_orderkey", "taken")


_TWO = """WITH RECURSIVE x AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS cost, CASE WHEN o_orderstatus = 'F' THEN 'fake' ELSE 'real' END AS kind, CAST(1 + (o_orderkey % 2) AS INT) AS phase FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY phase, o_orderkey) AS rn FROM x WHERE phase = 1 OR kind = 'real'),
g AS (SELECT o_custkey, kind, o_orderkey, phase, rn, cost <= 1500 AS taken, CASE WHEN cost <= 1500 THEN 1500 - cost ELSE 1500 END AS room FROM t WHERE rn = 1
 UNION ALL SELECT t.o_custkey, t.kind, t.o_orderkey, t.phase, t.rn, t.cost <= g.room AND g.room > 0, CASE WHEN t.cost <= g.room THEN g.room - t.cost ELSE g.room END FROM g JOIN t ON t.o_custkey = g.o_custkey AND t.kind = g.kind AND t.rn = g.rn + 1)
SELECT o_custkey, kind, o_orderkey, phase, taken FROM g"""


@query(_TWO)
def budget_two_phase(t):
    kind, phase = F.when(F.col("o_orderstatus") == "F", "fake").otherwise("real"), (1 + F.col("o_orderkey") % 2).cast("int")
    tasks = t("orders").select("o_custkey", "o_orderkey", (F.floor("o_totalprice") % 1000).alias("cost"), kind.alias("kind"), phase.alias("phase"))
    return budget.two_phase(tasks, ["o_custkey"], "kind", "phase", ["o_orderkey"], "cost", 1500).select("o_custkey", "kind", "o_orderkey", "phase", "taken")


@query("WITH h AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM h WHERE rn <= 3")
def retention_last3(t):
    return manifests.top(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("WITH n AS (SELECT quality, count(*) AS k FROM labels GROUP BY 1) SELECT doc_id, round(CAST(1 AS DOUBLE) / k, 6) AS weight FROM labels JOIN n USING (quality)")
def class_weights(t):
    return manifests.class_weights(t("labels"), "quality").select("doc_id", F.round("weight", 6).alias("weight"))


def _split(t, s):
    return t("orders").filter(F.col("o_orderstatus") == s).select("o_custkey")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def split_intersect(t):
    return manifests.shared(_split(t, "F"), _split(t, "O"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def split_only(t):
    return manifests.unshared(_split(t, "F"), [_split(t, "O"), _split(t, "P")])


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first(t):
    return manifests.first_of(t("documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query("SELECT k AS path, max(label) AS label FROM (SELECT s_nationkey AS k, 1 AS label FROM supplier UNION ALL SELECT c_nationkey, 0 FROM customer) GROUP BY 1")
def union_label(t):
    return manifests.labelled_union(t("customer").select(F.col("c_nationkey").alias("path")), t("supplier").select(F.col("s_nationkey").alias("path")), "path")


@query("SELECT page_id, url = 'https://' OR starts_with(url, 'https:/' || '/') AS allowed FROM pages")
def root_guard(t):
    root = "https:/"
    return t("pages").select("page_id", ((F.col("url") == root) | F.col("url").startswith(root + "/")).alias("allowed"))


@query("SELECT conv_id, count(DISTINCT turn) = max(turn) + 1 AND count(*) > 0 AS complete FROM conversations GROUP BY 1")
def completeness(t):
    return manifests.complete_sequences(t("conversations"), "conv_id", "turn")


@query("WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: exp(v)) AS e FROM embeddings) SELECT vec_id, round(e[2] / list_sum(e), 6) AS p FROM x")
def softmax(t):
    return t("embeddings").select("vec_id", F.round(V.softmax(F.col("embedding"), 1), 6).alias("p"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], qe) AS s FROM embeddings, q) SELECT vec_id, round(s, 6) AS similarity FROM x ORDER BY round(s, 6) DESC, vec_id LIMIT 20")
def cosine_topk(t):
    q = t("embeddings").filter("vec_id = 0").select(F.col("embedding").alias("qe"))  # one row
    s = t("embeddings").join(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("qe")), 6).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "vec_id").limit(20)


@query("WITH RECURSIVE t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), g AS (SELECT user_id, rn, value AS e FROM t WHERE rn = 1 UNION ALL SELECT t.user_id, t.rn, CAST(0.25 AS DOUBLE) * t.value + CAST(0.75 AS DOUBLE) * g.e FROM g JOIN t ON t.user_id = g.user_id AND t.rn = g.rn + 1), s AS (SELECT user_id, arg_max(e, rn) AS e FROM g GROUP BY 1) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(any_value(e), 6) AS ema FROM events JOIN s USING (user_id) GROUP BY 1")
def ema_meter(t):
    return budget.ema(t("events"), "user_id", ["ts", "event_id"], "value")


@query("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean FROM conversations")
def text_clean(t):
    return t("conversations").select("conv_id", "turn", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("clean"))


@query("SELECT unnest([n_name || '_' || r_name, r_name || '_' || n_name]) AS pair FROM nation JOIN region ON n_regionkey = r_regionkey")
def pair_expand(t):
    j = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    return j.select(F.explode(V.both_orders(F.col("n_name"), F.col("r_name"))).alias("pair"))


_TRACKS = "CASE WHEN l_tax < 0.04 THEN 'Real' WHEN l_tax < 0.07 THEN ' fake' END"


@query(f"""WITH x AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN ' RealVideo-FakeAudio ' WHEN l_returnflag = 'N' THEN 'other' END AS o, lower(trim({_TRACKS})) AS a, CASE l_linestatus WHEN 'O' THEN 'real' ELSE 'fake' END AS v FROM lineitem),
y AS (SELECT l_returnflag, CASE WHEN lower(trim(o)) = 'realvideo-fakeaudio' THEN 'Audio Fake' WHEN a = 'real' AND v = 'real' THEN 'Real' WHEN a = 'fake' AND v = 'real' THEN 'Audio Fake' WHEN a = 'real' AND v = 'fake' THEN 'Video Fake' WHEN a = 'fake' AND v = 'fake' THEN 'Audio + Video Fake' ELSE 'Unknown' END AS fake_type FROM x)
SELECT l_returnflag, fake_type, count(*) AS n FROM y GROUP BY ALL""")
def fake_type(t):
    original = F.when(F.col("l_returnflag") == "A", " RealVideo-FakeAudio ").when(F.col("l_returnflag") == "N", "other")
    kind = K.fake_type(original, F.expr(_TRACKS), F.when(F.col("l_linestatus") == "O", "real").otherwise("fake"))
    return t("lineitem").groupBy("l_returnflag", kind.alias("fake_type")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 40 AS s, o_orderkey % 40 + o_custkey % 15 AS e, 60 AS n FROM orders), y AS (SELECT *, 41 - (e - s) AS need FROM x),
z AS (SELECT *, greatest(0, s - need // 2) AS s1, least(n, e + need - need // 2) AS e1 FROM y), w AS (SELECT *, greatest(0, s1 - greatest(0, 41 - (e1 - s1))) AS s2 FROM z)
SELECT o_orderkey, CAST(s2 AS BIGINT) AS s, CAST(least(n, e1 + greatest(0, 41 - (e1 - s2))) AS BIGINT) AS e FROM w""")
def segment_expand(t):
    s = F.col("o_orderkey") % 40
    s, e = K.expand_segment(s, s + F.col("o_custkey") % 15, F.lit(60), 21, 2)
    return t("orders").select("o_orderkey", s.alias("s"), e.alias("e"))


@query("SELECT p_partkey, round(([p_size / CAST(255 AS DOUBLE)])[1] * 4 - 2, 6) AS c1, round((p_partkey % 256 / CAST(255 AS DOUBLE) - CAST(0.25 AS DOUBLE)) / CAST(0.5 AS DOUBLE), 6) AS c2 FROM part")
def channel_normalize(t):
    out = K.normalized(F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 256).cast("double")), [0.5, 0.25], [0.25, 0.5])
    return t("part").select("p_partkey", F.round(out[0], 6).alias("c1"), F.round(out[1], 6).alias("c2"))


@query(r"""WITH x AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 5 = 0 THEN '# note' WHEN o_orderkey % 5 = 1 THEN '  "sub/../c' || o_custkey || '.png"' || chr(9) || 'x' WHEN o_orderkey % 5 = 2 THEN 'Image_Path' WHEN o_orderkey % 5 = 3 THEN '/abs//c' || o_custkey || '.png' ELSE './c' || o_custkey || '.png' END AS line FROM orders),
y AS (SELECT line_no, CASE WHEN line LIKE '/abs%' THEN replace(line, '//', '/') ELSE '/base/' || regexp_extract(line, 'c\d+\.png') END AS path FROM x WHERE line NOT LIKE '#%' AND line <> 'Image_Path') SELECT min(line_no) AS line_no, path FROM y GROUP BY path""")
def path_list(t):
    k, name = F.col("o_orderkey") % 5, F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".png"))
    line = F.when(k == 0, "# note").when(k == 1, F.concat(F.lit('  "sub/../'), name, F.lit('"\tx'))).when(k == 2, "Image_Path").when(k == 3, F.concat(F.lit("/abs//"), name)).otherwise(F.concat(F.lit("./"), name))
    return files.parsed_paths(t("orders").select(F.col("o_orderkey").alias("line_no"), line.alias("line")), "/base")


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def tumbling_counts(t):
    """An extension: the batch form of the streaming operator."""
    out = events.tumbling_counts(t("events"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

"""More queries over the driver tables: selection of faces, segments, methods and samples, reports, rounding, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import text as T
from tessera.operators import metrics, selection
from tessera.plans.catalogue import _SAMPLES, _metric_sql, _samples, query

_FACES = "SELECT l_orderkey AS frame, l_linenumber AS face, l_partkey AS k, l_suppkey AS s, l_discount * 10 AS score, CAST(l_quantity AS BIGINT) % 7 AS w, 1 + l_partkey % 3 AS h FROM lineitem"


def _faces(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("face"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), (F.col("l_discount") * 10).alias("score"), (F.col("l_quantity").cast("long") % 7).alias("w"), (1 + F.col("l_partkey") % 3).alias("h"))
    return x.select("*", F.lit(0).alias("x1"), F.lit(0).alias("y1"))


@query(f"WITH d AS ({_FACES}) SELECT frame, CAST(arg_max(face, b) AS INT) AS face, max(w * h) AS area FROM (SELECT *, struct_pack(a := w * h, f := -face, k := -k, s := -s) AS b FROM d WHERE score >= 0.5) GROUP BY 1")
def largest_face(t):
    return selection.largest_detection(_faces(t), ["frame"], "score", ["x1", "y1", "w", "h"], ["face", "k", "s"]).select("frame", "face", "area")


@query(f"WITH d AS ({_FACES}) SELECT frame, count(*) AS n FROM d WHERE score >= 0.2 GROUP BY 1")
def faces_above_threshold(t):
    return _faces(t).filter("score >= 0.2").groupBy("frame").agg(F.count("*").alias("n"))


_KIND = "CASE l_returnflag WHEN 'R' THEN 'F' ELSE 'R' END || CASE l_linestatus WHEN 'O' THEN 'F' ELSE 'R' END"


def _kinds(t):
    return t("lineitem").select("l_suppkey", K.pair_type(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O").alias("kind"))


@query(f"WITH k AS (SELECT {_KIND} AS kind FROM lineitem) SELECT kind, CAST(kind IN ('FR', 'FF') AS INT) AS visual, CAST(kind IN ('RF', 'FF') AS INT) AS audio, CAST(kind <> 'RR' AS INT) AS any_forged, count(*) AS n FROM k GROUP BY ALL")
def binary_labels(t):
    return _kinds(t).groupBy("kind", *(K.binary_label(F.col("kind"), task).alias(a) for task, a in (("visual", "visual"), ("audio", "audio"), ("any", "any_forged")))).agg(F.count("*").alias("n"))


@query(f"WITH k AS (SELECT {_KIND} AS kind FROM lineitem) SELECT count_if(kind <> 'RF')::BIGINT AS kept, count_if(kind = 'RF')::BIGINT AS excluded FROM k")
def exclude_audio_only(t):
    return selection.without_audio_only(_kinds(t), "kind")[1]


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CASE WHEN o_custkey % 5 > 2 THEN 'FF' ELSE 'RR' END ELSE CASE WHEN o_orderkey % 4 = 2 THEN 'F' ELSE 'R' END || CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'R' END END AS kind FROM orders""")
def clip_type_fallback(t):
    four, none = F.col("o_orderkey") % 4, F.lit(None).cast("string")
    video = F.when(four < 2, none).when(four == 2, "yes").otherwise("0")
    return t("orders").select("o_orderkey", K.clip_type(video, F.when(four < 2, none).otherwise((F.col("o_orderstatus") == "F").cast("string")), F.col("o_custkey") % 5 - 2).alias("kind"))


@query("""WITH p AS (SELECT n_regionkey AS region, unnest(['BUILDING', 'MACHINERY', 'FURNITURE']) AS kind, n_nationkey AS nation FROM nation),
f AS (SELECT n_nationkey AS nation, c_mktsegment AS kind, min(c_custkey) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE CASE c_mktsegment WHEN 'BUILDING' THEN c_custkey % 50 = 1 WHEN 'MACHINERY' THEN c_custkey % 40 = 1 ELSE true END GROUP BY ALL)
SELECT nation, kind, id, CASE WHEN id IS NOT NULL THEN 'ok' WHEN kind = 'BUILDING' THEN 'skipped' ELSE 'error' END AS status FROM p LEFT JOIN f USING (nation, kind)""")
def methods_per_kind(t):
    plan = t("nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE")))).alias("kind"))
    method = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 50 == 1), "swap").when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") % 40 == 1), "gan").otherwise("none")
    rows = t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("id"), method.alias("method"))
    return selection.choose_methods(plan, rows, ["nation"], "kind", "method", {"BUILDING": ["swap"], "MACHINERY": ["gan"]}, ["BUILDING"], "id").select("nation", "kind", "id", "status")


@query("""WITH x AS (SELECT o_orderkey, unnest([0, 1, 2]) AS ordinal, unnest([[o_custkey % 7, o_custkey % 5 + 2], [3], [1, 9, 4]]) AS p FROM orders)
SELECT o_orderkey, CAST(ordinal AS INT) AS ordinal, CAST(p[1] AS DOUBLE) AS t0, CAST(p[2] AS DOUBLE) AS t1 FROM x WHERE len(p) >= 2 AND p[2] > p[1]""")
def valid_periods(t):
    s = lambda *xs: F.array(*(x.cast("string") for x in xs))
    periods = F.array(s(F.col("o_custkey") % 7, F.col("o_custkey") % 5 + 2), s(F.lit(3)), s(F.lit(1), F.lit(9), F.lit(4)), s(F.lit("x"), F.lit(1)))
    return selection.segments(t("orders").select("o_orderkey", periods.alias("p")), "o_orderkey", "p")


@query("WITH x AS (SELECT o_orderkey, unnest([0, 1]) AS ordinal, unnest([o_custkey % 7, 2]) AS t0, unnest([o_custkey % 5 + 3, 5]) AS t1 FROM orders) SELECT o_orderkey, CAST(ordinal AS INT) AS ordinal, CAST(t1 - t0 AS DOUBLE) AS duration FROM x WHERE t1 > t0 ORDER BY duration DESC, o_orderkey, ordinal LIMIT 500")
def longest_segments(t):
    s = lambda *xs: F.array(*(x.cast("double") for x in xs))
    found = selection.segments(t("orders").select("o_orderkey", F.array(s(F.col("o_custkey") % 7, F.col("o_custkey") % 5 + 3), s(F.lit(2), F.lit(5))).alias("p")), "o_orderkey", "p")
    return found.select("o_orderkey", "ordinal", (F.col("t1") - F.col("t0")).alias("duration")).orderBy(F.desc("duration"), "o_orderkey", "ordinal").limit(500)


@query("SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS group_size, count(*) OVER (PARTITION BY o_custkey) >= 10 AS kept FROM orders")
def flagged_groups(t):
    return selection.flag_groups(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 10)


@query("SELECT o_custkey, o_orderstatus, count(*) AS count, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS indexes FROM orders GROUP BY ALL")
def index_lists(t):
    return selection.index_lists(t("orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").withColumn("indexes", F.array_join(F.col("indexes").cast("array<string>"), ","))


@query("SELECT event_type AS label, count(DISTINCT user_id) AS folders, count(*) AS frames FROM events GROUP BY 1")
def label_totals(t):
    return selection.label_totals(t("events").withColumnRenamed("event_type", "label"), "label", "user_id")


@query("""WITH f AS (SELECT o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE l.k END AS there FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON k = o_orderkey WHERE o_orderkey % 3 > 0)
SELECT c_custkey, count(f.o_custkey) AS n_frames, count_if(f.o_custkey IS NOT NULL AND (there IS NULL OR there = -1))::BIGINT AS n_missing, count(f.o_custkey) > 0 AND count_if(f.o_custkey IS NOT NULL AND (there IS NULL OR there = -1)) = 0 AS complete FROM customer LEFT JOIN f ON c_custkey = f.o_custkey GROUP BY 1""")
def complete_samples(t):
    frames = t("orders").filter("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 50 == 0, -1).otherwise(F.col("o_orderkey")).alias("path"))
    return selection.complete(t("customer"), frames, t("lineitem").select(F.col("l_orderkey").alias("path")), "c_custkey", "path")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS index FROM orders WHERE o_orderstatus = 'F'")
def running_index(t):
    return selection.running_index(t("orders"), ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "index")


@query("""WITH s AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1), n AS (SELECT DISTINCT user_id, unnest(range(b, b + 2000)) AS event_id FROM (SELECT user_id, first + 1000 * k AS b FROM s, (VALUES (0), (1)) AS v(k)))
SELECT user_id, event_id FROM events JOIN n USING (user_id, event_id)""")
def needed_frames(t):
    starts = t("events").groupBy("user_id").agg(F.min("event_id").alias("first")).select("user_id", F.explode(F.array(F.col("first"), F.col("first") + 1000)).alias("start"))
    return selection.needed_frames(t("events"), "user_id", "event_id", starts, "start", 2000).select("user_id", "event_id")


def _positions(t):
    return t("events").select(F.col("event_id").alias("i"), F.col("value").alias("p")), t("orders").select(F.col("o_orderkey").alias("i"), F.col("o_orderpriority").alias("path")).filter("i % 4 > 0")


@query("SELECT event_id AS i, value AS p, coalesce(o_orderpriority, 'video_' || event_id) AS path FROM events LEFT JOIN (FROM orders WHERE o_orderkey % 4 > 0) ON event_id = o_orderkey")
def positional_placeholder(t):
    return selection.positional_join(*_positions(t), "i", "placeholder", F.concat(F.lit("video_"), F.col("i").cast("string")))


@query("SELECT o_orderkey AS i, o_totalprice AS p, o_orderpriority AS path FROM orders")
def positional_strict(t):
    """Scores and paths of as many positions: side by side. Of the tables of the other positional queries, which differ in length, it gives no row."""
    left, right = t("orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("p")), t("orders").select(F.col("o_orderkey").alias("i"), F.col("o_orderpriority").alias("path"))
    return selection.positional_join(left, right, "i").union(selection.positional_join(*_positions(t), "i"))


@query("SELECT event_id AS i, value AS p, o_orderpriority AS path FROM events JOIN orders ON event_id = o_orderkey WHERE o_orderkey % 4 > 0")
def positional_truncate(t):
    return selection.positional_join(*_positions(t), "i", "truncate")


@query("WITH l AS (SELECT lower(regexp_extract(url, '[^/]*$')) AS n, min(url) AS found FROM pages GROUP BY 1) SELECT page_id, upper(regexp_extract(url, '[^/]*$')) AS name, found FROM pages LEFT JOIN l ON lower(upper(regexp_extract(url, '[^/]*$'))) = n")
def find_by_basename(t):
    names = t("pages").select("page_id", F.upper(F.element_at(F.split("url", "/"), -1)).alias("name"))
    return selection.find_by_basename(names, "name", t("pages").select("url"), "url")


_TASKS = """WITH x AS (SELECT o_orderkey AS k, o_custkey % 23 - 2 AS room, CASE WHEN o_orderkey % 17 = 0 THEN 'soon' ELSE CAST(o_custkey % 9 AS VARCHAR) END AS t0, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_custkey % 9 + o_orderkey % 4 AS VARCHAR) END AS t1,
 o_orderkey % 13 > 0 AS there, o_orderkey % 11 = 0 AS done, o_orderkey % 7 > 0 AS opened, CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 5 END AS fps, o_custkey % 37 AS total, o_orderkey % 5 * 2 AS saved, o_orderkey % 3 > 0 AS written FROM orders),
p AS (SELECT *, TRY_CAST(t0 AS DOUBLE) * fps AS a, TRY_CAST(t1 AS DOUBLE) * fps AS b FROM x),
r AS (SELECT *, greatest(0, floor(a)) AS s, least(total, ceil(b)) AS e FROM p)"""


@query(f"""{_TASKS}, n AS (SELECT *, (CAST(e - s AS BIGINT) + 1) // 2 AS frames FROM r),
o AS (SELECT k, CASE WHEN room <= 0 THEN 'budget_exhausted' WHEN a IS NULL OR b IS NULL THEN 'invalid_period' WHEN NOT there THEN 'source_missing' WHEN done THEN 'skipped_existing' WHEN NOT opened THEN 'open_failed'
 WHEN fps <= 0 OR total <= 0 THEN 'invalid_video_info' WHEN e <= s THEN 'empty_segment' WHEN frames < 4 THEN 'segment_too_short_for_min_frames' WHEN frames > room THEN 'segment_exceeds_budget'
 WHEN saved < 4 THEN 'saved_frames_below_min' WHEN written THEN 'ok' ELSE 'json_write_failed' END AS status FROM n),
f AS (SELECT k, CASE WHEN room <= 0 THEN 'budget_exhausted' WHEN a IS NULL OR b IS NULL THEN 'invalid_period' WHEN NOT there THEN 'source_missing' WHEN done THEN 'skipped_existing' WHEN NOT opened THEN 'open_failed'
 WHEN fps <= 0 OR total <= 0 THEN 'invalid_video_info' WHEN e <= s THEN 'empty_segment' WHEN saved = 0 THEN 'no_valid_frames' WHEN written THEN 'ok' ELSE 'json_write_failed' END AS free FROM r)
SELECT status, free, CASE WHEN status = 'ok' THEN 'saved' WHEN status = 'skipped_existing' THEN 'existing' WHEN status IN ('budget_exhausted', 'segment_exceeds_budget') THEN 'over_budget' WHEN status IN ('segment_too_short_for_min_frames', 'saved_frames_below_min') THEN 'too_few_frames' ELSE 'failed' END AS family, count(*) AS n
FROM o JOIN f USING (k) GROUP BY ALL""")
def outcome_families(t):
    """Outcomes of tasks that must save four frames, and of the same tasks without a lower bound or a budget for the whole task."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    t0, t1 = F.when(key % 17 == 0, "soon").otherwise((cust % 9).cast("string")), F.when(key % 19 > 0, (cust % 9 + key % 4).cast("string"))
    seen = (cust % 23 - 2, t0, t1, key % 13 > 0, key % 11 == 0, key % 7 > 0, F.when(key % 29 == 0, 0.0).otherwise(5.0), cust % 37, key % 5 * 2, key % 3 > 0)
    tasks = t("orders").select(K.task_status(*seen, least=4, skip=2, expand=False).alias("status"), K.task_status(*seen, must_fit=False).alias("free"))
    return tasks.groupBy("status", "free", K.outcome_family(F.col("status")).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, CAST(printf('%.2f', x) AS DOUBLE) AS exact, round_even(x * 100, 0) / 100 AS product FROM (SELECT vec_id, (vec_id % 1000 * 5 + 5) / CAST(1000 AS DOUBLE) AS x FROM embeddings)")
def rounding(t):
    x = t("embeddings").select("vec_id", ((F.col("vec_id") % 1000 * 5 + 5) / F.lit(1000.0)).alias("x"))
    return x.select("vec_id", K.rounded_exactly(F.col("x")).alias("exact"), K.rounded_product(F.col("x")).alias("product"))


@query("SELECT o_orderkey, (o_custkey % 90 + 2) // 3 AS frames, CAST(o_orderkey % 100000 // 3600 AS BIGINT) AS hours, CAST(o_orderkey % 100000 % 3600 // 60 AS BIGINT) AS minutes, CAST(o_orderkey % 60 AS DOUBLE) AS seconds, strftime(o_orderdate + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS local FROM orders".replace("o_orderkey % 60 AS DOUBLE", "o_orderkey % 100000 % 60 AS DOUBLE"))
def clocks(t):
    c = K.clock(F.col("o_orderkey") % 100000)
    return t("orders").select("o_orderkey", K.frame_count(F.col("o_custkey") % 90, 3).alias("frames"), *(c[k].alias(k) for k in ("hours", "minutes", "seconds")), K.local_time(F.col("o_orderdate")).alias("local"))


@query("SELECT p_partkey, CAST(list_sum(range(p_size, p_size + 4)) AS BIGINT) AS total, p_size + 0.5 + 2 AS sum, p_partkey % 3 > 0 AS absolute FROM part".replace("p_size + 0.5 + 2", "CAST(p_size AS DOUBLE) + 2.5"))
def option_lists(t):
    n = F.col("p_size").cast("string")
    path = F.when(F.col("p_partkey") % 3 == 0, "x/y").when(F.col("p_partkey") % 3 == 1, "C:\\x").otherwise("/x")
    add = lambda a, zero: F.aggregate(a, zero, lambda s, x: s + x)
    spread = K.number_range(F.concat(n, F.lit(", "), (F.col("p_size") + 3).cast("string")))
    return t("part").select("p_partkey", add(F.transform(spread, lambda x: x.cast("long")), F.lit(0).cast("long")).alias("total"), add(K.number_list(F.concat(n, F.lit(", 2.5"))), F.lit(0.0)).alias("sum"), K.is_absolute(path).alias("absolute"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace('<b> & ' || text, '\\s+', ' ', 'g'))) AS clean FROM conversations")
def text_unescape(t):
    escaped = F.concat(F.lit("&amp;lt;b&amp;gt; &#38;amp; "), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&lt;")))
    return t("conversations").select("conv_id", "turn", T.cleaned(escaped).alias("clean"))


@query("SELECT o_orderkey, lower(o_orderpriority) AS p FROM orders ORDER BY lower(o_orderpriority), o_orderkey LIMIT 300")
def order_by_lower(t):
    return t("orders").select("o_orderkey", F.lower("o_orderpriority").alias("p")).orderBy("p", "o_orderkey").limit(300)


@query("""WITH f AS (SELECT 'real' AS kind, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3|' || o_orderkey), o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'fake', o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('4|' || o_orderkey), o_orderkey) FROM orders WHERE o_orderstatus = 'F') SELECT kind, o_orderkey FROM f WHERE rn <= 40""")
def sample_paired(t):
    o = t("orders").select(F.when(F.col("o_orderstatus") == "F", "fake").otherwise("real").alias("kind"), "o_orderpriority", "o_orderkey")
    return selection.paired_samples(o.filter("kind = 'real'"), o.filter("kind = 'fake'"), "o_orderpriority", "o_orderkey", 3, count=40).select("kind", "o_orderkey")


_ONE_CLASS = _SAMPLES.replace("SELECT doc_id, lang,", "SELECT doc_id, lang || source || doc_id % 9 AS g, lang,")


def _one_class(t):
    return _samples(t).withColumn("g", F.concat("lang", "source", (F.col("doc_id") % 9).cast("string")))


@query("SELECT g, auc, tp FROM (" + _metric_sql(_ONE_CLASS, "g").replace("ELSE 0 END, 6) AS auc", "END, 6) AS auc").replace("CAST(CASE WHEN two THEN tp ELSE 0 END AS BIGINT) AS tp FROM n", "CAST(CASE WHEN two THEN tp END AS BIGINT) AS tp FROM n") + ")")
def metrics_one_class_null(t):
    return metrics.binary_metrics(_one_class(t), ["g"], one_class="null").select("g", "auc", "tp")


@query(_ONE_CLASS + """, n AS (SELECT g, sum(y) AS pos, sum(1 - y) AS neg, count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y = 0) AS fp FROM x GROUP BY g HAVING min(y) = max(y))
SELECT g, CAST(0 AS DOUBLE) AS auc, CAST(0.5 AS DOUBLE) AS threshold, round((tp + neg - fp)::DOUBLE / (pos + neg), 6) AS acc, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM n""")
def metrics_one_class_half(t):
    one = _one_class(t).groupBy("g").agg(F.min("y").alias("a"), F.max("y").alias("b")).filter("a = b").select("g")
    return metrics.binary_metrics(_one_class(t).join(one, "g"), ["g"], one_class="half").select("g", "auc", "threshold", "acc", "tp", "fp")


@query("""WITH f AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS source FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderkey, source FROM orders JOIN f USING (o_custkey) WHERE o_orderstatus = 'F'""")
def pair_original(t):
    o = t("orders")
    real = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("file"), "o_orderdate", F.col("o_orderkey").alias("k"))
    found = selection.pair_with_original(o.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("original")), real, "original", "file", ["o_orderdate", "k"])
    return found.select("o_orderkey", F.col("source.k").alias("source"))


_PAIRS = "WITH p AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"{_PAIRS}, w AS (SELECT 'original' AS kind, unnest([a, b]) AS name FROM p UNION ALL SELECT 'method', unnest([a || '_' || b, b || '_' || a]) FROM p UNION ALL SELECT 'model', a || '_' || b FROM p) SELECT kind, name FROM w WHERE name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT b || '_' || a FROM p WHERE a > 'M')")
def pair_plan(t):
    pairs = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    there = t("nation").filter("n_nationkey < 5").select(F.col("n_name").alias("name")).union(pairs.filter("a > 'M'").select(F.concat_ws("_", "b", "a")))
    plan = lambda kind, **how: selection.pair_names(pairs, "a", "b", existing=there, **how).select(F.lit(kind).alias("kind"), "name")
    return plan("original", originals=True).union(plan("method")).union(plan("model", both_orders=False))


_DRAWN = "CAST('0x' || substr(md5('9|{0}|' || i), 1, 15) AS BIGINT)"


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('9|' || doc_id), doc_id) - 1 AS rank, count(*) OVER (PARTITION BY quality) AS size FROM labels),
c AS (SELECT quality, any_value(size) AS size, row_number() OVER (ORDER BY quality) - 1 AS number FROM r GROUP BY 1),
d AS (SELECT i AS draw, {_DRAWN.format('class')} % (SELECT count(*) FROM c) AS number, {_DRAWN.format('row')} AS u FROM range(2000) AS g(i))
SELECT draw, r.doc_id, r.quality FROM d JOIN c USING (number) JOIN r ON r.quality = c.quality AND r.rank = u % c.size""")
def balanced_draws(t):
    return selection.balanced_draws(t("labels").select("doc_id", "quality"), "quality", "doc_id", 2000, 9)

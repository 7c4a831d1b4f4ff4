import html
import html.entities
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import budget, manifests, metrics, selection
from tessera.plans import catalogue, large  # noqa: F401  the latter adds its queries to the first


def test_video_key_rules(spark):
    cases = {
        "0_real/2514_0.png": "0_real/2514", "0_real/X_RR/group_000.png": "0_real/X_RR", "1_fake/000173_seg0_0.png": "1_fake/000173",
        "0_real/000171_pair_000173_seg0_0.png": "0_real/000171_pair_000173", "1_FAKE/a_1.PNG": "1_FAKE/a", "x/y.png": "x/y.png", "a_1.png": "a", "0_real/1_fake/b_2.jpg": "1_fake/b",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", K.video_key(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in rows} == cases


def test_metrics_against_pairs(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 1), rng.randint(0, 9) / 10) for g in "ab" for _ in range(60)] + [("c", 1, 0.5)] * 3 + [("d", 1, 0.1), ("d", 0, 0.9)]
    got = {r.g: r for r in metrics.binary_metrics(spark.createDataFrame(rows, "g string, y int, p double"), ["g"]).collect()}
    for g in "ab":
        pos, neg = [p for k, y, p in rows if k == g and y], [p for k, y, p in rows if k == g and not y]
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
        assert math.isclose(got[g].auc, auc, abs_tol=1e-6)
        best = max((sum(a >= t for a in pos) * len(neg) - sum(b >= t for b in neg) * len(pos), t) for t in {*pos, *neg})
        assert got[g].threshold == best[1]
    assert (got["c"].auc, got["c"].threshold, got["c"].tp) == (0, 0, 0)
    assert got["d"].threshold == math.inf and got["d"].tp == 0 and got["d"].fn == 1


def test_metrics_of_any_scores(spark):
    """Logits of every size and sign, in one group and in many, null groups among them."""
    rng = random.Random(11)
    draw = [lambda: rng.gauss(0, 9), lambda: rng.gauss(0, 1e-9), lambda: rng.choice([-1e300, 0.0, -0.0, 1e300, math.inf, -math.inf]), lambda: rng.randint(-3, 3)]
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), float(rng.choice(draw)())) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    for by in ([], ["g"]):
        for r in metrics.binary_metrics(df, by).collect():
            own = [x for x in rows if not by or x[0] == r.g]
            pos, neg = [p for _, y, p in own if y], [p for _, y, p in own if not y]
            assert math.isclose(r.auc, sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg), abs_tol=1e-6)
            at = {t: (sum(a >= t for a in pos), sum(b >= t for b in neg)) for t in {*pos, *neg}}
            best = max((tp * len(neg) - fp * len(pos), t) for t, (tp, fp) in at.items())
            assert (r.tp, r.fp) == at[best[1]]
            steps = sorted(at, reverse=True)
            ap = sum((at[t][0] - (at[steps[k - 1]][0] if k else 0)) / len(pos) * at[t][0] / sum(at[t]) for k, t in enumerate(steps))
            assert math.isclose(r.ap, ap, abs_tol=1e-6)
    for bad in ((None, 1, math.nan), (None, 1, None), ("a", None, 0.5)):
        with pytest.raises(Exception, match="missing or no number"):
            metrics.binary_metrics(spark.createDataFrame([*rows, bad], df.schema), ["g"]).collect()
    assert metrics.binary_metrics(df.limit(0), ["g"]).collect() == metrics.binary_metrics(df.limit(0), []).collect() == []


def test_running_sums(spark):
    rng = random.Random(12)
    rows = [(g, k, rng.randint(0, 9)) for g in ("a", "b", None) for k in rng.sample(range(10**6), 500)]
    for parts in (1, 8):
        got = metrics.running_sums(spark.createDataFrame(rows, "g string, k int, n int").repartition(parts), ["g"], F.col("k"), {"n": "upto"}).collect()
        assert {(r.g, r.k): r.upto for r in got} == {(g, k): sum(c for h, j, c in rows if h == g and j <= k) for g, k, _ in rows}


def test_greedy_budget_skips(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice(["real", "fake"]), rng.choice([0, *range(1, 40)])) for g in range(5) for i in range(60)]
    tasks = spark.createDataFrame(rows, "g int, i int, kind string, cost int")
    for stop in (None, 3):
        got = {(r.g, r.i): r.taken for r in budget.greedy(tasks, ["g"], ["i"], "cost", 100, stop, "kind").collect()}
        for g in range(5):
            left, idle, stopped = {"real": 100, "fake": 100}, 0, False
            for k, i, kind, c in rows:
                if k == g:
                    spent = left[kind] <= 0
                    ok = not stopped and not spent and c <= left[kind]
                    left[kind] -= c if ok else 0
                    idle = 0 if ok and c > 0 else idle + 1
                    stopped |= stop is not None and spent and idle >= stop
                    assert got[g, i] == ok


def _scan(rows, budgets, stop):
    """(group, place, kind, phase, cost) rows in order, one after another."""
    left, idle, stopped, at, out = {}, 0, False, None, {}
    for g, i, kind, phase, c in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        if (g, phase) != at:
            left = left if at and at[0] == g else dict(budgets)
            at, idle, stopped = (g, phase), 0, False
        room = left.get(kind, 0)
        ok = not stopped and room > 0 and c is not None and 0 <= c <= room
        left[kind] = room - c if ok else room
        idle = 0 if ok and c > 0 else idle + 1
        stopped = stopped or (phase == 1 and stop is not None and room <= 0 and idle >= stop)
        out[g, i] = ok
    return out


@pytest.mark.parametrize(("stop", "spread"), [(4, 9), (25, 40), (None, 600)])
def test_blocks_of_a_large_group_decide_as_a_scan(spark, stop, spread):
    rng = random.Random(f"{stop} {spread}")
    cost = lambda: rng.choice([None, -1, 0, 0, rng.randint(0, 3), *(rng.randint(1, spread * k) for k in (1, 4, 9))])
    rows = [(g, i, rng.choice(["real", "real", "fake", "none"]), rng.choice([1, 1, 1, 2]), cost()) for g, n in enumerate((700, 35, 0, 400)) for i in range(n)]
    tasks = spark.createDataFrame(rows, "g int, i int, kind string, phase int, cost int")
    budgets = {"real": 1000, "fake": 777}
    want = _scan(rows, budgets, stop)
    for block in (1 << 16, 40):
        found = budget.greedy(tasks, ["g"], ["i"], "cost", budgets, stop, "kind", "phase", block)
        assert found.columns == [*tasks.columns, "taken"]
        assert {(r.g, r.i): r.taken for r in found.collect()} == want
    one = [("", r[0] * 1000 + r[1], "", 1, r[4]) for r in rows]
    got = budget.greedy(tasks.withColumn("at", F.expr("g * 1000 + i")), [], ["at"], "cost", 900, stop, block=64)
    assert {("", r.at): r.taken for r in got.collect()} == _scan(one, {"": 900}, stop)
    free = budget.greedy(tasks, ["g"], ["i"], "cost", {"real": None}, kind="kind", block=50).collect()
    assert all(r.taken == (r.kind == "real" and r.cost is not None and r.cost >= 0) for r in free)
    assert budget.greedy(tasks.limit(0), ["g"], ["i"], "cost", 10, stop).count() == 0


def test_rounding_of_both_kinds(spark):
    rng = random.Random(2)
    xs = [2.675, 0.125, 1.005, -2.675, 0.135, 2.5, 0.0, *(rng.randint(-10**6, 10**6) / 1000 for _ in range(3000)), *(rng.uniform(-1e6, 1e6) for _ in range(500))]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", K.rounded_exactly(F.col("x")).alias("e"), K.rounded_product(F.col("x")).alias("p"))
    for r in df.collect():
        assert r.e == round(r.x, 2) and r.p == float(np.round(r.x, 2))


def test_small_functions(spark):
    one = spark.range(1).select(
        K.number_range(F.lit("3, 6")).alias("a"), K.number_range(F.lit("7")).alias("b"), K.number_range(F.lit("5,4")).alias("c"), K.number_list(F.lit("0.5, 2")).alias("d"), K.clock(F.lit(7384.5)).alias("e"),
        K.local_time(F.lit("2024-12-31 20:00:00").cast("timestamp_ntz")).alias("f"), *(K.is_absolute(F.lit(x)).alias(f"p{i}") for i, x in enumerate(["C:/x", "c:\\x", "/x", "x/y", "C:x"])),
        K.clip_type(F.lit("yes"), F.lit(None)).alias("t1"), K.clip_type(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(2)).alias("t2"), K.clip_type(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("t3"),
    ).first()
    assert (one.a, one.b, one.c, one.d, tuple(one.e), one.f) == ([3, 4, 5, 6], [7], [], [0.5, 2.0], (2, 3, 4.5), "2025-01-01 04:00:00")
    assert [one[f"p{i}"] for i in range(5)] == [True, True, True, False, False] and (one.t1, one.t2, one.t3) == ("FR", "FF", "RR")


def test_positions_and_names(spark):
    left, right = (spark.createDataFrame([(i, f"{c}{i}") for i in range(n)], f"i int, {c} string") for c, n in (("a", 3), ("b", 2)))
    assert selection.positional_join(left, right, "i").collect() == [] and selection.positional_join(left.filter("i < 2"), right, "i").count() == 2
    assert selection.positional_join(left, right, "i", "truncate").count() == 2
    got = selection.positional_join(left, right, "i", "placeholder", F.concat(F.lit("video_"), F.col("i").cast("string"))).orderBy("i").collect()
    assert [r.b for r in got] == ["b0", "b1", "video_2"]
    found = selection.find_by_basename(spark.createDataFrame([("Ab",), ("zz",)], "n string"), "n", spark.createDataFrame([("q/aB",), ("d/AB",)], "p string"), "p").collect()
    assert {r.n: r.found for r in found} == {"Ab": "d/AB", "zz": None}


def test_samples_and_epochs(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    for count, ratio in ((70, None), (None, 0.05), (10_000, None)):
        got = selection.seeded_sample(rows, "g", "id", 9, count, ratio).groupBy("g").agg(F.collect_set("id").alias("s")).collect()
        import hashlib

        for r in got:
            order = sorted((i for i in range(5000) if i % 3 == r.g), key=lambda i: (hashlib.md5(f"9|{i}".encode()).hexdigest(), i))
            assert set(r.s) == set(order[: count or int(len(order) * ratio)])
    zeros = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "epoch int, auc double, ap double")
    assert selection.best_epoch(zeros, "epoch", ["auc", "ap"]).first()[0] is None
    more = zeros.union(spark.createDataFrame([(3, 0.5, 0.2), (4, 0.5, 0.2), (5, 0.5, 0.1)], zeros.schema))
    assert selection.best_epoch(more, "epoch", ["auc", "ap"]).first()[0] == 3


def test_one_class_policies(spark):
    rows = spark.createDataFrame([("a", 1, 0.7), ("a", 1, 0.2), ("b", 1, 0.9), ("b", 0, 0.1)], "g string, y int, p double")
    half = {r.g: r for r in metrics.binary_metrics(rows, ["g"], one_class="half").collect()}
    assert (half["a"].auc, half["a"].ap, half["a"].threshold, half["a"].tp, half["a"].fn, half["a"].acc, half["a"].best_f1) == (0, 0, 0.5, 1, 1, 0.5, 0.666667)
    null = {r.g: r for r in metrics.binary_metrics(rows, ["g"], one_class="null").collect()}
    assert null["a"].auc is None and null["a"].tp is None and null["b"] == half["b"]


def test_windows_are_linspace(spark):
    rows = spark.range(1, 60).select("id", *(K.windows(v, F.lit(0).cast("long"), F.col("id"), 5, 10).alias(f"v{v}") for v in (1, 2, 3, 4))).collect()
    for r in rows:
        n = r.id
        line = lambda stop, k: np.linspace(0, stop, k, dtype=np.int32).tolist()
        assert r.v1 == ([] if n <= 5 else line(n - 6, 10))
        assert r.v2 == ([0] * 10 if n <= 5 else line(max(n - 6, 0), 10))
        assert r.v3 == ([] if n - 5 < 1 else sorted(set(line(n - 6, min(10, n - 5)))))
        assert r.v4 == ([] if n - 4 < 1 else sorted(set(line(n - 5, min(10, n - 4)))))


def test_labels_and_paths(spark):
    rows = [(" Real ", None, 0), ("FAKE", None, 1), ("x", "RealVideo-RealAudio", 0), ("x", "other", 1), (None, " ", None)]
    got = spark.createDataFrame(rows, "l string, o string, e int").select(K.parse_label(F.col("l"), F.col("o")).alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)
    paths = [(' "C:\\a\\\\b//c" ', "C:/a/b/c"), (None, ""), ("'x'", "x")]
    assert all(r.g == r.e for r in spark.createDataFrame(paths, "p string, e string").select(K.normal_path(F.col("p")).alias("g"), "e").collect())


def test_pairs_and_draws(spark):
    fakes = spark.createDataFrame([("f1", "a"), ("f2", "b"), ("f3", None), ("f4", "zz")], "fake string, original string")
    reals = spark.createDataFrame([(0, "a", 1.0), (3, "a", 2.0), (1, "b", 3.0), (2, None, 4.0)], "i int, file string, d double")
    got = selection.pair_with_original(fakes, reals, "original", "file", ["i"]).collect()
    assert {r.fake: r.source.d for r in got} == {"f1": 2.0, "f2": 3.0}
    assert selection.pair_with_original(fakes, reals.limit(0), "original", "file", ["i"]).count() == 0

    pairs, there = spark.createDataFrame([("1", "2"), ("3", "4")], "a string, b string"), spark.createDataFrame([("1",), ("4_3",)], "name string")
    names = lambda **how: sorted(r.name for r in selection.pair_names(pairs, "a", "b", **how).collect())
    assert names() == ["1_2", "2_1", "3_4", "4_3"] and names(both_orders=False) == ["1_2", "3_4"] and names(originals=True) == ["1", "2", "3", "4"]
    assert names(existing=there) == ["1_2", "2_1", "3_4"] and names(originals=True, existing=there) == ["2", "3", "4"]

    rows = spark.createDataFrame([(i, "rare" if i < 20 else "common") for i in range(2000)] + [(9999, None)], "id int, y string")
    drawn = selection.balanced_draws(rows, "y", "id", 4000, 1).collect()
    assert sorted(r.draw for r in drawn) == list(range(4000)) and all((r.id < 20) == (r.y == "rare") for r in drawn)
    assert abs(sum(r.y == "rare" for r in drawn) - 2000) < 200 and len({r.id for r in drawn if r.y == "rare"}) == 20
    assert len({r.id for r in drawn if r.y == "common"}) > 1000
    assert selection.balanced_draws(rows.limit(0), "y", "id", 10, 1).count() == 0


def test_needed_frames_and_split_audit_edges(spark):
    rng = random.Random(4)
    frames = [(k, i) for k in ("a", "b", None) for i in range(-30, 90)]
    starts = [(rng.choice(["a", "b", "c", None]), rng.randint(-25, 80)) for _ in range(9)] + [("a", None)]
    f, s = spark.createDataFrame(frames + frames[:5], "k string, i int"), spark.createDataFrame(starts, "k string, s int")
    for length in (1, 4, 7):
        got = sorted((r.k, r.i) for r in selection.needed_frames(f, "k", "i", s, "s", length).collect())
        assert got == sorted((k, i) for k, i in frames + frames[:5] if k and any(k == x and b is not None and b <= i < b + length for x, b in starts))
    images = spark.createDataFrame([("one", "v_1.png"), ("one", "v_0.png"), ("one", "w_0.png"), ("two", "v_3.png"), ("two", "odd.png"), ("two", "x_1_2.png")], "split string, image_name string").select("split", "image_name", K.image_id(F.col("image_name")).alias("id")).select("split", "image_name", "id.*")
    two = {r.split: r for r in selection.split_summary(images, ["one", "two"]).collect()}
    assert two["one"].images_per_metadata == {"v": 2, "w": 1} and two["one"].frame_indices_per_metadata == {"v": [0, 1], "w": [0]} and two["one"].unique == ["w"]
    assert two["two"].skipped_files == ["odd.png"] and two["two"].unique == ["x_1"] and two["two"].shared_metadata_ids == ["v"] and two["two"].image_count == 2
    three = {r.split: r for r in selection.split_summary(images, ["one", "two", "none"]).collect()}
    assert three["none"].metadata_ids == [] and three["none"].image_count == 0 and three["one"].shared_metadata_ids == [] and three["one"].unique == ["w"]
    alone = selection.split_summary(images.filter("split = 'one'"), ["one"]).first()
    assert alone.unique == alone.shared_metadata_ids == []


def test_split_report_of_many_ids(spark, tmp_path):
    """The time of a split's report grows with its ids, not with their square (40,000 ids took minutes)."""
    orders = spark.range(80000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40000).alias("o_custkey"), F.when(F.col("id") == 3, "O").otherwise("F").alias("o_orderstatus"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    began = time.time()
    got = {r.split: r for r in catalogue.QUERIES["split_summary"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    places = {}
    for i in range(80000):
        if i % 50 and i != 3:
            places.setdefault(str(i % 40000), []).append(i)
    assert got["F"].listed == ",".join(f"{k}:{len(v)}:{' '.join(map(str, v))}" for k, v in sorted(places.items()))
    assert got["F"].skipped == 1600 and got["F"].unique_metadata_count == len(places) and got["O"].listed == "3:1:3" and got["O"].only_here == ""
    assert got["none"].listed == got["none"].only_here == "" and got["none"].skipped == 0
    images = spark.createDataFrame([("one", "v", 0, "v_0.png"), ("else", "w", 0, "w_0.png")], "split string, metadata_id string, frame_index long, image_name string")
    none = {r.split: r for r in selection.split_summary(images, ["one", "none"]).collect()}
    assert none.keys() == {"one", "none"} and none["none"].frame_indices_per_metadata == {} and none["none"].skipped_files == []


def test_vectors_and_manifests(spark):
    df = spark.createDataFrame([(1, [1000.0, 0.0], [3.0, 4.0]), (2, [0.0, 0.0], [0.0, 0.0]), (3, [], [])], "i int, a array<double>, b array<double>")
    got = {r.i: (r.s, r.c) for r in df.select("i", V.softmax(F.col("a"), 1).alias("s"), V.cosine(F.col("b"), F.array(F.lit(4.0), F.lit(3.0))).alias("c")).filter("i < 3").collect()}
    assert got[1][0] == 0 and math.isclose(got[1][1], 0.96) and got[2] == (0.5, None)
    rows = spark.createDataFrame([("x", k) for k in (5, 3, 9)] + [(None, 1)], "g string, k int")
    assert {(r.g, r.k) for r in manifests.first_of(rows, ["g"], ["k"]).collect()} == {("x", 3), (None, 1)}
    assert sorted((r.k, r.number) for r in manifests.numbered(rows, ["k"]).collect()) == [(1, 1), (3, 2), (5, 3), (9, 4)]
    assert manifests.group_totals(rows.limit(0), "g", 2).first().asDict() == {"videos": 0, "images": 0, "kept": 0, "dropped": 0, "min_frames": 0, "max_frames": 0, "mean_frames": 0.0}
    turns = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 0), ("c", 2), ("d", None)], "g string, t int")
    assert {r.g: r.complete for r in manifests.complete_sequences(turns, "g", "t").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_character_references(spark):
    rng = random.Random(13)
    parts = ["&", "amp", ";", "#", "x", "X", "41", "8364", "128", "x80", "0", "13", "55296", "1114112", "99999999999999999999", "1", "11", "65534", "lt", "notit", "notin", "not", "NotEqualTilde", "copy", "é", " ", "a", "&&", "&#", "&#x", "\n", "<", "&amp;amp;", "&lt", "&nosuchname;", "&fjlig;", "😀", "&Aacute", "f" * 40]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)), *(f"&#{n};" for n in range(300)), *(f"&#x{n:x}" for n in range(0xFDC8, 0xFDF8)), *(f"x&{k}y" for k in sorted(html.entities.html5)[::7])]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    for r in rows.select("i", "t", T.unescaped(F.col("t")).alias("u")).collect():
        assert r.u == (None if r.t is None else html.unescape(r.t)), repr(r.t)

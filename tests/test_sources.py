import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.sources import files, sinks
from tessera.streaming import events


def _touch(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("x" * (1 + len(n)))


def test_listings_and_plans(spark, tmp_path):
    _touch(tmp_path, "test/0_real/a_0.png", "test/0_real/b_1.PNG", "test/1_fake/c_0.jpeg", "test/1_fake/c.txt", "top.jpg", "sib/x.png")
    every = files.listing(spark, str(tmp_path))
    assert sorted(r.name for r in every.collect()) == ["a_0.png", "b_1.PNG", "c_0.jpeg", "top.jpg", "x.png"]
    assert files.listing(spark, str(tmp_path), any_case=False).count() == 4
    assert [r.name for r in files.listing(spark, str(tmp_path), recursive=False).collect()] == ["top.jpg"]
    assert {(r.name, r.label, r.split) for r in files.labelled(every).collect()} == {("a_0.png", 0, "test"), ("b_1.PNG", 0, "test"), ("c_0.jpeg", 1, "test"), ("top.jpg", None, None), ("x.png", None, None)}
    assert {r.label: r.n for r in files.counted(files.labelled(every), F.col("label")).collect()} == {0: 2, 1: 1, None: 2}
    root = f"{tmp_path}/test"
    there = every.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    asked = spark.createDataFrame([(f"{root}/0_real/a_0.png",), (f"{root}/0_real/a_0.png",), (f"{root}/no.png",), (f"{root}s/a.png",)], "path string")
    plan = sinks.removal_plan(asked, there, root)
    assert {r.action: r.n for r in sinks.action_counts(plan).collect()} == {"delete": 1, "missing": 1, "blocked": 1}
    assert (tmp_path / "test/0_real/a_0.png").exists()
    copies = sinks.copy_plan(spark.createDataFrame([("a",), ("zz",)], "id string"), there, F.regexp_extract("name", "^(.+)_", 1), "/out/")
    assert {(r.id, r.target) for r in copies.collect()} == {("a", "/out/a_0.png"), ("zz", None)}
    rows = spark.createDataFrame([(1, "/none", f"{root}/0_real/a_0.png"), (2, "/none", "/none")], "k int, one string, two string")
    assert {r.k: r.found for r in files.first_existing([F.col("one"), F.col("two")], rows, there, "k").collect()} == {1: f"{root}/0_real/a_0.png", 2: None}
    assert files.union_of([every, every]).count() == 5


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("\ufeffsource , path,status,\n a ,x.mp4, ok,dir \nb,y.mp4,error: z,\n".encode())
    table = files.table_csv(spark, str(tmp_path / "m.csv"), required=("source", "filename"))
    assert table.columns == ["source", "filename", "status", "folder"]
    assert [tuple(r) for r in files.with_status(table).collect()] == [("a", "x.mp4", "ok", "dir")]
    assert files.with_status(table.drop("status")).count() == files.with_status(table, ()).count() == 2
    with pytest.raises(ValueError, match="method"):
        files.table_csv(spark, str(tmp_path / "m.csv"), required=("method",))
    (tmp_path / "list.txt").write_text('# c\n\nimage_path\nx.png\tz\n "a/../x.png"\n/abs//y.png\n../../z.png\n')
    assert [tuple(r) for r in files.path_list(spark, str(tmp_path / "list.txt"), "/b/c").sort("line_no").collect()] == [(3, "/b/c/x.png"), (5, "/abs/y.png"), (6, "/z.png")]
    (tmp_path / "ids.txt").write_text(" 1 \n\n2\n")
    assert [r.id for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["1", "2"]
    (tmp_path / "r.json").write_text(json.dumps([{"file": "a", "n": 1}, {"file": "b"}], indent=1))
    assert [tuple(r) for r in files.records(spark, str(tmp_path / "r.json"), "file string, n int").collect()] == [("a", 1), ("b", None)]
    for name, text in (("a", '{"frames": [{"i": 1}]}'), ("b", '{"frames": []}'), ("c", "{broken"), ("d", "{}")):
        (tmp_path / "meta" / name).mkdir(parents=True)
        (tmp_path / "meta" / name / "metadata.json").write_text(text)
    assert files.frame_records(spark, str(tmp_path / "meta"), "frames array<struct<i int>>").count() == 1


def test_sinks(spark, tmp_path):
    clips = spark.createDataFrame([(1, "b", 0.5), (0, "z", 0.25), (1, "a", 1 / 3)], "label int, sample_name string, prob_fake double")
    sinks.write_clip_index(clips, f"{tmp_path}/index")
    lines = [x for p in sorted((tmp_path / "index").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("label")]
    assert [x.split("\t")[:2] for x in lines] == [["0", "z"], ["1", "a"], ["1", "b"]]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_clip_index(clips, f"{tmp_path}/index")
    sinks.write_predictions(clips, f"{tmp_path}/p")
    assert "0.33333333" in {r.prob_fake for r in files.table_csv(spark, f"{tmp_path}/p", sep="\t").collect()}
    sinks.write_lines(clips, "sample_name", f"{tmp_path}/l")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/l").collect()) == ["a", "b", "z"]
    sinks.write_summary(clips.agg(F.count("*").alias("n"), F.max(F.lit(None).cast("int")).alias("none")), f"{tmp_path}/s")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/s", multiLine=True).select("n", "none").collect()] == [(3, None)]


def test_stream_resumes_and_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = F.col("event_id") % 2
    table.filter(half == 0).write.parquet(f"{tmp_path}/in/a")
    schema = table.schema

    def take():
        stream = events.tumbling_counts(events.file_stream(spark, f"{tmp_path}/in/*", schema), late="0 seconds")
        q = events.take_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination(120)
        assert q.exception() is None

    raw = events.take_available(events.file_stream(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/raw", f"{tmp_path}/raw_state")
    raw.awaitTermination(120)
    table.filter(half == 1).write.parquet(f"{tmp_path}/in/b")
    raw = events.take_available(events.file_stream(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/raw", f"{tmp_path}/raw_state")
    raw.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/raw").count() == table.count()
    take()
    closed = spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{tmp_path}/out")
    batch = events.tumbling_counts(table)
    assert closed.exceptAll(batch).count() == 0
    assert closed.count() >= batch.filter(F.col("window_start") < batch.agg(F.max("window_start")).first()[0]).count() > 0


def test_expressions_against_python(spark):
    def widen(s, e, n, least, skip):
        span = (least - 1) * skip + 1
        if least <= 0 or e - s >= span:
            return s, e
        left = (span - (e - s)) // 2
        a, b = max(0, s - left), min(n, e + span - (e - s) - left)
        if b - a < span:
            a = max(0, a - (span - (b - a)))
        if b - a < span:
            b = min(n, b + span - (b - a))
        return a, b

    cases = [(s, e, n) for n in (0, 5, 30, 100) for s in range(0, n + 1, 7) for e in range(s, n + 1, 6)]
    df = spark.createDataFrame(cases, "s int, e int, n int")
    for least, skip in ((0, 2), (10, 2), (12, 1), (40, 3)):
        a, b = K.expand_segment(F.col("s"), F.col("e"), F.col("n"), least, skip)
        for r in df.select("*", a.alias("a"), b.alias("b")).collect():
            assert (r.a, r.b) == widen(r.s, r.e, r.n, least, skip), r
    kinds = {("realvideo-realaudio", "fake", "fake"): "Real", (None, " Fake", "REAL"): "Audio Fake", ("", "real", "fake"): "Video Fake", ("x", None, "fake"): "Unknown", ("x", "fake", "fake"): "Audio + Video Fake"}
    got = spark.createDataFrame(list(kinds), "o string, a string, v string").select("o", "a", "v", K.fake_type(F.col("o"), F.col("a"), F.col("v")).alias("k")).collect()
    assert {(r.o, r.a, r.v): r.k for r in got} == kinds

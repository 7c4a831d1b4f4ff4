"""Sources and effects that tasks carry out block by block, directory by directory or file by file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.sources import files, split, tree


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


SCHEMA = "file string, n int, note string, frames array<struct<i int, box array<double>>>, more map<string, string>"


def _record(rng, i):
    odd = ["a, b", '"', "\\", '\\",{', "[", "]}", "é, ü", "\n,\t", "x" * 900, ""]
    return {"file": f"clip {i}", "n": rng.randint(-5, 5), "note": rng.choice(odd) + rng.choice(odd), "frames": [{"i": k, "box": [k / 2, 1.5]} for k in range(rng.randint(0, 4))], "more": {rng.choice(odd) or "k": ", "}}


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_by_blocks(spark, tmp_path, small_blocks, indent):
    rng = random.Random(1)
    sizes = {"a": 300, "b": 1, "c": 0, "d": 40}
    for name, n in sizes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps([_record(rng, i) for i in range(n)], indent=indent, ensure_ascii=name == "d"), encoding="utf-8-sig" if name == "b" else "utf-8")
    raw = spark.read.option("lineSep", ",").text(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 20
    key = F.to_json(F.struct("*"))
    ours = sorted(r[0] for r in split.json_array(spark, str(tmp_path), SCHEMA).select(key).collect())
    theirs = sorted(r[0] for r in files.records(spark, str(tmp_path), SCHEMA).select(key).collect())
    assert ours == theirs and len(ours) == sum(sizes.values())


def test_json_that_is_no_array(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="no JSON array"):
        split.json_array(spark, f"{tmp_path}/x.json", "a int").collect()
    (tmp_path / "y.json").write_text(' [ 1 , {"a": 2}, null ] ')
    assert [r.a for r in split.json_array(spark, f"{tmp_path}/y.json", "a int").collect()] == [None, 2, None]


def test_lines_by_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    lists = {f"l{k}": ["x" * rng.randint(0, 300) + str(i) for i in range(rng.randint(0, 200))] for k in range(4)}
    for k, (name, lines) in enumerate(lists.items()):
        (tmp_path / name).write_bytes(("\r\n" if k % 2 else "\n").join(lines).encode())
    got = split.numbered_lines(spark, str(tmp_path)).select(F.element_at(F.split("file", "/"), -1).alias("f"), "line_no", "line").collect()
    assert sorted((r.f, r.line_no, r.line) for r in got) == sorted((f, i, x) for f, lines in lists.items() for i, x in enumerate(lines))
    (tmp_path / "paths.txt").write_text("\n".join(["# all", "path", *(f"d/../p{i % 50}.png\tz" for i in range(300))]))
    assert [(r.line_no, r.path) for r in files.path_list(spark, f"{tmp_path}/paths.txt", "/b").sort("line_no").collect()] == [(i + 2, f"/b/p{i}.png") for i in range(50)]


def test_walk_sees_every_name(spark, tmp_path):
    names = ["a.png", "_b.PNG", ".c.jpeg", "png", "d.png.txt", "x/_y/e.jpg", "x/.z/f.jpg", "x/g.mp4", "sp ace/h 1_2.png", "é/ü.png"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "loop").symlink_to(tmp_path / "x", target_is_directory=True)
    every = tree.walk(spark, str(tmp_path))
    assert sorted((r.path[len(str(tmp_path)) + 1 :], r.length) for r in every.collect()) == sorted((n, len(n.encode())) for n in names)
    assert sorted(r.name for r in tree.of_type(every, files.IMAGES, any_case=False).collect()) == sorted([".c.jpeg", "a.png", "png", "e.jpg", "f.jpg", "h 1_2.png", "ü.png"])
    assert sorted(r.name for r in tree.walk(spark, f"file://{tmp_path}", recursive=False).collect()) == sorted(n for n in names if "/" not in n)
    assert tree.walk(spark, f"{tmp_path}/none").count() == 0
    named = {r.image_name: (r.split, r.metadata_id, r.frame_index) for r in tree.named_images(every).collect()}
    assert named["h 1_2.png"] == ("sp ace", "h 1", 2) and named["a.png"][1:] == (None, None)


def test_metadata_names_every_broken_file(spark, tmp_path):
    cases = {"ok": b'{"fps": 5, "frames": [{"file_path": "a"}]}', "bom": b'\xef\xbb\xbf{"frames": [{"file_path": "a"}]}', "cut": b'{"frames": [', "array": b"[]", "none": b'{"frames": []}', "absent": b"{}", "latin": b'{"x": "\xe9"}', "empty": b"", "other": b'{"frames": "many"}'}
    for name, raw in cases.items():
        (tmp_path / "_s" / name).mkdir(parents=True)
        (tmp_path / "_s" / name / "metadata.json").write_bytes(raw)
    got = tree.metadata(spark, str(tmp_path), "fps int, frames array<struct<file_path string>>").collect()
    want = {"ok": "ok", "bom": "ok", "cut": "invalid", "array": "invalid", "none": "no_frames", "absent": "no_frames", "latin": "unreadable", "empty": "invalid", "other": "invalid"}
    assert sorted((r.sample, r.status) for r in got) == sorted(want.items())
    assert {r.sample: r.meta.frames[0].file_path for r in got if r.status == "ok"} == {"ok": "a", "bom": "a"}


def test_written_and_copied_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/in/{i}/f{i}.txt", "é" * i) for i in range(20)], "path string, content string")
    for _ in range(2):
        assert sorted(r.bytes for r in tree.write_each(rows).collect()) == [2 * i for i in range(20)]
    assert sum(1 for p in (tmp_path / "in").rglob("*") if p.is_file()) == 20
    plan = rows.select("path", F.regexp_replace("path", "/in/", "/out/").alias("target")).union(spark.createDataFrame([(f"{tmp_path}/no", f"{tmp_path}/out/no"), (None, "x")], "path string, target string"))
    counts = lambda df: {r.action: r["count"] for r in df.groupBy("action").count().collect()}
    assert counts(tree.copy_files(plan)) == {"copy": 20, "missing": 2} and not (tmp_path / "out").exists()
    assert counts(tree.copy_files(plan.union(plan), dry_run=False)) == {"copied": 20, "missing": 2}
    (tmp_path / "out/3/f3.txt").write_text("cut")
    assert counts(tree.copy_files(plan, dry_run=False)) == {"existing": 19, "copied": 1, "missing": 2}
    assert (tmp_path / "out/3/f3.txt").read_text() == "ééé" and sum(1 for p in (tmp_path / "out").rglob("*") if p.is_file()) == 20


def test_metadata_of_a_data_set(spark, tmp_path):
    (tmp_path / "SET").mkdir()
    (tmp_path / "SET/m.json").write_text("[]")
    where = lambda **how: files.resolve_metadata(spark, str(tmp_path), "m.json", **how)
    assert where() is None and where(below=("no", "SET")) == f"{tmp_path}/SET/m.json" and where(explicit=f"{tmp_path}/x.json", below=("SET",)) == f"{tmp_path}/SET/m.json"
    (tmp_path / "m.json").write_text("[]")
    assert where(below=("SET",)) == f"{tmp_path}/m.json" and where(explicit=f"{tmp_path}/SET/m.json") == f"{tmp_path}/SET/m.json"


def test_json_values(spark):
    cases = [('{"a": {"b": [1, 2]}, "s": "t"}', 2, "t"), ('{"a": {"b": [1]}}', -1, "d"), ('{"a": null, "s": null}', -1, None), ("{", -1, "d"), (None, -1, "d"), ('{"a": {"b": [1, "x"]}, "s": 5}', None, "5")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    v = J.parsed(F.col("t"))
    got = df.select("i", J.value(v, "$.a.b[1]", "int", -1).alias("b"), J.value(v, "$.s", "string", "d").alias("s"), J.broken(F.col("t")).alias("x")).sort("i").collect()
    assert [(r.b, r.s) for r in got] == [c[1:] for c in cases] and [r.x for r in got] == [False, False, False, True, False, False]

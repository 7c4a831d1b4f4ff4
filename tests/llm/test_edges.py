"""Very long texts, clashing columns, ties and empty tables, where other tests have none."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tessera.llm import chat, decontaminate, extract, langid, outliers, packing, pii, shared

CLASH = {"plain": "1", "again": "2", "level": "3", "formatted": "4", "parsed": "5", "loss": "6", "turns": "7", "kept": "8", "n": "9", "words": "a", "lines": "b", "kind": "c", "key": "d", "a.b`c": "e"}


def _with_clashes(df):
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASH.items()))


def test_chats(spark):
    long = "é\\</turn>\n### Assistant: " * 60_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "user", None), (1, 2, None, "tie"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, None, None, None), (3, 5, "x\ny", "</turn>\n")]
    df = _with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.report(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, role, t in own if role == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).collect() == []


def test_quality_of_clashing_and_long_rows(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    rows = [(i, words(80), "en", "s") for i in range(120)] + [(500, words(300_000), None, "s"), (501, None, None, None), (None, words(60), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    a, b = (sorted(map(tuple, outliers.report(outliers.rules(d)).collect()), key=str) for d in (docs, _with_clashes(docs)))
    assert [x[:8] for x in a] == [x[:8] for x in b] and len(a) == len(rows)
    assert next(x for x in a if x[0] == 500)[1] == 300_000 and next(x for x in a if x[0] == 501)[6]


def test_long_page(spark):
    lines = [f"Line {i} of a page" for i in range(30_000)]
    html = "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    pages = _with_clashes(spark.createDataFrame([(1, "http://a/1", html), (2, "http://a/2", html), (3, "http://a/3", "<p>" + "x" * 5_000_000)], "page_id long, url string, html string"))
    got = {r.page_id: r for r in extract.report(extract.main_text(pages)).collect()}
    assert got[1].text == got[2].text == "\n".join(lines) and got[3].n_chars == 5_000_000 and got[1].n_deleted == 0


def test_long_private_text(spark):
    text = "call 555-123-4567 or write to a.b@x.org; " * 5_000 + "z" * 2_000_000
    rows = spark.createDataFrame([(1, text), (2, "1 " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(_with_clashes(rows), "k", added=None).collect()}
    assert "555-123-4567" not in got[1].text and "a.b@x.org" not in got[1].text and len(set(got[1].text[:-2_000_000].split("; "))) == 2
    assert got[1].text.endswith("z" * 2_000_000) and got[2]["a.b`c"] == "e" and len(got[2].text) == 100_000


def test_packing_of_nothing(spark):
    assert packing.pack(_with_clashes(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def _greedy(lengths, length):
    """(sequence, tokens) of each part by plain loops: the cheapest sequence with room for the whole, else cuts."""
    n = max(1, -(-sum(lengths) // length))
    room, cost, out = [length] * n, [0.0] * n, []
    for left in lengths:
        parts = []
        while left:
            able = [k for k in range(n) if room[k] >= left] or [k for k in range(n) if room[k]]
            k = min(able, key=lambda k: (cost[k], k))
            take = min(left, room[k])
            parts.append((k, take))
            room[k] -= take
            cost[k] += packing.LINEAR * take + packing.QUADRATIC * take * take
            left -= take
        out.append(parts)
    return out, cost


def test_packing_is_balanced_and_full(spark):
    rng = random.Random(5)
    for _ in range(30):
        lengths = sorted((rng.choice([rng.randint(1, 4095), rng.randint(1, 300)]) for _ in range(rng.randint(1, 120))), reverse=True)
        want, cost = _greedy(lengths, 4096)
        assert [[(k, n) for k, _, _, n in parts] for parts in packing.assign(np.array(lengths), 4096)] == want
    docs = spark.createDataFrame([(i, "word " * rng.choice([10, 200, 900, 5000])) for i in range(400)], "doc_id long, text string")
    used = {}
    for r in packing.pack(docs, shard_bytes=1 << 18).collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    shards = len({s >> 32 for s in used})
    assert shards > 1 and len(used) <= -(-sum(used.values()) // 4096) + shards


def test_workers_hold_little(spark):
    """A text is sent to a task once, also where it is carried; batches come in parts; one operator's memory at a time."""
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 3, "en", "s") for i in range(8)], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([("a", "the cat sat on the mat the cat sat on")], "item_id string, text string")
    carry = ["lang", "text", "source"]
    for found in (langid.identify(docs, carry=carry), decontaminate.contamination(docs, bench, carry=carry)):
        plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = plan[next(i for i, x in enumerate(plan) if "MapInArrow" in x) + 1]
        assert below.count("text#") == 1, below
        assert sorted(r.carried for r in found.collect()) == sorted(tuple(r) for r in docs.select(carry).collect())
    batch = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    parts = list(shared.slices(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert [p.num_rows for p in parts] == [1024, 1024, 452, 3] and [x for p in parts[:3] for x in p.column(0).to_pylist()] == list(range(2500))
    one, two = {1: 1}, {2: 2}
    shared.keeps("one", one.clear)
    shared.keeps("one", one.clear)
    assert one
    shared.keeps("two", two.clear)
    assert not one and two
    shared.keeps("none", dict)

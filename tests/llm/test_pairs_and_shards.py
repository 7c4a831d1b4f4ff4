import base64
import hashlib
import io
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, extract, minhash, warc

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string"


def _alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 4096), (5, 80, 4096), (3, 85, 5)])
def test_minhash_against_all_pairs(spark, width, percent, block):
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words)
    texts = [base, base.upper(), base, None, "", " \t\n", "one", "one two", "ONE  two", "x y z", "y z x"]
    texts += [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in range(3, 390, 13)]
    texts += [" ".join(words[k:]) for k in range(0, 80, 7)] + [" ".join(f"u{(i * i + k) % 997}" for i in range(300)) for k in range(5)] + [base * 40]
    docs = spark.createDataFrame([(i + 10, t, None, None, 0, "x") for i, t in enumerate(texts)] + [(10, base, None, None, 0, "x"), (None, base, None, None, 0, "x")], DOCS)
    got = minhash.near_duplicates(docs, percent=percent, width=width, block=block).collect()
    assert len(got) == len(texts) + 2
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i + 10] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (10, False)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], r.doc_id == root[r.doc_id]), r
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_minhash_ids_of_text_none_and_twice(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([("k2", a, 1), ("k1", a, 2), ("k1", b, 3), (None, "only none", 4), (None, "only none", 5), ("k3", None, 6)], "doc_id string, text string, group int")
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("k2", 58, "k1", False), ("k1", 58, "k1", True), ("k1", 58, "k1", True), (None, 1, None, True), (None, 1, None, True), ("k3", 0, "k3", True)], key=str)


def test_decontamination_against_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    long = bench.filter("item_id = 1").first()["text"]
    more = [(9001, None), (9002, ""), (9003, "zz short ITEM zz"), (9004, f"a {long} b {long.upper()} " * 30), (9004, f"a {long}"), (None, long)]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    bench = bench.union(spark.createDataFrame([(777, "short item"), (778, ""), (779, None), (1, long), (10, long)], "item_id long, text string"))
    windows = defaultdict(set)
    for b in bench.collect():
        w = _alnum(b.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(b.item_id))
    expected = []
    for d in docs.collect():
        w, hit, items = _alnum(d.text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= own
        expected.append((d.doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    for block in (decontaminate.BLOCK, bench.agg(F.sum(F.length("text"))).first()[0] // 3):
        got = [tuple(r) for r in decontaminate.report(decontaminate.contamination(docs, bench, block=block)).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    clash = docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("spans", "items", "n_words", "uid", "row", "carried", "a.b`c")))
    carried = decontaminate.contamination(clash, bench, carry=["spans", "a.b`c"]).select("carried.*")
    assert carried.columns == ["spans", "a.b`c"] and carried.count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    none = decontaminate.report(decontaminate.contamination(docs, bench.limit(0))).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "same"), (5, "http://a/y", "same"), (3, None, None), (4, "u\r\nv", ""), (6, "http://b", "é" * 5000), (7, "http://c", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, kind int")
    got = {r.page_id: r for r in warc.report(warc.sound(warc.read_archives(warc.write_archives(pages, limit=200)))).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert len(got) == 6
    for i, _, h in rows:
        first = max(j for j, _, g in rows if (g or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((h or "").encode()), sha(h))
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_warc_headers_of_any_length(spark):
    rows = [(1, "http://a/" + "x" * 100_000, "page one"), (2, "http://b/" + "y" * 3_000_000, "p" * 2_000_000), (3, None, "page one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read_archives(warc.write_archives(pages, limit=1000))
    got = {r.page_id: (r.url, r.kind) for r in found.collect()}
    assert got == {"1": (rows[0][1], "revisit"), "2": (rows[1][1], "response"), "3": ("", "response")}
    assert warc.quarantine(found).count() == 0
    lines = b"WARC/1.1\r\nContent-Length: 3\r\n" * 20_000  # version lines without a header's end
    good = warc.record(9, "u", b"good")
    assert [x["kind"] for x in warc.salvage(lines + good)] == ["gap", "response"]
    assert [x["kind"] for x in warc.salvage(warc.member(lines + good))] == ["gap", "response"]


def test_warc_repeated_rows_and_ids_of_text(spark):
    rows = [("b c", "u", "same"), ("b c", "u", "same"), ("a", "u", "same"), (None, "u", "same"), (None, "v", "alone"), ("a", "u", "other")]
    found = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string")))
    got = [tuple(r) for r in warc.report(found, "string").select("page_id", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted([("b c", "response", None)] * 2 + [("a", "revisit", "b c"), (None, "revisit", "b c"), (None, "response", None), ("a", "response", None)], key=str)
    assert {r.payload for r in found.filter("kind = 'response'").collect()} == {b"same", b"alone", b"other"}
    assert warc.quarantine(found).count() == 0


def test_salvage_reader():
    one, two, three = (warc.record(i, "u", f"page {i}".encode() * 50) for i in (1, 2, 3))
    for pack in (warc.member, lambda x: x):
        a, b, c = pack(one), pack(two), pack(three)
        k = len(b) * 3 // 4
        bad = b[:k] + b"\x00\x01\x02" + b[k + 3 :]
        found = list(warc.salvage(a + bad + c))
        assert [x["page_id"] for x in found if x["kind"] != "gap"] == ["1", "3"]
        gaps = [(x["start"], x["end"]) for x in found if x["kind"] == "gap"]
        assert gaps == [(len(a), len(a) + len(bad))]
        assert [x["kind"] for x in warc.salvage(b"junk\n" + a + c[:40])] == ["gap", "response", "gap"]
    assert list(warc.salvage(b"")) == []


def test_salvage_inside_a_member():
    rng = random.Random(3)
    texts = [bytes(rng.randrange(32, 127) for _ in range(3000)) for _ in range(4)]
    one, two, three, four = (warc.record(i, "u", t) for i, t in enumerate(texts))
    bad = two.replace(texts[1][:10], b"X" * 10)
    found = list(warc.salvage(warc.member(one + bad + three)))
    assert [(x["kind"], x.get("page_id"), x["inner_start"], x["inner_end"]) for x in found] == [("response", "0", 0, len(one)), ("gap", None, len(one), len(one + bad)), ("response", "2", len(one + bad), len(one + bad + three))]
    whole = warc.member(one + two + three)
    cut = whole[: len(whole) * 9 // 10]
    found = list(warc.salvage(cut + warc.member(four)))
    assert [(x["kind"], x.get("page_id")) for x in found] == [("response", "0"), ("response", "1"), ("gap", None), ("response", "3")]
    assert (found[2]["start"], found[2]["end"], found[2]["inner_start"]) == (0, len(cut), len(one + two))
    flipped = whole[: len(whole) // 2] + bytes([whole[len(whole) // 2] ^ 255]) + whole[len(whole) // 2 + 1 :]
    found = list(warc.salvage(flipped + warc.member(four)))
    assert [x["page_id"] for x in found if x["kind"] != "gap"] in (["0", "3"], ["0", "1", "3"]) and sum(x["kind"] == "gap" for x in found) == 1
    plain = one + bad + three
    assert [x.get("page_id") for x in warc.salvage(plain)] == ["0", None, "2"]


def test_salvage_takes_time_in_proportion():
    def took(n):
        data = b"".join(warc.member(warc.record(i, "u", b"x%d" % i * 50)) for i in range(n)) + b"\x1f\x8b\x08 junk" * 50
        began = time.perf_counter()
        assert sum(x["kind"] == "response" for x in warc.salvage(data)) == n
        return time.perf_counter() - began

    took(500)
    assert took(8000) < 16 * took(2000)


def test_extraction(spark):
    nav = "<div>Home of things</div><div>All rights reserved here</div>"
    rows = [
        (1, "http://h/a/1", f"<html><body>{nav}<p>First  page &amp; text<br>more</p></body></html>"), (2, "http://h/a/2", f"<html><body>{nav}<p>Second page</p></body></html>"),
        (3, "http://h/a/3", "<body><nav>menu</nav><article><h1>T</h1><p>One<p class='ad'>buy</p><p>Released under the MIT License.<form>x</form></article><footer>f"),
        (4, "http://h/a/4", "<article><p>Released under the MIT License.</p><div class='comments'>hi</div><script>var t='</p>';</script></article>"),
        (5, None, None), (6, "::bad[", "<p>alone"), (7, "http://h/a/2", f"<html><body>{nav}<p>Second page</p></body></html>"),
    ]
    got = {r.page_id: r.text for r in extract.report(extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got[1] == "First page & text more"
    assert got[3] == "T\nOne\nReleased under the MIT License." and got[4] == "Released under the MIT License."
    assert got[5] == "" and got[6] == "alone" and "Second page" in got[2]


def test_extraction_against_all_neighbours(spark, sf_dir):
    rng = random.Random(7)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    top, end = [f"<div>Menu {i}</div>" for i in range(3)], [f"<p>All rights {i}</p>" for i in range(4)]
    for i in range(60):
        body = "".join(f"<p>Text {i} {k}</p>" for k in range(rng.randint(0, 4)))
        rows.append((10_000 + i, f"http://plain.org/{i % 4}/{rng.randint(0, 99)}/{i:02d}", "".join(top[: rng.randint(0, 3)]) + body + "".join(end[: rng.randint(0, 4)])))
    rows += [(20_000, "http://plain.org/a", None), (20_001, None, "<p>alone"), (20_002, None, ""), (20_003, "http://other.org/x", "<p>one</p><p>one</p>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, lines int, kept string")
    got = {r.page_id: r for r in extract.report(extract.main_text(pages)).collect()}
    shared = {r.page_id: (r.n_shared, r.n_deleted) for r in extract.alignment(pages).collect()}
    parsed = [(extract.url_key(u), i, *extract.blocks(h)) for i, u, h in rows]
    order = sorted((x for x in parsed if x[2]), key=lambda x: x[0])
    ties = {x[0] for x in order if sum(y[0] == x[0] for y in order) > 1}  # rows with one URL sort as they were read
    assert len(got) == len(rows)
    for at, ((host, path), i, lines, marked) in enumerate(order):
        sides = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order) and order[k][0][0] == host]
        if {(host, path), *(x[0] for x in sides)} & ties:
            continue
        best = max(sides, key=lambda x: extract._near(path, x[0][1]), default=None)
        common = extract.shared_lines(lines, best[2]) if best else []
        keep = lines if marked or len(common) == len(lines) else [x for k, x in enumerate(lines) if k not in common]
        assert (got[i].text, got[i].n_deleted) == ("\n".join(keep), len(lines) - len(keep)) and shared.get(i, (0, 0)) == (len(common), len(lines) - len(keep))
    assert sum(r.n_deleted > 0 for r in got.values()) > 20 and got[20_000].text == got[20_002].text == ""
    assert extract.main_text(pages.limit(0)).collect() == []


def test_articles_inside_skipped_elements():
    comments = '<div id="comments"><article class="comment"><p>Nice!</p></article><article><p>First</p></article></div><aside><article><h3>Read on</h3></article></aside>'
    assert extract.blocks(f"<body><div><p>Real text</p></div>{comments}<p>End</p></body>") == (["Real text", "End"], False)
    assert extract.blocks(f"<body><article><p>Real text</p>{comments}<p>End</p></article>{comments}</body>") == (["Real text", "End"], True)
    assert extract.blocks('<body><p>Real text</p><article class="comment"><p>Nice!</p></article></body>') == (["Real text"], False)
    assert extract.blocks("<body><div><aside>ad<article>teaser</article></div><article><p>Real text</p></article></body>") == (["Real text"], True)
    assert extract.blocks('<ul><li class="comment"><article>Hi</article><ul><li>reply</li></ul><li>Real item</ul>') == (["Real item"], False)
    assert extract.blocks('<form id="page"><nav>menu</nav><main><p>Real text</p></main></form>') == (["Real text"], True)


@pytest.mark.parametrize("cells", [extract.CELLS, 9])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(extract, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = extract.shared_lines(a, b)
        rest = iter(b)
        assert extract._lengths(a, b).tolist() == [r[-1] for r in best]
        assert len(at) == best[-1][-1] and at == sorted(set(at)) and all(a[i] in rest for i in at)


def test_long_pages_align_in_bounded_memory():
    a = [f"a{i}" if i % 3 else "same" for i in range(20_000)]
    b = [f"b{i}" if i % 2 else "same" for i in range(20_000)]
    at = extract.shared_lines(a, b)
    assert len(at) == sum(x == "same" for x in a) and all(a[i] == "same" for i in at)


def test_archives_are_read_by_windows():
    rng = random.Random(21)
    for trial in range(60):
        parts = []
        for i in range(rng.randint(0, 12)):
            one = b"".join(warc.record(f"{i}-{k}", "u", bytes(rng.choice(b"ab\nWARC/1.1") for _ in range(rng.choice([0, 5, 300, 3000])))) for k in range(rng.randint(1, 3)))
            packed = bytearray(warc.member(one) if trial % 3 else one)
            change = rng.random()
            if change < 0.2:
                packed[rng.randrange(len(packed))] ^= 1 << rng.randrange(8)
            elif change < 0.3:
                del packed[rng.randrange(len(packed)) :]
            elif change < 0.4:
                packed += rng.choice([b"junk\n" * 40, b"\x1f\x8b\x08", b"\nWARC/1.0\r\nx", b"\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nContent-Length: 99999\r\n\r\n"])
            parts.append(bytes(packed))
        data = b"".join(parts)
        want = list(warc.salvage(data))
        assert [0, *(x["end"] for x in want)][-1] == len(data)
        for window in (1, 70, 333, 5000, 1 << 20):
            stream = io.BytesIO(data)
            assert list(warc.salvage_stream(stream.read, window)) == want, (trial, window)

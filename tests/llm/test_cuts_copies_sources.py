"""Fill-in-middle, exact copies and source divergence, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import divergence, exactdup, fim

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = ["", None, "a", "\n", "\n\n", "é\nü", "x\n😀y\nz", "has <P> mark\nb", "<S>", "a\r\nb c\x85d", "KK ſ İ", "A\nA\n" * 5000, "ß" * 70000, "ab <\nP> <S\n>"]
SCHEMA = "doc_id long, text string, lang string, source string, n int, kept string, `a.b``c` int"


def _table(spark, more=()):
    rng = random.Random(8)
    rows = [(i, t, rng.choice(["en", None, "x"]), rng.choice(["s", "S", None, ""]), i, "k", 1) for i, t in enumerate(ODD)]
    rows += [(100 + i, "".join(rng.choice("aé\n<P>😀 ") for _ in range(rng.randint(0, 60))), "en", rng.choice("pqr"), 0, None, None) for i in range(300)]
    rows += [(None, "null id", None, None, None, None, None), (100, "again", "en", "p", 1, "k", 2), (100, "again", "en", "p", 1, "k", 2), *more]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_exceptions_convert_places():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab\né€😀") for _ in range(rng.randint(0, 40)))
        index = fim.Exceptions(np.frombuffer(text.encode(), np.uint8))
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in points])
        assert index.n_points == len(text) and len(index.points) == sum(ord(c) > 127 for c in text)
        assert (index.to_bytes(points) == places).all() and (index.to_points(places) == points).all()


@pytest.mark.parametrize(("unit", "rate", "spm", "marks"), [("line", 100, 50, fim.MARKS), ("char", 60, 30, fim.MARKS), ("line", 100, 100, ("[a]", "[b", "[c]"))])
def test_fim_against_python(spark, unit, rate, spm, marks):
    p, s, m = marks
    rows, df = _table(spark)
    got = fim.fill_in_middle(df, unit=unit, rate=rate, spm=spm, marks=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    assert set(got.columns) == {*df.columns, "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    want = []
    for doc_id, text, *_ in rows:
        t = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
        h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        one, two, three = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        if not t or any(x in t for x in marks) or h[2] % 100 >= rate:
            want.append((doc_id, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < spm:
            want.append((doc_id, len(units), "spm", len(one), len(two), s + three + p + one + m + two, t))
        else:
            want.append((doc_id, len(units), "psm", len(one), len(two), p + one + s + three + m + two, t))
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_fim_edges(spark):
    with pytest.raises(ValueError, match="overlap"):
        fim.fill_in_middle(spark.range(1), marks=("<a<", "<b>", "c"))
    _, df = _table(spark)
    assert fim.report(fim.fill_in_middle(df.limit(0))).collect() == []
    first = fim.fill_in_middle(df.select("doc_id", "text"), seed="8").select("output").collect()
    assert first != fim.fill_in_middle(df.select("doc_id", "text")).select("output").collect()


@pytest.mark.parametrize("most", [exactdup.MOST, 1])
def test_exact_copies_against_python(spark, most):
    rng = random.Random(4)
    copies = [(1000 + i, rng.choice(["Same TEXT", "same text", "İ", "i̇", None, "", f"one {i}"]), None, None, 5, "x", 7) for i in range(900)]
    rows, df = _table(spark, copies)
    got = exactdup.exact_copies(df, carry=["a.b`c", "kept"], most=most).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r)
    key = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    stay = Counter()
    for r in got:
        own = key[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((x[0] for x in own if x[0] is not None), default=None)
        assert any((x[0], x[6], x[5]) == (r.doc_id, r.carried["a.b`c"], r.carried.kept) for x in own)
        stay[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(stay) == set(key) and set(stay.values()) == {1}
    assert sorted(Counter((r.doc_id, r.text_sha256) for r in got).items(), key=str) == sorted(Counter((r[0], hashlib.sha256((r[1] or "").translate(LOW).encode()).hexdigest()) for r in rows).items(), key=str)
    assert exactdup.exact_copies(df.limit(0)).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and exactdup.exact_copies(df.limit(0)).collect() == []


def test_most_rows_pass_without_a_shuffle(spark):
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = df.select(exactdup.digest(F.col("text")).alias("text_sha256")).withColumn("slice", F.pmod(F.hash("text_sha256"), F.lit(64)))
    marked = exactdup._repeated(rows, 64)
    assert marked.count() == 64 and marked.filter(F.size("words") != 1024).count() == 0
    maybe = rows.join(marked, "slice")
    for p in exactdup._places(F.col("text_sha256")):
        maybe = maybe.filter(F.getbit(F.get("words", F.floor(p / 64).cast("int")), p % 64) == 1)
    assert 200 <= maybe.count() < 200 + 200_000 / 100


def _audit(rows, least, top):
    groups, terms = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        groups[lang or "", source or ""].update(w)
        terms[lang or ""].update(set(w))
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, n in terms[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        p = share(own)
        other = {s: share(c) for (x, s), c in groups.items() if x == lang and s != source}
        q = share(sum((c for (x, _), c in groups.items() if x == lang), Counter()))
        pair = sorted((-sum(f(p[t], o[t]) for t in kept), s.encode()) for s, o in other.items())
        term = sorted((-f(p[t], q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t])[:top]
        out |= {(lang, source, part, i.decode(), -v, k + 1) for part, x in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(x)}
    return out


@pytest.mark.parametrize(("least", "top", "postings", "pairs", "cut"), [(3, 200, 300_000, 1 << 19, 1 << 22), (1, 3, 5, 4, 7), (2, 10**6, 40, 50, 1)])
def test_audit_against_python(spark, monkeypatch, least, top, postings, pairs, cut):
    rng = random.Random(9)
    letters = ["a", "b", "É", "é", "Zz", "the", "The", "of", "x1y", "ß", "日本", "q"]
    more = [(5000 + i, " ".join(rng.choice(letters[: 3 + i % 10]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de"]), f"s{i % 7}", 0, "", 0) for i in range(400)]
    more += [(9000, "t" * 50 + " " + "1 " * 30, "one", "only", 0, "", 0), (9001, "unique words here", "none", "b", 0, "", 0), (9002, "", "none", "a", 0, "", 0)]
    rows, df = _table(spark, more)
    monkeypatch.setattr(divergence, "PAIRS", pairs)  # of this process; tasks have their own
    assert list(w for part in divergence._words("Ab c1dé ".encode() * 40) for w in part) == [b"ab", b"c", "dé".encode()] * 40
    monkeypatch.setattr(divergence, "SLICE", cut)
    assert list(w for part in divergence._words("Ab c1dé ".encode() * 40) for w in part) == [b"ab", b"c", "dé".encode()] * 40
    got = {tuple(r) for r in divergence.audit(df, least, top, postings).collect()}
    assert got == _audit(rows, least, top)


def test_corrections_in_small_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(lang, term, f"s{s}", rng.randint(1, 10**9), 1 + s) for term in "abcdef" for lang in ("l", "m") for s in range(9) if rng.random() < 0.6]
    table = pa.table(dict(zip(("lang", "term", "source", "p", "p0"), map(list, zip(*rows)))))
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] != b[2]:
                want[a[0], a[2], b[2]] += f(a[3], b[3]) - f(a[3], b[4]) - f(a[4], b[3]) + f(a[4], b[4])
    for pairs in (1, 20, 1 << 19):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        for step in (1, 7, 1000):
            got = Counter()
            for b in divergence._corrected(iter(table.to_batches(max_chunksize=step))):
                for lang, source, item, high, low in zip(*(c.to_pylist() for c in b.columns)):
                    got[lang, source, item] += (high << 32) + low
            assert got == want


def test_audit_of_nothing(spark):
    _, df = _table(spark)
    assert divergence.audit(df.limit(0)).collect() == []

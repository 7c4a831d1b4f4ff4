import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, langid, licenses, outliers, packing, pii

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = "the of and " * 3000
    more = [(9001, None, None, None, None), (9002, "", "", "s", 0), (9003, " \t\n\x0b a\n a\n\na", "en", None, 1), (9004, long, "en", "s", 1), (9004, long, "en", "s", 1), (None, "MIT  license, gnu GENERAL public\nlicense cc-by", None, "s", 2)]
    return d.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))


def test_statistics(docs):
    got = sorted((tuple(r)[:6] for r in outliers.report(outliers.rules(docs)).collect()), key=str)
    expected = []
    for d in docs.collect():
        s = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", s)
        c, marked, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                marked |= {i, i + 1, i + 2}
        for line in s.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        expected.append((d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), dup, len(marked)))
    assert got == sorted(expected, key=str)


def test_base_rule(docs):
    for r in outliers.rules(docs).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) and (r.distance2 is None) == r.base_failed


def _mcd(x, floors, rng):
    """Centre and covariance of the core with the least determinant, from many random starts and single rows' ranks."""
    h, best = int(np.ceil(outliers.CORE * len(x))), None
    for _ in range(200):
        own = rng.choice(len(x), 12, replace=False)
        for _ in range(40):
            c = np.cov(x[own].T, bias=True) + np.diag(np.array(floors) ** 2) * 1e-3
            z = x - x[own].mean(0)
            near = np.argsort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))[:h]
            if set(near) == set(own):
                break
            own = near
        det = np.linalg.slogdet(np.cov(x[own].T, bias=True))[1]
        if best is None or det < best[0]:
            best = det, own
    return x[best[1]].mean(0), np.cov(x[best[1]].T, bias=True)


def test_verdicts_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, (lang, source) in enumerate((("en", "a"), ("en", "b"), ("de", "a"))):
        for i in range(260):
            lines = []
            for _ in range(rng.integers(6, 30)):
                line = " ".join(w + ("#" * int(rng.integers(1, 4)) if rng.random() < 0.06 + 0.05 * k else "") for w in (f"w{rng.integers(0, 4000):0{4 + k}d}" for _ in range(rng.integers(6, 12))))
                lines += [line] * (2 if rng.random() < 0.08 else 1)
            if i % 13 == 0:
                lines = [" ".join(w + "#$%" * 6 for w in line.split()) for line in lines]
            rows.append((1000 * k + i, "\n".join(lines), lang, source))
    got = outliers.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("not base_failed").collect()
    floors, judged, gone = [x[1] for x in outliers.VECTOR.values()], 0, 0
    for group in {(r.lang, r.source) for r in got}:
        own = [r for r in got if (r.lang, r.source) == group]
        x = np.array([[np.log1p(r.n_words), np.log(max(r.word_chars, 1) / r.n_words), np.log1p(100 * r.n_symbols / r.n_words), np.log1p(r.n_dup_lines), np.log1p(100 * r.n_repeat_words / r.n_words)] for r in own])
        centre, cov = _mcd(x, floors, rng)
        z = x - centre
        wide = cov + np.diag(np.maximum(np.array(floors) ** 2 - np.diag(cov), 0))
        d2 = np.einsum("ij,jk,ik->i", z, np.linalg.inv(wide), z) / outliers.CONSISTENT
        d2 /= max(1.0, np.median(d2) / outliers.MIDDLE)
        for r, v in zip(own, d2):
            if not outliers.CUT / 2 < v < outliers.CUT * 2:
                assert r.kept == (v < outliers.CUT), (r.doc_id, v, r.distance2)
                judged, gone = judged + 1, gone + (not r.kept)
    assert judged > 600 and gone > 30


def test_outliers_go(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{rng.integers(0, 5000):04d}" for _ in range(rng.integers(80, 300))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{rng.integers(0, 5000):04d}%%%%" for _ in range(200)), "en", "s") for i in range(20)]
    got = {r.doc_id: r.kept for r in outliers.report(outliers.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))
    assert outliers.rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def _prose(rng, n, mark=""):
    return [f"w{rng.integers(0, 5000):04d}{mark}" for _ in range(n)]


def test_mild_junk_goes_and_tables_stay(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(_prose(rng, rng.integers(80, 300))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(_prose(rng, 150, "#")), "en", "s") for i in range(10)]
    rows += [(2000 + i, "\n".join([" ".join(_prose(rng, 200)), *["again"] * 51]), "en", "s") for i in range(10)]
    rows += [(3000 + i, "\n".join(" | ".join(_prose(rng, 10)) for _ in range(15)), "en", "s") for i in range(150)]
    rows += [(4000 + i, "\n".join(" | ".join(_prose(rng, 10, "#")) for _ in range(15)), "en", "s") for i in range(10)]
    got = {r.doc_id: r.kept for r in outliers.report(outliers.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert {k // 1000 for k, kept in got.items() if kept} == {0, 3} and {k // 1000 for k, kept in got.items() if not kept} == {1, 2, 4}


def test_rare_sources_are_judged_by_their_whole_language(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(_prose(rng, rng.integers(80, 300))), "en", f"big{i % 2}") for i in range(300)]
    rows += [(1000, " ".join(_prose(rng, 200, "%%%%")), "en", "rare"), (2000, " ".join(_prose(rng, 150)), "en", "small")]
    same = " ".join(_prose(rng, 200, "##"))
    rows += [(3000 + i, same, "en", f"odd{i}") for i in range(5)] + [(4000 + i, same, f"l{i}", "odd") for i in range(5)]
    got = {r.doc_id: r.kept for r in outliers.report(outliers.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert len(got) == len(rows) and {k for k, kept in got.items() if not kept} == {1000, *range(3000, 3005), *range(4000, 4005)}


def test_licenses(docs):
    got = sorted((tuple(r)[:6] for r in licenses.report(licenses.scan(docs)).collect()), key=str)
    expected = []
    for d in docs.collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (d.text or "").translate(LOW))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        expected.append((d.doc_id, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(expected, key=str)


def _votes(words):
    """Labels and best share by comparing every k-gram of a text with every one of each template."""
    found = {}
    listed = [*((t, x, True, 2) for t, x in licenses.PHRASES.items()), *((t, x, False, 2) for t, x in licenses.NOTICES.items()), *((t, x, False, 3) for x, t in licenses.TEXTS.items())]
    for text, label, base, k in listed:
        t = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
        grams = len(t) - k + 1
        diagonals = defaultdict(set)
        for i in range(len(words) - k + 1):
            for j in range(grams):
                if words[i : i + k] == t[j : j + k]:
                    diagonals[i - j].add(j)
        runs = []
        for d in sorted(diagonals):
            if runs and d - runs[-1][1] <= (0 if base else licenses.SHIFT):
                runs[-1] = runs[-1][0], d, runs[-1][2] | diagonals[d]
            else:
                runs.append((d, d, set(diagonals[d])))
        for lo, hi, places in runs:
            share = len(places) / grams
            if share == 1 if base else share >= licenses.LEAST and hi - lo <= grams:
                found[label] = max(share, found.get(label, 0))
    return ",".join(sorted(found)), max(found.values(), default=0.0)


def test_long_licence_texts(spark):
    rng = np.random.default_rng(5)
    long = _prose(rng, 700)
    worn = [w if rng.random() > 0.03 else "other" for w in long]
    rows = [(1, " ".join(_prose(rng, 50) + long)), (2, " ".join(worn[:350] + ["more"] + worn[350:])), (3, " ".join(long[:400])), (4, "mit license " + " ".join(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.report(licenses.scan(docs, {"own-1.0": " ".join(long)})).collect()}
    assert got[1] == ("own-1.0", 1.0) and got[2][0] == "own-1.0" and 0.85 <= got[2][1] < 1 and got[3] == ("", 0.0) and got[4] == ("mit,own-1.0", 1.0)


def test_license_texts_by_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for label, t in licenses.TEXTS.items():
        w = t.split()
        for change in range(9):
            x = list(w)
            for _ in range(change):
                at = int(rng.integers(0, len(x)))
                x[at : at + 1] = [[], ["other"], [x[at], "added"]][int(rng.integers(0, 3))]
            texts.append(" ".join(["some code", *x, "and more"]))
    texts += ["# Released under the CC BY-NC 4.0", "gnu general public license, version 3", "permission is hereby granted", "apache license mit license", ""]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id int, text string, own int, grams string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.report(licenses.scan(docs)).collect()}
    want = {i: _votes(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOW))) for i, t in enumerate(texts)}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and np.isclose(got[i][1], want[i][1]) for i in want), [(i, got[i], want[i]) for i in want if got[i] != want[i]][:3]
    assert sum(0 < s < 1 for _, s in got.values()) > 10 and licenses.scan(docs.limit(0)).collect() == []


def test_chat_round_trip(spark, sf_dir):
    odd = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-8, 1, "a\nb\\<", " </turn>\n### x:\n </turn>\n<\\/turn"), (-8, 0, "assistant", "</turn></turn><\\n\\"), (-9, 0, None, None), (-10, 3, "assistant", "x </turn"), (-10, 2, "assistant", "")]
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    by = defaultdict(list)
    for r in said.collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    formatted = chat.format_chats(said)
    for r in chat.report(formatted).collect():
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.select("formatted", "loss").collect():
        at = 0
        for x in r.loss:
            assert not x.masked or r.formatted[at : at + x.length] == x.text
            at += x.length
        assert at == len(r.formatted)


def test_language_held_out(docs):
    odd = docs.select(F.lit(8001).alias("doc_id"), F.lit("½ ² Ⅻ 12 _").alias("text"), "lang", "source", "n_chars").limit(1)
    clash = docs.union(odd).withColumn("score", F.lit(1)).withColumn("id", F.lit(2)).withColumn("a.b`c", F.lit(3))
    rows = langid.identify(clash, carry=["lang", "text", "score", "a.b`c"]).withColumn("out", langid.held_out()).collect()
    assert len(rows) == docs.count() + 1 and all((r.carried["score"], r.carried["a.b`c"]) == (1, 3) for r in rows)
    held = [r for r in rows if r.out and r.carried["lang"] and re.search(r"[^\W\d_]", r.carried["text"] or "")]
    assert len(held) > 20 and sum(r.carried["lang"] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if not r.carried["text"] or r.doc_id == 8001)
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, training=docs.limit(0)).collect()} == {"und"}


def test_words_keep_their_marks():
    assert langid.split_words("हिन्दी ½²Ⅻ Ünï-x2y") == ["▁हिन्दी", "▁ünï", "▁x", "▁y"]


def test_forward_sums_all_segmentations():
    vocab = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    probs = np.array([[0.3], [0.2], [0.25], [0.15], [0.1], [langid.UNKNOWN]])

    def total(w):
        return 1.0 if not w else sum(probs[vocab[w[:n]], 0] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in vocab)

    words = ["a", "ab", "aba", "ababa", "bbab"]
    lattice = langid.Lattice(words, vocab, 3)
    assert np.allclose(lattice.totals(probs)[:, 0], [total(w) for w in words])
    for w in [*words, "ab" * 100]:
        one = langid.log_total(w, vocab, 3, probs)[0]
        best = [1.0]
        for end in range(1, len(w) + 1):
            best.append(sum(probs[vocab[w[end - n : end]], 0] * best[end - n] for n in (1, 2, 3) if n <= end and w[end - n : end] in vocab))
        assert np.isclose(one, np.log(best[-1]))
    e = lattice.expected(probs, np.ones((len(words), 1)))
    assert np.isclose(sum(e[i, 0] * len(p) for p, i in vocab.items()), sum(map(len, words)))


def test_surrogates(spark):
    text = "Mrs. Anna Schmidt, Mrs Schmidt, Mr. Smith, Г-жа Иванова; 4111 1111 1111 1111 or 4111-1111-1111-1111, 1.2.3.4. 078-05-1120 +1 (743) 555-3824 a.b@x.org A.B@X.ORG ghp_abcdefghijklmnop1234 " + "0af9" * 10
    rows = [(1, text), (2, None), (3, ""), (4, "nothing 12 here"), (1, text), (5, "again 1.2.3.4, 1.2.3.5"), (6, "4111 1111 1111 1112 and 999.1.2.3")]
    got = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_entities", F.lit(7)), "a key").collect()
    assert len(got) == 7
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[6] == [rows[-1][1]] and sum(r.n_entities for r in got) == 2 * 13 + 2
    assert by[2] == [None] and by[3] == [""] and by[4] == ["nothing 12 here"] and by[1][0] == by[1][1]
    new = by[1][0]
    for private in ("Schmidt", "Anna", "Smith", "Иванова", "4111", "1.2.3.4", "078-05", "743", "a.b@x", "A.B@X", "abcdefgh", "0af90af9"):
        assert private not in new
    assert re.match(r"Mrs\. \w+na (\w+), Mrs \1, Mr\. ", new) and re.search(r"Г-жа \w+нова;", new)
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", new)
    assert re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1])
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub(r"\D", "", cards[0])))) % 10 == 0
    mails = re.findall(r"\S+@\S+", new)
    assert mails[0] == mails[1].lower() and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    first, second = re.findall(r"\d+\.\d+\.\d+\.\d+", by[5][0])
    assert first in new and first != second


def test_many_surnames(spark):
    letters = "bcdfghijklmnopqrtuwxyz"
    name = lambda i: "Q" + "".join(letters[i // 22**k % 22] for k in range(4))
    rows = [(k, "; ".join(f"Mr {name(i)}" + (f", Mr John {name(i)}, Mrs {name(i)}" if i % 20 == 0 else "") for i in range(k, 40000, 40))) for k in range(40)]
    surnames = {}
    for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "a key").collect():
        for i, part in zip(range(r.doc_id, 40000, 40), r.text.split("; ")):
            found = {x.split(" ")[-1] for x in part.split(", ")}
            assert len(found) == 1 and part.count(", ") == (2 if i % 20 == 0 else 0)
            surnames[i] = found.pop()
    assert len(surnames) == len(set(surnames.values())) == 40000 and not set(surnames.values()) & {name(i) for i in range(40000)}


def test_small_spaces_fill_up(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@x.org" for a in letters] + [f"{a}@{b}{c}.org" for a in "ab" for b in letters[:10] for c in letters[:10]]
    rows = [(i, f"write to {m} or {m.upper()}!", "o", 1, 2) for i, m in enumerate(mails)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string, found int, `a.b``c` int")
    got = pii.replace_entities(docs, "a key").orderBy("doc_id").collect()
    assert all((r.own, r.found, r["a.b`c"], r.n_entities, r.entity_kinds) == ("o", 1, 2, 2, ["email"]) for r in got)
    new = [re.fullmatch(r"write to (\S+) or (\S+)!", r.text).groups() for r in got]
    assert all(a.upper() == b for a, b in new) and len({a for a, _ in new} | set(mails)) == 2 * len(mails)
    domains = {}
    for old, (a, _) in zip(mails, new):
        assert domains.setdefault(old.split("@")[1], a.split("@")[1]) == a.split("@")[1]
    assert len(set(domains.values())) == len(domains) == 101
    other = pii.replace_entities(docs, "another key").orderBy("doc_id").collect()
    assert sum(a.text != b.text for a, b in zip(got, other)) > 200
    assert pii.replace_entities(docs.limit(0), "a key", added=None).columns == docs.columns
    assert pii.replace_entities(docs.limit(0), "a key").collect() == []


def test_packing(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(docs, shard_bytes=1 << 17).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    for d in docs.filter("doc_id <> 9004 or doc_id is null").collect():
        ids = model.encode(d.text or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by[d.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    parts = packing.assign(np.array([4096, 3000, 3000, 3000, 5]), 4096)
    assert sum(n for p in parts for *_, n in p) == 13101 and len({k for p in parts for k, *_ in p}) == 4

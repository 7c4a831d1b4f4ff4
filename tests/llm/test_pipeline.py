import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.llm import langid

STAGES = dict(corpus_pipeline.STAGES)
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASHING = ["score", "lang_pred", "n_words", "spans", "items", "carried", "n_entities", "group", "kept", "id", "key", "found", "a.b`c"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = d.filter("lang = 'en' and length(text) > 2000").orderBy("doc_id").first()["text"]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    words = text.split(" ")
    near = " ".join(["changed", *words[1:]])
    more = [(9001, None), (9002, ""), (9003, "12 ½ --"), (9004, text), (9005, near), (9006, "x " + item + " y"), (9007, f"mail jo.doe@some.org about 10.1.2.3, {text[:900]}"), (9007, f"mail jo.doe@some.org about 10.1.2.3, {text[:900]}"), (None, text[-1500:]), (None, text[-1500:]), (9008, text[200:1500]), (9008, text[1500:])]
    more = spark.createDataFrame([(i, t, None, "s", 7) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long").select(*d.columns)
    all_ = d.union(more)
    path = corpus_pipeline.saved(all_.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING))), "documents")
    return path


def _rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark, sf_dir, docs):
    out = [docs]
    for stage, function in corpus_pipeline.STAGES[:-1]:
        new = function(spark, out[-1], sf_dir)
        assert new.columns == docs.columns, stage
        out.append(corpus_pipeline.saved(new, stage))
        assert [tuple(r) for r in out[-1].select(*(f"`{c.replace('`', '``')}`" for c in CLASHING)).distinct().collect()] == [tuple(range(len(CLASHING)))]
    return out


def test_language_stage(chain):
    kept = chain[1].collect()
    found = {r.doc_id: r for r in langid.identify(chain[0]).collect()}
    assert all(found[r.doc_id].score >= 0.5 and found[r.doc_id].lang_pred == r.lang for r in kept)
    before, after = _rows(chain[0]), _rows(chain[1])
    assert all(n in (0, before[k]) for k, n in after.items()) and not {9001, 9002, 9003} & {i for i, _ in after}
    assert sum(after.values()) >= 0.97 * (sum(before.values()) - 3)


def test_near_duplicates_stage(chain):
    rows = list(_rows(chain[1]))
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    expected = Counter(min((d for d in g if d is not None), default=None) for g in groups.values())
    got = _rows(chain[2])
    assert Counter(d for (d, _), n in got.items() for _ in range(n)) == expected and set(got) <= set(rows)


def test_decontamination_stage(spark, sf_dir, chain):
    alnum = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = alnum(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [alnum(t)] for n in sizes for i in range(len(w) - n + 1))
    before = _rows(chain[2])
    assert _rows(chain[3]) == Counter({k: n for k, n in before.items() if not hit(k[1])}) and any(i == 9006 for i, _ in before)


def test_personal_data_stage(chain):
    before, after = ({r.doc_id: r for r in df.filter("doc_id is not null and doc_id <> 9008").collect()} for df in chain[3:5])
    assert before.keys() == after.keys() and chain[3].count() == chain[4].count()
    private = re.compile(r"\S+@\S+\.\w+|\d")
    for i, r in after.items():
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source)
        assert r.text == before[i].text or private.search(before[i].text)
    assert "jo.doe@some.org" in before[9007].text and "jo.doe" not in after[9007].text and "10.1.2.3" not in after[9007].text


def test_packing_stage_and_whole_run(spark, sf_dir, chain):
    packed = STAGES["packing"](spark, chain[4], sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in chain[4].collect())
    assert all(sum(p.length for p in packed if p.doc_id == r.doc_id) == r.doc_tokens for r in packed if r.doc_id not in (None, 9008))
    out = corpus_pipeline.run(spark, sf_dir)
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0.6 * plain.count() <= out.select("doc_id").distinct().count() <= plain.count()


def test_empty_tables(spark, sf_dir, docs):
    at = docs.limit(0)
    for _, function in corpus_pipeline.STAGES:
        at = corpus_pipeline.saved(function(spark, at, sf_dir), "none")
        assert at.count() == 0

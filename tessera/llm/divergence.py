"""Source divergence: term frequencies of sources by single-pass indexing, and how far each source is from its language's others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved

#: A-Z to a-z, other ASCII characters than letters to a space, everything beyond ASCII as it is.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
POSTINGS = 300_000  # postings (source and term) that a block holds before it is spilled as a sorted run
SLICE = 1 << 22  # bytes of a text that are split into words at a time
PAIRS = 1 << 19  # pairs of sources of terms that are corrected at a time
UNIT = 1_000_000_000  # what the shares of a group's terms add up to, about
LEAST, TOP = 3, 200  # documents of a kept term, ranks of top terms

_RUN = "lang string, source string, term string, n bigint, n_docs bigint"
_FREQUENCY = "lang string, term string, source string, n bigint, total bigint, first boolean"
_CORRECTION = "lang string, source string, item string, high bigint, low bigint"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time; a word that a slice cuts is left to the next."""
    rest = b""
    for at in range(0, len(text), SLICE):
        part = rest + text[at : at + SLICE].translate(TERMS)
        cut = part.rfind(b" ") + 1
        yield part[:cut].split()
        rest = part[cut:]
    yield rest.split()


def _blocks(postings: int):
    """Rows of texts to term-sorted runs: a block's postings are counted in memory and spilled once there are so many."""

    def run(block: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sorted(block.items()):
            terms = list(n)
            packed = pa.array(terms, pa.binary())
            order = pc.sort_indices(packed)
            counts = [np.fromiter(x, np.int64, len(terms))[order.to_numpy()] for x in (n.values(), map(docs.__getitem__, terms))]
            columns = [packed.take(order).cast(pa.string()), *map(pa.array, counts)]
            for k in range(0, len(terms), 50_000):
                term, n_, docs_ = (c.slice(k, 50_000) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(term)), pa.repeat(source, len(term)), term, n_, docs_], ["lang", "source", "term", "n", "n_docs"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, docs = block.setdefault((lang, source), (Counter({b"": 0}), Counter({b"": 0})))  # the empty term marks the group
                before, seen = len(n), set()
                for words in _words(text.as_py()):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                held += len(n) - before
                if held >= postings:
                    yield from run(block)
                    block, held = {}, 0
        yield from run(block)

    return of


def _steps(*columns: pa.Array) -> np.ndarray:
    """Where rows begin that differ from the row before in some column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _merged(least: int):
    """Rows sorted by term, language and source to one row a source and term, of terms that at least so many documents have."""

    def folded(parts: list[pa.RecordBatch]) -> list[pa.Array]:
        lang, source, term, n, docs = (pa.concat_arrays(c) for c in zip(*(b.columns for b in parts)))
        at = _steps(term, lang, source)
        return [lang.take(pa.array(at)), source.take(pa.array(at)), term.take(pa.array(at)), *(pa.array(np.add.reduceat(c.to_numpy(), at)) for c in (n, docs))]

    def kept(columns: list[pa.Array]) -> pa.RecordBatch:
        lang, source, term, n, docs = columns
        at = _steps(term, lang)
        size = np.diff(np.append(at, len(term)))
        total, of_docs = (np.repeat(np.add.reduceat(c.to_numpy(), at), size) for c in (n, docs))
        first = np.zeros(len(term), bool)
        first[at] = True
        out = pa.RecordBatch.from_arrays([lang, term, source, n, pa.array(total), pa.array(first)], ["lang", "term", "source", "n", "total", "first"])
        return out.filter(pa.array((of_docs >= least) | pc.equal(term, "").to_numpy(zero_copy_only=False)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = folded([*rest, batch])
            last = int(_steps(columns[2], columns[0])[-1])
            if last:
                yield kept([c.slice(0, last) for c in columns])
            rest = [pa.RecordBatch.from_arrays([c.slice(last) for c in columns], batch.schema.names)]
        if rest:
            yield kept(rest[0].columns)

    return of


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term and language (lang, term, source, p, p0) to sums over terms, a row a pair of sources that share one.

    For a term that both have, what the sums by source alone take for it is replaced by its own value. Sums are split
    at 32 bits, so that none can overflow, and handed on once a task holds very many pairs.
    """
    names: dict[tuple[str, str], int] = {}
    held: dict[str, np.ndarray] = {}

    def add(key: np.ndarray, value: np.ndarray) -> None:
        high, low = value >> 32, value & 0xFFFFFFFF
        if held:
            key, high, low = np.concatenate([held["key"], key]), np.concatenate([held["high"], high]), np.concatenate([held["low"], low])
        own, at = np.unique(key, return_inverse=True)
        sums = [np.zeros(len(own), np.int64) for _ in range(2)]
        np.add.at(sums[0], at, high)
        np.add.at(sums[1], at, low)
        held.update(key=own, high=sums[0] + (sums[1] >> 32), low=sums[1] & 0xFFFFFFFF)

    def handed() -> pa.RecordBatch:
        back = list(names)
        left, right = held["key"] >> 32, held["key"] & 0xFFFFFFFF
        out = [pa.array([back[k][0] for k in left.tolist()]), pa.array([back[k][1] for k in left.tolist()]), pa.array([back[k][1] for k in right.tolist()]), pa.array(held["high"]), pa.array(held["low"])]
        held.clear()
        return pa.RecordBatch.from_arrays(out, ["lang", "source", "item", "high", "low"])

    def corrections(source: np.ndarray, p: np.ndarray, p0: np.ndarray, size: np.ndarray, first: np.ndarray) -> None:
        """source, p and p0 of postings; a posting's term has size of them from first on."""
        ends, lo = np.cumsum(size), 0
        while lo < len(p):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            left = np.repeat(np.arange(lo, hi), size[lo:hi])
            right = first[left] + np.arange(len(left)) - np.repeat(ends[lo:hi] - size[lo:hi] - (ends[lo - 1] if lo else 0), size[lo:hi])
            left, right = left[left != right], right[left != right]
            f = lambda a, b: (a - b) * (a - b) // b
            value = f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right])
            add(source[left] << 32 | source[right], value)
            lo = hi

    def numbers(lang: pa.Array, source: pa.Array) -> np.ndarray:
        a, b = lang.dictionary_encode(), source.dictionary_encode()
        own, at = np.unique(a.indices.to_numpy() * np.int64(len(b.dictionary)) + b.indices.to_numpy(), return_inverse=True)
        pair = ((a.dictionary[k // len(b.dictionary)].as_py(), b.dictionary[k % len(b.dictionary)].as_py()) for k in own.tolist())
        return np.array([names.setdefault(x, len(names)) for x in pair], np.int64)[at]

    def flat(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        lang, term, source, p, p0 = columns
        first = _steps(term, lang)
        size = np.diff(np.append(first, len(term)))
        corrections(numbers(lang, source), p.to_numpy(), p0.to_numpy(), np.repeat(size, size), np.repeat(first, size))
        if held and len(held["key"]) > PAIRS:
            yield handed()

    rest: list[pa.Array] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = batch.columns if rest is None else [pa.concat_arrays(x) for x in zip(rest, batch.columns)]
        last = int(_steps(columns[1], columns[0])[-1])
        if last:
            yield from flat([c.slice(0, last) for c in columns])
        rest = [c.slice(last) for c in columns]
    if rest is not None:
        yield from flat(rest)
    if held:
        yield handed()


def _share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + v)), in whole numbers of any size."""
    return F.expr(f"cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast(nullif({total} + v, 0) as decimal(19,0)) + 1")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """Per source of a language: its distance to every other source (part "pair") and its top terms (part "term").

    Terms are runs of ASCII letters (A-Z lowered) and of characters beyond ASCII. A language keeps the V terms that at
    least so many of its documents have. A group gives a kept term the share p = 1 + floor(UNIT * (count + 1) / (N + V)),
    and f(p, q) = floor((p - q)^2 / q). pair: f against the other source, summed over all kept terms, 0 where V is 0.
    term: f against the whole language, of terms with p above its q, ranks to top. Ranks go by value, then by item.

    One pass over the texts counts a block of postings in memory and spills it as a term-sorted run; runs are dealt to
    shards by language and term, where Spark's external sorter merges them, and equal keys are folded as they stream by.
    A pair's sum is V times the value of absent terms, and one value for each distinct share of either source, as if the
    other lacked the term; a second stream over each shard corrects it for the terms that both have.
    A task holds one block, or one term's sources; a long text is split a slice at a time. Null text, lang and source
    count as empty. A group without terms has rows too, an empty table has none. Repeated rows count each; other columns
    of docs may have any names.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    runs = docs.select(plain("lang"), plain("source"), plain("text").cast("binary").alias("text")).mapInArrow(_blocks(postings), _RUN)
    shards = runs.repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    frequencies = saved(shards.mapInArrow(_merged(least), _FREQUENCY), "frequencies")
    kept = frequencies.filter("term <> ''")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = frequencies.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("own_n"), zero("lang_n"), zero("v"))
    groups = saved(groups.withColumn("p0", _share("0", "own_n")), "groups")

    held = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "own_n"))
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = held.select("lang", "source", F.col("term").alias("item"), "p", _share("total", "lang_n").alias("q")).filter("p > q").withColumn("value", _distance("p", "q"))
    terms = terms.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    whole = lambda c: c.cast("decimal(38,0)").alias("s")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    levels = saved(held.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k")), "levels")
    level = levels.join(other, "lang").filter("source <> item")
    times = F.col("k").cast("decimal(18,0)")
    there = level.select("lang", "source", "item", whole((_distance("p", "q0") - _distance("p0", "q0")).cast("decimal(19,0)") * times))
    back = level.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), whole((_distance("q0", "p") - _distance("q0", "p0")).cast("decimal(19,0)") * times))
    absent = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", whole(F.coalesce(F.col("v").cast("decimal(18,0)") * _distance("p0", "q0").cast("decimal(19,0)"), F.lit(0))))
    shared = held.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("term", "lang").mapInArrow(_corrected, _CORRECTION)
    shared = shared.select("lang", "source", "item", whole(F.col("high").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")))
    sums = absent.union(there).union(back).union(shared).groupBy("lang", "source", "item").agg(F.sum("s").cast("long").alias("value"))
    pairs = sums.withColumn("rank", F.row_number().over(by_group)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.union(terms)

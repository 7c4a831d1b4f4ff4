"""Benchmark decontamination: every shard of training texts is indexed, and all test phrases are searched in its index."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.fmindex import FMIndex
from tessera.llm.shared import LOWER_ALNUM, keeps, name, saved, sent_once, slices

WINDOW = 10
SHARD = 1 << 19  # words that one index holds (one longer text is a shard of its own)
BLOCK = 4 << 20  # characters of test items searched at once: what the driver and a task hold of them

_FOUND = "n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER_ALNUM).split()


class _Phrases:
    """Test phrases by length, as rows of word numbers, and the items of each: arrays, and a number a word."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.names = sorted({item for item, _ in items})
        number, self.vocab = {x: i for i, x in enumerate(self.names)}, {}
        by: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in _words(text)], np.int32)
            if len(ids):
                rows = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                by[rows.shape[1]][0].append(rows)
                by[rows.shape[1]][1].append(np.full(len(rows), number[item], np.int32))
        self.lengths = {}
        for n, (rows, owners) in sorted(by.items()):
            rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], 1), axis=0)
            self.lengths[n] = rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1].astype(np.int32)
        self.least = min(by, default=0)


_built: dict[int, _Phrases] = {}


def _phrases(held, window: int) -> _Phrases:
    """Those of a broadcast block, built once a worker; an earlier block's are given up."""
    if held.id not in _built:
        _built.clear()
        _built[held.id] = _Phrases(held.items.value, window)
    return _built[held.id]


class _Held(NamedTuple):
    id: str
    items: object


def _scanner(held, window: int, all_rows: bool, rest: int = 1):
    def shard(texts: list, phrases: _Phrases) -> tuple[np.ndarray, list, list]:
        counts, parts, docs, places = np.zeros(len(texts), np.int64), [], [], []
        for d, text in enumerate(texts):
            words = _words(text)
            counts[d] = n = len(words)
            if not n or not phrases.least:
                continue
            ids = np.fromiter(map(phrases.vocab.get, words, repeat(0)), np.int64, n)
            edge = np.flatnonzero(np.diff((ids > 0).astype(np.int8), prepend=0, append=0))
            starts, ends = edge[::2], edge[1::2]
            long = ends - starts >= phrases.least
            if not long.any():
                continue
            mark = np.zeros(n + 2, np.int64)
            mark[starts[long]] += 1
            mark[ends[long] + 1] -= 1  # with the place after it, a 0
            at = np.flatnonzero(np.cumsum(mark)[: n + 1])
            parts.append(np.append(ids, 0)[at])
            docs.append(np.full(len(at), d))
            places.append(at)
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        if not parts:
            return counts, spans, items
        s, doc, place = np.concatenate(parts), np.concatenate(docs), np.concatenate(places)
        index, cover = FMIndex(s), np.zeros(len(s) + 1, np.int64)
        for n, (rows, firsts, owners) in phrases.lengths.items():
            which, where = index.search(rows)
            np.add.at(cover, where, 1)
            np.add.at(cover, where + n, -1)
            pairs = np.unique(np.stack([doc[where], which], 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
            for d, p in pairs.tolist():
                items[d].update(phrases.names[k] for k in owners[firsts[p] : firsts[p + 1]])
        edge = np.flatnonzero(np.diff((np.cumsum(cover[:-1]) > 0).astype(np.int8), prepend=0, append=0))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            spans[doc[a]].append((int(place[a]), int(place[b - 1]) + 1))
        return counts, spans, items

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("decontamination", lambda: None)
        phrases = _phrases(held, window)
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            texts, lo = batch.column(0).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= 6 * SHARD):
                    size += len(texts[hi] or "")
                    hi += 1
                counts, spans, items = shard(texts[lo:hi], phrases)
                spans = [[{"first": a, "end": b} for a, b in x] for x in spans]
                out = pa.RecordBatch.from_arrays([pa.array(counts), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *(c.slice(lo, hi - lo) for c in batch.columns[rest:])], ["n_words", "spans", "items", *batch.schema.names[rest:]])
                yield out if all_rows else out.filter(pa.array([bool(x) for x in items]))
                lo = hi

    return of


def _joined(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap merged."""
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    start = F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)")
    return F.aggregate(F.array_sort(spans), start, lambda acc, x: F.when((F.size(acc) > 0) & (x["first"] <= last(acc)["end"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (merged, in words, the end exclusive), items whose windows occur, and a struct "carried" of the columns in carry.

    Words are runs of ASCII letters and digits (A-Z lowered) and of everything beyond ASCII. Only runs of words that
    the items know are indexed, which loses no occurrence. Texts stream through, one shard of about SHARD words at a
    time, without a shuffle. A benchmark of more than block characters is searched in parts of about that size, one
    after another: driver and tasks hold one part, and only hits are kept between the passes.
    Null or empty text: no words, no span. Items without words or with a null id: never found. Items with fewer words
    than the window are one window. Repeated items count once, repeated rows are each returned; null ids stay null.
    Empty docs give an empty result, an empty benchmark no span. Other columns may have any names.
    """
    spark, carry = docs.sparkSession, carry or []
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = 1 + size // block
    once = sent_once(docs, carry)
    rest = F.struct(F.col(name(id_col)).alias("doc_id"), F.struct(F.lit(None).cast("int").alias("none"), *(F.col(name(c)).alias(c) for c in carry if not (once and c == "text"))).alias("carried"))
    rows = docs.select(F.col("text").cast("string").alias("text"), rest.alias("row"))

    def search(df: DataFrame, part: int, all_rows: bool) -> tuple[DataFrame, object]:
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in own.collect()])
        kind = StructType.fromDDL(_FOUND)
        with_text = once and parts == 1
        return df.mapInArrow(_scanner(_Held(uuid.uuid4().hex, held), window, all_rows, 0 if with_text else 1), StructType(kind.fields + [f for f in df.schema if with_text or f.name != "text"])), held

    if parts == 1:
        out, _ = search(rows, 0, True)
    else:
        numbered = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "numbered")
        found = []
        for part in range(parts):
            hits, held = search(numbered.select("text", "uid"), part, part == 0)
            found.append(saved(hits, "hits"))
            held.destroy()
        merged = reduce(DataFrame.union, found).groupBy("uid").agg(F.max("n_words").alias("n_words"), _joined(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a part
        out = numbered.select("uid", "row", *(["text"] if once else [])).join(merged, "uid")
    carried = F.struct(*((F.col("text") if once and c == "text" else F.col(f"row.carried.{name(c)}")).alias(c) for c in carry)).alias("carried")
    return out.select("row.doc_id", "n_words", "spans", "items", *([carried] if carry else []))


def report(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    listed = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (hit > 0).alias("contaminated"))

"""Near-duplicates: MinHash bands propose pairs, odd sketches sift them, full shingle sets decide.

Pairs live inside a task only: a group of one band bucket emits the links of a spanning forest, never its pairs.

An odd sketch folds a set's MinHash samples into a bitmap of parities: the exclusive-or of two bitmaps is the bitmap of
their symmetric difference, so its number of ones estimates how many samples differ, most precisely where few do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import LOWER, chunks, keeps, saved, slices

BANDS, ROWS = 24, 4  # a pair at 0.85 shares no band with probability (1 - 0.85**4)**24 = 2e-8
BINS, BITS = 2048, 4096  # of the samples in an odd sketch, and its size
SIGMAS = 5  # a linked pair's estimate lies further off than this with probability 3e-7
BLOCK, SHINGLES = 4096, 1 << 22  # members of a bucket that one group compares, and their shingles at most

_ODD = np.random.default_rng(20240501).integers(0, 1 << 63, 4 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS, _ADDED, _FOLD = _ODD[: BANDS * ROWS], _ODD[BANDS * ROWS : 2 * BANDS * ROWS], _ODD[2 * BANDS * ROWS :]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def shingles(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; of its whole sequence where it has fewer words."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined.translate(LOWER), np.uint8)
    up, down = _powers_to(len(raw) + 1)
    space = _SPACE[raw]
    turns = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = turns[::2], turns[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * up[: len(raw)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    found = []
    for lo, hi in zip(bounds, bounds[1:]):
        own, k = words[lo:hi], min(width, hi - lo)
        if not k:
            found.append(own)
            continue
        total = np.full(len(own) - k + 1, k, np.uint64)
        for j in range(k):
            total += own[j : len(own) - k + 1 + j] * _FOLD[j]
        found.append(np.unique(_mix(total)))
    return found


def signature(own: np.ndarray) -> tuple[np.ndarray, int, bytes]:
    """Band keys, number of samples in the sketch, and the sketch of a set of at least one shingle."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(own), 2048):
        part = own[i : i + 2048]
        np.minimum(least, ((part[:, None] ^ _ADDED) * _FACTORS).min(0), out=least)
    keys = _mix((least.reshape(BANDS, ROWS) * _FOLD[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    ranks = np.sort(own * np.uint64(0xD6E8FEB86659FD93))
    bins = ranks >> np.uint64(64 - 11)
    samples = ranks[np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))]
    odd = np.bincount((_mix(samples) >> np.uint64(64 - 12)).astype(np.int64), minlength=BITS) & 1
    return keys, len(samples), np.packbits(odd.astype(np.uint8)).tobytes()


def _signed(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("minhash", _powers.clear)
        for batch in slices(batches):
            texts = [(x or "").encode("utf-8", "replace") for x in batch.column(2).to_pylist()]
            for lo, hi in chunks(texts):
                sizes, keys, bands, bins, sketches = [], [], [], [], []
                for own in shingles(texts[lo:hi], width):
                    sizes.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    b, n, s = signature(own) if len(own) else (None, 0, None)
                    bands.append(b)
                    bins.append(n)
                    sketches.append(s)
                own = (pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bins, pa.int32()), pa.array(sketches, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), *own], ["id", "text_key", "n", "set_key", "bands", "bins", "sketch"])

    return of


def _sets(width: int):
    """The whole sets of representatives, each once a task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keeps("minhash", _powers.clear)
        for batch in slices(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fresh = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
            texts = [texts[k].encode("utf-8", "replace") for k in fresh]
            for lo, hi in chunks(texts):
                own = [x.tobytes() for x in shingles(texts[lo:hi], width)]
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in fresh[lo:hi]], pa.binary()), pa.array(own, pa.binary())], ["set_key", "hashes"])

    return of


def _column(name: str, x: pa.Array) -> np.ndarray:
    if name == "sketch":
        return np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(-1, BITS // 64)
    if name == "bands":
        return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    if pa.types.is_binary(x.type):
        out = np.empty(len(x), object)
        out[:] = x.to_pylist()
        return out
    return x.to_numpy(zero_copy_only=False)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal keys, of batches sorted by them; a sketch is a row of 64-bit words."""
    held: dict[str, np.ndarray] = {}

    def runs(cols, last):
        n = len(cols[keys[0]])
        if not n:
            return 0
        turn = np.zeros(n, bool)
        turn[0] = True
        for k in keys:
            turn[1:] |= cols[k][1:] != cols[k][:-1]
        at = [*np.flatnonzero(turn), *([n] if last else [])]
        for lo, hi in zip(at, at[1:]):
            found.append({c: x[lo:hi] for c, x in cols.items()})
        return at[-1]

    for batch in batches:
        cols = {c: _column(c, x) for c, x in zip(batch.schema.names, batch.columns)}
        held = {c: np.concatenate([held[c], x]) for c, x in cols.items()} if held else cols
        found: list[dict[str, np.ndarray]] = []
        done = runs(held, False)
        yield from found
        held = {c: x[done:] for c, x in held.items()}
    if held:
        found = []
        runs(held, True)
        yield from found


def _alike(g: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """How far the estimate of rows i against rows j lies above the least that a link may have; negative: no link."""
    ones = np.bitwise_count(g["sketch"][i] ^ g["sketch"][j]).sum(1, dtype=np.int64)
    differ = -BITS / 2 * np.log1p(-np.minimum(2 * ones, BITS - 2) / BITS)
    both = g["bins"][i] + g["bins"][j]
    a, b = g["n"][i], g["n"][j]
    share = percent / 100
    union = (a + b) / (1 + share)
    filled = lambda n: BINS * -np.expm1(n * np.log1p(-1 / BINS))
    bins = np.minimum(filled(union) * both / (filled(a) + filled(b)), BINS)
    empty = np.exp(-union / BINS)
    uneven = BINS * empty * (1 - (1 + union / BINS) * empty)  # variance of the number of filled bins, most of it known by now
    load = 2 * (1 - share) * bins / BITS  # of the bitmap of the difference, at most
    noise = BITS / 16 * -np.expm1(np.log1p(4 * load) - 4 * load) * np.exp(4 * load)
    spread = np.sqrt(share * (1 - share) * bins * np.maximum(0, 1 - bins / union) + noise + 0.2 * uneven + 0.25)
    return (both - differ) / 2 - share * bins + SIGMAS * spread


def _candidates(g: dict, comp: np.ndarray, i: np.ndarray, percent: int, done: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sifted pairs of rows i (that ask) and rows that hold: of other components, this band the first that both share.

    done marks rows between which no pair is wanted any more. Returns both sides and by how much the sift is passed.
    """
    band, n = int(g["band"][0]), g["n"]
    able = g["asks"][i][:, None] & g["holds"] & (comp[i][:, None] != comp)
    able &= ~(g["asks"] & g["holds"][i][:, None] & (np.arange(len(comp)) < i[:, None]))  # the other way round it is asked already
    able &= 100 * np.minimum(n[i][:, None], n) >= percent * np.maximum(n[i][:, None], n)
    if done is not None:
        able &= ~(done[i][:, None] & done)
    for k in range(band):
        able &= g["bands"][i, k][:, None] != g["bands"][:, k]
    q, j = np.nonzero(able)
    over = np.concatenate([_alike(g, i[q[lo : lo + 65536]], j[lo : lo + 65536], percent) for lo in range(0, len(q), 65536)] or [np.zeros(0)])
    near = over >= 0
    return i[q[near]], j[near], over[near]


_GROUP = ["bucket", "block", "other"]


def _sifter(percent: int):
    """The rows of each group that are in a sifted pair."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, _GROUP):
            m = len(g["n"])
            comp, hit = np.unique(g["comp"], return_inverse=True)[1], np.zeros(m, bool)
            for lo in range(0, m, 64):
                i, j, _ = _candidates(g, comp, np.arange(lo, min(m, lo + 64)), percent, hit)
                hit[i] = hit[j] = True
            if hit.any():
                names = [*_GROUP, "band", "set_key", "comp", "asks", "holds"]
                yield pa.RecordBatch.from_arrays([pa.array(g[c][hit]) for c in names], names)

    return of


def _linker(percent: int):
    """Links that join the components of each group, by whole sets: at most one fewer than its rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, _GROUP):
            sizes = g["n"].astype(np.int64)
            own = np.unique(np.frombuffer(b"".join(g["hashes"].tolist()), np.uint64), return_inverse=True)[1]
            ends = np.cumsum(sizes)
            starts, mark = ends - sizes, np.zeros(int(own.max()) + 1, bool)
            comp, found = np.unique(g["comp"], return_inverse=True)[1], []
            for lo in range(0, len(sizes), 64):
                i, j, over = _candidates(g, comp, np.arange(lo, min(len(sizes), lo + 64)), percent)
                order = np.lexsort((-over, i))
                i, j = i[order], j[order]
                for at in np.unique(i).tolist():
                    left, step = j[i == at], 8
                    mark[own[starts[at] : ends[at]]] = True
                    while len(left := left[comp[left] != comp[at]]):
                        part, left = left[:step], left[step:]
                        both = np.add.reduceat(mark[np.concatenate([own[starts[k] : ends[k]] for k in part])].astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
                        for k in part[100 * both >= percent * (sizes[at] + sizes[part] - both)].tolist():
                            if comp[k] != comp[at]:
                                found.append((g["set_key"][at], g["set_key"][k]))
                                comp[comp == comp[k]] = comp[at]
                        step *= 8
                    mark[own[starts[at] : ends[at]]] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])

    return of


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 3, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id is that id), and
    the keys group (of the component; null without a set) and text_key (md5 of the text).

    Words are runs other than ASCII white space, after lower-casing A-Z; the set holds shingles of width words. Two sets are
    linked if 100 * intersection >= percent * union. Exact copies form one class at once; every class goes to its band
    buckets, of buckets with the same members one is kept. A task compares the members of a bucket, in blocks of at most
    block of them, and emits a spanning forest of the confirmed links. Of larger buckets, the members that are not in
    the largest component then meet all blocks: no cap, and no pair inside a component.
    Null or empty text: no set, no link, a component of its own. Null ids link like others but name no component; a
    component of null ids alone has a null component_id and keeps all rows. Repeated rows are each returned; rows of
    one id with different texts are each placed by their own text. Ids of any type that sorts. Other columns of docs are
    not read, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("string").cast("binary")).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = saved(rows.mapInArrow(_signed(width), f"id {kind}, text_key string, n long, set_key binary, bands array<long>, bins int, sketch binary"), "signed")
    classes = signed.filter("set_key is not null").groupBy("set_key").agg(F.min("id").alias("least"), F.min(F.struct("text_key", "id")).alias("from"), F.first(F.struct("n", "bins", "sketch", "bands")).alias("r"))
    classes = saved(classes.select("set_key", "least", "from", "r.*"), "classes")

    each = classes.select("set_key", "n", F.posexplode("bands").alias("band", "bucket"))
    full = each.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("band").alias("band"), F.expr("bit_xor(xxhash64(set_key))").alias("h"), F.expr("bit_xor(xxhash64(set_key, 1))").alias("g"))
    full = full.filter("members > 1").groupBy("members", "h", "g").agg(F.min(F.struct("band", "bucket", "shingles")).alias("r"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("r.shingles") / SHINGLES)).alias("blocks")
    shared = saved(each.select("set_key", "band", "bucket").join(full.select("r.bucket", "members", blocks), "bucket"), "buckets")
    sketches = classes.select("set_key", "n", "bins", "sketch", "bands")

    def linked(placed: DataFrame) -> DataFrame:
        """Links within the groups of placed (bucket, block, other, band, set_key, comp, asks, holds)."""
        dealt = lambda df: df.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "set_key")
        marks = "bucket long, block long, other long, band int, set_key binary, comp binary, asks boolean, holds boolean"
        near = saved(dealt(placed.join(sketches, "set_key").select("bucket", "block", "other", "band", "set_key", "comp", "asks", "holds", "n", "bins", "sketch", "bands")).mapInArrow(_sifter(percent), marks), "sifted")
        need = near.select("set_key").distinct().join(classes.select("set_key", "from"), "set_key")
        same = rows["id"].eqNullSafe(need["from.id"]) & (rows["text_key"] == need["from.text_key"])
        sets = saved(rows.join(need, same).select("set_key", "text").mapInArrow(_sets(width), "set_key binary, hashes binary"), "sets").dropDuplicates(["set_key"])
        return saved(dealt(near.join(sketches, "set_key").join(sets, "set_key")).mapInArrow(_linker(percent), "a binary, b binary"), "linked")

    at = lambda by, n: F.pmod(F.xxhash64("set_key", F.lit(by)), F.col(n))
    yes, no = F.lit(True), F.lit(False)
    links = linked(shared.select("bucket", at(0, "blocks").alias("block"), F.lit(0).cast("long").alias("other"), "band", "set_key", F.col("set_key").alias("comp"), yes.alias("asks"), yes.alias("holds")))
    roots = components(links)

    large = shared.filter("blocks > 1")
    if not large.isEmpty():
        placed = large.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("comp", F.coalesce("root", "set_key"))
        sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
        split = sizes.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
        apart = F.ceil((F.col("members") - F.col("top.k")) / F.col("members") * F.col("blocks"))
        left = saved(placed.join(split, "bucket").select("bucket", "band", "set_key", "comp", (F.col("comp") != F.col("top.comp")).alias("asks"), "blocks", apart.alias("apart")), "unjoined")
        held = left.select("bucket", at(0, "blocks").alias("block"), F.explode(F.expr("sequence(0L, apart - 1)")).alias("other"), "band", "set_key", "comp", no.alias("asks"), yes.alias("holds"))
        asks = left.filter("asks").select("bucket", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), at(1, "apart").alias("other"), "band", "set_key", "comp", "asks", no.alias("holds"))
        roots = components(linked(held.union(asks)).union(links))

    named = classes.select("set_key", "least").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "least", F.coalesce("root", "set_key").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    out = signed.select("id", "text_key", "n", "set_key").join(named.join(least, "group").select("set_key", "group", "component"), "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "group", "text_key")

"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import keeps, slices

LENGTH = 4096  # tokens of a sequence
END = 2  # the id after each document
SHARD_BYTES = 3 << 20  # text of a shard: some 300 sequences, of which the last is padded
LINEAR, QUADRATIC = 1.0, 1 / 4096  # cost of a token, and of a pair of tokens that attend to each other
CACHED = 250_000  # words whose ids a worker keeps

_SAFE = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x180))]
_letters = "".join(c for c in _SAFE if unicodedata.category(c)[0] == "L")
_numbers = "".join(c for c in _SAFE if unicodedata.category(c)[0] == "N")
_ODD = re.compile("[^" + re.escape("".join(_SAFE)) + "]|<\\|(?:start|end)oftext\\|>")
#: Fixed value: how the public tokenizer splits text into words, for the characters above.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(_letters)}]+|[{re.escape(_numbers)}]|[^\\s{re.escape(_letters)}{re.escape(_numbers)}]+")


class Tokens:
    """Ids of texts by a tokenizer file with word ends. Words of Latin text are looked up; other texts go to it whole."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(path), {}

    def _learn(self, words: list[str]) -> None:
        """One call for many words: each is one piece of the tokenizer's own splitting, so its ids are those of that piece."""
        one = self.model.encode(" ".join(words), add_special_tokens=False)
        ids, places = np.array(one.ids, "<u4"), np.array(one.word_ids, np.int64)
        edge = np.flatnonzero(np.diff(places, prepend=-1))
        if len(edge) == len(words):
            self.known.update((w, ids[a:b].tobytes()) for w, a, b in zip(words, edge.tolist(), [*edge[1:].tolist(), len(ids)]))
        else:
            self.known.update((w, np.array(self.model.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in words)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        lists = [None if _ODD.search(t) else _PIECE.findall(t.lower()) for t in texts]
        own = [x for x in lists if x is not None]
        new = sorted(set().union(*own).difference(self.known))  # goes over the texts, not over all known words
        if len(self.known) + len(new) > CACHED:
            self.known, new = {}, sorted(set().union(*own))
        for k in range(0, len(new), 500):
            self._learn(new[k : k + 500])
        look = self.known.__getitem__
        return [np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4") if x is None else np.frombuffer(b"".join(map(look, x)), "<u4") for t, x in zip(texts, lists)]


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _cutter(path: str, shards: int, length: int, end: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keeps("packing", _tokens.clear)
        turn = TaskContext.get().partitionId() * 7919
        for batch in slices(batches):
            docs, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 64):
                rows = []
                for k, ids in enumerate(tokens(path).of(texts[lo : lo + 64]), lo):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for start in range(0, len(ids), length):
                        part = ids[start : start + length]
                        rows.append((k, start, len(part), len(ids), zlib.crc32(part.tobytes()), None if len(part) == length else part.astype("<u2" if part.max() < 1 << 16 else "<u4").tobytes(), turn % shards))
                        turn += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(cols[0], pa.int32())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())))], ["doc_id", "start", "length", "doc_tokens", "crc", "ids", "shard"])

    return of


def assign(lengths: np.ndarray, length: int) -> list[list[tuple[int, int, int, int]]]:
    """For pieces of descending lengths: (sequence, offset, from, tokens) of each part, in order.

    As many sequences as the tokens need. A piece goes to the sequence of lowest cost among those that have room for
    it; if none has, it is cut, its first part filling the sequence of lowest cost that has any room.
    """
    count = max(1, -(-int(lengths.sum()) // length))
    room, cost, out = np.full(count, length, np.int64), np.zeros(count), []
    for n in lengths.tolist():
        at, parts = 0, []
        while at < n:
            fits = room >= n - at
            if not fits.any():
                fits = room > 0
            k = int(np.where(fits, cost, np.inf).argmin())
            take = min(n - at, int(room[k]))
            parts.append((k, length - int(room[k]), at, take))
            room[k] -= take
            cost[k] += LINEAR * take + QUADRATIC * take * take
            at += take
        out.append(parts)
    return out


def _packer(length: int):
    def of(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "start", "crc"], ascending=[False, True, True, True], kind="stable")
        rows = []
        for (doc, start, n, total, crc, ids), parts in zip(df[["doc_id", "start", "length", "doc_tokens", "crc", "ids"]].itertuples(index=False), assign(df["length"].to_numpy(), length)):
            wide = None
            for k, offset, at, take in parts:
                if take != n:
                    wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4") if wide is None else wide
                    crc = zlib.crc32(wide[at : at + take].tobytes())
                rows.append((doc, start + at, take, crc, total, (int(key[0]) << 32) + k, offset))
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return of


def pack(docs: DataFrame, vocab_path: str | None = None, length: int = LENGTH, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text), each in a sequence of at most length tokens.

    A document is cut at multiples of length; its full pieces are sequences, and the rest is packed in shards of about
    shard_bytes of text, so a shard's size doesn't grow with the input and at most its last sequence is padded. Rows
    are dealt to shards in turn by their place in the scan: docs should be read from files (any scan whose order is
    the same when repeated), and then no key, copy or source gathers in a shard. Null text is empty: the end id alone.
    A null doc_id stays null. Repeated rows are each packed. Other
    columns are not read, whatever their names. An empty table gives no piece.
    """
    if vocab_path is None:
        import public_tokenizers

        vocab_path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 4).alias("n")).first()["n"] or 0
    shards = max(1, round(total / shard_bytes))
    key = docs.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(_cutter(vocab_path, shards, length, end), f"doc_id {key}, start bigint, length bigint, doc_tokens bigint, crc bigint, ids binary, shard int")
    return cut.groupBy("shard").applyInPandas(_packer(length), f"doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

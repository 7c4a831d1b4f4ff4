"""Language identification by unigram pieces: a word's probability is the sum over all its segmentations into pieces."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.shared import keeps, name, sent_once

SAMPLE_DOCS = 2000  # about so many documents a language are learned from
SAMPLE_WORDS = 8000  # and so many of their most frequent words
ROUNDS = 5  # of expectation and maximisation
SEGMENT = 32  # words up to this length are scored many at once, longer ones each by itself, over its whole length
UNKNOWN = 1e-7  # the probability of a character that no piece covers
CACHED = 150_000  # words whose scores a worker keeps
_ASCII, _WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
_pieces: dict[str, dict[str, int]] = {}


def vocabulary(path: str | None = None) -> dict[str, int]:
    """The pieces of a public SentencePiece model by number, byte and control pieces left out; loaded once a process."""
    import public_tokenizers
    import sentencepiece

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _pieces[path] = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return _pieces[path]


def split_words(text: str) -> list[str]:
    """Lower-cased runs of letters with their marks, a word mark before each."""
    low = text.lower()
    return ["▁" + w for w in (_ASCII if low.isascii() else _WORD).findall(low)]


def log_total(word: str, vocab: dict[str, int], longest: int, probs: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of a word of any length: only the last places' sums are held, scaled to their largest."""
    held, scale = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for end in range(1, len(word) + 1):
        total = np.zeros(probs.shape[1])
        for n in range(1, min(len(held), longest) + 1):
            piece = vocab.get(word[end - n : end], -1 if n == 1 else None)
            if piece is not None:
                total += held[-n] * probs[piece]
        held = [*held[-longest + 1 :], total]
        if end % SEGMENT == 0:
            top = np.max(held, axis=0)
            held, scale = [x / top for x in held], scale + np.log(top)
    return np.log(np.maximum(held[-1], 1e-300)) + scale


class _Index:
    """Numbers of pieces by their hashes, looked up many at a time; pieces of one length share no 64-bit hash (it is checked)."""

    BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

    def __init__(self, vocab: dict[str, int]) -> None:
        self.vocab, self.slots = vocab, max(10, (4 * len(vocab)).bit_length())
        self.longest = max(map(len, vocab), default=1)
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, self.BASE)]))
        hashes = np.zeros(len(vocab), np.uint64)
        for i, w in enumerate(vocab):
            for k, c in enumerate(reversed(w)):
                hashes[i] += np.uint64(ord(c)) * self.power[k]
        self.hashes = self._mixed(hashes, np.array([len(w) for w in vocab], np.uint64))
        if len(np.unique(self.hashes)) < len(vocab):
            raise ValueError("two pieces have one hash")
        self.numbers, self.table = np.fromiter(vocab.values(), np.int64, len(vocab)), np.full(1 << self.slots, -1, np.int32)
        for i, at in enumerate(self._slot(self.hashes).tolist()):
            while self.table[at] >= 0:
                at = (at + 1) & (len(self.table) - 1)
            self.table[at] = i

    def _mixed(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (h + n * self.MIX) * self.BASE

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.slots)).astype(np.int64)

    def find(self, raw: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the pieces with n characters and these sums of characters by powers; -1 for none."""
        h = self._mixed(raw, np.array([n], np.uint64))
        at = self._slot(h)
        found = self.table[at]
        wrong = np.flatnonzero((found >= 0) & (self.hashes[found] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.table) - 1)
            found[wrong] = self.table[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.hashes[found[wrong]] != h[wrong])]
        return np.where(found >= 0, self.numbers[found], -1)


_indexes: dict[int, _Index] = {}


class Lattice:
    """All pieces at all places of some words, grouped by end and length."""

    def __init__(self, words: list[str], vocab: dict[str, int], longest: int) -> None:
        if id(vocab) not in _indexes or _indexes[id(vocab)].vocab is not vocab:
            _indexes[id(vocab)] = _Index(vocab)
        index, self.lengths = _indexes[id(vocab)], np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        steps, sums, at = [], np.zeros(len(codes), np.uint64), np.arange(len(codes))
        for n in range(1, min(longest, index.longest) + 1):
            at = at[place[at] >= n - 1]
            sums[at] += codes[at - n + 1] * index.power[n - 1]
            piece = index.find(sums[at], n)
            hit = np.arange(len(at)) if n == 1 else np.flatnonzero(piece >= 0)
            hit = hit[np.argsort(place[at[hit]], kind="stable")]
            ends = place[at[hit]] + 1
            cuts = np.flatnonzero(np.diff(ends, prepend=-1))
            steps += [(int(ends[lo]), n, word[at[hit[lo:hi]]], piece[hit[lo:hi]]) for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hit)])]
        self.steps = sorted(steps, key=lambda x: x[:2])

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """alpha[word, place, language]; probs has a last row for unknown characters."""
        alpha = np.zeros((len(self.lengths), int(self.lengths.max()) + 1, probs.shape[1]))
        alpha[:, 0] = 1
        for end, n, k, p in self.steps:
            alpha[k, end] += alpha[k, end - n] * probs[p]
        return alpha

    def totals(self, probs: np.ndarray) -> np.ndarray:
        return self.forward(probs)[np.arange(len(self.lengths)), self.lengths]

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected per language, over all segmentations of words that occur counts times."""
        alpha = self.forward(probs)
        rows = np.arange(len(self.lengths))
        beta = np.zeros_like(alpha)
        beta[rows, self.lengths] = counts / np.maximum(alpha[rows, self.lengths], 1e-300)
        out = np.zeros_like(probs)
        for end, n, k, p in reversed(self.steps):
            flow = probs[p] * beta[k, end]
            np.add.at(out, p, flow * alpha[k, end - n])
            beta[k, end - n] += flow
        return out


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, Counter()).update(w[i : i + SEGMENT] for w in split_words(text) for i in range(0, len(w), SEGMENT))
        rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])


def train(labelled: DataFrame, vocab_path: str | None = None, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (a column each, a last row for unknown characters) from (id, lang, text).

    Bounded by its parameters: about sample_docs whole documents a language, chosen by a hash of their id, are counted
    on the executors, and the sample_words most frequent words of each come to the driver for the rounds of
    expectation and maximisation (a word of the sample that is longer than SEGMENT counts as parts of that length). No
    labelled row: no language.
    """
    known = labelled.filter("lang is not null and text is not null and id is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, int(min(1.0, sample_docs / sizes[lang]) * 1_000_000)).otherwise(share)
    taken = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < share)
    counted = taken.select("lang", "text").mapInArrow(_sample_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # of a bounded sample
    top = counted.withColumn("k", rank).filter(F.col("k") <= sample_words).collect()
    vocab = vocabulary(vocab_path)
    size, words = max(vocab.values()) + 2, sorted({r["word"] for r in top})
    if not words:
        return langs, np.full((size, len(langs)), 1 / size)
    number, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(words), len(langs)))
    for r in top:
        counts[number[r["word"]], column[r["lang"]]] = r["n"]
    lattice, longest = None, max(map(len, vocab))
    lattice = Lattice(words, vocab, min(longest, SEGMENT))
    seen = np.zeros(size, bool)
    for _, _, _, p in lattice.steps:
        seen[p] = True
    probs = np.full((size, len(langs)), 1 / max(1, seen.sum()))
    for _ in range(ROUNDS):
        probs[-1] = UNKNOWN
        e = lattice.expected(probs, counts)
        e[-1] = 0
        probs = (e + 0.01 * seen[:, None]) / (e.sum(0) + 0.01 * seen.sum())
    probs = np.maximum(probs, 1e-8)
    probs[-1] = UNKNOWN
    return langs, probs


_scores: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def _scorer(model, own: str, vocab_path: str | None, rest: int = 2, step: int = 256):
    """Scores texts and passes on the columns from rest; a worker keeps the scores of the first CACHED words that it meets, over all its tasks with this model."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("langid", _scores.clear)
        langs, probs = model.value
        vocab = vocabulary(vocab_path)
        longest = max(map(len, vocab))
        if own not in _scores:
            _scores.clear()
            _scores[own] = {}, np.zeros((1024, len(langs)))
        number, logs = _scores[own]
        for batch in batches:
            preds, scores = [], []
            for lo in range(0, batch.num_rows, step):
                lists = [split_words(t) if t else [] for t in batch.column(1).slice(lo, step).to_pylist()]
                all_ = set().union(*lists) if langs else set()
                long = {w: log_total(w, vocab, longest, probs) for w in all_ if len(w) > SEGMENT}
                all_ -= long.keys()
                new = sorted(all_.difference(number))  # goes over the texts' words, not over all known ones
                while len(number) + len(new) > len(logs):
                    logs = np.concatenate([logs, np.zeros_like(logs)])
                for k in range(0, len(new), 20_000):
                    part = new[k : k + 20_000]
                    logs[len(number) : len(number) + len(part)] = np.log(np.maximum(Lattice(part, vocab, longest).totals(probs), 1e-300))
                    number.update(zip(part, range(len(number), len(number) + len(part))))
                _scores[own] = number, logs
                for words in lists:
                    if not words or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    more = [long[w] for w in words if w in long] if long else []
                    known = [w for w in words if w not in long] if more else words
                    total = logs[np.fromiter(map(number.__getitem__, known), np.int64, len(known))].sum(0) + sum(more)
                    best = int(total.argmax())
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                if len(number) > CACHED:
                    for w in new[-(len(number) - CACHED) :]:  # the last ones added
                        del number[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), *batch.columns[rest:]], ["id", "lang_pred", "score", *batch.schema.names[rest:]])

    return of


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, training: DataFrame | None = None, vocab_path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, and a struct "carried" of the columns in carry. Learned from training (docs unless given).

    Learns only from rows with non-null lang, text and doc_id whose held_out() is false; predictions read text alone.
    Letters are those of Unicode, a letter's marks stay with it; digits and number forms are none. score is the
    posterior of the chosen language under equal priors. Null text, or none with a letter: und, 0. No labelled row at
    all: und. Ties go to the first language by name. Repeated rows are each returned; a null doc_id stays null; other
    columns may have any names. An empty table gives an empty result.
    """
    training = docs if training is None else training
    labelled = training.filter(~held_out()).select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, vocab_path))
    carry = carry or []
    once = len(carry) > 1 and sent_once(docs, carry)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t"), F.struct(*(F.col(name(c)).alias(c) for c in carry if not (once and c == "text"))).alias("carried"))
    rows = rows if carry else rows.drop("carried")
    kind = StructType([rows.schema["id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), *rows.schema.fields[1 if once else 2 :]])
    out = rows.mapInArrow(_scorer(model, uuid.uuid4().hex, vocab_path, 1 if once else 2), kind).withColumnRenamed("id", "doc_id")
    if not once:
        return out
    return out.select("doc_id", "lang_pred", "score", F.struct(*((F.col("t") if c == "text" else F.col(f"carried.{name(c)}")).alias(c) for c in carry)).alias("carried"))

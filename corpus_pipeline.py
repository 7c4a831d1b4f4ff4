"""From raw documents to packed training sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, minhash, packing, pii
from tessera.llm.shared import name, saved


#: Documents of other languages go, and such of which the model is less sure. None: every learned language stays.
LANGUAGES: list[str] | None = None
LEAST_SCORE = 0.5


def _back(found: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs out of "carried", those in new replaced."""
    kept = [new.get(c, F.col(f"carried.{name(c)}")) if c != "doc_id" else F.col("doc_id") for c in docs.columns]
    return found.select(*(x.alias(c) for x, c in zip(kept, docs.columns)))


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "doc_id"]


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of LANGUAGES with a score of LEAST_SCORE or more; lang is then the language found.

    Learned from the documents of the stage. Null texts and such without a letter have no language and go.
    """
    found = langid.identify(docs, carry=_others(docs)).filter(F.col("score") >= LEAST_SCORE)
    if LANGUAGES is not None:
        found = found.filter(F.col("lang_pred").isin(*LANGUAGES))
    return _back(found, docs, lang=F.col("lang_pred").cast(docs.schema["lang"].dataType))


def _deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, 0.8), that with the smallest doc_id.

    Of rows that repeat its doc_id and text, or that all lack a doc_id, the first by its other columns stays. Texts
    without a word are copies of nothing: of those, only repeated rows of one doc_id and text are one.
    """
    found = minhash.near_duplicates(docs, percent=80, width=5).filter("kept")
    own = F.coalesce(F.hex("group"), F.to_json(F.struct("doc_id", "text_key")))
    stay = found.groupBy(own.alias("g")).agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.count("*").alias("copies")).select(F.col("r.doc_id").alias("d"), F.col("r.text_key").alias("k"), "copies")
    stay = saved(stay, "stay")
    rows = docs.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("string").cast("binary")).alias("key"), F.struct(*(F.col(name(c)).alias(c) for c in docs.columns)).alias("carried"))
    same = lambda s: rows["id"].eqNullSafe(s["d"]) & rows["key"].eqNullSafe(s["k"])
    once, more = stay.filter("copies = 1"), stay.filter("copies > 1")
    one = rows.join(more, same(more), "left_semi").groupBy("id", "key").agg(F.min_by("carried", F.to_json("carried")).alias("carried"))
    kept = rows.join(once, same(once), "left_semi").select("carried").union(one.select("carried"))
    return kept.select(*(F.col(f"carried.{name(c)}").alias(c) for c in docs.columns))


def _decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, carry=_others(docs))
    return _back(found.filter(F.size("spans") == 0), docs)


def _private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the new text."""
    out = pii.replace_entities(docs, pii.session_key(spark), added=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", _language),
    ("near_duplicates", _deduplicated),
    ("decontamination", _decontaminated),
    ("personal_data", _private),
    ("packing", _packed),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

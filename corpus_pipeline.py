"""Preparation of a training corpus: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger.llm import bpe, decontamination, near_duplicates, suffix_dedup, toxicity
from tickledger.llm import texts as X

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; those without text are kept."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = X.free(docs, "toxicity")
    return toxicity.score(docs, model, name=name).where(F.col(name) < toxicity.TOXIC_FROM).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group (shingles of five words, similarity 0.8).

    Documents with a null id stay; rows that share an id stay or go together.
    """
    rows = near_duplicates.groups(docs, words=5)
    gone = X.stored(rows.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents; of a character that is cut, no byte stays.

    Every document is kept, also with nothing left of its text; ``n_chars``, where there is one, follows the text.
    """
    docs, named = X.shielded(docs, key="doc_id", text="text", chars="n_chars")
    rows = suffix_dedup.dedup(docs, "own_key", "own_text")
    changed = F.size("removed") > 0
    rows = suffix_dedup.whole_characters(rows, "kept", "_left")
    rows = rows.withColumn("own_text", F.when(changed, F.col("_left")).otherwise(F.col("own_text")))
    if "own_chars" in docs.columns:
        rows = rows.withColumn("own_chars", F.when(changed, F.char_length("own_text").cast("bigint")).otherwise(F.col("own_chars")))
    return named(rows.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    docs, named = X.shielded(docs, key="doc_id", text="text")
    rows = decontamination.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text="own_text")
    return named(rows.where(F.size("hits") == 0).select(*docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, the number of these, and the text that they decode to."""
    rows = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER)
    return rows.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = X.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

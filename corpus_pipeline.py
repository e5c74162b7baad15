"""Corpus pipeline: quality rules, near-dedup, decontamination, personal data, BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what goes on. Each
result is written as Parquet below the session's shared folder and read again as the next stage's docs, so a lost
executor costs one stage at most. A stage's table is deleted once the next one's is whole; the fourth's stays, as the
result is computed from it. All but the last return the columns of documents as they came:

1. quality: documents that the rules or the model reject go.
2. near_dedup: one document of each near-duplicate class stays.
3. decontamination: documents with a word inside a benchmark window go.
4. personal_data: spans become <EMAIL>, <IP>, <CARD>, <PHONE> or <IDENTIFIER>; where there is an n_chars, it follows the text.
5. bpe: doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text.

Null texts and texts of fewer than 50 words end in stage 1; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import bpe, decontamination, neardup, pii, quality
from lanewise.llm.common import discard, load, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("bpe", bpe_stage),
]
#: Near-duplicate classes, learned weights and token ids have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

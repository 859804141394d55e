"""A training-corpus pipeline: filter, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept;
its result is written as Parquet and read again as the next one's input. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineament.llm.bpe import encoded_digests
from lineament.llm.decontam import decontamination_stage
from lineament.llm.quality import quality_stage
from lineament.llm.secrets import secrets_stage
from lineament.llm.shared import Cut, table
from lineament.llm.simhash import dedup_stage


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining, redacted texts."""
    return encoded_digests(docs, ["doc_id"])


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encoding", encode_stage),
]

#: Fingerprints, the random field and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        cut = Cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = cut.df, cut
    return STAGES[-1][1](spark, docs, sf_dir)

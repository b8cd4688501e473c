"""Corpus pipeline: the stages a training corpus passes, in order, each written as Parquet and read again by the next.

1. quality: documents that the quality classifier rejects go.
2. near duplicates: one document of each group of near copies stays, that with the smallest id.
3. decontamination: documents that hold benchmark passages go.
4. secrets: what the secret scan finds is masked in the text.
5. tokens: texts become token ids, checked by decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytequarry.llm import bpe, common, decontaminate, minhash, quality, secrets

STAGES = [
    ("quality classifier", quality.stage_quality),
    ("MinHash near-dedup", minhash.stage_near),
    ("benchmark decontamination", decontaminate.stage_decontaminate),
    ("secret scans", secrets.stage_secrets),
    ("byte-level BPE", bpe.stage_tokens),
]

ORACLE_SQL = None
"""A trained network and byte-pair merges have no SQL form; tests hold the run against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.spool(docs, f"pipeline-{k + 1}")
    return docs

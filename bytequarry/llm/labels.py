"""A bounded, seeded sample of labelled texts for the networks that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 3000
"""Rows that a network is fitted on, at most; their texts are taken whole."""


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(documents: DataFrame, labels: DataFrame, target: str, keep: F.Column, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """(text, label) of at most rows labelled documents that meet keep, those with the smallest hash of their id.

    A document with several labels counts with its largest; null ids, texts and labels are left out."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return [(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: r["doc_id"])]

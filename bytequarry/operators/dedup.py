"""Content-addressed dedup of documents and chunks: the first by order is kept, later ones refer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs


def chunks(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, chunk_no, offset, length, sha256): content-defined chunks with the digest of each; the bytes stay behind."""
    cut = df.select(F.col(id_col).alias("id"), F.col(content_col).alias("c"), F.posexplode(udfs.cdc_chunks(F.col(content_col))).alias("chunk_no", "at"))
    return cut.select("id", "chunk_no", "at.offset", "at.length", F.sha2(F.expr("substring(c, int(at.offset) + 1, int(at.length))"), 256).alias("sha256"))


def index(df: DataFrame, digest_col: str, order_cols: list[str]) -> DataFrame:
    """Adds already_present: whether an earlier row by order_cols has the digest. A null digest is like no other: never present.

    The first of each digest is a minimum, formed on the map side and joined back by the digest. The join's rows carry no
    payload of their own, and adaptive execution splits a partition that one digest makes large."""
    digest, first = "first_digest", "first_place"
    while {digest, first} & set(df.columns):
        digest, first = digest + "_", first + "_"
    least = df.filter(F.col(digest_col).isNotNull()).groupBy(F.col(digest_col).alias(digest)).agg(F.min(F.struct(*order_cols)).alias(first))
    joined = df.join(least, F.col(digest_col) == F.col(digest), "left")
    present = F.coalesce(~F.struct(*order_cols).eqNullSafe(F.col(first)) & F.col(digest).isNotNull(), F.lit(False))
    return joined.withColumn("already_present", present).drop(digest, first)


def stored(df: DataFrame, digest_col: str, order_cols: list[str]) -> DataFrame:
    """The rows that are stored: the first of each digest, and those without one."""
    return index(df, digest_col, order_cols).filter(~F.col("already_present")).drop("already_present")


def lookup(wanted: DataFrame, store: DataFrame, digest_col: str = "sha256") -> DataFrame:
    """wanted with what the store has for each digest, null where it has none."""
    return wanted.join(store, digest_col, "left")


def upsert_latest(rows: DataFrame, key: str, order_col: str) -> DataFrame:
    """The latest row of each key, newest first."""
    latest = Window.partitionBy(key).orderBy(F.desc(order_col))
    return rows.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n").orderBy(F.desc(order_col))


def stage(rows: DataFrame, path_col: str = "path", order_col: str = "seq", removed: DataFrame | None = None) -> DataFrame:
    """A stage list: the first entry of each path by order, less the removed ones."""
    first = Window.partitionBy(path_col).orderBy(order_col)
    kept = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return kept.join(removed.select(order_col), order_col, "left_anti") if removed is not None else kept

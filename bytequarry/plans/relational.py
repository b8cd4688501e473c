"""Byte operators as relational plans over one row per byte: the meaning of the transforms in joins, windows and groups.

They are exact and need no Python, but a window sorts each document's bytes; the Arrow forms in functions.udfs give the same
results at a fraction of the cost and are what archives use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns


def byte_rows(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(id, pos, b): one row per byte."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(columns.byte_array(content)).alias("pos", "b"))


def _packed(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """Hexadecimal string of the values of each id in order of pos."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return rows.groupBy("id").agg(columns.hex_of(F.transform(ordered, lambda x: x[value])).alias(alias))


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "b").agg(F.count("*").alias("n"))


def entropy(rows: DataFrame) -> DataFrame:
    """(id, entropy): counts are formed on the map side, so a document is 256 rows at most after the first exchange."""
    by = histogram(rows).groupBy("id").agg(F.sum("n").alias("total"), F.collect_list("n").alias("counts"))
    parts = F.transform("counts", lambda c: (c / F.col("total")) * F.log2(c / F.col("total")))
    return by.select("id", (-F.aggregate(F.array_sort(parts), F.lit(0.0), lambda a, x: a + x) + F.lit(0.0)).alias("entropy"))


def huffman_size(rows: DataFrame) -> DataFrame:
    return histogram(rows).groupBy("id").agg(F.collect_list("n").alias("counts")).select("id", columns.huffman_size(F.col("counts")).alias("size"))


def delta(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("pos")
    return _packed(rows.withColumn("d", F.pmod(F.col("b") - F.lag("b", 1, 0).over(w), F.lit(256))), "d", "hex")


def undelta(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return _packed(rows.withColumn("d", F.pmod(F.sum("b").over(w), F.lit(256)).cast("int")), "d", "hex")


def predict(rows: DataFrame) -> DataFrame:
    """The byte before is the context; the difference is to the context's last byte."""
    w = Window.partitionBy("id").orderBy("pos")
    own = Window.partitionBy("id", "context").orderBy("pos")
    placed = rows.withColumn("context", F.lag("b", 1, 0).over(w))
    return _packed(placed.withColumn("d", F.pmod(F.col("b") - F.lag("b", 1, 0).over(own), F.lit(256))), "d", "hex")


def rle(rows: DataFrame) -> DataFrame:
    """Gaps and islands; an island is split every 255 bytes."""
    w = Window.partitionBy("id").orderBy("pos")
    runs = rows.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("id", "b").orderBy("pos")))
    within = F.row_number().over(Window.partitionBy("id", "b", "run").orderBy("pos")) - 1
    pieces = runs.withColumn("piece", F.floor(within / 255)).groupBy("id", "b", "run", "piece").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    paired = pieces.withColumn("pair", F.col("n") * 256 + F.col("b"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "pair")))
    return paired.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: F.lpad(F.hex(x["pair"]), 4, "0")), "").alias("hex"))


def bwt(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(id, row, hex): rotations sorted as binaries, equal ones by start. Quadratic in a text's length: for short texts."""
    base = df.select(F.col(id_col).alias("id"), content.alias("c")).withColumn("n", F.octet_length("c"))
    turns = base.filter("n > 0").select("id", "c", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    turned = turns.withColumn("turned", F.concat(F.expr("substring(c, pos + 1)"), F.expr("substring(c, 1, pos)")))
    ranked = turned.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("turned", "pos")) - 1)
    last = F.array_sort(F.collect_list(F.struct("rank", F.hex(F.expr("substring(turned, n, 1)")).alias("h"))))
    return ranked.groupBy("id").agg(F.min(F.when(F.col("pos") == 0, F.col("rank"))).alias("row"), F.array_join(F.transform(last, lambda x: x["h"]), "").alias("hex"))


def mtf(rows: DataFrame) -> DataFrame:
    """Place of a byte: how many distinct bytes came since its last place; at its first, itself plus the larger ones seen.

    A symbol's place counts as its last one from the position after it up to its next one, so each position meets as many rows
    as there are symbols before it, 256 at most, and not all earlier positions."""
    own = Window.partitionBy("id", "b").orderBy("pos")
    placed = rows.withColumn("last", F.lag("pos").over(own))
    until = F.coalesce(F.lead("pos").over(own), F.max("pos").over(Window.partitionBy("id")))
    spans = rows.select("id", F.col("b").alias("s"), F.col("pos").alias("p"), until.alias("until")).filter("p < until")
    seen = spans.select("id", "s", "p", F.explode(F.sequence(F.col("p") + 1, F.col("until"))).alias("pos"))
    counted = placed.join(seen, ["id", "pos"]).groupBy("id", "pos").agg(F.count(F.when(F.col("last").isNotNull() & (F.col("p") > F.col("last")), 1)).alias("since"), F.count(F.when(F.col("s") > F.col("b"), 1)).alias("larger"))
    place = F.when(F.col("last").isNull(), F.col("b") + F.coalesce("larger", F.lit(0))).otherwise(F.coalesce("since", F.lit(0))).cast("int")
    return _packed(placed.join(counted, ["id", "pos"], "left").withColumn("place", place), "place", "hex")

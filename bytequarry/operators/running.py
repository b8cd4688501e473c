"""Running sums over large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 10_000


def ranges(rows: DataFrame, order_col: str, buckets: int) -> list:
    """At most buckets - 1 cuts of the order column, from the SAMPLE rows with the least hash of it (a bounded collect)."""
    some = rows.select(F.col(order_col).alias("o")).filter("o is not null").orderBy(F.xxhash64("o"), "o").limit(SAMPLE)
    values = sorted(r["o"] for r in some.collect())
    return sorted({values[len(values) * k // buckets] for k in range(1, buckets)}) if values else []


def with_sum_before(rows: DataFrame, order_col: str, size_col: str, out_col: str, group_cols: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """Adds the sum of size over all rows before this one in its group, by order (null first; equal ones in any order).

    Rows are dealt into ranges of the order. A range's sums are windows of their own, and the sums of whole ranges, at most
    `buckets` for each group, are added; so a group is shared out among that many tasks."""
    part, total = "__part", "__range"
    cuts = ranges(rows, order_col, buckets)
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order_col))) if cuts else F.lit(0)
    dealt = rows.withColumn(part, F.coalesce(number, F.lit(-1)))
    before = Window.partitionBy(*group_cols).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group_cols, part).agg(F.sum(size_col).alias(total)).withColumn(total, F.coalesce(F.sum(total).over(before), F.lit(0)))
    own = F.sum(size_col).over(Window.partitionBy(*group_cols, part).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn(out_col, F.coalesce(own, F.lit(0)))
    named = sums.select(*[F.col(g).alias(f"__{g}") for g in group_cols], F.col(part).alias("__of"), total)
    same = F.col(part) == F.col("__of")
    for g in group_cols:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return placed.join(named, same).withColumn(out_col, F.col(out_col) + F.col(total)).select(*[F.col(f"`{c}`") for c in rows.columns], out_col)

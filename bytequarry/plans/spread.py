"""Parallelism for costly row-wise work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as there are cores. Only small inputs have fewer, so only they are moved; give
    it plans without an exchange, as it looks at their partitions."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)

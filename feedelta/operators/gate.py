"""The key gate: totals, common keys and duplicates of both sides from one shuffle of the key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedelta.operators.table import Table


def key_names(key: list[str]) -> list[str]:
    return [f"k{i}" for i in range(len(key))]


def keys(table: Table, key: list[str]) -> DataFrame:
    """line, k0..kn. Keys are compared exactly: no trimming, no case folding."""
    return table.df.select("line", *(table.cell(c).alias(k) for c, k in zip(key, key_names(key), strict=True)))


def key_sides(base: Table, new: Table, key: list[str]) -> DataFrame:
    """A row for each key with its number of rows on either side. Counts combine before the shuffle."""
    ks = key_names(key)
    both = keys(base, key).select(F.lit(1).alias("b"), F.lit(0).alias("n"), *ks).unionAll(keys(new, key).select(F.lit(0).alias("b"), F.lit(1).alias("n"), *ks))
    return both.groupBy(*ks).agg(F.sum("b").alias("n_base"), F.sum("n").alias("n_new"))


def gate(base: Table, new: Table, key: list[str]) -> DataFrame:
    """One row: total_base, total_new, common, duplicated_base, duplicated_new."""
    both = F.col("n_base") > 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    return key_sides(base, new, key).agg(
        zero(F.sum("n_base")).alias("total_base"),
        zero(F.sum("n_new")).alias("total_new"),
        F.count_if(both & (F.col("n_new") > 0)).alias("common"),
        F.count_if(F.col("n_base") > 1).alias("duplicated_base"),
        F.count_if(F.col("n_new") > 1).alias("duplicated_new"),
    )


def duplicate_keys(table: Table, key: list[str]) -> DataFrame:
    """k0..kn, n, first_line, second_line of every key that occurs more than once.

    The second line comes from a partial aggregation of the two smallest lines; no group is gathered.
    """
    ks = key_names(key)
    rows = keys(table, key)
    first = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line")).where("n > 1")
    second = (
        rows.join(first, ks)
        .where(F.col("line") > F.col("first_line"))
        .groupBy(*ks)
        .agg(F.first("n").alias("n"), F.first("first_line").alias("first_line"), F.min("line").alias("second_line"))
    )
    return second


def first_duplicate(table: Table, key: list[str]) -> DataFrame:
    """The duplicate that a reader from top to bottom meets first: the smallest second line."""
    return duplicate_keys(table, key).orderBy("second_line").limit(1)

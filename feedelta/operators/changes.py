"""Added, deleted and modified rows, field changes and per-column counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedelta.functions.csvtext import csv_line
from feedelta.functions.equality import differs
from feedelta.operators.gate import key_names
from feedelta.operators.table import Table


def _keyed(table: Table, key: list[str], columns: list[str], prefix: str) -> DataFrame:
    ks = [table.cell(c).alias(k) for c, k in zip(key, key_names(key), strict=True)]
    return table.df.select(F.col("line").alias(f"{prefix}_line"), *ks, *(table.cell(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)))


def identifier(key: list[str]) -> Column:
    """Map of key column to value, in key order; an absent optional column appears with ''."""
    return F.create_map(*(x for c, k in zip(key, key_names(key), strict=True) for x in (F.lit(c), F.col(k))))


def one_sided(table: Table, other: Table, key: list[str], union: list[str]) -> DataFrame:
    """Rows of `table` whose key the other side lacks: line, k0..kn, raw_value."""
    ks = key_names(key)
    rows = _keyed(table, key, union, "v")
    missing = rows.join(_keyed(other, key, [], "o").select(*ks), ks, "left_anti")
    return missing.select(F.col("v_line").alias("line"), *ks, csv_line([F.col(f"v{i}") for i in range(len(union))]).alias("raw_value"))


def added(base: Table, new: Table, key: list[str], union: list[str]) -> DataFrame:
    return one_sided(new, base, key, union)


def deleted(base: Table, new: Table, key: list[str], union: list[str]) -> DataFrame:
    return one_sided(base, new, key, union)


def common(base: Table, new: Table, key: list[str], shared: list[str]) -> DataFrame:
    """b_line, n_line, k0..kn, b0.., n0.. of keys on both sides; only the shared columns are read."""
    return _keyed(base, key, shared, "b").join(_keyed(new, key, shared, "n"), key_names(key))


def _compared(key: list[str], shared: list[str]) -> list[tuple[int, str]]:
    return [(i, c) for i, c in enumerate(shared) if c not in key]  # keys are equal by the join


def change_counts(base: Table, new: Table, key: list[str], shared: list[str]) -> DataFrame:
    """One row: modified, m0..mn (changes of each shared column over all rows)."""
    cols = _compared(key, shared)
    flags = common(base, new, key, [c for _, c in cols]).select(*(differs(F.col(f"b{j}"), F.col(f"n{j}")).alias(f"d{i}") for j, (i, _) in enumerate(cols)))
    any_ = F.greatest(*(F.col(f"d{i}") for i, _ in cols), F.lit(False)) if cols else F.lit(False)
    tested = {i for i, _ in cols}
    counts = [F.count_if(F.col(f"d{i}")) if i in tested else F.lit(0).cast("bigint") for i in range(len(shared))]
    return flags.agg(F.count_if(any_).alias("modified"), *(c.alias(f"m{i}") for i, c in enumerate(counts)))


def modified(base: Table, new: Table, key: list[str], shared: list[str], union: list[str] | None = None) -> DataFrame:
    """b_line, n_line, k0..kn, field_changes array<struct<field, base_value, new_value>>, raw_value of the base row.

    Values in field_changes are the untrimmed originals. raw_value is there only if `union` is given.
    """
    cols = _compared(key, shared)
    ks = key_names(key)
    b = _keyed(base, key, [c for _, c in cols], "b")
    if union is not None:
        raw = csv_line([base.cell(c) for c in union]).alias("raw_value")
        b = base.df.select(
            F.col("line").alias("b_line"),
            *(base.cell(c).alias(k) for c, k in zip(key, ks, strict=True)),
            *(base.cell(c).alias(f"b{j}") for j, (_, c) in enumerate(cols)),
            raw,
        )
    rows = b.join(_keyed(new, key, [c for _, c in cols], "n"), ks)
    kind = "array<struct<field:string,base_value:string,new_value:string>>"
    change = [
        F.when(differs(F.col(f"b{j}"), F.col(f"n{j}")), F.struct(F.lit(c).alias("field"), F.col(f"b{j}").alias("base_value"), F.col(f"n{j}").alias("new_value")))
        for j, (_, c) in enumerate(cols)
    ]
    changes = (F.array_compact(F.array(*change)) if change else F.array()).cast(kind)
    keep = ["b_line", "n_line", *ks, "field_changes", *(["raw_value"] if union is not None else [])]
    return rows.withColumn("field_changes", changes).where(F.size("field_changes") > 0).select(*keep)


def field_changes(base: Table, new: Table, key: list[str], shared: list[str]) -> DataFrame:
    """Long form: b_line, n_line, k0..kn, field, base_value, new_value."""
    rows = modified(base, new, key, shared)
    return rows.select("b_line", "n_line", *key_names(key), F.inline("field_changes"))


def earliest(df: DataFrame, by: str, limit: int | None) -> DataFrame:
    """Ordered by line; with a limit a bounded top-k instead of a full sort."""
    df = df.orderBy(by)
    return df if limit is None else df.limit(limit)

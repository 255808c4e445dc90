"""Added, deleted and modified rows from one pass: a full outer join of both sides on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedelta.functions.csvtext import csv_line
from feedelta.functions.equality import differs
from feedelta.operators.gate import key_names
from feedelta.operators.table import Table

CHANGES = "array<struct<field:string,base_value:string,new_value:string>>"


def compared(base: Table, new: Table, key: list[str], shared: list[str], union: list[str]) -> DataFrame:
    """A row for each key that was added, deleted or modified (keys are unique on either side).

    change, b_line, n_line, k0..kn, raw_value (of the base row, of an added row the new one), field_changes, d0..dn (whether
    each shared column differs). What a plan above doesn't use is neither read nor shuffled.
    """
    ks = key_names(key)
    tested = [i for i, c in enumerate(shared) if c not in key]  # keys are equal by the join

    def side(table: Table, prefix: str) -> DataFrame:
        cells = (table.cell(c).alias(k) for c, k in zip(key, ks, strict=True))
        return table.df.select(F.col("line").alias(f"{prefix}_line"), *cells, *(table.cell(c).alias(f"{prefix}{i}") for i, c in enumerate(union)))

    rows = side(base, "b").join(side(new, "n"), ks, "full_outer")
    both = F.col("b_line").isNotNull() & F.col("n_line").isNotNull()
    place = {c: i for i, c in enumerate(union)}
    unlike = {i: F.coalesce(both & differs(F.col(f"b{place[shared[i]]}"), F.col(f"n{place[shared[i]]}")), F.lit(False)) for i in tested}
    rows = rows.withColumns({"change": F.when(F.col("b_line").isNull(), "added").when(F.col("n_line").isNull(), "deleted").otherwise("modified"), **{f"d{i}": unlike.get(i, F.lit(False)) for i in range(len(shared))}})
    rows = rows.where((F.col("change") != "modified") | F.greatest(*(F.col(f"d{i}") for i in tested), F.lit(False), F.lit(False)))
    texts = [csv_line([F.col(f"{p}{i}") for i in range(len(union))]) for p in ("b", "n")]
    pair = lambda i: F.struct(F.lit(shared[i]).alias("field"), F.col(f"b{place[shared[i]]}").alias("base_value"), F.col(f"n{place[shared[i]]}").alias("new_value"))
    found = F.array_compact(F.array(*(F.when(F.col(f"d{i}"), pair(i)) for i in tested))).cast(CHANGES) if tested else F.array().cast(CHANGES)
    raw = F.when(F.col("change") == "added", texts[1]).otherwise(texts[0]).alias("raw_value")
    return rows.select("change", "b_line", "n_line", *ks, raw, found.alias("field_changes"), *(f"d{i}" for i in range(len(shared))))


def counts(rows: DataFrame, shared: list[str]) -> DataFrame:
    """One row from `compared`: added, deleted, modified, m0..mn (changes of each shared column)."""
    kinds = [F.count_if(F.col("change") == k).alias(k) for k in ("added", "deleted", "modified")]
    return rows.agg(*kinds, *(F.count_if(F.col(f"d{i}")).alias(f"m{i}") for i in range(len(shared))))


def listed(rows: DataFrame, change: str, limit: int | None = None) -> DataFrame:
    """The rows of one kind in the order of their line; with a limit a bounded top-k instead of a full sort."""
    some = rows.where(F.col("change") == change).orderBy("n_line" if change == "added" else "b_line")
    return some if limit is None else some.limit(limit)

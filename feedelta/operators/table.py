"""A table of one side: a header list on the driver and a lazy DataFrame with positional columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """df has `line` (bigint, 1-based record ordinal, header = 1) and c0..cn, one string column for each header."""

    headers: list[str]
    df: DataFrame

    @classmethod
    def of(cls, df: DataFrame, line: str = "line") -> Table:
        """From named columns; every value becomes text and null becomes the empty text."""
        names = [c for c in df.columns if c != line]
        cells = [F.coalesce(df[f"`{c}`"].cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(names)]
        return cls(names, df.select(df[f"`{line}`"].cast("bigint").alias("line"), *cells))

    def cell(self, name: str) -> Column:
        """The named column ('' if absent). Of repeated names the last one counts."""
        at = [i for i, c in enumerate(self.headers) if c == name]
        return F.col(f"c{at[-1]}") if at else F.lit("")

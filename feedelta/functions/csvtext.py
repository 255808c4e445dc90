"""A row as one line of CSV text, quoted only where it must be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\\r\\n]'), quoted).otherwise(c)


def csv_line(cells: list[Column]) -> Column:
    """Cells must not be null. A single empty cell is written as "" so that the line is not blank."""
    if len(cells) == 1:
        return F.when(cells[0] == "", F.lit('""')).otherwise(csv_cell(cells[0]))
    return F.concat_ws(",", *map(csv_cell, cells)) if cells else F.lit("")

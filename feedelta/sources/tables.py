"""CSV text as a Table.

Two readers give the same rows for ordinary files:

* strict - the record rules of Python's csv module in byte ranges of a file, see `feedelta.sources.strict`;
* native - Spark's own CSV scan. Without line breaks inside quotes it splits a file over many tasks. It drops blank
  lines and treats text after a closing quote literally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedelta.operators.table import Table
from feedelta.sources import strict
from feedelta.sources.feeds import FeedFile


def numbered(df: DataFrame) -> DataFrame:
    """Adds `line`: the place in scan order plus 2, from per-partition counts; no global sort or window."""
    tagged = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33))
    counts = dict(tagged.groupBy("_p").count().collect())  # one row for each input split
    start, starts = 2, {}
    for p in sorted(counts):
        starts[p] = start
        start += counts[p]
    if not starts:
        return tagged.select(F.lit(0).cast("bigint").alias("line"), *df.columns)
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(starts.items()), "_p bigint, _start bigint")
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(offsets), "_p").select((F.col("_start") + within).alias("line"), *df.columns)


def read_native(spark: SparkSession, path: str, headers: list[str], multi_line: bool = True, has_header: bool = True) -> Table:
    names = [f"c{i}" for i in range(len(headers))]
    schema = StructType([StructField(c, StringType()) for c in names])
    df = (
        spark.read.schema(schema)
        .options(header=has_header, enforceSchema=True, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8", mode="PERMISSIVE", nullValue="\x00", emptyValue="")
        .csv(path)
    )
    return Table(headers, numbered(df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in names))))


def read_strict(spark: SparkSession, path: str, headers: list[str]) -> Table:
    return Table(headers, strict.scan(spark, path, headers))


def read_table(spark: SparkSession, file: FeedFile, reader: str = "strict") -> Table:
    if not file.headers:
        return Table([], spark.createDataFrame([], strict.table_schema([])))
    if reader == "strict":
        return read_strict(spark, file.path, file.headers)
    return read_native(spark, file.path, file.headers, multi_line=reader != "native_split")

"""Shared folder, lineage cuts and batch bounds for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most this much, however long the texts are.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='feedelta-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: later stages start from files that outlive any executor. The folder goes
    with the driver, or earlier by `drop`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    got = spark.read.schema(df.schema).parquet(path)
    got._cut = path
    return got


def drop(*frames: DataFrame) -> None:
    """Deletes the files of cuts that no later plan reads."""
    for df in frames:
        fs, p = _hadoop(df.sparkSession, df._cut)
        fs.delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch; a smaller bound that the session has already is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_HELD: dict = {}


def held_by_worker(key, build):
    """What a Python worker keeps from task to task: one operator's model and caches at a time, so memory doesn't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release_memory() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can; otherwise the worker stays at its peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(batches: Iterator) -> Iterator:
    """The same batches; after the last one, freed memory is given back."""
    try:
        yield from batches
    finally:
        release_memory()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that have one of the output names, so that results never clash with extra input columns."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def words(text: Column) -> Column:
    """Words are runs of anything but the six ASCII white-space characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)


def word_count(text: Column) -> Column:
    """Number of words without building them: positions where a word starts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")

"""Canonical exact digests of documents.

A text is brought to canonical form: Unicode NFKC, full case folding, every run of Unicode white space one space, none at
the ends. Its digest is the 128-bit xxHash of that form in UTF-8. Documents whose digests are equal fall into one bucket,
and within a bucket the canonical bytes themselves are compared: should two forms ever share a digest, the fingerprint of
each gets the form's SHA-256 appended, so fingerprints are equal if and only if canonical forms are.

Likeness of two fingerprints is 1.0 if they are equal and 0.0 otherwise; this is an exact method.

Scale: a bucket is compared by the smallest and the largest bytes in it (kept in compressed form), which combine before
the shuffle, so a group of copies never meets in one task. The next document comes from a range of ids that each task
reads in order; the first document of a range is also sent to the range before it.

Defined results: a null text counts as empty; documents with equal ids follow each other by text (rows alike in both are
kept, each with its successor); rows with a null id come last; a single document is its own next one; an empty table
gives an empty table. Extra columns are ignored by edited_pairs, and kept by fingerprints unless they have a result's name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedelta.llm.common import bounded_batches, cut, fresh, without

_WHITE = re.compile(r"\s+")


def canonical(text: str | None) -> str:
    """NFKC, case folding and white-space folding, repeated until nothing changes; each step can undo another's work."""
    t = text or ""
    if t.isascii():
        return " ".join(t.lower().split())
    while True:
        u = " ".join(unicodedata.normalize("NFKC", t.casefold()).split())
        if u == t:
            return u
        t = u


def digest(form: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _pack(form: bytes) -> bytes:
    """Compressed bytes; equal if and only if the forms are, since the compressor is deterministic and lossless."""
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(form)


def _shared(pairs: DataFrame, key: str, form: str) -> DataFrame:
    """Digests under which two different forms met. Empty unless the hash collides."""
    return pairs.groupBy(key).agg(F.min(form).alias("lo"), F.max(form).alias("hi")).where(F.col("lo") != F.col("hi")).select(key)


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fingerprint; equal if and only if the canonical forms of the texts are equal."""
    import pyarrow as pa

    bounded_batches(df.sparkSession)
    df = without(df, "fingerprint")
    d, form, wide = fresh(df, "digest", "form", "wide")
    kept = df.columns
    schema = StructType(list(df.schema.fields)).add("fingerprint", "string").add(form, "binary").add(wide, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [canonical(t).encode() for t in b.column(text).to_pylist()]
            cols = [pa.array([digest(f) for f in forms], pa.string()), pa.array([_pack(f) for f in forms], pa.binary()), pa.array([hashlib.sha256(f).hexdigest() for f in forms], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], names=[*kept, "fingerprint", form, wide])

    rows = cut(df.mapInArrow(run, schema), "fingerprints")
    bad = _collided(rows, "fingerprint", form)
    return rows.withColumn("fingerprint", _told_apart("fingerprint", wide, bad)).drop(form, wide)


def _collided(rows: DataFrame, key: str, form: str) -> list[str]:
    """Colliding digests; with 128 bits there are none in any real table, and more than a few mean a broken hash."""
    bad = [r[0] for r in _shared(rows, key, form).limit(1001).collect()]
    if len(bad) > 1000:
        raise RuntimeError("more than 1000 digest collisions: the hash does not work")
    return bad


def _told_apart(key: str, wide: str, bad: list[str]):
    return F.when(F.col(key).isin(bad), F.concat(key, F.lit("-"), wide)).otherwise(F.col(key)) if bad else F.col(key)


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness, also with the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Likeness is decided on the
    canonical bytes. Should digests of unlike bytes be equal anywhere, all is done again with SHA-256 as the digest.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    sent, n = _with_next(df, id_col, text)
    if n == 0:
        return spark.createDataFrame([], RESULT)
    done = cut(sent.mapInArrow(_pairs(wide), RESULT + ", clash boolean"), "edited")
    if done.where("clash").limit(1).count() or _collided(_forms_of_equal(df, id_col, text, done, wide), "fingerprint", "form"):
        if wide:
            raise RuntimeError("SHA-256 digests of unlike texts are equal")
        return edited_pairs(df, id_col, text, wide=True)
    return done.drop("clash")


def _forms_of_equal(df: DataFrame, id_col: str, text: str, done: DataFrame, wide: bool) -> DataFrame:
    """fingerprint, form of the documents whose digest another row has too; the texts of others are not read into a shuffle."""
    import pyarrow as pa

    # Written first: a table joined with a table can be split where many documents have one digest.
    twice = cut(done.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "repeated")
    members = cut(done.join(twice, "fingerprint", "left_semi").select(F.col("doc_id").alias("member")).distinct(), "members")
    # Broadcast only up to a fixed number of ids; beyond it both sides are shuffled.
    side = F.broadcast(members) if members.count() <= BROADCAST_IDS else members
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    some = rows.join(side, rows["doc_id"].eqNullSafe(F.col("member")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [canonical(t).encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_hash(wide)(f) for f in forms], pa.string()), pa.array(list(map(_pack, forms)), pa.binary())], names=["fingerprint", "form"])

    return some.mapInArrow(run, "fingerprint string, form binary")


#: Ids of documents with equal digests that may be broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000


def _hash(wide: bool):
    return (lambda form: hashlib.sha256(form).hexdigest()) if wide else digest


def _with_next(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """Ranges of documents in order, each followed by the first document of the next range (halo = 1)."""
    spark = df.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 3 * tasks
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    inside = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda c: c <= F.col("doc_id"))) if bounds else F.lit(0)
    key = F.struct(F.col("doc_id").isNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.xxhash64("text").alias("c"))
    ranged = rows.withColumns({"part": F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(inside).cast("int"), "k": key})
    # The smallest key of each range; a row for each range reaches the driver.
    starts = sorted((r["part"], r["k"]) for r in ranged.groupBy("part").agg(F.min("k").alias("k")).collect())
    if not starts:
        return rows, 0
    names = [p for p, _ in starts]
    before = {p: names[i - 1] for i, p in enumerate(names)}  # before the first comes the last
    first = dict(starts)
    lit_key = lambda k: F.struct(F.lit(k["a"]).alias("a"), F.lit(k["b"]).cast("bigint").alias("b"), F.lit(k["c"]).cast("bigint").alias("c"))
    every = range(names[-1] + 1)
    targets = F.array(*(F.lit(before.get(p)).cast("int") for p in every))
    keys = F.array(*(lit_key(first.get(p, starts[0][1])) for p in every))
    to = F.when(F.col("k") == F.get(keys, F.col("part")), F.get(targets, F.col("part")))
    copies = F.array(F.struct(F.col("part").alias("to"), F.lit(0).alias("halo")), F.struct(to.alias("to"), F.lit(1).alias("halo")))
    sent = ranged.select("doc_id", "text", "k", F.inline(F.filter(copies, lambda x: x["to"].isNotNull())))
    return sent.repartition(tasks, "to").sortWithinPartitions("to", "halo", "k").select("to", "halo", "doc_id", "text"), len(starts)


def _pairs(wide: bool):
    import pyarrow as pa

    hashed = _hash(wide)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "clash"]

    def row(doc_id: int | None, t: str, following: str) -> tuple:
        changed = edited(t, following)
        forms = [canonical(x).encode() for x in (t, changed, following)]
        own, of_changed, of_next = map(hashed, forms)
        near = [f == forms[0] for f in forms]
        clash = (own == of_changed) != near[1] or (own == of_next) != near[2]
        return doc_id, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, of_changed, float(near[1]), float(near[2]), clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose successor is still to come
        for b in batches:
            out = []
            for to, halo, doc_id, t in zip(*(b.column(c).to_pylist() for c in ("to", "halo", "doc_id", "text")), strict=True):
                if held is not None and held[0] == to:
                    out.append(row(*held[1:], t))
                held = None if halo else (to, doc_id, t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


#: Columns of edited_pairs.
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

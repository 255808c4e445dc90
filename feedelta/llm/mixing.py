"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Every source has a weight schedule, linear over the training time t in 0..1: its weight at t is proportional to
1 + slope * (2 t - 1). The integral of the schedule gives the share of the source's words that is due by t; inverting it
gives the position of each word. A source's documents stand in the order of the MD5 of their id; their running word count
is the demand that the schedule has to have reached, so the middle of a document's words gives its position. A source
whose target exceeds its size is read again from the start, up to three times; the last reading stops where the target is
reached, inside a document if need be.

Targets: shares by weight of all words (weights 1, 2, 3, repeating over the sources in code-point order, null last), at
most REPEATS times a source's size, the excess shared again by weight until none is above.

Scale: sources are summed once (a row for each source reaches the driver, at most SOURCES); running counts are offsets of
hash ranges within a source plus a window inside each range. A source has 4096 ranges, and sixteen times as many whenever a
source with all rows would have more than RANGE_ROWS in one, so the largest task doesn't grow with the table. Window and
offsets share one partitioning: texts are dealt once to be numbered and once to be sorted.

Defined results: null and empty texts have size 0, take nothing and are not repeated; a source without words has target 0;
documents with equal ids follow each other by size and text hash; null ids are ordered by the hash of the text; extra columns
are ignored by `plan` and kept by `mix` (those that have a result's name are replaced); an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedelta.llm.common import cut, without, word_count

REPEATS = 3
#: Hash ranges of a source: the first hexadecimal digits of the MD5 of the id, at least so many, and more beyond so many rows a range.
DIGITS, RANGE_ROWS = 3, 20_000
#: Sources that a mix may have, and up to which their shares are broadcast (about 50 bytes each).
SOURCES, BROADCAST_SOURCES = 1_000_000, 100_000
#: Curriculum: later sources (by code point) come more and more to the end. Slopes by turn, each within -1..1.
SLOPES = (-0.5, 0.0, 0.5)


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    weight: int
    slope: float
    target: float


def targets(sizes: dict[str | None, int], repeats: int = REPEATS) -> list[Share]:
    """Shares of the sources. The level rises until every source is at its share by weight or at its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be", "surrogatepass")))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    slope = {s: SLOPES[i % 3] for i, s in enumerate(names)}
    limit = {s: float(repeats * sizes[s]) for s in names}
    left, open_weight = float(sum(sizes.values())), float(sum(weight.values()))
    got: dict[str | None, float] = {}
    for s in sorted(names, key=lambda s: (limit[s] / weight[s], names.index(s))):
        level = left / open_weight
        if limit[s] < level * weight[s]:
            got[s] = limit[s]
            left -= limit[s]
            open_weight -= weight[s]
        else:
            got |= {o: level * weight[o] for o in names if o not in got}
            break
    return [Share(s, sizes[s], weight[s], slope[s], got[s]) for s in names]


def due(t: Column, slope: Column) -> Column:
    """Share of a source's words due by time t: the integral of its schedule."""
    return (1 - slope) * t + slope * t * t


def when(share: Column, slope: Column) -> Column:
    """The time by which a share of a source's words is due: the inverse of `due`."""
    b = 1 - slope
    root = F.sqrt(b * b + 4 * slope * share)
    return F.when((slope == 0) | (share == 0), share).otherwise(2 * share / (b + root))


def digits(rows: int) -> int:
    """How many digits make the hash ranges. Ranges only say where rows are numbered: no result depends on them."""
    n = DIGITS
    while rows > RANGE_ROWS * 16**n:
        n += 1
    return n


def plan(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, part, position (of the first copy), and the columns `keep`."""
    key, src, size = F.col(f"`{id_col}`"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("-")), word_count(F.col(f"`{text}`"))
    order = F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("null"), F.xxhash64(F.col(f"`{text}`")).cast("string"))))
    sized = df.select(key.cast("bigint").alias("doc_id"), src.alias("src"), size.alias("size"), order.alias("h"), F.xxhash64(F.col(f"`{text}`")).alias("x"), *(F.col(f"`{c}`") for c in keep or []))
    if not keep:
        sized = cut(sized, "sizes")  # words are counted once
    sized = sized.withColumn("bucket", F.substring("h", 1, digits((df if keep else sized).count())))
    sums = cut(sized.groupBy("src", "bucket").agg(F.sum("size").alias("n")), "sums")
    named = lambda src: None if src == "-" else src[1:]
    per_source = {named(r["src"]): r["n"] for r in sums.groupBy("src").agg(F.sum("n").alias("n")).limit(SOURCES + 1).collect()}
    if len(per_source) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources to mix")
    shares = df.sparkSession.createDataFrame(
        [("-" if s.source is None else f"s{s.source}", s.size, s.target, s.slope) for s in targets(per_source)], "src string, source_size bigint, target double, slope double"
    )
    if len(per_source) <= BROADCAST_SOURCES:
        shares = F.broadcast(shares)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("src", "bucket", before.alias("offset"))
    w = Window.partitionBy("src", "bucket").orderBy("h", "size", "x").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("within", F.coalesce(F.sum("size").over(w), F.lit(0)))
    rows = rows.join(offsets, ["src", "bucket"]).join(shares, "src")
    rows = rows.withColumn("start", F.col("offset") + F.col("within"))
    # Whole words of the target; whole readings of the source; words of the last reading.
    words = F.floor("target").cast("bigint")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = words - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("bigint")
    rows = rows.withColumns({"copies": full, "part": part})
    taken = F.col("copies") * F.col("size") + F.col("part")
    middle = F.col("start") + F.when(F.col("copies") > 0, F.col("size")).otherwise(F.col("part")) / 2.0
    place = F.when(taken > 0, when(middle / F.col("target"), F.col("slope")))
    out = ["doc_id", "size", "source_size", "target", taken.alias("taken"), "copies", "part", place.alias("position")]
    return rows.select(*out, *(F.col(f"`{c}`") for c in keep or []), "start", "slope")


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows of df in training order: each as often as it is read, with `position`. The last reading of a source has whole
    documents: the one in which the target lies is read if at least half of it is due."""
    df = without(df, "position")
    names = df.columns
    # Input columns travel under names that cannot clash with those of the plan.
    inner = df.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)))
    at = {c: f"in_{i}" for i, c in enumerate(names)}
    rows = plan(inner, at[id_col], at[text], at[source], keep=list(at.values()))
    times = F.col("copies") + (F.col("part") * 2 >= F.col("size")).cast("bigint")
    rows = rows.where(F.col("size") > 0).withColumn("times", times).where(F.col("times") > 0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    middle = F.col("copy") * F.col("source_size") + F.col("start") + F.col("size") / 2.0
    rows = rows.withColumn("position", when(F.least(middle / F.col("target"), F.lit(1.0)), F.col("slope")))
    return rows.orderBy("position", "doc_id", "copy").select(*(F.col(v).alias(c) for c, v in at.items()), "position")


#: DuckDB SQL for doc_id, size, source_size, target, taken, position over documents (ids unique and not null).
SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
 l AS (SELECT *, 3.0::DOUBLE * source_size AS lim, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, i) AS k FROM s),
 c AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY k DESC)::DOUBLE AS ow FROM l),
 f AS (SELECT min(k) AS k FROM c WHERE NOT lim < rest / ow * w),
 v AS (SELECT rest / ow AS level FROM c WHERE k = (SELECT k FROM f)),
 t AS (SELECT source, source_size, ((w - 2) * 0.5)::DOUBLE AS slope, CASE WHEN (SELECT k FROM f) IS NULL OR k < (SELECT k FROM f) THEN lim ELSE (SELECT level FROM v) * w END AS target FROM c),
 r AS (SELECT d.*, source_size, target, slope, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS copies FROM r),
 p AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0, least(size, floor(target)::BIGINT % source_size - start)) ELSE 0 END AS part FROM n),
 m AS (SELECT *, (start::DOUBLE + (CASE WHEN copies > 0 THEN size ELSE part END)::DOUBLE / 2.0::DOUBLE) / target AS due FROM p)
SELECT doc_id, size, source_size, target, (copies * size + part)::BIGINT AS taken, CASE WHEN copies * size + part > 0 THEN CASE WHEN slope = 0 OR due = 0 THEN due
 ELSE 2::DOUBLE * due / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4::DOUBLE * slope * due)) END END AS position FROM m"""

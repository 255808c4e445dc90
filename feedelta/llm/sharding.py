"""Sharding by a Feistel permutation of global row numbers (DataFrame operations only).

Rows are numbered 0..n-1 in the order of their id. A Feistel network over the pairs (l, r) with l < a and r < b, where
a * b is just above n, permutes these numbers; a result outside 0..n-1 is permuted again (cycle walking) until it lies
inside. Shard and slot are then computed: place mod shards and place div shards. Counts of shards differ by one at most,
slots have no gaps, and the place of a row follows from its number, n and the seed alone - on any machine, in any order.

Row numbers need no global sort in one task: rows are dealt to ranges of the id, ranges are counted, and a row's number
is its range's offset plus its rank within. Ids that fill more than one range are dealt further by a hash of the row.

Defined results: rows with a null id come last; rows with equal ids are numbered by size, checksum of the text and hash
of the row (rows alike in everything are interchangeable); a null text has size 1 and the checksum of the empty text; an
empty table gives an empty table. Input columns are kept except those that have a result's name. The law kept here is
`rows`: equal texts are not held together, since one group may be larger than a shard.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedelta.llm.common import cut, fresh, without

ROUNDS = 4
#: The round function works modulo 2 ** 31 - 1, so halves are below that and tables below 2 ** 62 rows.
PRIME = 2**31 - 1
#: Ids that fill more than one range are dealt to as many parts.
PARTS = 64


def dimensions(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _constants(i: int, half: int, seed: int) -> list[int]:
    """Six numbers below PRIME for one half of one round."""
    raw = hashlib.sha256(f"{seed}/{i}/{half}".encode()).digest()
    return [int.from_bytes(raw[k : k + 4], "big") % (PRIME - 1) + 1 for k in range(0, 24, 4)]


def _keys(half: int, seed: int) -> Column:
    """The constants of all rounds."""
    return F.array(*(F.array(*(F.lit(c).cast("bigint") for c in _constants(i, half, seed))) for i in range(ROUNDS)))


def _mixed(x: Column, k: Column, size: int) -> Column:
    """Below size: two quadratic residues of x side by side. Nothing here leaves 62 bits."""
    p, q = F.lit(PRIME).cast("bigint"), F.lit(PRIME).cast("bigint")
    y, z = (x % p * k[0] + k[1]) % p, (x % p * k[2] + k[3]) % p
    return (((y * y + k[4]) % p) * q + (z * z + k[5]) % q) % F.lit(size).cast("bigint")


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The place of a row number: a bijection of 0..n-1."""
    a, b = dimensions(n)

    big = lambda v: F.lit(v).cast("bigint")

    def network(x: Column) -> Column:
        def round_(s: Column, i: Column) -> Column:
            left = (s["l"] + _mixed(s["r"], F.get(_keys(0, seed), i), a)) % big(a)
            # The new left half is a lambda's variable, so that it is computed once.
            return F.aggregate(F.array(left), s, lambda t, new: F.struct(new.alias("l"), ((t["r"] + _mixed(new, F.get(_keys(1, seed), i), b)) % big(b)).alias("r")))

        first = F.struct(((x - x % big(b)) / big(b)).cast("bigint").alias("l"), (x % big(b)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, round_, lambda s: s["l"] * big(b) + s["r"])

    # At most a * b - n places lie outside, so a walk has no more steps; with many rows a step fails with chance below 1 / b.
    steps = min(a * b - n, 64)
    start = network(number.cast("bigint"))
    if steps == 0:
        return start
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.aggregate(F.array(walked), F.lit(-1).cast("bigint"), lambda _, x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint")))


def numbered(df: DataFrame, order: list[str], name: str, ranges: int | None = None) -> tuple[DataFrame, int]:
    """df with the row's number in the order of the columns named, and the number of rows.

    The first column is the id (bigint). Only ids and counts of ranges reach the driver, as many as there are ranges.
    """
    key = order[0]
    ranges = ranges or max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    part, sub, start = fresh(df, "part", "sub", "start")
    at = F.when(F.col(key).isNull(), F.lit(len(bounds) + 1))
    # The position among at most `ranges` bounds.
    at = at.otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda c: c <= F.col(key))) if bounds else F.lit(0))
    dealt = F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")
    held = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    tagged = df.withColumn(part, at.cast("int")).withColumn(sub, F.when(held, dealt).otherwise(F.lit(-1)))
    counts = sorted((r[0], r[1], r[2]) for r in tagged.groupBy(part, sub).count().collect())
    total, rows = 0, []
    for p, s, n in counts:
        rows.append((p, s, total))
        total += n
    offsets = df.sparkSession.createDataFrame(rows, f"`{part}` int, `{sub}` int, `{start}` bigint")
    rank = F.row_number().over(Window.partitionBy(part, sub).orderBy(*(F.col(c).asc_nulls_last() for c in order)))
    out = tagged.withColumn(name, rank.cast("bigint") - 1).join(F.broadcast(offsets), [part, sub])  # a row for each range
    return out.withColumn(name, F.col(name) + F.col(start)).drop(part, sub, start), total


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with size, text_crc32, law, shard, slot, grown_shard."""
    results = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    (number, key, row) = fresh(df, "number", "key", "row")
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = df.withColumns({key: F.col(f"`{id_col}`").cast("bigint"), row: F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")))})
    size, crc = F.octet_length(held).cast("bigint") + 1, F.crc32(held.cast("binary"))
    kept = without(df.select(*(f"`{c}`" for c in keep)) if keep else df, *results).columns
    sized = sized.select(*(F.col(f"`{c}`") for c in kept), key, row, size.alias("size"), crc.alias("text_crc32"))
    if keep:
        sized = cut(sized, "sizes")  # texts are read once
    rows, n = numbered(sized, [key, "size", "text_crc32", row], number)
    place = permuted(F.col(number), max(n, 1), seed)
    return (
        rows.withColumn(number, place)
        .withColumns({
            "law": F.lit("rows"),
            "shard": F.pmod(F.col(number), F.lit(shards)).cast("int"),
            "slot": ((F.col(number) - F.pmod(F.col(number), F.lit(shards))) / shards).cast("bigint"),
            "grown_shard": F.lit(None).cast("int"),
        })
        .drop(number, key, row)
    )


def write(df: DataFrame, path: str) -> None:
    """A folder for each shard, rows in slot order."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _network_sql(x: str, seed: int) -> str:
    """The place of x by the same rounds, from a query with doc_id, x and the dimensions a, b, n."""

    def mixed(v: str, i: int, half: int, size: str) -> str:
        c = _constants(i, half, seed)
        part = lambda m, add, plus: f"((({v} % {PRIME} * {m} + {add}) % {PRIME}) * (({v} % {PRIME} * {m} + {add}) % {PRIME}) + {plus}) % {PRIME}"
        return f"((({part(c[0], c[1], c[4])}) * {PRIME} + ({part(c[2], c[3], c[5])})) % {size})"

    q = f"SELECT doc_id, n, a, b, x // b AS l, x % b AS r FROM ({x})"
    for i in range(ROUNDS):
        q = f"SELECT doc_id, n, a, b, (l + {mixed('r', i, 0, 'a')}) % a AS l, r FROM ({q})"
        q = f"SELECT doc_id, n, a, b, l, (r + {mixed('l', i, 1, 'b')}) % b AS r FROM ({q})"
    return f"SELECT doc_id, n, a, b, l * b + r AS x FROM ({q})"


#: DuckDB SQL for doc_id, size, text_crc32, law, shard, slot, grown_shard over documents (ids unique and not null), 16 shards.
#: The checksum is that of the table-driven rule for the polynomial 0xEDB88320, byte by byte.
SQL = f"""WITH RECURSIVE c AS (SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
 d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT)), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM documents, c),
 m AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, greatest(1, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1) AS a FROM (SELECT count(*) AS n FROM documents))),
 x AS (SELECT doc_id, n, a, b, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM documents, m),
 w AS ({_network_sql("SELECT * FROM x", 0)} UNION ALL {_network_sql("SELECT * FROM w WHERE x >= n", 0)})
SELECT d.doc_id, size, text_crc32, 'rows' AS law, (x % 16)::INT AS shard, (x // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM d JOIN w ON d.doc_id = w.doc_id AND x < n"""

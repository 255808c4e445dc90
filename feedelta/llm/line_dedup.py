"""Cross-site boilerplate lines by distinct-site spread (DataFrame operations only).

A line's spread is the number of different sites on which it occurs. Lines are counted by a 128-bit hash of their trimmed
text. Lines that occur often enough to matter get a HyperLogLog sketch of their sites; sketches merge by aggregation, so a
line that is everywhere costs no task more than its own rows. Lines whose estimate lies near the threshold are counted
exactly. Lines at or above the threshold are removed from every document but the first (smallest id, then text hash), so
what is on many sites stays in the data once.

Defined results: a null text stays null and an empty one empty; blank lines are never removed; a null site counts as one
site of its own; rows alike in id and text lose the same lines; of rows with a null id the smallest text hash comes first,
after all ids; the order of the remaining lines is kept; a text of which every line goes becomes empty, and its row stays;
extra columns are kept, those that have a result's name are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedelta.llm.common import cut, fresh, without

MIN_SITES = 10
#: Registers of a sketch as a power of two; the estimate's relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Estimates within so many standard errors of the threshold are settled exactly.
ERRORS = 4
#: Lines that may be broadcast (about 40 bytes each).
BROADCAST_LINES = 500_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines that occur on at least min_sites sites. lines: h1, h2, site (not null)."""
    key = ["h1", "h2"]
    # A line's rows on one site become one row before anything is joined, so a line that is everywhere has a row for each site.
    pairs = cut(lines.groupBy(*key, "site").agg(F.count(F.lit(1)).alias("n")), "line-sites")
    # A line has no more sites than rows here.
    often = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_sites).select(*key)
    some = cut(pairs.join(cut(often, "often"), key, "left_semi").select(*key, "site"), "frequent-lines")
    sketched = some.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    sketched = cut(sketched, "sketched")
    band = ERRORS * 1.04 / (2 ** (LG_K / 2)) * min_sites + 1
    near = cut(sketched.where(F.abs(F.col("sites") - min_sites) <= band).select(*key), "near")
    exact = some.join(near, key, "left_semi").select(*key, "site").distinct().groupBy(*key).count().where(F.col("count") >= min_sites)
    return sketched.where(F.col("sites") > min_sites + band).select(*key).unionAll(exact.select(*key))


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """df with cleaned text, n_lines and n_removed."""
    df = without(df, "n_lines", "n_removed")
    key, digest, gone, rk, rd = fresh(df, "key", "digest", "gone", "rk", "rd")
    t = F.col(f"`{text}`")
    keyed = df.withColumns({key: F.col(f"`{id_col}`").cast("bigint"), digest: F.xxhash64(t)})
    who = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site}`").cast("string")), F.lit("-")).alias("site")
    rows = keyed.where(t.isNotNull()).select(F.col(key).alias("id"), F.col(digest).alias("d"), who, F.posexplode(F.split(t, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", trimmed(F.col("line"))).where(F.col("line") != "")
    lines = cut(rows.select("id", "d", "site", "pos", *_hashes(F.col("line"))), "lines")
    common = cut(spread(lines.select("h1", "h2", "site"), min_sites), "boilerplate")
    # Boilerplate is few lines as a rule: up to a fixed number of them it is broadcast, beyond it both sides are shuffled.
    few = F.broadcast if common.count() <= BROADCAST_LINES else lambda x: x
    found = cut(lines.join(few(common), ["h1", "h2"], "left_semi"), "boilerplate-places")
    first = cut(found.groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "d")).alias("f")), "first-places")
    later = found.join(few(first), ["h1", "h2"]).where(~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("d") == F.col("f.d"))))
    drops = later.groupBy(F.col("id").alias(rk), F.col("d").alias(rd)).agg(F.collect_set("pos").alias(gone))
    out = keyed.join(drops, F.col(key).eqNullSafe(F.col(rk)) & (F.col(digest) == F.col(rd)), "left")
    parts = F.split(t, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i))
    cleaned = F.when(F.col(gone).isNull(), t).otherwise(F.array_join(kept, "\n"))
    counts = {
        "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("bigint"),
        "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint"),
    }
    out = out.withColumns(counts | {gone: cleaned})
    return out.select(*(F.col(gone).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns), "n_lines", "n_removed")


#: DuckDB SQL for doc_id, n_lines, n_removed, text_sha256 over documents (ids and sources not null, ids unique).
SQL = f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 k AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
 b AS (SELECT line, min(doc_id) AS first FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
 m AS (SELECT k.*, b.line IS NOT NULL AND k.doc_id <> b.first AS gone FROM k LEFT JOIN b ON k.line = b.line),
 g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(g.text, '')) END AS text_sha256 FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""

"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. The index is cut into shards; each shard posts its vectors
under their pivots together with the pivot's place in the order (pivot inverted files). A query reads the lists of its
own nearest pivots, ranks what it meets by footrule distance between the two orders, and the best part of a shard is
ranked again by the exact inner product in double precision.

Equal vectors form one class that is indexed once and carries its smallest row ids: the k + 1 smallest are all that any
answer can hold. Ties in the inner product go to the smaller id.

A query meets the lists of PREFIX of PIVOTS pivots, since few lists hold too few of the true neighbours where vectors have
no clusters: of 51,282 vectors with 64 dimensions, the lists of the 32 nearest of 256 pivots hold 0.56 of them.

Bounds: pivots come from a sample of at most `sample` vectors (those with the smallest hash of their id); every vector is
indexed. A shard is one row of at most about SHARD_ROWS vectors, a query block at most BLOCK_ROWS, and Python holds one
pair of them at a time. Each block meets each shard once: the stated query set against all rows, in blocks.

Defined results: null vectors, zero vectors and vectors with null or non-finite components take no part, nor do vectors
of another length than the table's most frequent one (the smaller of equally frequent lengths) and rows without an id.
Rows that repeat an id and a vector count once. An empty table, or one without queries, gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedelta.llm.common import cut

SHARD_ROWS, BLOCK_ROWS = 8192, 512
PIVOTS, PREFIX, SAMPLE = 256, 64, 4096
#: Part of the vectors that is ranked again, and the least number of them for each answer that is asked for.
RERANK, RERANK_LEAST = 0.1, 16


def clean(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id bigint, v array<double>, dim int) of the vectors that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.coalesce(ok, F.lit(False))).withColumn("dim", F.size("v"))
    most = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.where(F.col("dim") == (most[0]["dim"] if most else 0))


def _pivots(rows: DataFrame, n: int, sample: int):
    """At most n distinct vectors of a bounded sample."""
    import numpy as np

    got = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not got:
        return np.zeros((0, 1))
    x = np.unique(np.array([r["v"] for r in got]), axis=0)
    x = x[np.random.default_rng(7).permutation(len(x))]
    return x[:n]


def classes(rows: DataFrame, k: int) -> DataFrame:
    """class (its smallest id), v, members (its k + 1 smallest ids). Only these ids leave the map side of a large class."""
    w = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").distinct().withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("members")).select(F.col("members")[0].alias("class"), "v", F.slice("members", 1, k + 1).alias("members"))


def _matrices(df: DataFrame, name: str, parts: int, seed: int) -> DataFrame:
    """One row for each of `parts` groups of classes: its ids and its vectors as one binary matrix of doubles."""
    part = F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(parts)).alias("part")

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v = table["v"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        return pa.table({name: pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "x": pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary())})

    return df.select(part, F.col("class").alias("id"), "v").groupBy("part").applyInArrow(run, f"{name} bigint, ids binary, x binary")


class Index:
    """One shard: pivot inverted files in the form of offsets, local rows and places."""

    def __init__(self, x, pivots, prefix: int):
        import numpy as np

        self.x, self.pivots = x, pivots
        self.prefix = min(prefix, len(pivots))
        order = nearest_pivots(x, pivots, self.prefix)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // self.prefix).astype(np.int32)
        self.places = (by % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def candidates(self, order, n: int):
        """The n rows with the smallest induced footrule distance to a query's pivot order, from its pivots' lists."""
        import numpy as np

        near = np.zeros(len(self.x), np.int32)
        for place, p in enumerate(order):
            a, b = self.starts[p], self.starts[p + 1]
            near[self.rows[a:b]] -= self.prefix - np.abs(self.places[a:b] - place)
        return np.arange(len(near)) if n >= len(near) else np.argpartition(near, n - 1)[:n]

    def search(self, q, ids, k: int, n: int):
        """(query, row) positions and scores: the best k of n candidates of this shard, ties to the smaller id."""
        import numpy as np

        orders = nearest_pivots(q, self.pivots, self.prefix)
        at, rows, scores = [], [], []
        for i in range(len(q)):
            c = self.candidates(orders[i], n)
            if len(c) > 2 * k:  # a fast product leaves those that may be among the best; equal vectors are one row, so ties are rare
                c = c[np.argpartition(-(self.x[c] @ q[i]), 2 * k - 1)[: 2 * k]]
            s = (self.x[c] * q[i]).sum(axis=1)
            best = np.lexsort((ids[c], -s))[:k]
            at.append(np.full(len(best), i))
            rows.append(c[best])
            scores.append(s[best])
        return np.concatenate(at), np.concatenate(rows), np.concatenate(scores)


def nearest_pivots(x, pivots, prefix: int):
    import numpy as np

    s = x @ pivots.T
    part = np.argpartition(-s, prefix - 1, axis=1)[:, :prefix] if prefix < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(x), 1))
    inner = np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, inner, 1)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, sample: int = SAMPLE) -> DataFrame:
    """The k nearest found for each query row among all other rows: query_id, rank, vec_id, score.

    is_query is a condition on the column `id` (the id as bigint). The result has fewer than k rows for a query only if there are fewer
    candidates.
    """
    spark = df.sparkSession
    rows = clean(df, id_col, vector)
    queries = rows.where(is_query).select("id", "v").distinct()
    piv = spark.sparkContext.broadcast(_pivots(rows, pivots, sample))
    table = cut(classes(rows, k), "classes")
    n = table.count()
    shards = max(1, -(-n // SHARD_ROWS))
    index = _matrices(table, "shard", shards, 0)
    owners = cut(queries.join(table.select(F.col("v"), "class"), "v").select(F.col("id").alias("query_id"), "class"), "owners")
    asked = owners.select("class").distinct().join(table, "class")
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // BLOCK_ROWS))
    packed = _matrices(asked, "block", blocks, 1)
    to_all = packed.withColumnsRenamed({"ids": "q_ids", "x": "q"}).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    pairs = to_all.join(index, "shard").select("ids", "x", "q_ids", "q")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kept: tuple = (None, None)
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][r].as_py(), "<i8")
                q_ids = np.frombuffer(batch["q_ids"][r].as_py(), "<i8")
                q = np.frombuffer(batch["q"][r].as_py(), "<f8").reshape(len(q_ids), -1)
                if kept[0] is None or not np.array_equal(kept[0], ids):
                    kept = ids, Index(np.frombuffer(batch["x"][r].as_py(), "<f8").reshape(len(ids), -1), piv.value, prefix)
                share = max(rerank * len(ids), RERANK_LEAST * (k + 1) * len(ids) / n)
                at, rows_, scores = kept[1].search(q, ids, k + 1, max(k + 1, int(np.ceil(share))))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[rows_]), pa.array(scores)], names=["asked", "class", "score"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    many = spark.conf.get(key)
    spark.conf.set(key, "2")  # a row holds a whole shard
    try:
        found = cut(pairs.mapInArrow(run, "asked bigint, class bigint, score double"), "found")
    finally:
        spark.conf.set(key, many)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "class")
    near = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    near = near.join(table.select("class", "members"), "class").select("asked", "score", F.explode("members").alias("vec_id"))
    top = near.withColumn("at", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= k + 1)
    # An answer of a class has its k + 1 nearest rows; each query row of the class leaves itself out.
    lists = top.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("list"))
    own = owners.join(lists, F.col("asked") == F.col("class")).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return own.select("query_id", F.posexplode("list")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))

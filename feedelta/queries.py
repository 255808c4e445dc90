"""The registered queries over base/new pairs derived from the test tables, each with its SQL for DuckDB.

A pair is plain SQL that both engines read; {table} stands for the parquet table. `line` = key + 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedelta import feed_queries
from feedelta.functions.csvtext import csv_line
from feedelta.functions.equality import differs
from feedelta.operators import changes, compare
from feedelta.operators import gate as gates
from feedelta.operators.table import Table
from feedelta.plans import planning, registry
from feedelta.session import Scratch

# --- base/new pairs ---------------------------------------------------------------------------------------------------

_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)"
ORDERS_BASE = f"""SELECT o_orderkey + 2 AS line, CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey,
  o_orderstatus, {_MONEY} AS o_totalprice, o_orderpriority FROM {{orders}} WHERE o_orderkey % 11 <> 0"""
ORDERS_NEW = f"""SELECT o_orderkey + 2 AS line, CAST(o_orderkey AS STRING) AS o_orderkey, CAST(o_custkey AS STRING) AS o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(CAST(o_totalprice + 1 AS DECIMAL(12,2)) AS STRING)
       WHEN o_orderkey % 5 = 0 THEN concat({_MONEY}, '00') ELSE {_MONEY} END AS o_totalprice,
  CASE WHEN o_orderkey % 19 = 0 THEN '9-CHANGED' WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority)
       WHEN o_orderkey % 17 = 0 THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS o_orderpriority,
  'n' AS o_note FROM {{orders}} WHERE o_orderkey % 13 <> 0"""
#: The customers get new identifiers, and the orders follow.
CHURN_SHIFT = 1_000_000_000
CUSTOMER_BASE = "SELECT c_custkey + 2 AS line, CAST(c_custkey AS STRING) AS c_custkey, c_name FROM {customer}"
CUSTOMER_NEW = f"SELECT c_custkey + 2 AS line, CAST(c_custkey + {CHURN_SHIFT} AS STRING) AS c_custkey, c_name FROM {{customer}}"
FK_NEW = ORDERS_NEW.replace("CAST(o_custkey AS STRING)", f"CAST(o_custkey + {CHURN_SHIFT} AS STRING)")
PART_BASE = "SELECT p_partkey + 2 AS line, CAST(p_partkey AS STRING) AS p_partkey, p_name FROM {part} WHERE p_partkey % 3 = 0"
PART_NEW = "SELECT p_partkey + 2 AS line, CAST(p_partkey AS STRING) AS p_partkey, p_name FROM {part}"
TALK_BASE = "SELECT conv_id * 100 + turn + 2 AS line, CAST(conv_id AS STRING) AS conv_id, CAST(turn AS STRING) AS turn, role, text FROM {conversations}"
TALK_NEW = TALK_BASE + " WHERE turn % 5 <> 4"
EVENT_BASE = "SELECT event_id + 2 AS line, CAST(event_id AS STRING) AS event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS event_type FROM {events}"
EVENT_NEW = "SELECT event_id + 2 AS line, CAST(event_id AS STRING) AS event_id FROM {events}"
NATION_BASE = "SELECT n_nationkey + 2 AS line, CAST(n_nationkey AS STRING) AS n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM {nation}"
NATION_NEW = "SELECT n_nationkey + 2 AS line, CAST(n_nationkey AS STRING) AS n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN concat(n_name, '!') ELSE n_name END AS n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM {nation}"
LINES = "SELECT l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1 AS line, CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber FROM {lineitem}"
LABELS_BASE = "SELECT doc_id + 2 AS line, CAST(doc_id AS STRING) AS doc_id FROM {labels}"

ORDERS_KEY = ["o_orderkey"]
CAP = 20
ORDER_COLUMNS = {"base": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], "new": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_note"]}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _sql(text: str) -> str:
    return text.format(**{t: t for t in _TABLES})


def _pair_sql(base: str, new: str) -> str:
    return f"WITH b AS ({_sql(base)}), n AS ({_sql(new)}) "


def _table(spark: SparkSession, sf: str, text: str) -> Table:
    used = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    return Table.of(spark.sql(text, **used))


def _orders(spark: SparkSession, sf: str, new: str = ORDERS_NEW) -> tuple[Table, Table]:
    return _table(spark, sf, ORDERS_BASE), _table(spark, sf, new)


# --- the DuckDB side of tolerant equality; the pairs hold no numeral on which the engines' casts disagree ---------------

_DIFF = "(lower(trim({0})) <> lower(trim({1})) AND NOT coalesce(try_cast(trim({0}) AS DOUBLE) = try_cast(trim({1}) AS DOUBLE), false))"
_PRICE = _DIFF.format("b.o_totalprice", "n.o_totalprice")
_PRIO = _DIFF.format("b.o_orderpriority", "n.o_orderpriority")
_CUST = _DIFF.format("b.o_custkey", "n.o_custkey")
_JOINED = "b JOIN n ON b.o_orderkey = n.o_orderkey"
_OPAIR = _pair_sql(ORDERS_BASE, ORDERS_NEW)
_cell = lambda c: f"CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') THEN concat('\"', replace({c}, '\"', '\"\"'), '\"') ELSE {c} END"
_line = lambda *cs: "concat_ws(',', " + ", ".join(map(_cell, cs)) + ")"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return put


# --- keys and joins ----------------------------------------------------------------------------------------------------


@query(_OPAIR + """SELECT (SELECT count(*) FROM b) AS total_base, (SELECT count(*) FROM n) AS total_new,
 (SELECT count(*) FROM b SEMI JOIN n USING (o_orderkey)) AS common, 0::BIGINT AS duplicated_base, 0::BIGINT AS duplicated_new""")
def key_set_counts(spark, sf):
    return gates.gate(*_orders(spark, sf), ORDERS_KEY)


@query(_OPAIR + f"SELECT line, o_orderkey, {_line('o_orderkey', 'o_custkey', chr(39) * 2, 'o_totalprice', 'o_orderpriority', 'o_note')} AS raw_value FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = n.o_orderkey)")
def rows_added(spark, sf):
    b, n = _orders(spark, sf)
    union = planning.column_changes(b.headers, n.headers)[2]
    return changes.added(b, n, ORDERS_KEY, union).withColumnRenamed("k0", "o_orderkey")


@query(_OPAIR + f"SELECT line, o_orderkey, {_line('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority', chr(39) * 2)} AS raw_value FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE b.o_orderkey = n.o_orderkey)")
def rows_deleted(spark, sf):
    b, n = _orders(spark, sf)
    union = planning.column_changes(b.headers, n.headers)[2]
    return changes.deleted(b, n, ORDERS_KEY, union).withColumnRenamed("k0", "o_orderkey")


@query(_OPAIR + f"SELECT b.line AS b_line, n.line AS n_line, b.o_orderkey FROM {_JOINED}")
def common_keys(spark, sf):
    return changes.common(*_orders(spark, sf), ORDERS_KEY, []).withColumnRenamed("k0", "o_orderkey")


@query(_OPAIR + f"SELECT b.line AS b_line, n.line AS n_line, b.o_orderkey, CAST({_PRICE} AS INT) + CAST({_PRIO} AS INT) AS n_changes, {_line('b.o_orderkey', 'b.o_custkey', 'b.o_orderstatus', 'b.o_totalprice', 'b.o_orderpriority', chr(39) * 2)} AS raw_value FROM {_JOINED} WHERE {_PRICE} OR {_PRIO}")
def rows_modified(spark, sf):
    b, n = _orders(spark, sf)
    shared = planning.shared_columns(b.headers, n.headers)
    union = planning.column_changes(b.headers, n.headers)[2]
    rows = changes.modified(b, n, ORDERS_KEY, shared, union)
    return rows.select("b_line", "n_line", F.col("k0").alias("o_orderkey"), F.size("field_changes").alias("n_changes"), "raw_value")


def _changes_sql(new: str, cols: list[tuple[str, str]]) -> str:
    parts = [f"SELECT b.line AS b_line, n.line AS n_line, b.o_orderkey, '{c}' AS field, b.{c} AS base_value, n.{c} AS new_value FROM {_JOINED} WHERE {p}" for c, p in cols]
    return _pair_sql(ORDERS_BASE, new) + " UNION ALL ".join(parts)


@query(_changes_sql(ORDERS_NEW, [("o_totalprice", _PRICE), ("o_orderpriority", _PRIO)]))
def field_changes(spark, sf):
    b, n = _orders(spark, sf)
    return changes.field_changes(b, n, ORDERS_KEY, planning.shared_columns(b.headers, n.headers)).withColumnRenamed("k0", "o_orderkey")


@query(_changes_sql(FK_NEW, [("o_custkey", _CUST), ("o_totalprice", _PRICE), ("o_orderpriority", _PRIO)]))
def field_changes_fk_churned(spark, sf):
    b, n = _orders(spark, sf, FK_NEW)
    return changes.field_changes(b, n, ORDERS_KEY, planning.shared_columns(b.headers, n.headers)).withColumnRenamed("k0", "o_orderkey")


@query(_changes_sql(FK_NEW, [("o_totalprice", _PRICE), ("o_orderpriority", _PRIO)]))
def field_changes_fk_pruned(spark, sf):
    """The parent's identifiers churned, so the referencing column is left out of the comparison."""
    b, n = _orders(spark, sf, FK_NEW)
    parent = gates.gate(_table(spark, sf, CUSTOMER_BASE), _table(spark, sf, CUSTOMER_NEW), ["c_custkey"]).first()
    bad = planning.churn_reason(parent.total_base, parent.total_new, parent.common, registry.CHURN_THRESHOLD, ["c_custkey"])
    shared = planning.shared_columns(b.headers, n.headers, ["o_custkey"] if bad else [])
    return changes.field_changes(b, n, ORDERS_KEY, shared).withColumnRenamed("k0", "o_orderkey")


#: value pairs and whether they differ under Python's strip/lower/float rules
TRUTH = [
    ("a", "A", False), (" x ", "x", False), ("1", "1.0", False), ("007", "7", False), ("1e5", "100000", False), ("-73.55625", "-73.556250", False),
    ("", " ", False), ("", "0", True), ("a", "b", True), ("1", "2", True), ("1d", "1", True), ("0x10", "16", True), ("inf", "Infinity", False),
    (".5", "0.5", False), ("5.", "5", False), ("+3", "3", False), ("1 2", "12", True), ("9007199254740993", "9007199254740992", False),
    ("É", "é", False), ("08:00:00", "8:00:00", True), ("-0", "0", False), ("1,5", "1.5", True), (" y", "y", False), ("1_000", "1000", False), ("nan", "nan ", False), ("nan", "+nan", True),
]
_lit = lambda s: "'" + s.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_lit(a)}, {_lit(b)}, {str(d).lower()})" for i, (a, b, d) in enumerate(TRUTH)) + ") t(id, a, b, differs)")
def values_differ_truth_table(spark, sf):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(TRUTH)], "id int, a string, b string")
    return rows.select("id", "a", "b", differs(F.col("a"), F.col("b")).alias("differs"))


# --- statistics --------------------------------------------------------------------------------------------------------


@query(_OPAIR + f""", d AS (SELECT {_PRICE} AS p, {_PRIO} AS q FROM {_JOINED}), m AS (SELECT count(*) FILTER (p OR q) AS m, count(*) FILTER (p) AS p, count(*) FILTER (q) AS q FROM d)
SELECT 'o_totalprice' AS "column", p AS modifications_count, round(p::DOUBLE / m * 100, 2) AS modifications_percentage FROM m
UNION ALL SELECT 'o_orderpriority', q, round(q::DOUBLE / m * 100, 2) FROM m""")
def column_stats(spark, sf):
    b, n = _orders(spark, sf)
    shared = planning.shared_columns(b.headers, n.headers)
    one = changes.change_counts(b, n, ORDERS_KEY, shared)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("modifications_count")) for i, c in enumerate(shared)))
    rows = one.select("modified", F.inline(pairs)).where("modifications_count > 0")
    return rows.select("column", "modifications_count", F.round(F.col("modifications_count").cast("double") / F.col("modified") * 100, 2).alias("modifications_percentage"))


_STATS = f""", t AS (SELECT (SELECT count(*) FROM b) AS tb, (SELECT count(*) FROM n) AS tn, (SELECT count(*) FROM {_JOINED}) AS c, (SELECT count(*) FROM {_JOINED} WHERE {_PRICE} OR {_PRIO}) AS m)
SELECT tb AS total_rows_base, tn AS total_rows_new, tn - c AS rows_added_count, tb - c AS rows_deleted_count, m AS rows_modified_count,
 round(least((tn - c + tb - c + m)::DOUBLE / greatest(tb, tn) * 100, 100), 2) AS rows_changed_percentage FROM t"""


def _file_stats(b: Table, n: Table, key: list[str]) -> DataFrame:
    counts = changes.change_counts(b, n, key, planning.shared_columns(b.headers, n.headers)).select("modified")
    t = gates.gate(b, n, key).crossJoin(counts)  # one row each
    added, deleted = F.col("total_new") - F.col("common"), F.col("total_base") - F.col("common")
    share = (added + deleted + F.col("modified")).cast("double") / F.greatest("total_base", "total_new") * 100
    return t.select(
        F.col("total_base").alias("total_rows_base"), F.col("total_new").alias("total_rows_new"), added.alias("rows_added_count"), deleted.alias("rows_deleted_count"),
        F.col("modified").alias("rows_modified_count"), F.round(F.least(share, F.lit(100.0)), 2).alias("rows_changed_percentage"),
    )


@query(_OPAIR + _STATS)
def file_stats(spark, sf):
    return _file_stats(*_orders(spark, sf), ORDERS_KEY)


@query(_OPAIR + _STATS.replace("tb AS total_rows_base, tn AS total_rows_new, tn - c AS rows_added_count, tb - c AS rows_deleted_count, m AS rows_modified_count,", ""))
def rows_changed_percentage(spark, sf):
    return _file_stats(*_orders(spark, sf), ORDERS_KEY).select("rows_changed_percentage")


_CHURN_PAIRS = [
    ("customer", CUSTOMER_BASE, CUSTOMER_NEW, ["c_custkey"]),
    ("orders", ORDERS_BASE, ORDERS_NEW, ORDERS_KEY),
    ("part", PART_BASE, PART_NEW, ["p_partkey"]),
]


@query(" UNION ALL ".join(f"""SELECT '{t}' AS table_name, tb AS total_base, tn AS total_new, c AS common, 1.0::DOUBLE - c::DOUBLE / least(tb, tn) AS churn_ratio FROM
 (SELECT (SELECT count(*) FROM ({_sql(b)})) AS tb, (SELECT count(*) FROM ({_sql(n)})) AS tn, (SELECT count(*) FROM ({_sql(b)}) x SEMI JOIN ({_sql(n)}) y USING ({k[0]})) AS c)""" for t, b, n, k in _CHURN_PAIRS))
def churn_ratio(spark, sf):
    out = None
    for name, b, n, key in _CHURN_PAIRS:
        g = gates.gate(_table(spark, sf, b), _table(spark, sf, n), key)
        ratio = F.lit(1.0) - F.col("common").cast("double") / F.least("total_base", "total_new")
        row = g.select(F.lit(name).alias("table_name"), "total_base", "total_new", "common", ratio.alias("churn_ratio"))
        out = row if out is None else out.unionAll(row)
    return out


@query("SELECT * FROM (VALUES ('customer', 'id_churn'), ('lineitem', 'duplicate_primary_key'), ('orders', ''), ('part', '')) t(table_name, code)")
def not_compared_verdict(spark, sf):
    rows = []
    for name, b, n, key in [*_CHURN_PAIRS, ("lineitem", LINES, LINES, ["l_orderkey", "l_linenumber"])]:
        g = gates.gate(_table(spark, sf, b), _table(spark, sf, n), key).first()
        twice = g.duplicated_base or g.duplicated_new
        reason = planning.duplicate_key_reason("both", key, None) if twice else planning.churn_reason(g.total_base, g.total_new, g.common, registry.CHURN_THRESHOLD, key)
        rows.append((name, reason["code"] if reason else ""))
    return spark.createDataFrame(rows, "table_name string, code string")


_TWICE = f"WITH r AS ({_sql(LINES)}), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY line) AS rn, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM r) "


@query(_TWICE + "SELECT l_orderkey, l_linenumber, n, min(line) AS first_line, max(line) FILTER (rn = 2) AS second_line FROM k WHERE n > 1 GROUP BY ALL")
def duplicate_keys(spark, sf):
    return gates.duplicate_keys(_table(spark, sf, LINES), ["l_orderkey", "l_linenumber"]).withColumnsRenamed({"k0": "l_orderkey", "k1": "l_linenumber"})


@query(_TWICE + "SELECT l_orderkey, l_linenumber, n, min(line) AS first_line, max(line) FILTER (rn = 2) AS second_line FROM k WHERE n > 1 GROUP BY ALL ORDER BY second_line LIMIT 1")
def first_duplicate(spark, sf):
    return gates.first_duplicate(_table(spark, sf, LINES), ["l_orderkey", "l_linenumber"]).withColumnsRenamed({"k0": "l_orderkey", "k1": "l_linenumber"})


@query("SELECT * FROM (VALUES ('shapes.txt', 'base', 'shape_id'), ('fare_rules.txt', 'new', 'fare_id'), ('calendar_dates.txt', 'new', 'date')) t(file_name, side, missing)")
def missing_pk_report(spark, sf):
    headers = {
        ("shapes.txt", "base"): ["shape_pt_lat", "shape_pt_sequence"],
        ("fare_rules.txt", "new"): ["route_id"],
        ("calendar_dates.txt", "new"): ["service_id", "exception_type"],
        ("agency.txt", "base"): ["agency_name"],
    }
    rows = [(f, s, c) for (f, s), h in headers.items() for c in planning.missing_key_columns(h, registry.primary_key(f), registry.optional_key_columns(f))]
    return spark.createDataFrame(rows, "file_name string, side string, missing string")


@query(_pair_sql(EVENT_BASE, EVENT_NEW) + """SELECT (SELECT count(*) FROM b) AS total_base, (SELECT count(*) FROM n) AS total_new,
 (SELECT count(*) FROM b WHERE event_type = '' AND event_id IN (SELECT event_id FROM n)) AS common, 0::BIGINT AS duplicated_base, 0::BIGINT AS duplicated_new""")
def optional_pk_alignment(spark, sf):
    """The key column event_type is absent on the new side and counts as ''."""
    return gates.gate(_table(spark, sf, EVENT_BASE), _table(spark, sf, EVENT_NEW), ["event_id", "event_type"])


_ALLKEY = "b.n_nationkey = n.n_nationkey AND b.n_name = n.n_name AND b.n_regionkey = n.n_regionkey"


@query(_pair_sql(NATION_BASE, NATION_NEW) + f"""SELECT 'added' AS change, line, n_nationkey, n_name, n_regionkey FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_ALLKEY})
 UNION ALL SELECT 'deleted', line, n_nationkey, n_name, n_regionkey FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_ALLKEY})""")
def empty_pk_diff(spark, sf):
    """Without a key all columns of the base side are the key."""
    b, n = _table(spark, sf, NATION_BASE), _table(spark, sf, NATION_NEW)
    part = lambda kind, df: df.select(F.lit(kind).alias("change"), "line", *(F.col(f"k{i}").alias(c) for i, c in enumerate(b.headers)))
    return part("added", changes.added(b, n, b.headers, b.headers)).unionAll(part("deleted", changes.deleted(b, n, b.headers, b.headers)))


@query(_pair_sql(TALK_BASE, TALK_NEW) + f"""SELECT line, b.conv_id, b.turn, {_line('conv_id', 'turn', 'role', 'text')} AS raw_value FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = b.conv_id AND n.turn = b.turn)""")
def composite_key_deleted(spark, sf):
    b, n = _table(spark, sf, TALK_BASE), _table(spark, sf, TALK_NEW)
    return changes.deleted(b, n, ["conv_id", "turn"], b.headers).withColumnsRenamed({"k0": "conv_id", "k1": "turn"})


# --- columns, order, foreign keys ---------------------------------------------------------------------------------------


@query("SELECT 'o_note' AS name, 5 AS position")
def columns_added(spark, sf):
    got = planning.column_changes(ORDER_COLUMNS["base"], ORDER_COLUMNS["new"])[0]
    return spark.createDataFrame([(c["name"], c["position"]) for c in got], "name string, position int")


@query("SELECT 'o_orderstatus' AS name, 3 AS position")
def columns_deleted(spark, sf):
    got = planning.column_changes(ORDER_COLUMNS["base"], ORDER_COLUMNS["new"])[1]
    return spark.createDataFrame([(c["name"], c["position"]) for c in got], "name string, position int")


@query("SELECT * FROM (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus'), (4, 'o_totalprice'), (5, 'o_orderpriority'), (6, 'o_note')) t(position, name)")
def union_columns(spark, sf):
    got = planning.column_changes(ORDER_COLUMNS["base"], ORDER_COLUMNS["new"])[2]
    return spark.createDataFrame(list(enumerate(got, 1)), "position int, name string")


@query("SELECT 'trips.txt' AS file_name, 'shape_id' AS \"column\", 'references_not_compared_file' AS code")
def ignored_fk_columns(spark, sf):
    h = ["trip_id", "route_id", "service_id", "shape_id"]
    got = planning.ignored_columns("trips.txt", h, h, ["trip_id"], {"shapes.txt": "id_churn"})
    return spark.createDataFrame([("trips.txt", x["column"], x["reason"]["code"]) for x in got], "file_name string, column string, code string")


@query("SELECT * FROM (VALUES (1, 'agency.txt'), (2, 'calendar.txt'), (3, 'shapes.txt'), (4, 'stops.txt'), (5, 'calendar_dates.txt'), (6, 'routes.txt'), (7, 'trips.txt'), (8, 'stop_times.txt')) t(place, file_name)")
def processing_order(spark, sf):
    files = "stop_times trips routes agency shapes calendar calendar_dates stops".split()
    return spark.createDataFrame(list(enumerate(planning.processing_order(f"{f}.txt" for f in files), 1)), "place int, file_name string")


@query("SELECT * FROM (VALUES ('notes.txt', 'base'), ('zones.txt', 'both')) t(file_name, present_in)")
def unsupported_files(spark, sf):
    base, new = {"stops.txt", "notes.txt", "zones.txt"}, {"stops.txt", "zones.txt"}
    rows = [(f, "both" if f in base & new else "base" if f in base else "new") for f in sorted(base | new) if registry.primary_key(f) is None]
    return spark.createDataFrame(rows, "file_name string, present_in string")


# --- payloads ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_line('CAST(doc_id AS STRING)', 'text', 'lang', 'source')} AS raw_value FROM documents")
def raw_value_rows(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", csv_line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text", "lang", "source")]).alias("raw_value"))


@query(_pair_sql(TALK_BASE, TALK_NEW) + "SELECT line, concat('{\"conv_id\":\"', conv_id, '\",\"turn\":\"', turn, '\"}') AS identifier FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = b.conv_id AND n.turn = b.turn)")
def identifier_rows(spark, sf):
    b, n = _table(spark, sf, TALK_BASE), _table(spark, sf, TALK_NEW)
    key = ["conv_id", "turn"]
    return changes.deleted(b, n, key, b.headers).select("line", F.to_json(changes.identifier(key)).alias("identifier"))


# --- caps, document ----------------------------------------------------------------------------------------------------

#: cap, true counts, expected shares
SHARES = [(6, 5, 5, 5, 2, 2, 2), (3, 5, 0, 0, 3, 0, 0), (7, 5, 5, 5, 3, 2, 2), (8, 1, 9, 9, 1, 4, 3), (0, 1, 1, 1, 0, 0, 0), (10, 2, 1, 100, 2, 1, 7)]


@query("SELECT * FROM (VALUES " + ", ".join(map(str, SHARES)) + ") t(cap, added, deleted, modified, got_added, got_deleted, got_modified)")
def cap_split(spark, sf):
    names = "cap added deleted modified got_added got_deleted got_modified".split()
    return spark.createDataFrame([(*x[:4], *planning.split_cap(*x[:4])) for x in SHARES], ", ".join(f"{n} int" for n in names))


def _capped(kind: str, by: str, rows: str, limit: int) -> str:
    return f"SELECT '{kind}' AS change, {by} AS line, o_orderkey FROM ({rows}) ORDER BY {by} LIMIT {limit}"


_MOD = f"SELECT b.line AS b_line, b.o_orderkey FROM {_JOINED} WHERE {_PRICE} OR {_PRIO}"
_ADD = "SELECT line, o_orderkey FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = n.o_orderkey)"
_DEL = "SELECT line, o_orderkey FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE b.o_orderkey = n.o_orderkey)"


@query(_OPAIR + f"SELECT * FROM ({_capped('added', 'line', _ADD, 7)}) UNION ALL SELECT * FROM ({_capped('deleted', 'line', _DEL, 7)}) UNION ALL SELECT * FROM ({_capped('modified', 'b_line', _MOD, 6)})")
def capped_rows(spark, sf):
    """A cap of 20 over three kinds with more rows each: 7, 7 and 6, the earliest lines."""
    b, n = _orders(spark, sf)
    shared = planning.shared_columns(b.headers, n.headers)
    with Scratch(spark) as keep:
        rows = keep(compare.compared(b, n, ORDERS_KEY, shared, b.headers).select("change", "b_line", "n_line", "k0", *(f"d{i}" for i in range(len(shared)))))
        got = compare.counts(rows, shared).first()
        limits = planning.split_cap(CAP, got.added, got.deleted, got.modified)
        line = F.coalesce("b_line", "n_line").alias("line")
        # At most CAP rows.
        parts = [r for kind, k in zip(("added", "deleted", "modified"), limits, strict=True) for r in compare.listed(rows, kind, k).select("change", line, F.col("k0").alias("o_orderkey")).collect()]
    return spark.createDataFrame(parts, "change string, line bigint, o_orderkey string")


@query(_OPAIR + f"""SELECT CASE WHEN b.line IS NULL THEN 'added' WHEN n.line IS NULL THEN 'deleted' ELSE 'modified' END AS change, coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey, b.line AS b_line, n.line AS n_line,
 coalesce({_PRICE}, false) AS price, coalesce({_PRIO}, false) AS priority FROM b FULL JOIN n ON b.o_orderkey = n.o_orderkey WHERE b.line IS NULL OR n.line IS NULL OR {_PRICE} OR {_PRIO}""")
def fused_comparison(spark, sf):
    """Added, deleted and modified rows from one join."""
    b, n = _orders(spark, sf)
    shared = planning.shared_columns(b.headers, n.headers)
    rows = compare.compared(b, n, ORDERS_KEY, shared, planning.column_changes(b.headers, n.headers)[2])
    flag = lambda c: F.col(f"d{shared.index(c)}")
    return rows.select("change", F.col("k0").alias("o_orderkey"), "b_line", "n_line", flag("o_totalprice").alias("price"), flag("o_orderpriority").alias("priority"))


@query(_OPAIR + f"SELECT true AS is_truncated, (SELECT count(*) FROM ({_ADD})) + (SELECT count(*) FROM ({_DEL})) + (SELECT count(*) FROM ({_MOD})) - {CAP} AS omitted_count")
def truncation(spark, sf):
    b, n = _orders(spark, sf)
    s = _file_stats(b, n, ORDERS_KEY)
    total = F.col("rows_added_count") + F.col("rows_deleted_count") + F.col("rows_modified_count")
    return s.where(total > CAP).select(F.lit(True).alias("is_truncated"), (total - CAP).alias("omitted_count"))


_FEED = ["customer", "labels", "lineitem", "nation", "orders", "part", "region", "supplier"]


def _feed_rows(spark, sf) -> list[dict]:
    """Every kind of verdict in one feed, through the API's own path."""
    from feedelta.api import diff_tables
    from feedelta.plans import document

    t = lambda text: _table(spark, sf, text)
    region = "SELECT r_regionkey + 2 AS line, CAST(r_regionkey AS STRING) AS r_regionkey, r_name FROM {region}"
    return [
        diff_tables(t(CUSTOMER_BASE), t(CUSTOMER_NEW), ["c_custkey"], name="customer", cap=0),
        document.one_sided("labels", "deleted", ["doc_id", "quality", "toxic"]),
        diff_tables(t(LINES), t(LINES), ["l_orderkey", "l_linenumber"], name="lineitem", cap=0),
        diff_tables(t(NATION_BASE), t(NATION_NEW), [], name="nation", cap=0),
        diff_tables(t(ORDERS_BASE), t(ORDERS_NEW), ORDERS_KEY, name="orders", cap=0),
        diff_tables(t(PART_BASE), t(PART_NEW), ["p_partkey"], name="part", cap=0),
        diff_tables(t(region), t(region), ["r_regionkey"], name="region", cap=0),
        document.one_sided("supplier", "added", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    ]


@query("SELECT * FROM (VALUES ('customer', 'not_compared'), ('labels', 'deleted'), ('lineitem', 'not_compared'), ('nation', 'modified'), ('orders', 'modified'), ('part', 'modified'), ('supplier', 'added')) t(file_name, status)")
def file_status(spark, sf):
    """Unchanged tables (region) do not appear."""
    from feedelta.plans import document

    rows = [(d["file_name"], d["file_action"]) for d in _feed_rows(spark, sf) if not document.unchanged(d)]
    return spark.createDataFrame(rows, "file_name string, status string")


@query(_OPAIR + f"""SELECT (SELECT count(*) FROM ({_ADD})) + (SELECT count(*) FROM ({_DEL})) + (SELECT count(*) FROM ({_MOD})) + 2
 + 2 * (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 0) + (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0) + 3 + 4 + 2 AS total_changes""")
def total_changes(spark, sf):
    from datetime import UTC, datetime

    from feedelta.plans import document

    at = datetime(2024, 1, 1, tzinfo=UTC)
    doc = document.assemble(_feed_rows(spark, sf), cap=0, base=("base", at), new=("new", at), generated_at=at, unsupported=[])
    return spark.createDataFrame([(doc["summary"]["total_changes"],)], "total_changes bigint")


# --- CSV ---------------------------------------------------------------------------------------------------------------


def _staging(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    import uuid

    from feedelta.session import shared_dir

    return f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"


def _as_csv(spark: SparkSession, df: DataFrame, header: list[str]) -> DataFrame:
    """Writes rows as one CSV text file with our own rendering and reads it back through the native scan."""
    from feedelta.sources.tables import read_native

    path = _staging(spark)
    line = csv_line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in header]).alias("value")
    # One file, as a feed table is one file; its record order is what the line numbers count.
    df.repartition(1).sortWithinPartitions(header[0]).select(line).write.text(path)
    return read_native(spark, path, header, has_header=False).df


@query("SELECT event_id + 2 AS line, event_id, event_type, props FROM events")
def line_numbers(spark, sf):
    """Line numbers of a CSV file whose record of event_id i is record i + 2."""
    df = _as_csv(spark, spark.read.parquet(f"{sf}/events.parquet"), ["event_id", "event_type", "props"])
    return df.select("line", F.col("c0").cast("bigint").alias("event_id"), F.col("c1").alias("event_type"), F.col("c2").alias("props"))


@query("SELECT item_id, text FROM benchmark")
def csv_roundtrip(spark, sf):
    df = _as_csv(spark, spark.read.parquet(f"{sf}/benchmark.parquet"), ["item_id", "text"])
    return df.select(F.col("c0").cast("bigint").alias("item_id"), F.col("c1").alias("text"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-feed change summary: a row for each table."""
    rows = []
    for d in _feed_rows(spark, sf):
        s = d["stats"]
        rows.append((d["file_name"], d["file_action"], (d["not_compared_reason"] or {}).get("code"), s["total_rows_base"], s["total_rows_new"], s["rows_added_count"], s["rows_deleted_count"], s["rows_modified_count"], s["rows_changed_percentage"]))
    return spark.createDataFrame(rows, "file_name string, status string, reason string, total_rows_base bigint, total_rows_new bigint, rows_added bigint, rows_deleted bigint, rows_modified bigint, rows_changed_percentage double")


Q |= feed_queries.Q
O |= feed_queries.O

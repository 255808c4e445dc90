"""diff_feeds: two feeds in, one change document out; diff_tables: the same for one pair of tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedelta.operators import compare
from feedelta.operators import gate as gates
from feedelta.operators.gate import key_names
from feedelta.operators.table import Table
from feedelta.plans import document, planning, registry
from feedelta.session import Scratch, shared_local_dir, step
from feedelta.sources.feeds import open_feed
from feedelta.sources.tables import read_table


class _Pair:
    """A file that both sides have, with the verdict of its key gate."""

    def __init__(self, name: str, base: Table, new: Table, key: list[str], explicit: bool, optional):
        self.name, self.base, self.new = name, base, new
        self.explicit = explicit
        self.key = key if explicit else list(base.headers)
        self.added, self.deleted, self.union = planning.column_changes(base.headers, new.headers)
        self.reason: dict | None = None
        # A file without any text has no header to judge; its columns and rows count as added or deleted.
        lacks = {side: planning.missing_key_columns(t.headers, self.key, optional) for side, t in (("base", base), ("new", new)) if t.headers}
        if not self.key:
            raise ValueError(f"{name}: primary_key is empty because the base side has no columns")
        self.missing = lacks if any(lacks.values()) else None
        self.counts: dict = {}

    def run_gate(self, threshold: float) -> None:
        key = self.key
        if self.missing:
            self.counts = {"total_base": self.base.df.count(), "total_new": self.new.df.count()}
            self.reason = planning.missing_key_reason(self.missing)
            return
        c = self.counts = gates.gate(self.base, self.new, key).first().asDict()
        twice = [s for s in ("base", "new") if c[f"duplicated_{s}"]]
        if twice:
            row = gates.first_duplicate(getattr(self, twice[0]), key).first()
            example = {"key": {n: row[f"k{i}"] for i, n in enumerate(key)}, "first_line": row["first_line"], "second_line": row["second_line"], "side": twice[0]}
            self.reason = planning.duplicate_key_reason("both" if len(twice) == 2 else twice[0], key, example)
        elif self.explicit:
            self.reason = planning.churn_reason(c["total_base"], c["total_new"], c["common"], threshold, key)

    def diff(self, not_compared: dict[str, str], cap: int | None, column_stats: bool, keep: Scratch, rows_to: str | None = None) -> dict:
        """The file's entry. Both sides are joined once: without rows for their counts, otherwise the changed rows are kept."""
        if self.reason:
            return document.not_compared(self.name, self.reason, self.added, self.deleted, self.counts["total_base"], self.counts["total_new"])
        b, n, key = self.base, self.new, self.key
        ignored = planning.ignored_columns(self.name, b.headers, n.headers, key, not_compared)
        shared = planning.shared_columns(b.headers, n.headers, [x["column"] for x in ignored])
        rows = compare.compared(b, n, key, shared, self.union)
        if cap != 0:
            rows = keep(rows)
        got = compare.counts(rows, shared).first().asDict()
        counts = self.counts | {k: got[k] for k in ("added", "deleted", "modified")} | {"by_column": {c: got[f"m{i}"] for i, c in enumerate(shared)}}
        if rows_to is not None:
            as_rows(rows, key).write.json(f"{rows_to}/{self.name}")
            lists = None
        else:
            lists = None if cap == 0 else self._rows(rows, counts, cap)
        return document.modified(
            self.name, key=key, union=self.union, columns_added=self.added, columns_deleted=self.deleted, ignored=ignored,
            counts=counts, rows=lists, cap=cap, with_column_stats=column_stats,
        )

    def _rows(self, rows: DataFrame, counts: dict, cap: int | None) -> dict:
        """Row lists by line. Kinds without rows start no job; rows arrive partition by partition."""
        limits = planning.split_cap(cap, counts["added"], counts["deleted"], counts["modified"])
        out: dict = {}
        for kind, limit in zip(("added", "deleted", "modified"), limits, strict=True):
            found = compare.listed(rows, kind, limit if cap is not None else None)
            out[kind] = [self._entry(kind, r) for r in found.toLocalIterator()] if limit else []
        return out

    def _entry(self, kind: str, r) -> dict:
        lines = {"base_line_number": r["b_line"], "new_line_number": r["n_line"]}
        entry = {"identifier": {c: r[f"k{i}"] for i, c in enumerate(self.key)}, "raw_value": r["raw_value"]} | {k: v for k, v in lines.items() if v is not None}
        return entry | {"field_changes": [x.asDict() for x in r["field_changes"]]} if kind == "modified" else entry


def as_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """Changed rows with the fields of the document's row lists, to be written by Spark: change, identifier, raw_value,
    base_line_number, new_line_number, field_changes."""
    identifier = F.struct(*(F.col(k).alias(c) for c, k in zip(key, key_names(key), strict=True)))
    return rows.select("change", identifier.alias("identifier"), "raw_value", F.col("b_line").alias("base_line_number"), F.col("n_line").alias("new_line_number"), F.when(F.col("change") == "modified", F.col("field_changes")).alias("field_changes"))


def diff_tables(base: Table, new: Table, key: list[str], *, name: str = "table", optional=(), cap: int | None = None, churn_threshold: float = registry.CHURN_THRESHOLD, not_compared: dict[str, str] | None = None, column_stats: bool = True) -> dict:
    """The file entry of the document for one pair of tables; an empty key means all base columns."""
    pair = _Pair(name, base, new, list(key), bool(key), optional)
    with Scratch(base.df.sparkSession) as keep:
        pair.run_gate(churn_threshold)
        return pair.diff(not_compared or {}, cap, column_stats, keep)


def diff_feeds(
    spark: SparkSession,
    base_path,
    new_path,
    row_changes_cap_per_file: int | None = None,
    base_downloaded_at: datetime | None = None,
    new_downloaded_at: datetime | None = None,
    id_churn_threshold: float = registry.CHURN_THRESHOLD,
    id_churn_thresholds: dict[str, float] | None = None,
    files: list[str] | None = None,
    column_stats: bool = True,
    reader: str = "strict",
    staging: str | None = None,
    parallel_files: int = 4,
    rows_to: str | None = None,
) -> dict:
    """Compare two feeds.

    Every table is scanned once, into the shared folder. With `rows_to` all changed rows are written there by Spark, a folder
    of JSON lines for each file, and the document has counts only; otherwise they become lists in the document.


    Key gates of all files run first, several at a time, because they do not depend on each other; only the field scan of
    a child has to know whether its parents were compared. `reader` is "strict", "native" (Spark's CSV scan, quoted line
    breaks allowed) or "native_split" (as native, splittable, no line breaks inside quotes).
    """
    cap = row_changes_cap_per_file
    if cap is not None and cap < 0:
        raise ValueError("row_changes_cap_per_file must not be negative")
    now = datetime.now(UTC)
    when = {"base": base_downloaded_at or now, "new": new_downloaded_at or now}
    for side, at in when.items():
        if at.tzinfo is None:
            raise ValueError(f"{side}_downloaded_at needs a time zone")
    with ExitStack() as stack:
        keep = stack.enter_context(Scratch(spark))
        staging = staging or shared_local_dir(spark)
        base = stack.enter_context(open_feed(base_path, files, staging))
        new = stack.enter_context(open_feed(new_path, files, staging))
        names = sorted(base.keys() | new.keys())
        unsupported, diffs, pairs = [], [], {}
        for name in names:
            sides = "both" if name in base and name in new else "base" if name in base else "new"
            key = registry.primary_key(name)
            if key is None:
                unsupported.append({"file_name": name, "present_in": sides})
            elif sides == "both":
                with step(spark, f"{name}: scan"):
                    tables = [Table(t.headers, keep(t.df)) for t in (read_table(spark, side[name], reader) for side in (base, new))]
                pairs[name] = _Pair(name, *tables, key, bool(key), registry.optional_key_columns(name))
            else:
                action, where = ("added", new) if sides == "new" else ("deleted", base)
                diffs.append(document.one_sided(name, action, where[name].headers))
        with ThreadPoolExecutor(max(1, parallel_files)) as pool:

            def gate(pair: _Pair) -> None:
                with step(spark, f"{pair.name}: key gate"):
                    pair.run_gate(registry.churn_threshold(pair.name, id_churn_threshold, id_churn_thresholds))

            def diff(name: str) -> dict:
                with step(spark, f"{name}: changes"):
                    return pairs[name].diff(untrusted, cap, column_stats, keep, rows_to)

            list(pool.map(gate, pairs.values()))
            untrusted = {n: p.reason["code"] for n, p in pairs.items() if p.reason}
            order = planning.processing_order(pairs)
            diffs += pool.map(diff, order)
        return document.assemble(diffs, cap=cap, base=(str(base_path), when["base"]), new=(str(new_path), when["new"]), generated_at=now, unsupported=unsupported)

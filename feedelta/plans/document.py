"""The change document: plain dicts, checked for shape and bounds, written as JSON."""

from __future__ import annotations

import json
from datetime import datetime

from feedelta.plans import planning, registry


# The fields of the document, in its order.
STATS_FIELDS = [
    "total_rows_base",
    "total_rows_new",
    "columns_added_count",
    "columns_deleted_count",
    "rows_added_count",
    "rows_deleted_count",
    "rows_modified_count",
    "rows_changed_percentage",
    "column_stats",
]
FILE_FIELDS = ["not_compared_reason", "ignored_columns", "columns_added", "columns_deleted", "row_changes", "truncated", "stats"]


def _stats(**known) -> dict:
    return {n: known.get(n) for n in STATS_FIELDS}


def _file(name: str, action: str, **known) -> dict:
    return {"file_name": name, "file_action": action} | {n: known.get(n) for n in FILE_FIELDS}


def one_sided(name: str, action: str, headers: list[str]) -> dict:
    """An added or deleted file: columns only, its rows are never read."""
    cols = [{"name": c, "position": i} for i, c in enumerate(headers, 1)]
    added, deleted = (cols, []) if action == "added" else ([], cols)
    return _file(name, action, columns_added=added, columns_deleted=deleted, stats=_stats(columns_added_count=len(added), columns_deleted_count=len(deleted)))


def not_compared(name: str, reason: dict, added: list[dict], deleted: list[dict], total_base: int, total_new: int) -> dict:
    stats = _stats(total_rows_base=total_base, total_rows_new=total_new, columns_added_count=len(added), columns_deleted_count=len(deleted))
    return _file(name, "not_compared", not_compared_reason=reason, columns_added=added, columns_deleted=deleted, stats=stats)


def modified(name: str, *, key, union, columns_added, columns_deleted, ignored, counts, rows, cap, with_column_stats=True) -> dict:
    """counts: total_base, total_new, added, deleted, modified, by_column. rows: the three capped lists, or None for cap 0."""
    a, d, m = counts["added"], counts["deleted"], counts["modified"]
    changes = truncated = None
    if rows is not None:
        included = sum(map(len, rows.values()))
        if cap is not None and a + d + m > cap:
            truncated = {"is_truncated": True, "omitted_count": a + d + m - included}
        changes = {"primary_key": key, "columns": union} | rows
    stats = _stats(
        total_rows_base=counts["total_base"],
        total_rows_new=counts["total_new"],
        columns_added_count=len(columns_added),
        columns_deleted_count=len(columns_deleted),
        rows_added_count=a,
        rows_deleted_count=d,
        rows_modified_count=m,
        rows_changed_percentage=planning.rows_changed_percentage(a, d, m, counts["total_base"], counts["total_new"]),
        column_stats=planning.column_stats(counts["by_column"], m, union) if with_column_stats else None,
    )
    return _file(name, "modified", ignored_columns=ignored or None, columns_added=columns_added, columns_deleted=columns_deleted, row_changes=changes, truncated=truncated, stats=stats)


COUNTS = ("rows_added_count", "rows_deleted_count", "rows_modified_count", "columns_added_count", "columns_deleted_count")


def unchanged(diff: dict) -> bool:
    return diff["file_action"] == "modified" and not any(diff["stats"][c] for c in COUNTS)


def assemble(diffs: list[dict], *, cap, base: tuple[str, datetime], new: tuple[str, datetime], generated_at: datetime, unsupported: list[dict]) -> dict:
    diffs = sorted((d for d in diffs if not unchanged(d)), key=lambda d: d["file_name"])
    by = {s: sum(d["file_action"] == s for d in diffs) for s in ("added", "deleted", "modified", "not_compared")}
    total = sum(d["stats"][c] or 0 for d in diffs for c in COUNTS) + by["added"] + by["deleted"]
    feed = lambda x: {"source": x[0], "downloaded_at": x[1].isoformat()}
    doc = {
        "metadata": {
            "schema_version": registry.SCHEMA_VERSION,
            "generated_at": generated_at.isoformat(),
            "row_changes_cap_per_file": cap,
            "base_feed": feed(base),
            "new_feed": feed(new),
            "unsupported_files": sorted(unsupported, key=lambda x: x["file_name"]),
        },
        "summary": {"total_changes": total}
        | {f"files_{s}_count": n for s, n in by.items()}
        | {"files": [{"file_name": d["file_name"], "status": d["file_action"]} for d in diffs]},
        "file_diffs": diffs,
    }
    validate(doc)
    return doc


def validate(doc: dict) -> None:
    """Raises ValueError where a bound or a required field of the document does not hold."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"invalid document: {what}")

    meta = doc["metadata"]
    cap = meta["row_changes_cap_per_file"]
    need(cap is None or cap >= 0, "row_changes_cap_per_file is negative")
    for side in ("base_feed", "new_feed"):
        need(datetime.fromisoformat(meta[side]["downloaded_at"]).tzinfo is not None, f"{side}.downloaded_at has no time zone")
    need(all(x["present_in"] in ("base", "new", "both") for x in meta["unsupported_files"]), "present_in")
    need(doc["summary"]["total_changes"] >= 0, "total_changes is negative")
    for d in doc["file_diffs"]:
        need(d["file_action"] in ("added", "deleted", "modified", "not_compared"), "file_action")
        need((d["not_compared_reason"] is not None) == (d["file_action"] == "not_compared"), "not_compared_reason")
        need(all(c["position"] >= 1 for c in (d["columns_added"] or []) + (d["columns_deleted"] or [])), "position")
        need(d["truncated"] is None or d["truncated"]["omitted_count"] >= 1, "omitted_count")
        need(all((d["stats"][c] or 0) >= 0 for c in COUNTS), "a count is negative")
        need(0 <= (d["stats"]["rows_changed_percentage"] or 0) <= 100, "percentage")
        if rows := d["row_changes"]:
            need(len(rows["primary_key"]) >= 1, f"{d['file_name']}: primary_key is empty")
            need(all(r["field_changes"] for r in rows["modified"]), "field_changes is empty")


def _prune(x):
    if isinstance(x, dict):
        return {k: _prune(v) for k, v in x.items() if v is not None}
    return [_prune(v) for v in x] if isinstance(x, list) else x


def to_json(doc: dict, *, pretty: bool = True, drop_nulls: bool = True) -> str:
    doc = _prune(doc) if drop_nulls else doc
    return json.dumps(doc, ensure_ascii=False, **({"indent": 2} if pretty else {"separators": (",", ":")}))

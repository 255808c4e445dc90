import os
import shutil

import pytest

from feedelta import feed_queries as fq

SF = "/root/testdata/sf0.001"


@pytest.fixture
def made(monkeypatch):
    """Documents that the queries make, none of them kept from before."""
    docs, real = [], fq.diff_feeds
    monkeypatch.setattr(fq, "_KEPT", {})
    monkeypatch.setattr(fq, "diff_feeds", lambda *a, **kw: docs.append(real(*a, **kw)) or docs[-1])
    return docs


def listed(doc):
    """The row lists of a document in the form of the query."""
    for d in doc["file_diffs"]:
        for kind in ("added", "deleted", "modified") if d["row_changes"] else ():
            for r in d["row_changes"][kind]:
                (identifier,) = r["identifier"].values()
                fields = "; ".join(f"{x['field']}: {x['base_value']} -> {x['new_value']}" for x in r.get("field_changes", ())) or None
                yield d["file_name"], kind, identifier, r.get("base_line_number"), r.get("new_line_number"), r["raw_value"], fields


def test_changed_rows_do_not_pass_through_the_driver(spark, made):
    got = fq.feed_row_changes(spark, SF)
    (doc,) = made
    assert got.inputFiles() and not any(d["row_changes"] for d in doc["file_diffs"])
    counted = sum(d["stats"][f"rows_{k}_count"] or 0 for d in doc["file_diffs"] for k in ("added", "deleted", "modified"))
    assert got.count() == counted > 0


def test_rows_equal_the_lists_of_a_document(spark, made):
    base, new = fq._stage(spark, SF)
    want = list(listed(fq.diff_feeds(spark, base, new, id_churn_threshold=fq.THRESHOLD, id_churn_thresholds=fq.OVERRIDES)))
    got = fq.feed_row_changes(spark, SF)
    assert got.columns == ["file_name", "change", "id", "base_line", "new_line", "raw_value", "fields"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert len({r[:2] for r in want}) == 6


def test_rows_are_made_again_where_their_folder_is_gone(spark, made):
    fq.feed_row_changes(spark, SF)
    ((_, folder),) = fq._KEPT.values()
    shutil.rmtree(folder)
    assert fq.feed_row_changes(spark, SF).count() > 0
    assert len(made) == 2 and not os.path.exists(folder)

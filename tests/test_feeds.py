import http.server
import io
import json
import os
import threading
import zipfile

import pytest

from feedelta.api import diff_feeds
from feedelta.cli import main
from feedelta.plans import document
from feedelta.sources import feeds


def folder(tmp_path, name, files):
    d = tmp_path / name
    d.mkdir()
    for f, text in files.items():
        (d / f).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(d)


@pytest.fixture
def run(spark, tmp_path):
    def go(base, new, **kw):
        return diff_feeds(spark, folder(tmp_path, "base", base), folder(tmp_path, "new", new), **kw)

    return go


def only(doc):
    (d,) = doc["file_diffs"]
    return d


STOPS = "stop_id,stop_name,stop_lat\nS1,Alpha,45.50\nS2,Beta,46\nS3,Gamma,47\n"


def test_identical_reordered_and_cosmetic_changes_are_no_changes(run):
    new = "stop_lat,stop_name,stop_id\n47.0,GAMMA,S3\n45.5, alpha ,S1\n46,Beta,S2\n"
    doc = run({"stops.txt": STOPS}, {"stops.txt": new})
    assert doc["file_diffs"] == []
    assert doc["summary"]["total_changes"] == 0


def test_rows_lines_identifiers_and_raw_values(run):
    new = 'stop_id,stop_name,stop_lat,stop_desc\nS1,"Alpha, Inc",45.50,x\nS3,Gamma,47,\nS4,Delta,48,"say ""hi"""\n'
    d = only(run({"stops.txt": STOPS}, {"stops.txt": new}))
    assert d["columns_added"] == [{"name": "stop_desc", "position": 4}]
    rows = d["row_changes"]
    assert rows["columns"] == ["stop_id", "stop_name", "stop_lat", "stop_desc"]
    assert rows["added"] == [{"identifier": {"stop_id": "S4"}, "raw_value": 'S4,Delta,48,"say ""hi"""', "new_line_number": 4}]
    assert rows["deleted"] == [{"identifier": {"stop_id": "S2"}, "raw_value": "S2,Beta,46,", "base_line_number": 3}]
    (m,) = rows["modified"]
    assert m["field_changes"] == [{"field": "stop_name", "base_value": "Alpha", "new_value": "Alpha, Inc"}]
    assert (m["base_line_number"], m["new_line_number"], m["raw_value"]) == (2, 2, "S1,Alpha,45.50,")
    assert d["stats"]["rows_changed_percentage"] == 100.0
    assert d["stats"]["column_stats"] == [{"column": "stop_name", "modifications_count": 1, "modifications_percentage": 100.0}]


def test_files_added_deleted_and_unsupported(run):
    doc = run({"stops.txt": STOPS, "agency.txt": "agency_id,agency_name\nA,B\n", "odd.txt": "a\n1\n"}, {"stops.txt": STOPS, "routes.txt": "route_id\nR\n"})
    assert [(f["file_name"], f["status"]) for f in doc["summary"]["files"]] == [("agency.txt", "deleted"), ("routes.txt", "added")]
    assert doc["summary"]["total_changes"] == 2 + 2 + 1
    assert doc["metadata"]["unsupported_files"] == [{"file_name": "odd.txt", "present_in": "base"}]
    assert doc["file_diffs"][0]["stats"]["total_rows_base"] is None


def test_caps(run, spark, tmp_path):
    base = "stop_id,stop_name\n" + "".join(f"B{i},x\nC{i},x\n" for i in range(5))
    new = "stop_id,stop_name\n" + "".join(f"N{i},x\nC{i},y\n" for i in range(5))
    d = only(run({"stops.txt": base}, {"stops.txt": new}, row_changes_cap_per_file=6))
    assert [len(d["row_changes"][k]) for k in ("added", "deleted", "modified")] == [2, 2, 2]
    assert d["truncated"] == {"is_truncated": True, "omitted_count": 9}
    assert d["stats"]["rows_modified_count"] == 5
    d = only(diff_feeds(spark, tmp_path / "base", tmp_path / "new", 0, column_stats=False))
    assert d["row_changes"] is None and d["truncated"] is None and d["stats"]["column_stats"] is None


def test_churned_parent_hides_referring_column(run):
    shapes = lambda p: "shape_id,shape_pt_sequence\n" + "".join(f"{p}{i},1\n" for i in range(60))
    trips = lambda p, h: "trip_id,route_id,service_id,shape_id,trip_headsign\n" + "".join(f"T{i},R,S,{p}{i},{h if i == 0 else 'same'}\n" for i in range(60))
    doc = run({"shapes.txt": shapes("a"), "trips.txt": trips("a", "x")}, {"shapes.txt": shapes("b"), "trips.txt": trips("b", "y")})
    by = {d["file_name"]: d for d in doc["file_diffs"]}
    assert by["shapes.txt"]["not_compared_reason"]["code"] == "id_churn"
    assert by["trips.txt"]["ignored_columns"][0]["column"] == "shape_id"
    assert by["trips.txt"]["stats"]["rows_modified_count"] == 1


def test_change_in_ignored_column_only_leaves_the_file_out(run):
    shapes = lambda p: "shape_id,shape_pt_sequence\n" + "".join(f"{p}{i},1\n" for i in range(60))
    trips = lambda p: "trip_id,shape_id\n" + "".join(f"T{i},{p}{i}\n" for i in range(5))
    doc = run({"shapes.txt": shapes("a"), "trips.txt": trips("a")}, {"shapes.txt": shapes("b"), "trips.txt": trips("b")})
    assert [d["file_name"] for d in doc["file_diffs"]] == ["shapes.txt"]


def test_duplicate_and_missing_keys(run):
    doc = run(
        {"stops.txt": "stop_id,stop_name\nS1,a\nS2,b\nS1,c\n", "shapes.txt": "shape_pt_lat,shape_pt_sequence\n1,1\n"},
        {"stops.txt": "stop_id,stop_name\nS1,a\n", "shapes.txt": "shape_id,shape_pt_sequence\nA,1\n"},
    )
    by = {d["file_name"]: d for d in doc["file_diffs"]}
    dup = by["stops.txt"]["not_compared_reason"]
    assert dup["code"] == "duplicate_primary_key" and "base" in dup["message"] and "stop_id" in dup["message"] and "2 and 4" in dup["message"]
    assert by["stops.txt"]["stats"]["total_rows_base"] == 3
    missing = by["shapes.txt"]["not_compared_reason"]
    assert missing["code"] == "missing_primary_key" and "base" in missing["message"] and "shape_id" in missing["message"]


def test_optional_and_empty_keys(run):
    doc = run(
        {"agency.txt": "agency_name,agency_url\nA,u\n", "feed_info.txt": "feed_lang,feed_version\nen,1\n"},
        {"agency.txt": "agency_name,agency_url\nA,v\n", "feed_info.txt": "feed_lang,feed_version\nen,2\n"},
    )
    by = {d["file_name"]: d for d in doc["file_diffs"]}
    assert by["agency.txt"]["row_changes"]["modified"][0]["identifier"] == {"agency_id": ""}
    assert by["agency.txt"]["row_changes"]["columns"] == ["agency_name", "agency_url"]
    info = by["feed_info.txt"]
    assert info["row_changes"]["primary_key"] == ["feed_lang", "feed_version"]
    assert info["stats"]["rows_added_count"] == info["stats"]["rows_deleted_count"] == 1


def test_csv_rules(run):
    base = b"\xef\xbb\xbfstop_id , stop_name,stop_lat\r\nS1,\"two\r\nlines\",1\r\nS2,short\r\nS3,long,3,extra\r\n"
    new = "stop_id,stop_name,stop_lat\nS1,\"two\nlines\",1\nS2,short,\nS3,long,3\nS4,\"\",\n"
    d = only(run({"stops.txt": base}, {"stops.txt": new}))
    assert d["stats"]["rows_modified_count"] == 0
    assert d["row_changes"]["added"] == [{"identifier": {"stop_id": "S4"}, "raw_value": "S4,,", "new_line_number": 5}]


def test_blank_lines_are_rows_and_an_empty_file_has_none(run):
    doc = run({"stops.txt": "stop_id,stop_name\nS1,a\n\n\n", "levels.txt": "level_id\nL\n"}, {"stops.txt": "stop_id,stop_name\nS1,a\n", "levels.txt": ""})
    by = {d["file_name"]: d for d in doc["file_diffs"]}
    assert by["stops.txt"]["not_compared_reason"]["code"] == "duplicate_primary_key"
    assert by["levels.txt"]["stats"]["rows_deleted_count"] == 1 and by["levels.txt"]["columns_deleted"] == [{"name": "level_id", "position": 1}]


def test_native_reader_agrees_with_strict(spark, tmp_path):
    new = STOPS.replace("Beta", "Bravo") + "S9,Nine,9\n"
    b, n = folder(tmp_path, "b", {"stops.txt": STOPS}), folder(tmp_path, "n", {"stops.txt": new})
    docs = [diff_feeds(spark, b, n, reader=r)["file_diffs"] for r in ("strict", "native", "native_split")]
    assert docs[0] == docs[1] == docs[2]


def test_zip_members_at_any_depth(spark, tmp_path):
    z = tmp_path / "f.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("old/stops.txt", "stop_id\nX\n")
        f.writestr("inner/deep/stops.txt", STOPS)
        f.writestr("readme.md", "no")
    doc = diff_feeds(spark, z, folder(tmp_path, "n", {"stops.txt": STOPS}))
    assert doc["file_diffs"] == []
    with pytest.raises(ValueError):
        diff_feeds(spark, tmp_path / "none", z)
    assert diff_feeds(spark, z, folder(tmp_path, "m", {}), files=[])["summary"]["total_changes"] == 0


@pytest.fixture
def server():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("inner/stops.txt", STOPS)
    served = {"/feed/stops.txt": STOPS.encode(), "/feed/levels.txt": b"level_id\nL1\n", "/feed/all.zip?v=2": packed.getvalue(), "/feed/text.zip": b"no archive"}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.answer(405 if self.path.endswith("levels.txt") else 200)

        def do_GET(self):
            self.answer(200)

        def answer(self, code):
            body = served.get(self.path)
            self.send_response(404 if body is None else code)
            self.send_header("Content-Length", str(len(body or b"")))
            self.end_headers()
            if self.command == "GET" and body:
                self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/feed"
    s.shutdown()


def test_http_folder(spark, tmp_path, server):
    assert feeds.url_exists(f"{server}/stops.txt") and feeds.url_exists(f"{server}/levels.txt") and not feeds.url_exists(f"{server}/trips.txt")
    assert feeds.url_size(f"{server}/stops.txt") == len(STOPS)
    doc = diff_feeds(spark, server, folder(tmp_path, "n", {"stops.txt": STOPS, "levels.txt": "level_id\nL1\n"}))
    assert doc["file_diffs"] == []


def test_archive_at_a_url(spark, tmp_path, server):
    n = folder(tmp_path, "n", {"stops.txt": STOPS + "S9,Nine,9\n"})
    d = only(diff_feeds(spark, f"{server}/all.zip?v=2", n))
    assert d["file_name"] == "stops.txt" and d["stats"]["rows_added_count"] == 1
    with feeds.open_feed(f"{server}/all.zip?v=2", files=[], staging=str(tmp_path)) as found:
        assert found == {}
    for url in (f"{server}/text.zip", f"{server}/none.zip"):
        with pytest.raises(ValueError):
            diff_feeds(spark, url, n)


def test_cli(spark, tmp_path, capsys):
    b, n = folder(tmp_path, "b", {"stops.txt": STOPS}), folder(tmp_path, "n", {"stops.txt": STOPS + "S9,Nine,9\n"})
    out = tmp_path / "o.json"
    assert main([b, n, "-o", str(out), "--cap", "1", "--base-downloaded-at", "2024-01-01T00:00:00+00:00"], spark) == 0
    doc = json.loads(out.read_text())
    document.validate({**doc, "file_diffs": []})
    assert doc["metadata"]["row_changes_cap_per_file"] == 1 and "truncated" not in doc["file_diffs"][0]
    assert main([b, n, "--no-pretty"], spark) == 0
    assert "\n" not in capsys.readouterr().out.strip()
    assert main([b, str(tmp_path / "none")], spark) == 1
    assert main([b, n, "--cap", "-1"], spark) == 1
    assert main([b, n, "--new-downloaded-at", "yesterday"], spark) == 1
    assert main([b, n, "--new-downloaded-at", "2024-01-01T00:00:00"], spark) == 1
    assert main([b, n, "--id-churn-threshold", "2"], spark) == 1


def test_rows_can_be_written_by_spark(spark, tmp_path):
    b, n = folder(tmp_path, "b", {"stops.txt": STOPS}), folder(tmp_path, "n", {"stops.txt": STOPS.replace("Beta", "Bravo") + "S9,Nine,9\n"})
    d = only(diff_feeds(spark, b, n, rows_to=f"file://{tmp_path}/rows"))
    assert d["row_changes"] is None and d["stats"]["rows_added_count"] == d["stats"]["rows_modified_count"] == 1
    got = {r.change: r for r in spark.read.json(f"file://{tmp_path}/rows/stops.txt").collect()}
    assert got["added"].raw_value == "S9,Nine,9" and got["added"].new_line_number == 5
    assert got["modified"].field_changes[0].new_value == "Bravo" and got["modified"].identifier.stop_id == "S2"


def test_steps_are_traced(spark, tmp_path, caplog):
    import logging

    with caplog.at_level(logging.INFO, "feedelta"):
        diff_feeds(spark, folder(tmp_path, "b", {"stops.txt": STOPS}), folder(tmp_path, "n", {"stops.txt": STOPS}))
    assert any("stops.txt: key gate" in m and "MB" in m for m in caplog.messages)


def test_server_errors_are_raised_and_refusals_mean_absent(monkeypatch):
    import urllib.error

    def says(head, get):
        def answer(request, timeout):
            code = head if request.method == "HEAD" else get
            raise urllib.error.HTTPError(request.full_url, code, "", {}, None)

        monkeypatch.setattr(feeds.urllib.request, "urlopen", answer)

    for head, get in ((404, None), (410, None), (403, 403), (405, 404), (501, 401)):
        says(head, get)
        assert not feeds.url_exists("http://x/y")
    for head, get in ((500, None), (403, 503)):
        says(head, get)
        with pytest.raises(urllib.error.HTTPError):
            feeds.url_exists("http://x/y")
        assert feeds.url_size("http://x/y") is None


def test_staging_is_removed(tmp_path):
    z = tmp_path / "f.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("stops.txt", STOPS)
    with feeds.open_feed(z, staging=str(tmp_path)) as found:
        assert os.path.exists(found["stops.txt"].path)
    assert not os.path.exists(found["stops.txt"].path)

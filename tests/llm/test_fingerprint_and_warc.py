import hashlib
import random

import pytest

from feedelta.llm import fingerprint, warc


def test_canonical_form():
    same = ["Straße  ﬁn", "STRASSE fin", " strasse\t\nfin ", "ＳＴＲＡＳＳＥ fin"]
    assert len({fingerprint.canonical(t) for t in same}) == 1
    assert fingerprint.canonical(None) == fingerprint.canonical("") == fingerprint.canonical(" \n") == ""
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x2000, 0x2200), rng.randrange(0x300, 0x370)])) for _ in range(8))
        assert fingerprint.canonical(fingerprint.canonical(t)) == fingerprint.canonical(t)


def test_fingerprints_are_equal_just_when_forms_are(docs, no_docs):
    got = fingerprint.fingerprints(docs).collect()
    forms = {(fingerprint.canonical(r.text), r.fingerprint) for r in got}
    assert len(got) == 10 and len(forms) == len({f for f, _ in forms}) == len({p for _, p in forms})
    assert fingerprint.fingerprints(no_docs).count() == 0


def test_a_collision_is_told_apart(docs, monkeypatch):
    assert fingerprint._collided(docs.selectExpr("'same' AS k", "cast(text AS binary) AS f"), "k", "f") == ["same"]


@pytest.mark.parametrize("n", [1, 2, 57])
def test_edited_pairs(spark, n):
    rows = [(3 * i, ("w%d " % (i // 2)) * (i % 9) if i % 7 else None) for i in range(n)]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % n][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == float(fingerprint.canonical(t) == fingerprint.canonical(e)) == float(r.fingerprint == r.edited_fingerprint)
        assert r.near_next == float(fingerprint.canonical(t) == fingerprint.canonical(nxt))


def test_edited_pairs_edge_cases(docs, no_docs):
    assert fingerprint.edited_pairs(docs).count() == 10
    assert fingerprint.edited_pairs(no_docs).count() == 0


PAGES = [(4, "http://a.org/x", "p" * 200), (2, "https://www.A.org:443/x#top", "p" * 200), (9, None, "p" * 200), (5, "http://b.org/?q=1 2", "small"), (6, "http://b.org/", "small"), (7, "bad://[", None), (8, "http://b.org/", "é" * 50), (None, "http://c.org/\n", "p" * 200)]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, digest int, key string")
    manifest, files = warc.archive(df)
    places = warc.look_up(warc.wanted(df), files)
    got = {r.page_id: r for r in warc.read(warc.in_file_order(places), files).collect()}
    assert len(got) == len(PAGES) == manifest.count() == places.count()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = len(raw) >= 100 and i in (4, 9)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert got[i].payload == (None if revisit else raw)
    index = warc.CaptureIndex([r.asDict() for r in files.collect()])
    ids = lambda url: sorted(int(warc.parse(warc.read_range(c["path"], c["offset"], c["length"]))[0]["WARC-Record-ID"][10:-1]) for c in index.lookup(url))
    assert ids("http://a.org/x") == [2, 4]
    assert ids("http://b.org/") == [6, 8]
    assert ids("http://b.org/?q=1 2") == [5]
    assert index.lookup("http://none.org/") == []
    assert warc.round_trip(df.where("false")).count() == 0


def test_long_and_repeated_pages(spark):
    long = "<p>é\r\n\r\n" * 200_000
    rows = [(1, "http://a.org", long), (2, "http://a.org\n/b c", long), (2, "http://a.org\n/b c", long), (3, "http://a.org", "x" * 100), (3, "http://a.org", "y" * 100), (4, "q", "y" * 100), (None, None, long), (None, None, None), (5, "http://a.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    n = len(long.encode())
    want = [(1, n, "response", None), (2, n, "revisit", 1), (2, n, "revisit", 1), (3, 100, "response", None), (3, 100, "response", None), (4, 100, "revisit", 3), (0, n, "response", None), (0, 0, "response", None), (5, 0, "response", None)]
    assert got == sorted(want, key=str)


def test_lookups_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    df = spark.createDataFrame([(i, f"http://h{i % 5}.org/", str(i)) for i in range(60)], "page_id long, url string, html string")
    _, files = warc.archive(df)
    assert files.count() <= 4 and files.selectExpr("sum(lines) AS n").first().n == 60
    index = warc.CaptureIndex([r.asDict() for r in files.collect()])
    for h in range(5):
        assert len(index.lookup(f"http://h{h}.org")) == 12
        for i in range(60):
            assert len(index.find(warc.capture_key(f"http://h{h}.org"), i)) == (i % 5 == h)


def test_files_begin_with_their_description(spark):
    manifest, _ = warc.archive(spark.createDataFrame([(1, "http://a.org", "x")], "page_id long, url string, html string"))
    r = manifest.first()
    head, block = warc.parse(warc.read_range(r.path, 0, r.offset))
    assert head["WARC-Type"] == "warcinfo" and r.offset > 0

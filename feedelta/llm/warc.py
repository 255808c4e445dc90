"""WARC archives with a two-level capture index.

Archives: one gzip member for each record (WARC/1.1), a `warcinfo` record at the head of each file, `response` records with
the payload and `revisit` records that name the response with the same payload by its id and URL.

Index: a line for each capture, keyed by the URL with its host reversed and by the id; lines are sorted by key, grouped into
compressed blocks, and a sparse directory holds each block's first key and place. The directory of an index file stands at
its end; a row for each file (its first and last key and the place of its directory) is all that the driver and each task
hold. A lookup searches these rows, reads a file's directory by range, searches it, reads a block by range, searches it, and
reads the record by range. The captures wanted come sorted, so neighbours find their block read already.

Reading: every wanted capture is looked up, its record is read from the archive, and a revisit's response is looked up and
read in turn; digest and length are those of the payload that was read, and must be those that the record states.

Files are named by task attempt, and the rows that a task returns name its own files, so retried or lost tasks never mix.
The manifest is written as a table before anything is read back.

Which captures are responses: of equal payloads of at least MIN_PAYLOAD bytes that with the smallest id; smaller payloads
are all responses. Digests are grouped with their ids alone; payloads are not moved by digest as long as the digests that
occur twice are at most BROADCAST_DIGESTS.

Defined results: a null payload counts as empty; a null URL gets the key "-"; rows with equal ids are kept as they are
(a revisit refers to an id, so rows that repeat an id and payload are all responses if the id is the smallest); rows with
a null id are never referred to by others and are responses; pages carry no time of their own, so all captures have
WARC_DATE; extra columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedelta.llm.common import bounded_batches, cut, new_path, without

MIN_PAYLOAD = 100
#: Capture lines in an index block.
BLOCK_LINES = 1000
WARC_DATE = "2024-01-01T00:00:00Z"
#: Digests of repeated payloads that may be broadcast (about 200 bytes each).
BROADCAST_DIGESTS = 200_000
#: Bytes of archive that a task reads back.
READ_BYTES = 32 << 20
#: Index blocks, directories and responses that a reader keeps.
KEPT = 64


def filesystem(path: str):
    """File system and plain path of a URI; local paths may come without a scheme."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


# --- keys --------------------------------------------------------------------------------------------------------------


def target_uri(url: str | None) -> str:
    """The URL as records state it: control characters could end a header line."""
    return "".join(c for c in (url or "") if c >= " ").strip()


def capture_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: com,example,www)/path?query. Scheme and fragment don't count, and white
    space is escaped."""
    key = _plain_key(target_uri(url))
    return key if key.isascii() and " " not in key else "".join(quote(c) if c.isspace() else c for c in key)


def _plain_key(url: str) -> str:
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return f"-){url}"
    if not host:
        return f"-){u.path}" if url else "-"
    port = f":{port}" if port and (u.scheme.lower(), port) not in (("http", 80), ("https", 443)) else ""
    labels = host if ":" in host else ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{labels}{port}){u.path or '/'}{'?' + u.query if u.query else ''}"


# --- records -----------------------------------------------------------------------------------------------------------


def _member(kind: str, fields: list[str], block: bytes) -> bytes:
    """One gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def info(name: str) -> bytes:
    """The record at the head of an archive."""
    fields = [f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {WARC_DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member("warcinfo", fields, b"software: feedelta\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None = None) -> bytes:
    """A response, or a revisit, which carries headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {target_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        return _member("response", fields, http + payload)
    fields += [
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        f"WARC-Refers-To: <urn:page:{refers_to}>",
        f"WARC-Refers-To-Target-URI: {target_uri(refers_url)}",
        f"WARC-Refers-To-Date: {WARC_DATE}",
    ]
    return _member("revisit", fields, http)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError if it is not whole."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return headers, block.partition(b"\r\n\r\n")[2]


# --- index -------------------------------------------------------------------------------------------------------------


def place_of(key: str, page_id: int | None) -> tuple:
    """What lines are sorted by; a null id comes first."""
    return key, page_id is not None, page_id or 0


def pack_block(lines: list[tuple[str, int | None, str]]) -> bytes:
    return zlib.compress("\n".join(f"{k} {'-' if i is None else i} {v}" for k, i, v in lines).encode(), 6)


def unpack_block(block: bytes) -> tuple[list[tuple], list[str]]:
    """The sorted places of the lines of a block, and the rest of each line."""
    lines = [x.split(" ", 2) for x in zlib.decompress(block).decode().split("\n")]
    return [place_of(k, None if i == "-" else int(i)) for k, i, _ in lines], [v for _, _, v in lines]


class CaptureIndex:
    """Lookups through the sparse directory.

    files: a row for each index file: first_key, first_id, last_key, last_id, path, offset, length; offset and length are the
    place of the file's directory.
    """

    def __init__(self, files: list[dict]):
        rows = sorted(((place_of(r["first_key"], r["first_id"]), place_of(r["last_key"], r["last_id"]), r) for r in files), key=lambda r: r[:2])
        self.files, self.firsts = [r[2] for r in rows], [r[0] for r in rows]
        self.kept: dict = {}

    def _held(self, path: str, offset: int, length: int, build):
        key = path, offset
        if key in self.kept:
            self.kept[key] = self.kept.pop(key)
        else:
            if len(self.kept) >= KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = build(read_range(path, offset, length))
        return self.kept[key]

    def between(self, low: tuple, high: tuple) -> Iterator[dict]:
        """Captures at places from low to high, in order."""
        for f in self.files[max(0, bisect_left(self.firsts, low) - 1) :]:
            if place_of(f["first_key"], f["first_id"]) > high:
                break
            if place_of(f["last_key"], f["last_id"]) < low:
                continue
            firsts, blocks = self._held(f["path"], f["offset"], f["length"], _directory)
            for i in range(max(0, bisect_left(firsts, low) - 1), len(blocks)):
                if firsts[i] > high:
                    break
                places, lines = self._held(f["path"], *blocks[i], unpack_block)
                at = bisect_left(places, low)
                while at < len(places) and places[at] <= high:
                    yield json.loads(lines[at])
                    at += 1

    def lookup(self, url: str | None) -> list[dict]:
        """All captures of a URL."""
        key = capture_key(url)
        return list(self.between((key, False, 0), (key, True, 1 << 63)))

    def find(self, key: str, page_id: int | None) -> list[dict]:
        """The captures with a key and an id; rows that repeat both give several."""
        return list(self.between(place_of(key, page_id), place_of(key, page_id)))


def _directory(raw: bytes) -> tuple[list[tuple], list[tuple[int, int]]]:
    rows = json.loads(zlib.decompress(raw))
    return [place_of(k, i) for k, i, _, _ in rows], [(at, n) for _, _, at, n in rows]


def read_range(path: str, offset: int, length: int) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        f.seek(offset)
        return f.read(length)


# --- operators ---------------------------------------------------------------------------------------------------------


def classify(df: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to, refers_url."""
    p = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), p.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_PAYLOAD
    first = rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.min_by("url", F.struct("page_id", "url")).alias("refers_url"))
    # Only payloads that occur under two ids.
    first = cut(first.where(F.col("first") < F.col("last")).select(F.col("digest").alias("d"), "first", "refers_url"), "repeated")
    # Up to a fixed number of digests payloads stay where they are; beyond it, tables are joined that can be split where a digest is frequent.
    side = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    joined = rows.join(side, (F.col("digest") == F.col("d")) & large, "left")
    other = F.col("page_id") != F.col("first")
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("refers_url")).alias("refers_url"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes classified pages; the manifest has a row for each record: key, page_id, url, digest, path, offset, length."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        path, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            rows = []
            for page_id, url, payload, digest, refers, refers_url in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")), strict=True):
                if out is None:
                    out = fs.open_output_stream(filesystem(path)[1], compression=None)
                    at = out.write(info(path.rpartition("/")[2]))
                member = record(page_id, url, payload, digest, refers, refers_url)
                out.write(member)
                rows.append((capture_key(url), page_id, url, digest, path, at, len(member)))
                at += len(member)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["key", "page_id", "url", "digest", "path", "offset", "length"])
        if out is not None:
            out.close()

    schema = "key string, page_id bigint, url string, digest string, path string, offset bigint, length bigint"
    return cut(pages.mapInArrow(run, schema), "manifest")


def _parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def index(manifest: DataFrame, folder: str) -> DataFrame:
    """Sorted capture lines in compressed blocks, the directory at the end of each file. Returns a row for each index file."""
    line = F.to_json(F.struct("url", "digest", "path", "offset", "length"))
    rows = manifest.select("key", "page_id", line.alias("line"))
    names = ["first_key", "first_id", "last_key", "last_id", "path", "offset", "length", "blocks", "lines"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        path, out, at, lines, directory, last, total = f"{folder}/{uuid.uuid4().hex}.idx", None, 0, [], [], None, 0

        def close() -> None:
            nonlocal out, at, last, total
            block = pack_block(lines)
            out = out or fs.open_output_stream(filesystem(path)[1], compression=None)
            out.write(block)
            directory.append((lines[0][0], lines[0][1], at, len(block)))
            at += len(block)
            last, total = lines[-1][:2], total + len(lines)
            lines.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "line")), strict=True):
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    close()
        if lines:
            close()
        if out is not None:
            footer = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(footer)
            out.close()
            row = (*directory[0][:2], *last, path, at, len(footer), len(directory), total)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    # Ranges of (key, id), so captures of one much-crawled URL still spread.
    ranged = rows.repartitionByRange(_parts(manifest.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id").select("key", "page_id", "line")
    return cut(ranged.mapInArrow(run, "first_key string, first_id bigint, last_key string, last_id bigint, path string, offset bigint, length bigint, blocks bigint, lines bigint"), "directory")


def _sent(files: DataFrame):
    """The rows of the index files, as many as there were tasks to write them, for every task."""
    return files.sparkSession.sparkContext.broadcast([r.asDict() for r in files.collect()])


def wanted(df: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """key, page_id: what to look up for each page."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")], names=["key", "page_id"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"))
    return rows.mapInArrow(run, "key string, page_id bigint").distinct()


def look_up(keys: DataFrame, files: DataFrame) -> DataFrame:
    """key, page_id, path, offset, length: the captures of (key, page_id) rows, found by search in the index."""
    sent = _sent(files)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = CaptureIndex(sent.value)
        for b in batches:
            rows = [(k, i, c["path"], c["offset"], c["length"]) for k, i in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True) for c in found.find(k, i)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["key", "page_id", "path", "offset", "length"])

    sorted_ = keys.repartitionByRange(_parts(keys.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id").select("key", "page_id")
    return sorted_.mapInArrow(run, "key string, page_id bigint, path string, offset bigint, length bigint")


def read(places: DataFrame, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records at (path, offset, length): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Digest and length are those of the payload that was read, of a revisit those of its response, which is found through the
    index; a record that states another digest ends the job. The payload of a revisit is null.
    """
    bounded_batches(places.sparkSession)
    sent = _sent(files)
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + (", payload binary" if with_payload else "")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: 6 + with_payload]

    def number(urn: str | None):
        v = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "None"
        return None if v == "None" else int(v)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 + with_payload]
        found, responses = CaptureIndex(sent.value), {}

        def checked(head: dict, payload: bytes) -> tuple[int, str]:
            digest = hashlib.sha256(payload).hexdigest()
            if head["WARC-Payload-Digest"] != f"sha256:{digest}":
                raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its stated digest")
            return len(payload), digest

        def response(url: str, page_id: int, stated: str) -> tuple[int, str]:
            """Length and digest of the response that a revisit names; ids may be repeated with other payloads."""
            key = capture_key(url), page_id, stated
            if key not in responses:
                if len(responses) >= KEPT:
                    responses.pop(next(iter(responses)))
                for c in found.find(*key[:2]):
                    if f"sha256:{c['digest']}" == stated:
                        head, payload = parse(read_range(c["path"], c["offset"], c["length"]))
                        if head["WARC-Type"] == "response":
                            responses[key] = checked(head, payload)
                            break
                else:
                    raise ValueError(f"page {page_id}: a revisit refers to it, but there is no such response")
            return responses[key]

        def batch(out: list):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        files: dict = {}
        for b in batches:
            out, held = [], 0
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path not in files:
                    if len(files) > 63:
                        files.pop(next(iter(files))).close()
                    fs, at = filesystem(path)
                    files[path] = fs.open_input_file(at)
                files[path].seek(offset)
                head, payload = parse(files[path].read(length))
                kind, refers = head["WARC-Type"], number(head.get("WARC-Refers-To"))
                if kind == "response":
                    n, digest = checked(head, payload)
                else:
                    (n, digest), payload = response(head["WARC-Refers-To-Target-URI"], refers, head["WARC-Payload-Digest"]), None
                out.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, refers, n, digest, payload)[: 6 + with_payload])
                held += with_payload and len(payload or b"")
                if held > 8 << 20:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)
        for f in files.values():
            f.close()

    return places.mapInArrow(run, schema)


def archive(df: DataFrame, folder: str | None = None, **columns) -> tuple[DataFrame, DataFrame]:
    """Writes archives and index below `folder`; returns the manifest and the rows of the index files."""
    spark: SparkSession = df.sparkSession
    folder = (folder or new_path(spark, "warc")).rstrip("/")
    manifest = write(classify(df, **columns), f"{folder}/archive")
    return manifest, index(manifest, f"{folder}/index")


def in_file_order(places: DataFrame) -> DataFrame:
    """Places by file and offset, so that reads go forward, in as many parts as their bytes ask for."""
    places = cut(places.select("path", "offset", "length"), "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    parts = max(_parts(places.sparkSession), -(-total // READ_BYTES))
    return places.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")


def round_trip(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives all pages, looks each of them up through the index and reads it back: the columns of `read` without payloads."""
    _, files = archive(without(df, "key"), folder)
    return read(in_file_order(look_up(wanted(df), files)), files, with_payload=False)


#: DuckDB SQL for round_trip over pages (ids unique and not null).
SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
 d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
 f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {MIN_PAYLOAD} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
 FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= {MIN_PAYLOAD}"""

__all__ = ["CaptureIndex", "archive", "capture_key", "classify", "in_file_order", "index", "look_up", "parse", "read", "record", "round_trip", "wanted", "write"]

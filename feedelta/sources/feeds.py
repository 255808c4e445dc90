"""Finding the tables of a feed: a directory, a zip archive, or an HTTP(S) folder or zip archive."""

from __future__ import annotations

import csv
import io
import os
import shutil
import tempfile
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from feedelta.plans import registry

TIMEOUT_S = 30


@dataclass(frozen=True)
class FeedFile:
    """A table's text: `path` can be read by whoever runs the scan; the header is already known."""

    name: str
    path: str
    headers: list[str]
    size: int | None


def is_url(path) -> bool:
    return str(path).lower().startswith(("http://", "https://"))


def is_archive_url(path) -> bool:
    return is_url(path) and urllib.parse.urlsplit(str(path)).path.lower().endswith(".zip")


def join_url(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{urllib.parse.quote(name)}"


def read_header(path: str) -> list[str]:
    """Names of the first CSV record without surrounding white space; [] for an empty file."""
    with open(path, encoding="utf-8-sig", newline=None) as f:
        return [c.strip() for c in next(csv.reader(f), [])]


#: What the status of an answer says about a file. Other errors are raised.
ABSENT, UNSURE, THERE = "absent", "unsure", "there"
SAYS = {
    "HEAD": {404: ABSENT, 410: ABSENT, 401: UNSURE, 403: UNSURE, 405: UNSURE, 501: UNSURE},
    "GET": {401: ABSENT, 403: ABSENT, 404: ABSENT, 410: ABSENT},
}
#: Files that are asked for at the same time.
PARALLEL = 8


@contextmanager
def _answer(url: str, method: str = "GET", **headers):
    request = urllib.request.Request(url, headers=headers, method=method)  # noqa: S310
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:  # noqa: S310
        yield answer


@dataclass(frozen=True)
class Probe:
    there: bool
    size: int | None = None


def probe(url: str) -> Probe:
    """Whether a file is there, and its size where the server tells it. Servers that refuse HEAD are asked for one byte."""
    for method, headers in (("HEAD", {}), ("GET", {"Range": "bytes=0-0"})):
        try:
            with _answer(url, method, **headers) as answer:
                said = answer.headers.get("Content-Length") if method == "HEAD" else None
                return Probe(True, int(said) if said and said.isdigit() else None)
        except urllib.error.HTTPError as e:
            verdict = SAYS[method].get(e.code)
            if verdict == ABSENT:
                return Probe(False)
            if verdict is None:
                raise
    raise AssertionError("a GET is never unsure")


def url_exists(url: str) -> bool:
    return probe(url).there


def url_size(url: str) -> int | None:
    """The size is only a hint: whatever goes wrong, it is unknown."""
    try:
        return probe(url).size
    except Exception:
        return None


def download(url: str, to: str) -> str | None:
    """Streams the file to a path; None if it is not there."""
    if not probe(url).there:
        return None
    with _answer(url) as answer, open(to, "wb") as f:
        shutil.copyfileobj(answer, f, 1 << 20)
    return to


@contextmanager
def open_feed(path, files: list[str] | None = None, staging: str | None = None):
    """Yields {file name: FeedFile}. Zip members and URLs are staged below `staging` (a folder all executors see;
    a temporary folder where none is given) and removed afterwards."""
    path = str(path)
    held = tempfile.mkdtemp(prefix="feed-", dir=staging)
    try:
        if is_archive_url(path):
            found = _from_zip(_archive(path, held), files, held)
        elif is_url(path):
            found = _from_url(path, files, held)
        elif os.path.isdir(path):
            found = {n: os.path.join(path, n) for n in sorted(os.listdir(path)) if n.endswith(".txt") and os.path.isfile(os.path.join(path, n))}
        elif os.path.isfile(path) and zipfile.is_zipfile(path):
            found = _from_zip(path, files, held)
        else:
            raise ValueError(f"{path!r} is neither a folder, a zip archive nor an http(s) folder")
        all_of_folder = is_url(path) and not is_archive_url(path) and not files
        if files is not None and not all_of_folder:
            found = {n: p for n, p in found.items() if n in set(files)}
        yield {n: FeedFile(n, os.path.abspath(p), read_header(p), os.path.getsize(p)) for n, p in sorted(found.items())}
    finally:
        shutil.rmtree(held, ignore_errors=True)


def _from_url(folder: str, files: list[str] | None, held: str) -> dict[str, str]:
    names = files or registry.supported_files()
    with ThreadPoolExecutor(PARALLEL) as pool:
        got = pool.map(lambda n: download(join_url(folder, n), os.path.join(held, os.path.basename(n))), names)
        return {n: path for n, path in zip(names, got, strict=True) if path}


def _archive(url: str, held: str) -> str:
    """The archive that a URL names, staged; its name cannot be that of a member, since members end in .txt."""
    path = download(url, os.path.join(held, "feed.zip"))
    if path is None or not zipfile.is_zipfile(path):
        raise ValueError(f"{url!r} is no zip archive")
    return path


def _from_zip(path: str, files: list[str] | None, held: str) -> dict[str, str]:
    """Members at any depth, keyed by base name; of equal base names the last member counts."""
    out = {}
    with zipfile.ZipFile(path) as z:
        members = {os.path.basename(m.filename): m for m in z.infolist() if not m.is_dir() and m.filename.endswith(".txt")}
        for name, member in members.items():
            if files is None or name in files:
                out[name] = os.path.join(held, name)
                with z.open(member) as src, open(out[name], "wb") as dst:
                    shutil.copyfileobj(src, dst)
    return out


def text_of(path: str) -> io.TextIOBase:
    return open(path, encoding="utf-8-sig", newline=None)

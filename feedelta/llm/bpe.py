"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that ends the encoding of that prefix. A suffix automaton of the
vocabulary yields the tokens that are suffixes of the prefix, longest first; the first whose left neighbour (the stored
last token of what remains) is compatible with it is that token. Two tokens are compatible if merging their joined text
gives just these two. Following the stored tokens back from the end of the word gives the ids. Time is linear in the
length of a word, so a text without any white space costs no more than ordinary prose.

Defined results: null and empty texts have no tokens; repeated rows are encoded alike; all other columns are kept (a
column that has the name of a result column is replaced); an empty table gives an empty table. A text is one unit of
work; texts are never cut.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from feedelta.llm.common import bounded_batches, held_by_worker, releasing, without

#: The last character of a word is moved up by this much, so "ends a word" is part of the alphabet.
END = 0x1000
#: Entries of a generation of a Python worker's cache of words; the cache of pairs is emptied when it has as many.
WORD_CACHE, PAIR_CACHE = 150_000, 200_000
NEVER = 1 << 30
#: Texts are encoded together until they have about as many bytes.
PART_BYTES = 2 << 20
# How the vocabulary's file normalises texts and splits them into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Automaton:
    """Suffix automaton of all tokens: transitions in one dict, links and lengths in arrays."""

    def __init__(self, tokens: dict[str, int]):
        self.next: dict[int, int] = {}  # state << 16 | character -> state
        self.link, self.len = array("i", [-1]), array("i", [0])
        out: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for text, token in tokens.items():
            last = 0
            for c in map(ord, text):
                last = self._extend(out, last, c)
            ends[last] = token
        for v, row in enumerate(out):
            for c, w in row.items():
                self.next[v << 16 | c] = w
        #: token whose text is the longest text of the state
        self.token = array("i", [ends.get(v, -1) for v in range(len(out))])
        #: for states met so far: (token, length) of all tokens that are suffixes of the state's texts, longest first
        self.suffixes: list[tuple | None] = [None] * len(out)

    def tokens_of(self, state: int) -> tuple:
        found, v = [], state
        while v > 0:
            if self.token[v] >= 0:
                found.append((self.token[v], self.len[v]))
            v = self.link[v]
        self.suffixes[state] = got = tuple(found)
        return got

    def _extend(self, out: list[dict[int, int]], last: int, c: int) -> int:
        if c in out[last]:
            q = out[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(out, last, c, q)
        new = len(out)
        out.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in out[p]:
            out[p][c] = new
            p = self.link[p]
        if p != -1:
            q = out[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(out, p, c, q)
        return new

    def _split(self, out: list[dict[int, int]], p: int, c: int, q: int) -> int:
        twin = len(out)
        out.append(dict(out[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p != -1 and out[p].get(c) == q:
            out[p][c] = twin
            p = self.link[p]
        return twin


class Bpe:
    """Encoder and decoder of one vocabulary file (a BPE model with word ends and byte-level characters)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        splitters = spec["pre_tokenizer"].get("pretokenizers", [{}])
        if spec["normalizer"] != NORMALIZER or splitters[0].get("pattern") != {"Regex": SPLIT} or [x.get("type") for x in splitters] != ["Split", "ByteLevel"]:
            raise ValueError("a vocabulary with another normaliser or splitter")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with conditions")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.names[i] = t
        own = lambda t: t[:-5] + chr(ord(t[-5]) + END) if t.endswith("</w>") else t
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(own(a), own(b)): i for i, (a, b) in enumerate(pairs)}
        ids = {own(t): i for t, i in model["vocab"].items()}
        #: tokens that their own merges produce, with their last merge; others never occur in an encoding
        halves = {t: self._merge(list(t), 2) for t in ids}
        usable = {t: ids[t] for t, h in halves.items() if len(h) == 1 or len(h) == 2 and tuple(h) in self.rank and h[0] + h[1] == t}
        self.whole = usable
        self.pair_rank = {ids[a] << 20 | ids[b]: r for (a, b), r in self.rank.items() if a in usable and b in usable}
        self.edge = ({}, {})  # of each token: its last (first) part at every stage of its merging, with the rank that ends the stage
        for t in sorted(usable, key=len):
            h = halves[t]
            for side, part in ((0, h[-1]), (1, h[0])):
                inner = self.edge[side][ids[part]][:-1] + ((ids[part], self.rank[tuple(h)]),) if len(h) == 2 else ()
                self.edge[side][ids[t]] = (*inner, (ids[t], NEVER))
        self.sam = Automaton(usable)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _merge(self, parts: list[str], until: int = 1) -> list[str]:
        """Merging by rank as long as more than `until` parts are left; for single tokens."""
        rank, none = self.rank, len(self.rank)
        while len(parts) > until:
            best = min(rank.get(p, none) for p in zip(parts, parts[1:], strict=False))
            if best == none:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1]), none) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, left: int, right: int, cache: dict[int, bool]) -> bool:
        """Whether nothing merges across the border of two tokens that stand side by side.

        The border's two parts grow as their tokens do. A merge across it happens if its rank comes before the ranks by
        which either part is taken into its own token; of equal ranks the one further left comes first.
        """
        if len(cache) >= PAIR_CACHE:
            cache.clear()
        rank, xs, ys = self.pair_rank.get, self.edge[0][left], self.edge[1][right]
        i = j = 0
        ok = True
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = rank(x << 20 | y, NEVER)
            if r < x_ends and r <= y_ends and r != NEVER:
                ok = False
                break
            if x_ends <= y_ends:
                if x_ends == NEVER:
                    break
                i += 1
            else:
                j += 1
        cache[left << 20 | right] = ok
        return ok

    def words(self, sorted_words: list[str], cache: dict[int, bool]) -> Iterator[list[int]]:
        """Ids of words in ascending order, each in the alphabet in which its last character is moved up.

        What is stored for a prefix holds for every word that begins with it, so neighbours share that work.
        """
        nxt, link, size, suffixes = self.sam.next.get, self.sam.link, self.sam.len, self.sam.suffixes
        last, at, states, lengths = [0], [0], [0], [0]  # by prefix: last token, its start, automaton state, match length
        before = ""
        for s in sorted_words:
            if s in self.whole:
                yield [self.whole[s]]
                continue
            i = 0
            for a, b in zip(s, before, strict=False):
                if a != b:
                    break
                i += 1
            before = s
            del last[i + 1 :], at[i + 1 :], states[i + 1 :], lengths[i + 1 :]
            state, matched = states[i], lengths[i]
            for c in map(ord, s[i:]):
                i += 1
                to = nxt(state << 16 | c)
                while to is None:
                    if not state:
                        raise ValueError(f"no token for {s[i - 1]!r}")
                    state = link[state]
                    matched = size[state]
                    to = nxt(state << 16 | c)
                state = to
                matched += 1
                for t, k in suffixes[to] or self.sam.tokens_of(to):
                    if k <= matched:
                        j = i - k
                        if j:
                            key = last[j] << 20 | t
                            if not (cache[key] if key in cache else self.compatible(last[j], t, cache)):
                                continue
                        last.append(t)
                        at.append(j)
                        break
                else:
                    raise AssertionError("a prefix without a last token")
                states.append(state)
                lengths.append(matched)
            out = []
            while i:
                out.append(last[i])
                i = at[i]
            out.reverse()
            yield out


class Recent:
    """A cache of two generations: a full one becomes the old one, and what is asked for again moves up from it."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys: list) -> list:
        """Those of the distinct keys that are not held; all others are in `now` afterwards."""
        now = self.now
        lack = [k for k in keys if k not in now]
        if now and len(now) + len(lack) > self.most:
            self.old, self.now, lack = now, {}, keys
        if not self.old:
            return lack
        old, now, out = self.old, self.now, []
        for k in lack:
            if k in old:
                now[k] = old[k]
            else:
                out.append(k)
        return out


class Codec:
    """Texts to ids and back, with caches of words and token pairs. A part's texts are cut into words, each distinct word is
    encoded once, and ids are gathered and joined by column operations."""

    #: Below this, lower case and normal forms are the same in every Unicode version.
    _OTHER = r"[^\x00-\u024f]"

    def __init__(self, bpe: Bpe):
        import os

        import pyarrow as pa
        import regex

        self.bpe, self.known, self.pairs = bpe, Recent(WORD_CACHE), {}
        self.other = regex.compile(self._OTHER)
        self.split = regex.compile(SPLIT)
        names = sorted(bpe.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        #: what all special tokens begin with; a text without it has none
        self.mark = os.path.commonprefix(names)
        self.byte = byte_alphabet()
        self.names = pa.array(bpe.names, pa.string())
        self._library = None

    def _others(self, text: str) -> list[str]:
        """Words of a text with rare scripts: its chunks with such letters go through the library's own normaliser and splitter."""
        import unicodedata

        if self._library is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
            self._library = normal, pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True)
        normal, splitter = self._library
        out: list[str] = []
        # Neither normal form, lower case nor words reach across a space, so chunks can be treated alone.
        for chunk in text.split(" "):
            if self.other.search(chunk) is None:
                out += self.split.findall(unicodedata.normalize("NFC", chunk).lower())
            else:
                out += [w for w, _ in splitter.pre_tokenize_str(normal.normalize_str(chunk))]
        return out

    def _plain(self, text: str) -> list[str]:
        """Words of a text without special tokens, in normal form."""
        if text.isascii():
            return self.split.findall(text.lower())
        if self.other.search(text) is not None:
            return self._others(text)
        import unicodedata

        return self.split.findall(unicodedata.normalize("NFC", text).lower())

    def words_of(self, text: str | None) -> list[str]:
        """Words of a text; a special token is a word of its own, led by a space, which no other word has."""
        if not text:
            return []
        if self.cut is None or self.mark not in text:
            return self._plain(text)
        return [w for part in self.cut.split(text) for w in ([f" {part}"] if part in self.bpe.special else self._plain(part))]

    def _spelled(self, w: str) -> str:
        s = w if w.isascii() and w.isprintable() else "".join(map(self.byte.__getitem__, w.encode()))
        return s[:-1] + chr(ord(s[-1]) + END)

    def _learn(self, words: list[str]) -> None:
        known = self.known.now
        plain = []
        for w in words:
            if w[0] == " ":
                known[w] = _little(array("I", [self.bpe.special[w[1:]]]))
            else:
                plain.append((self._spelled(w), w))
        plain.sort()
        for (_, w), ids in zip(plain, self.bpe.words([s for s, _ in plain], self.pairs), strict=True):
            known[w] = _little(array("I", ids))

    def encode_parts(self, texts: list[str | None]):
        """The number of ids of each text (numpy int64) and all ids in a row (numpy uint32)."""
        import numpy as np
        import pyarrow as pa

        words, sizes = [], []
        for t in texts:
            got = self.words_of(t)
            words += got
            sizes.append(len(got))
        if not words:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        coded = pa.array(words, pa.string()).dictionary_encode()
        del words
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if new := self.known.missing(distinct):
            self._learn(new)
        have = self.known.now
        own = [have[w] for w in distinct]
        flat = np.frombuffer(b"".join(own), "<u4")
        n = np.fromiter(map(len, own), np.int64, len(own)) // 4
        first = np.cumsum(n) - n
        each = n[at]
        ends = np.cumsum(each)
        ids = flat[np.repeat(first[at] - (ends - each), each) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.diff(upto), ids

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        import numpy as np

        n, ids = self.encode_parts(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_parts(self, n, ids):
        """Token texts with a space between them, as an Arrow array of strings: the vocabulary's file names no decoder, and that is what decoding then means."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(pa.array(ids))), " ")

    def decode(self, ids: bytes | None) -> str:
        import numpy as np

        got = np.frombuffer(ids or b"", "<u4")
        return self.decode_parts(np.array([len(got)]), got)[0].as_py()


def _little(x) -> bytes:
    """Bytes of 32-bit integers, least significant byte first."""
    import sys

    if isinstance(x, array):
        if sys.byteorder == "big":
            x.byteswap()
        return x.tobytes()
    return x.astype("<u4").tobytes()


def _mapped(df: DataFrame, vocabulary: str, source: str, results: list[StructField], work) -> DataFrame:
    """df with the columns that `work` makes of parts of a column: Arrow arrays, one for each result."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = df.sparkSession
    bounded_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kept = without(df, *(f.name for f in results)).columns
    schema = StructType([*(df.schema[c] for c in kept), *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_by_worker(("bpe", vocabulary), lambda: Codec(Bpe(json.loads(spec.value))))
        for batch in batches:
            sizes, at = pc.fill_null(pc.binary_length(batch.column(source)), 0).to_pylist(), 0
            while at < len(sizes):
                start, held = at, 0
                while at < len(sizes) and held < PART_BYTES:
                    held += sizes[at]
                    at += 1
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(codec, part.column(source))], names=schema.names)

    return df.mapInArrow(lambda batches: releasing(run(batches)), schema)


def _packed(n, ids):
    """Ids of each row as one binary value; the values lie in one buffer."""
    import numpy as np
    import pyarrow as pa

    offsets = (4 * np.concatenate([[0], np.cumsum(n)])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(_little(ids))])


def _encoded(codec: Codec, texts) -> list:
    import pyarrow as pa

    n, ids = codec.encode_parts(texts.to_pylist())
    return [pa.array(n, pa.int64()), _packed(n, ids)]


def _round_trip(codec: Codec, texts) -> list:
    import pyarrow as pa

    n, ids = codec.encode_parts(texts.to_pylist())
    return [pa.array(n, pa.int64()), _packed(n, ids), codec.decode_parts(n, ids)]


def _decoded(codec: Codec, packed) -> list:
    import numpy as np

    raw = [x or b"" for x in packed.to_pylist()]
    return [codec.decode_parts(np.array([len(x) // 4 for x in raw]), np.frombuffer(b"".join(raw), "<u4"))]


_N_TOKENS, _IDS, _TEXT = StructField("n_tokens", LongType(), False), StructField("ids", BinaryType(), False), StructField("decoded", StringType(), False)


def encode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df with n_tokens (bigint) and ids (binary, little-endian unsigned 32-bit)."""
    return _mapped(df, vocabulary, text, [_N_TOKENS, _IDS], _encoded)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """df with decoded (string)."""
    return _mapped(df, vocabulary, ids, [_TEXT], _decoded)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """encode and decode in one pass over the batches: n_tokens, ids, decoded."""
    return _mapped(df, vocabulary, text, [_N_TOKENS, _IDS, _TEXT], _round_trip)


def ids_array(ids: Column) -> Column:
    """Packed ids as array<bigint>, on the JVM."""
    four = lambda i, k: F.conv(F.substring(F.hex(F.substring(ids, i * 4 + k, 1)), 1, 2), 16, 10).cast("bigint")
    return F.when(F.length(ids) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1),
            lambda i: four(i, 1) + F.shiftleft(four(i, 2), 8) + F.shiftleft(four(i, 3), 16) + F.shiftleft(four(i, 4), 24),
        )
    )


def digests(df: DataFrame) -> DataFrame:
    """The result columns of the registered query, from the operator's outputs."""
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

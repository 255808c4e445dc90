"""MinHash near-duplicates by an LSH forest, confirmed on whole shingle sets.

Documents with the same words in the same order form one class. Each class gets a signature of 128 minimum hashes, which
is read in 32 orders (rotations); every order is sorted, and classes whose longest common prefix with a neighbour is at
least DEPTH values form a region. A region with more than REGION classes is split where its prefixes part, deeper and
deeper, so the depth follows the density. Inside a region signatures are compared, and pairs that may be similar are
handed on. A pair at the threshold meets in one order with chance 0.75 ** DEPTH, in none of 32 with chance 2e-8 (DEPTH 3).

Candidates are confirmed on the full shingle sets (64-bit hashes), in two steps. First the two likeliest partners of
each class, out of a spanning forest of likely pairs in each region. Then, in each region that still has several
components, whole sets are compared for all likely pairs between them. Only links leave a region, fewer than it has
classes; what is not compared lies within one component already, so no component changes by it.

Deeper prefixes part similar classes, and so do the borders of sorted partitions. The classes of such a run therefore take
a second path, which is exact, if the run still has several components: every set is put in one order, from rare to
frequent shingles, and two similar sets have a shingle in common among the first |set| - ceil(75 % of |set|) + 1 of each.
Whole sets are compared within the list of every such shingle whose classes are in several components; equal lists are
compared once, long ones block by block. Nothing is capped. How frequent a shingle is comes from COUNTERS counts of hash
values; any order that is the same for all sets is right, and this one makes lists short.

Contract: words are runs of other than the six ASCII white-space characters, A-Z in lower case; a document's set has its
distinct 5-word shingles, or its whole word sequence if it has fewer words; documents are linked if 100 * intersection >=
75 * union. Empty sets are linked with nothing. Defined results: null and empty texts have no shingles and are their own
component; rows that repeat an id are separate documents, kept if the id is the component's smallest; a null id is never
smallest unless all are null, and such rows are kept; extra columns are ignored by `near_duplicates` and kept by `dedup`;
an empty table gives an empty table.

Bounds: texts are hashed in pieces of about PIECE bytes; region work holds at most REGION sketches (128 bytes each), their
similarity matrix and sets, a block of a list about half of that; COUNTERS counts reach the driver. Word sequences are told
apart by 128 bits: classes are keyed by 64 of them, and should the other 64 differ within a class, all is hashed anew with
another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedelta.llm.common import bounded_batches, cut, drop, held_by_worker, releasing
from feedelta.llm.components import components

WORDS = 5
HASHES, ORDERS, DEPTH, LABEL = 128, 32, 3, 8
#: Bytes of text that are hashed together, and the length from which a word is hashed by itself.
PIECE, LONG_WORD = 1 << 20, 1 << 16
#: Counts of shingle hashes, and the parts in which they are added up.
COUNTERS, SLICES = 1 << 20, 64
#: Most classes of a region; beyond, prefixes are taken longer, and the classes are also compared by their rare shingles.
REGION = 1024
#: Signature agreement from which a pair is confirmed: 0.75 less 5.2 standard deviations of the estimate, which a pair at the
#: threshold misses with chance 5e-7.
LIKELY = 0.55
PERCENT = 75
#: Shingles of a region up to which a table of all of them is made.
MARKED = 4 << 20


class Hasher:
    """Shingle sets and signatures of texts, by operations on whole arrays of bytes and words."""

    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(11)
        self.np = np
        self.letter = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.letter[65:91] = self.letter[97:123]  # A-Z count as a-z
        self.white = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
        self.power = np.multiply.accumulate(np.full(LONG_WORD, rng.integers(0, 2**61) * 8 + 5, np.uint64))
        self.mul = rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, HASHES, dtype=np.uint32)

    def _mixed(self, h):
        np = self.np
        h = h ^ (h >> np.uint64(31))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def words(self, raw, bounds):
        """A hash of each word of raw (uint8), and the number of words before each bound. Words don't reach over bounds."""
        np = self.np
        white = self.white[raw]
        begins, ends = ~white, ~white
        filled = np.diff(bounds) > 0
        firsts, lasts = bounds[:-1][filled], bounds[1:][filled] - 1
        begins[1:] &= white[:-1]
        begins[firsts] = ~white[firsts]
        ends[:-1] &= white[1:]
        ends[lasts] = ~white[lasts]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size = end - start
        before = np.searchsorted(start, bounds)
        if not len(start):
            return np.zeros(0, np.uint64), before
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            import xxhash

            for i in long:
                white[start[i] : end[i]] = True
                white[start[i]] = False  # stands for the word
            size[long] = 1
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        h = np.add.reduceat(self.letter[raw[~white]] * self.power[place], at)
        for i in long:
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes().lower())
        return self._mixed(h), before

    def _pieces(self, raw, bounds):
        """Words of all texts, piece by piece; a long text is cut at white space."""
        np = self.np
        i, n = 0, len(bounds) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PIECE, side="right")) - 1)
            a, b = bounds[i], bounds[j]
            if b - a <= PIECE:
                h, before = self.words(raw[a:b], bounds[i : j + 1] - a)
                for k in range(j - i):
                    yield h[before[k] : before[k + 1]]
            else:  # one long text
                got = []
                while a < b:
                    c = min(a + PIECE, b)
                    while c < b and not self.white[raw[c]]:
                        c += 1
                    got.append(self.words(raw[a:c], np.array([0, c - a]))[0])
                    a = c
                yield np.concatenate(got)
            i = j

    def texts(self, column) -> Iterator:
        """The word hashes of each text of an Arrow column; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        column = pc.fill_null(column, "").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        yield from self._pieces(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds)

    def shingles(self, h):
        """Sorted distinct hashes of the word shingles."""
        np = self.np
        if not len(h):
            return np.zeros(0, np.uint64)
        n = max(1, len(h) - WORDS + 1)
        # A sequence shorter than a shingle is told apart by its length.
        s = np.full(n, min(len(h), WORDS) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for k in range(min(WORDS, len(h))):
            s += h[k : k + n] * self.mul[k]
        return np.unique(self._mixed(s))

    def signature(self, shingles):
        """HASHES values of 16 bits."""
        np = self.np
        low = np.full(HASHES, 2**32 - 1, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 512):
            np.minimum(low, (x[i : i + 512, None] * self.a + self.b).min(axis=0), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _signed(v: int) -> int:
    return v - 2**64 if v >= 2**63 else v


def sequence_hash(h, seed: int) -> tuple[int, int]:
    """The class of a word sequence, and 64 bits more that tell classes with the same key apart."""
    import xxhash

    v = xxhash.xxh3_128_intdigest(h.tobytes(), seed)
    return _signed(v % 2**64), _signed(v >> 64)


def _hasher() -> Hasher:
    return held_by_worker("shingles", Hasher)


def signatures(df: DataFrame, id_col: str, text: str, seed: int = 0) -> DataFrame:
    """doc_id, node and proof (hashes of the word sequence; null without words), n_shingles, sig (16-bit values, most
    significant byte first), sketch (their low bytes)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = _hasher()
        for b in batches:
            nodes, proofs, sizes, sigs, low = [], [], [], [], []
            for h in hasher.texts(b.column("text")):
                s = hasher.shingles(h)
                node, proof = sequence_hash(h, seed) if len(h) else (None, None)
                sig = hasher.signature(s) if len(h) else None
                nodes.append(node)
                proofs.append(proof)
                sizes.append(len(s))
                sigs.append(None if sig is None else sig.astype(">u2").tobytes())
                low.append(None if sig is None else sig.astype("u1").tobytes())
            cols = [pa.array(nodes, pa.int64()), pa.array(proofs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "node", "proof", "n_shingles", "sig", "sketch"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lambda batches: releasing(run(batches)), "doc_id bigint, node bigint, proof bigint, n_shingles bigint, sig binary, sketch binary")


def _labels(classes: DataFrame) -> DataFrame:
    """o (order), label (LABEL values of two bytes), node: each class once in every order."""
    step, size = 2 * HASHES // ORDERS, 2 * LABEL
    around = F.concat("sig", F.substring("sig", 1, size))
    rows = classes.select("node", around.alias("around"), F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("o"))
    return rows.select("o", F.substring("around", F.col("o") * step + 1, F.lit(size)).alias("label"), "node")


def _split(common, lo: int, hi: int, depth: int, most: int) -> list[tuple[int, int]]:
    """Regions within lo..hi, whose neighbours share at least `depth` values; common[i] is shared by i - 1 and i.

    A region that is too large is cut where fewer than depth + 1 values are shared. What is alike to the last value is
    cut into pieces that share their border classes.
    """
    import numpy as np

    if hi - lo <= most:
        return [(lo, hi)]
    if depth == LABEL:
        return [(i, min(i + most, hi)) for i in range(lo, hi - 1, most - 1)]
    cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] <= depth)).tolist(), hi]
    return [r for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for r in _split(common, a, b, depth + 1, most)]


def _regions(labels: DataFrame, most: int) -> DataFrame:
    """region, node, parted for all regions of at least two classes, from the sorted orders. Classes of runs that are cut, by
    depth or by the border of a partition, come once more with the run as region and `parted` true."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        def name(o, values) -> int:
            return xxhash.xxh3_64_intdigest(values.tobytes() + int(o).to_bytes(2, "big"))

        def out(o, lab, nodes, border):
            # border: whether the first and the last run may go on elsewhere
            common = np.zeros(len(nodes), np.int64)
            same = (lab[1:] == lab[:-1]) & (o[1:] == o[:-1])[:, None]
            common[1:] = np.where(same.all(axis=1), LABEL, same.argmin(axis=1))
            starts = np.flatnonzero(common < DEPTH)
            ends = np.append(starts[1:], len(nodes))
            ids, members, parted = [], [], []
            # Runs of one class are met in no region, unless they may go on elsewhere.
            some = (ends - starts > 1) | ((starts == 0) & border[0]) | ((ends == len(nodes)) & border[1])
            for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
                if b - a > most or (a == 0 and border[0]) or (b == len(nodes) and border[1]):
                    ids.append(np.full(b - a, name(o[a], lab[a, :DEPTH]), np.uint64))
                    members.append(nodes[a:b])
                    parted.append(np.ones(b - a, bool))
                if b - a < 2:
                    continue
                for lo, hi in _split(common, a, b, DEPTH, most):
                    deep = int(common[lo + 1 : hi].min())
                    key = lab[lo, :deep] if deep < LABEL else np.append(lab[lo].view(np.uint8), nodes[lo : lo + 1].view(np.uint8))
                    ids.append(np.full(hi - lo, name(o[lo], key), np.uint64))
                    members.append(nodes[lo:hi])
                    parted.append(np.zeros(hi - lo, bool))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).view(np.int64)), pa.array(np.concatenate(members)), pa.array(np.concatenate(parted))], names=["region", "node", "parted"])

        held: list = []
        opens = True  # the first run may have begun in the partition before
        for b in batches:
            o = b.column("o").to_numpy()
            lab = np.frombuffer(b"".join(b.column("label").to_pylist()), ">u2").reshape(-1, LABEL)
            nodes = b.column("node").to_numpy()
            if held:
                o, lab, nodes = (np.concatenate([x, y]) for x, y in zip(held, (o, lab, nodes), strict=True))
            # The run that is still open at the end of the batch waits for the next batch; a run of many batches is cut.
            last = len(o) - 1
            while last > 0 and o[last - 1] == o[last] and (lab[last - 1, :DEPTH] == lab[last, :DEPTH]).all():
                last -= 1
            if last == 0 or len(o) - last > 64 * most:
                if len(o) <= 64 * most:
                    held = [o, lab, nodes]
                    continue
                last = len(o) - 1
            goes_on = last > 0 and o[last - 1] == o[last] and bool((lab[last - 1, :DEPTH] == lab[last, :DEPTH]).all())
            yield from out(o[:last], lab[:last], nodes[:last], (opens, goes_on))
            held, opens = [x[last:] for x in (o, lab, nodes)], goes_on
        if held:
            yield from out(*held, (opens, True))

    parts = max(2, int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = labels.repartitionByRange(parts, "o", "label").sortWithinPartitions("o", "label", "node")
    return ordered.mapInArrow(lambda batches: releasing(run(batches)), "region bigint, node bigint, parted boolean")


def _agreement(sketch):
    import numpy as np

    m = len(sketch)
    e = np.zeros((m, m), np.uint8)
    for j in range(sketch.shape[1]):
        c = sketch[:, j]
        e += c[:, None] == c
    np.fill_diagonal(e, 0)
    return e


def _forest(e, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of greatest agreement, using agreements of at least `least` only."""
    import numpy as np

    m = len(e)
    best, parent, left = np.full(m, -1, np.int16), np.full(m, -1), np.ones(m, bool)
    out = []
    for _ in range(m):
        i = int(np.argmax(np.where(left, best, -2)))
        if best[i] >= least:
            out.append((int(parent[i]), i))
        left[i] = False
        better = left & (e[i] > best)
        best[better] = e[i][better]
        parent[better] = i
    return out


def _by_region(batches: Iterator, names: list[str]) -> Iterator[list]:
    """The columns of one region after another, from rows in the order of regions. Numbers as arrays, binaries as lists."""
    import numpy as np

    held: list = []
    for b in batches:
        cols = [c.to_pylist() if str(c.type) == "binary" else c.to_numpy() for c in (b.column(n) for n in names)]
        if held:
            cols = [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])).tolist()
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield [c[lo:hi] for c in cols]
        held = [c[starts[-1] :] for c in cols]
    if held:
        yield held


def _in_batches(parts: Iterator[list], names: list[str]) -> Iterator:
    """Record batches of about 100,000 rows from lists of columns."""
    import numpy as np
    import pyarrow as pa

    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def _sketches(raw: list[bytes]):
    import numpy as np

    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, HASHES)


def _least() -> int:
    return -int(-LIKELY * HASHES // 1)


def _likely_pairs(regions: DataFrame) -> DataFrame:
    """a, b, est: of each region a spanning forest of its likely pairs, so fewer pairs than classes."""

    def found(batches: Iterator) -> Iterator[list]:
        import numpy as np

        for _, nodes, raw in _by_region(batches, ["region", "node", "sketch"]):
            e = _agreement(_sketches(raw))
            edges = _forest(e, _least())
            if edges:
                i, j = (np.array(x) for x in zip(*edges, strict=True))
                yield [np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j]), e[i, j].astype(np.int32)]

    ordered = _together(regions).select("region", "node", "sketch")
    return ordered.mapInArrow(lambda batches: _in_batches(found(batches), ["a", "b", "est"]), "a bigint, b bigint, est int").distinct()


def _together(regions: DataFrame) -> DataFrame:
    parts = max(2, int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return regions.repartition(parts, "region").sortWithinPartitions("region", "node")


def _rest(regions: DataFrame, whole: bool = False) -> DataFrame:
    """a, b: links between the components of each region, found by comparing whole sets of all likely pairs, or, if `whole`,
    of all pairs whose sizes allow it.

    regions: region, node, root, sketch (not if `whole`), set. Once two components are linked, pairs between them are not
    needed any more, so a region gives fewer links than it has components.
    """
    names = ["region", "node", "root", *([] if whole else ["sketch"]), "set"]

    def found(batches: Iterator) -> Iterator[list]:
        import numpy as np

        for _, nodes, roots, *raw, sets in _by_region(batches, names):
            if (roots == roots[0]).all():
                continue
            size = np.array([len(x) // 8 for x in sets])
            likely = 100 * np.minimum.outer(size, size) >= PERCENT * np.maximum.outer(size, size) if whole else _agreement(_sketches(raw[0])) >= _least()
            group = np.unique(roots, return_inverse=True)[1]
            likely &= group[:, None] != group[None, :]
            live = np.flatnonzero(likely.any(axis=1))
            if not len(live):
                continue
            sizes = _intersections({i: np.frombuffer(sets[i], np.uint64) for i in live.tolist()})
            a, b = [], []
            for i in live.tolist():
                js = np.flatnonzero(likely[i, i + 1 :] & (group[i + 1 :] != group[i])) + i + 1
                if not len(js):
                    continue
                both = sizes(i, js)
                for j in js[100 * both >= PERCENT * (size[i] + size[js] - both)].tolist():
                    if group[i] != group[j]:
                        a.append(nodes[i])
                        b.append(nodes[j])
                        group[group == group[j]] = group[i]
            if a:
                a, b = np.array(a), np.array(b)
                yield [np.minimum(a, b), np.maximum(a, b)]

    ordered = _together(regions).select(*names)
    return ordered.mapInArrow(lambda batches: _in_batches(found(batches), ["a", "b"]), "a bigint, b bigint").distinct()


def _intersections(sets: dict):
    """A function (i, js) -> sizes of the intersections of set i with each of the sets js."""
    import numpy as np

    if sum(map(len, sets.values())) > MARKED:
        # Large sets are looked up one in the other, which needs no table of all their members.
        def looked_up(i, js):
            own, out = sets[i], []
            for j in js.tolist():
                at = np.minimum(np.searchsorted(own, sets[j]), len(own) - 1)
                out.append(int((own[at] == sets[j]).sum()))
            return np.array(out)

        return looked_up
    ids = np.unique(np.concatenate(list(sets.values())), return_inverse=True)[1]
    own = dict(zip(sets, np.split(ids, np.cumsum([len(x) for x in sets.values()])[:-1]), strict=True))
    mark = np.zeros(int(ids.max()) + 1, np.int32)

    def marked(i, js):
        mark[own[i]] = 1
        parts = [own[j] for j in js.tolist()]
        got = np.add.reduceat(mark[np.concatenate(parts)], np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]))
        mark[own[i]] = 0
        return got

    return marked


def _frequency(sets: DataFrame):
    """Of each of COUNTERS hash values a number that grows with how many shingles have it. Each task sends its counts once, in
    SLICES parts; their sums reach the driver (four bytes each)."""
    import numpy as np

    width = COUNTERS // SLICES

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for raw in b.column("set"):
                np.add.at(n, _counter(np.frombuffer(raw.as_buffer(), np.uint64)), 1)
        if n.any():
            parts = n.astype("<u4").reshape(SLICES, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "n"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for k, raw in zip(b.column("slice").to_pylist(), b.column("n"), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()], pa.binary())], names=["slice", "n"])

    kind = "slice int, n binary"
    total = np.zeros((SLICES, width), np.uint32)
    for r in sets.select("set").mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect():
        total[r["slice"]] = np.frombuffer(r["n"], "<u4")
    return (8 * np.log2(np.maximum(total.ravel(), 1))).astype(np.uint8)


def _counter(shingles):
    import numpy as np

    return (shingles >> np.uint64(64 - (COUNTERS - 1).bit_length())).astype(np.int64)


def _first_shingles(sets: DataFrame, frequency) -> DataFrame:
    """shingle, node, root: of each set so many of its rarest shingles that two similar sets have one of them in common."""
    sent = sets.sparkSession.sparkContext.broadcast(frequency)  # COUNTERS bytes

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rank = sent.value
        for b in batches:
            parts, sizes = [], []
            for raw in b.column("set"):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                k = len(s) - -(-len(s) * PERCENT // 100) + 1
                parts.append(s[np.argsort(rank[_counter(s)], kind="stable")[:k]])
                sizes.append(k)
            if parts:
                n = np.array(sizes)
                cols = [np.concatenate(parts).view(np.int64), np.repeat(b.column("node").to_numpy(), n), np.repeat(b.column("root").to_numpy(), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shingle", "node", "root"])

    return sets.select("node", "root", "set").mapInArrow(lambda batches: releasing(run(batches)), "shingle bigint, node bigint, root bigint")


def _rare_lists(sets: DataFrame, most: int) -> DataFrame:
    """region, node, root: classes that have one of their rarest shingles in common, where these are in several components.

    sets: node, root, set. Any two sets that are similar enough and in different components are together in some region. A
    list of more than `most` classes is dealt to cells of about most / 4, and every two cells make a region; cells of one and
    the same component are not paired, so a large group costs only the outsiders in its lists.
    """
    first = cut(_first_shingles(sets, _frequency(sets)), "firsts")
    total = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)"))
    lists = first.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), total(1).alias("t1"), total(2).alias("t2")).where("lo <> hi")
    # Equal lists have equal sums of hashes.
    lists = cut(lists.groupBy("n", "t1", "t2").agg(F.min("shingle").alias("shingle")).select("shingle", "n"), "lists")
    listed = cut(first.join(lists, "shingle"), "listed")
    small = listed.where(F.col("n") <= most).select(F.xxhash64("shingle", F.lit(-1), F.lit(-1)).alias("region"), "node", "root")
    long = listed.where(F.col("n") > most)
    if long.isEmpty():
        return small
    cell = max(1, most // 4)
    part = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), F.ceil(F.col(n) / cell))
    large = long.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > cell)
    long = long.join(large, ["shingle", "root"], "left")
    # A cell of a large component's own has its root; the others are mixed.
    own = F.col("m").isNotNull()
    long = cut(long.select("shingle", "node", "root", F.when(own, F.col("root")).alias("only"), F.when(own, F.xxhash64("root", part("node", "m"))).otherwise(part("node", "n")).alias("cell")), "cells")
    cells = long.select("shingle", "cell", "only").distinct()
    other = cells.select(F.col("shingle").alias("s2"), F.col("cell").alias("c2"), F.col("only").alias("o2"))
    paired = cells.join(other, (F.col("shingle") == F.col("s2")) & (F.col("cell") <= F.col("c2")) & ~F.coalesce(F.col("only") == F.col("o2"), F.lit(False)))
    paired = cut(paired.select("shingle", "cell", "c2", F.xxhash64("shingle", "cell", "c2").alias("region")), "paired")
    both = paired.select("shingle", "cell", "region").unionAll(paired.where("cell <> c2").select("shingle", F.col("c2").alias("cell"), "region"))
    return small.unionAll(both.join(long, ["shingle", "cell"]).select("region", "node", "root"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs whose sets are similar enough."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            a_sets, b_sets, keep = b.column("sa"), b.column("sb"), []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a_sets, b_sets))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(lambda batches: releasing(run(batches)), "a bigint, b bigint")


def _sets(df: DataFrame, id_col: str, text: str, wanted: DataFrame, seed: int) -> DataFrame:
    """node, set for the documents (doc_id, node) that stand for their classes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = _hasher()
        for b in batches:
            nodes, sets = [], []
            for h in hasher.texts(b.column("text")):
                nodes.append(sequence_hash(h, seed)[0])
                sets.append(hasher.shingles(h).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    some = rows.join(wanted, F.coalesce(rows["doc_id"], F.lit(-1)) == wanted["stands"], "left_semi")
    made = some.select("text").mapInArrow(lambda batches: releasing(run(batches)), "node bigint, set binary")
    # Rows may share an id; only the wanted classes stay, each once.
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document."""
    docs, groups = _grouped(df, id_col, text)
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = docs.join(groups, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _classes(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their class, the classes, and the seed by which no two word sequences share a class."""
    for seed in range(8):
        docs = cut(signatures(df, id_col, text, seed), "signatures")
        # One row for each class; copies combine before the shuffle.
        some = F.first("sig").alias("sig"), F.first("sketch").alias("sketch")
        classes = docs.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), *some, F.min("proof").alias("lo"), F.max("proof").alias("hi"))
        classes = cut(classes, "classes")
        if classes.where("lo <> hi").isEmpty():
            return docs.select("doc_id", "node", "n_shingles"), classes.drop("lo", "hi"), seed
    raise RuntimeError("word sequences share hashes under every seed: the hash does not work")


def _several(rooted: DataFrame) -> DataFrame:
    """The regions that have classes of several components."""
    return cut(rooted.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region"), "several")


def _grouped(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their class, and the component of each class (its smallest doc_id)."""
    bounded_batches(df.sparkSession)
    docs, classes, seed = _classes(df, id_col, text)
    found = cut(_regions(_labels(classes), REGION), "regions")
    runs, regions = found.where("parted").select("region", "node"), found.where("NOT parted").select("region", "node")
    sketch = classes.select("node", "sketch")
    pairs = cut(_likely_pairs(regions.join(sketch, "node")), "pairs")
    # Every class with a likely partner is in some pair; of the others, only those of cut runs have a part in what follows.
    involved = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "involved")
    parted = runs.select("node").distinct()
    wanted = cut(involved.unionAll(parted).distinct().join(classes.select("node", F.coalesce("first", F.lit(-1)).alias("stands")), "node"), "wanted")
    sets = cut(_sets(df, id_col, text, wanted, seed), "sets")
    links = cut(_confirmed(_likeliest(pairs, 2), sets), "links")
    roots = cut(components(links), "roots")
    root = F.coalesce("root", "node").alias("root")
    rooted = regions.join(involved, "node", "left_semi").join(roots, "node", "left").select("region", "node", root)
    open_ = cut(rooted.join(_several(rooted), "region", "left_semi"), "open")
    more = cut(_rest(open_.join(sketch, "node").join(sets, "node")), "links")
    links = links.unionAll(more)
    roots = cut(components(links), "roots") if not more.isEmpty() else roots
    cut_runs = cut(runs.join(roots, "node", "left").select("region", "node", root), "runs")
    drop(found, pairs, involved, wanted, open_)
    apart = cut(cut_runs.join(_several(cut_runs), "region", "left_semi").select("node", "root").distinct(), "apart")
    if not apart.isEmpty():
        lists = _rare_lists(cut(sets.join(apart, "node"), "apart"), REGION)
        links = links.unionAll(cut(_rest(lists.join(sets, "node"), whole=True), "links"))
        roots = cut(components(links), "roots")
    drop(sets, cut_runs)
    rooted = classes.join(roots, "node", "left").select("node", root, "first")
    firsts = cut(rooted.groupBy("root").agg(F.min("first").alias("component")), "firsts")
    return docs, rooted.join(firsts, "root").select("node", "component")


def _likeliest(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs that are among the k likeliest of either class."""
    ends = pairs.select("a", "b", "est", F.explode(F.array("a", "b")).alias("n"))
    at = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("est"), "a", "b"))
    return ends.withColumn("at", at).where(F.col("at") <= k).select("a", "b").distinct()


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each group: the one with the smallest id. Rows that repeat this id all stay."""
    got = near_duplicates(df, id_col, text)
    keep = got.where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return df.join(keep, F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("_kept_id")), "left_semi")


#: DuckDB SQL for near_duplicates over documents (ids unique and not null); it joins all shingles with each other.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS g FROM w),
 x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
 m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN m ON s.doc_id = m.doc_id"""

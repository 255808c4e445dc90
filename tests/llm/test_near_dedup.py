import random
import re

import pytest

from feedelta.llm import near_dedup
from feedelta.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=120):
    """Groups whose members differ by a few words, so that many pairs lie around the threshold."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for d in range(n):
        w = list(base[d % 6])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((d * 3, " ".join(w).upper() if d % 2 else "\n".join(w)))
    return [*rows, (1, ""), (4, None), (7, "one two"), (10, "one\ttwo"), (13, "a a a a a a a"), (16, "a a a a a"), (19, " ")]


@pytest.mark.parametrize("region", [1024, 7])
def test_components_are_those_of_all_pairs(spark, region, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", region)
    rows = corpus(region)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    if region == 1024:
        assert got == want
    else:  # regions of seven: depth adapts, and few links may be missed
        assert sum(got[d] != want[d] for d in want) <= 3


def test_edge_cases(docs, no_docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 10
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert all(r.kept for r in got if r.doc_id not in (2,))
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 0 and kept.count() == 8
    assert near_dedup.dedup(no_docs).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (-5, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, -5: -5, 200: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def templates(seed, n=200, pairs=60):
    """Documents that share most of a text and are alike just below the threshold; some have a partner just above it."""
    rng = random.Random(seed)
    own = lambda k: [f"o{rng.randrange(10**9)}" for _ in range(k)]
    base = own(120)
    rows = [(d, base + own(25)) for d in range(n)]
    rows += [(1000 + p, rows[p][1][:-19] + own(19)) for p in range(pairs)]
    return [(d, " ".join(w)) for d, w in rows]


def test_crowded_regions_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    # Apart from that, groups that are dense at the threshold.
    rows = templates(8) + [(10_000 + (d or 0), t) for d, t in corpus(8)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in range(1000, 1060)} == {d: (141, d - 1000) for d in range(1000, 1060)}
    assert got == brute(rows)

import hashlib
import random
import struct

import numpy as np
import pytest

from feedelta.llm import bpe
from feedelta.llm.queries import vocabulary_path


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_ids_and_decoding_are_the_librarys():
    codec, lib = bpe.Codec(bpe.Bpe.load(vocabulary_path())), library()
    rng = random.Random(1)
    texts = ["", "<|endoftext|>a<|startoftext|>", "ΑΣ ΣΑΣ", "İstanbul ǅ ẞ", "a\x1c\x1d!b\x85c d", "don't we'll I'M", "ﬁ ½ ²", "x" * 3000]
    texts += ["".join(rng.choice("etaoinsrhldcu'") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(0, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert codec.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_full_caches_change_no_ids():
    b, lib = bpe.Bpe.load(vocabulary_path()), library()
    small = bpe.Codec(b)
    small.known = bpe.Recent(3)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh,'1") for _ in range(rng.randrange(1, 6))) for _ in range(40)] + ["<|endoftext|>"]
    for _ in range(60):
        texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(rng.randrange(1, 4))]
        for ids, e in zip(small.encode_all(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids


def test_other_vocabularies_are_refused():
    import json

    spec = json.load(open(vocabulary_path(), encoding="utf-8"))
    for key in ("normalizer", "pre_tokenizer"):
        with pytest.raises((ValueError, AttributeError)):
            bpe.Bpe(spec | {key: {"type": "Lowercase"}})


def test_pair_test_is_what_merging_says():
    b = bpe.Bpe.load(vocabulary_path())
    rng, names = random.Random(2), {i: t for t, i in b.whole.items()}
    ids = sorted(names)
    for _ in range(5000):
        x, y = rng.choice(ids), rng.choice(ids)
        if ord(names[x][-1]) < bpe.END:
            assert b.compatible(x, y, {}) == (b._merge([*names[x], *names[y]]) == [names[x], names[y]])


def test_columns_and_edge_cases(docs, no_docs):
    got = bpe.round_trip(docs.withColumnRenamed("size", "n_tokens"), vocabulary_path())
    assert got.columns == ["doc_id", "text", "lang", "source", "shard", "n_tokens", "ids", "decoded"]
    lib = library()
    for r in got.collect():
        e = lib.encode(r.text or "", add_special_tokens=False)
        assert bytes(r.ids) == struct.pack(f"<{len(e.ids)}I", *e.ids) and r.n_tokens == len(e.ids)
    row = bpe.digests(got.where("doc_id = 1")).first()
    assert row.decoded_sha256 == hashlib.sha256(lib.decode(lib.encode("alpha beta gamma delta epsilon zeta eta", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(no_docs, vocabulary_path()).count() == 0
    one = bpe.encode(docs.where("doc_id = 8"), vocabulary_path())
    assert one.select(bpe.ids_array(one.ids).alias("i")).first().i == lib.encode("Ünïcode ﬁ İ <|endoftext|> 日本 😀", add_special_tokens=False).ids
    assert bpe.decode(one, vocabulary_path()).count() == 1

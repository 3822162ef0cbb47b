import base64
import random

import numpy as np
import pytest

from leadweave.llm.byte_bpe import BytePairs, byte_ranks, encode_texts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_against_library(docs, odd, library):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        expect = [(i, ids := library[0].encode_ordinary(t), len(ids), t.encode()) for i, t in rows]
        got = [(r.id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, bytes(r.decoded)) for r in encode_texts(df).collect()]
        assert sorted(got, key=str) == sorted(expect, key=str)


def test_hard_pieces(spark, library):
    rng = random.Random(4)
    texts = ["a" * 5000, "ab" * 3001, "".join(rng.choice("abcé") for _ in range(3000)), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(4000)), " " * 700 + "x", "<|endoftext|> it's we'll", "\r\n\t \n", "".join(rng.choice("aeinrst") for _ in range(257))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in encode_texts(df).collect()}
    assert got == {i: library[0].encode_ordinary(t) for i, t in enumerate(texts)}


def test_batch_equals_single(library):
    rng = random.Random(5)
    pairs = BytePairs(library[1])
    pieces = [bytes(rng.choice(b"abcdehint \xc3\xa9") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    single = [b"".join(i.to_bytes(4, "little") for i in pairs._merge_one(p)) if p not in library[1] else library[1][p].to_bytes(4, "little") for p in pieces]
    assert pairs.encode_pieces(pieces) == single
    assert [pairs.decode(x) for x in single] == pieces


def test_digests_and_empty(odd, empty):
    assert encode_texts(odd, digests=True).columns == ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert encode_texts(empty).collect() == []

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from nearfold.llm.bpe import Merges, PrefixTable, TextCoder, decoded, encoded

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = "ab c  \n\t\r'st\u00e9\u00df\u00f1\u4e2d\u658712!? \u00a0\u2003\u0085\u001c\u0301\u01c5\u0663\u3000 the ing tion "


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return TextCoder(PATH, P.PATTERN)


def test_random_texts(library, coder):
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice(ODD) for _ in range(rng.randrange(40)))
        ids = coder.encode(t)
        assert [int(x) for x in ids.split()] == library.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_a_full_dictionary_is_emptied(library):
    small = TextCoder(PATH, P.PATTERN, most=3)
    for t in ["a b c d e f g", "h i j k l", "a b", "<|endoftext|> x"]:
        assert [int(x) for x in small.encode(t).split()] == library.encode_ordinary(t)


def test_appends_and_edits(library, coder):
    rng = random.Random(2)
    data = b"hello world this is a test " * 40
    table = PrefixTable(coder.merges, data)
    for _ in range(150):
        a = rng.randrange(len(data))
        b, new = min(len(data), a + rng.randrange(9)), bytes(rng.choice(b"abcthe in\xc3") for _ in range(rng.randrange(9)))
        data = data[:a] + new + data[b:]
        table.replace(a, b, new)
        assert table.ids() == library._encode_single_piece(data)
        data += new
        table.append(new)
        assert table.ids() == library._encode_single_piece(data)


def test_encode_and_decode_frames(spark, library):
    rows = [(1, "Hello  World\n x"), (2, None), (2, ""), (None, "a b"), (1, "Hello  World\n x"), (5, "long text é " * 20_000)]
    docs = spark.createDataFrame([(i, t, "z", 7) for i, t in rows], "doc_id long, text string, id string, ids long")
    out = encoded(docs, PATH, P.PATTERN)
    got = sorted((r.doc_id or 0, r.n_tokens, hashlib.sha256(r.ids.encode()).hexdigest(), bytes(r.decoded)) for r in out.collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), (t or "").encode()))
    assert got == sorted(want)
    back = decoded(out, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == sorted((w[0], w[3]) for w in want)
    assert encoded(docs.filter("false"), PATH, P.PATTERN).count() == 0


def test_new_pieces_are_encoded_together(library, coder, monkeypatch):
    rng = random.Random(4)
    bits = [bytes(rng.choice(b"ab e\xc3\xa9\xff\n.tion") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + [b"a" * 300, b""]
    ids, counts = coder.merges.encode_many(bits)
    ends = [0, *counts.cumsum().tolist()]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [coder.merges.encode(b) if b else [] for b in bits]
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(200))) for _ in range(300)] + ["", " ", "it's done.\nAgain and again"]
    fresh = TextCoder(PATH, P.PATTERN)
    monkeypatch.setattr(Merges, "last_tokens", None)  # not one by one
    assert [[int(x) for x in got.split()] for got in fresh.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]

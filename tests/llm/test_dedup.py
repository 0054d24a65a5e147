import itertools
import random
import re
import zlib

import pytest

from nearfold.llm.exact_dedup import drop_exact_copies, exact_groups
from nearfold.llm.packing import WordIds, packed, plan
from nearfold.llm.simhash import components, fingerprint, links, near_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, key string, digit string, fp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, 9, "k", "d", 3) for i, t in rows], SCHEMA)


TRICKY = ["", None, " ", "a", "a b", "a  b", "a\t\nb", "é" * 70, "x" * 64, "x" * 65, "x" * 64 + "y", "x" * 600, "x" * 600 + "z", "A b", " a"]


@pytest.mark.parametrize("most_hashes", [0, 2_000_000])  # all texts moved, and only those that may have an equal one
def test_exact_groups_match_brute_force(spark, most_hashes):
    rng = random.Random(1)
    rows = [(i, rng.choice(TRICKY + ["q" * 5000 + str(rng.randrange(3)), " " * 900 + "q", "q " * 700_000 + str(rng.randrange(2))][: 17 + (i < 9)])) for i in range(300)] + [(None, "a b"), (None, None), (7, "a"), (7, "a")]
    got = exact_groups(frame(spark, rows), first=4, most_hashes=most_hashes).collect()
    assert len(got) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i if i is not None else -1, min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)])) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_copies_leave(spark):
    kept = drop_exact_copies(frame(spark, [(3, "a b"), (1, "a  b"), (2, "c")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and len(kept.columns) == 9


@pytest.mark.parametrize("most_hashes", [0, 2_000_000])
def test_exact_copies_leave_by_row(spark, most_hashes):
    rows = [(3, "a b"), (5, "a b"), (5, "only copy of this text"), (None, "a  b"), (None, "x"), (None, "x"), (7, "twice"), (7, "twice"), (8, None), (8, "")]
    kept = drop_exact_copies(frame(spark, rows), most_hashes=most_hashes)
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == [(0, "x"), (3, "a b"), (5, "only copy of this text"), (7, "twice"), (8, "")]


def test_empty_tables(spark):
    empty = frame(spark, [(1, "a")]).filter("false")
    assert exact_groups(empty).count() == 0 and near_groups(empty).count() == 0
    import public_tokenizers as P

    assert packed(empty, P.path("word_bpe_49k.json")).count() == 0


def slow_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for t in [*TRICKY, "The quick brown fox jumps over the LAZY dog ÉTÉ", "w " * 70_000]:
        assert fingerprint(t) == slow_fingerprint(t)


def brute(fps):
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(sorted(set(fps)), 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


@pytest.mark.parametrize("crowded", [3, 100_000])
def test_links_match_brute_force(spark, crowded):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    fps = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for b in base for _ in range(25)}
    fps = [x - 2**64 if x >> 63 else x for x in fps]
    got = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowded).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(fps)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 300), (201, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and {got[200], got[201], got[300]} == {200}


def test_near_groups(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(5, " ".join(words)), (9, " ".join(words).upper()), (2, "solo one two three"), (3, None), (4, ""), (None, "solo one two three"), (9, " ".join(words))]
    got = near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[9].component_id == 5 and by[3].component_id == by[4].component_id == 3 and by[3].fingerprint == "0" * 16 and by[None].component_id == 2


def test_near_groups_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if bin(texts[a] ^ texts[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_groups(docs).collect()}
    assert got == {i: (f, find(i)) for i, f in texts.items()}


def test_word_ids_are_the_tokenizers():
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(8)
    texts = ["Hello, World's  end\n\n1234\x85x  y é ́ a ΣΣ <|endoftext|> z", "", "  ", "it's 'LL don't 中文 \x1c a　b İ", None, "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext", "İ> İ- ²½ Ⅷ."]
    texts += ["".join(rng.choice("aZé'½ ²ß日 <|>endoftx. ́İΣ-0Ⅷ‍") for _ in range(40)) for _ in range(300)]
    for x, ids in zip(texts, WordIds(P.path("word_bpe_49k.json")).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, x


def test_many_words_are_merged_as_the_tokenizer_does():
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from nearfold.llm.packing import Merges

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(5)
    words = ["".join(rng.choice("aaeinorstßéü") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a", "aaaa", "the", "ÿ"]
    ids, sizes = Merges(path, t.get_vocab())([w.encode() for w in words])
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]


def test_a_full_dictionary_keeps_the_words_seen_again():
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, coder, rng = Tokenizer.from_file(path), WordIds(path, 100), random.Random(6)
    for _ in range(30):
        text = " ".join(rng.choice(["The", "house.", "é,", "3.5", "...", "it's", "a.b@c"]) + " " + "".join(rng.choice("abcÉ!") for _ in range(9)) for _ in range(60))
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert b"the" in coder.number and len(coder.number) <= 100 + 300
    assert len(coder.ids) < 20 * 400


def test_freed_memory_goes_back_to_the_system():
    import numpy as np

    from nearfold.llm import common

    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    blocks = [np.ones(8000) for _ in range(3000)]
    pin = np.ones(8000)  # above them, so that the heap can't shrink from its end
    before = resident()
    del blocks
    common.drop_held(None)
    assert resident() < before - 100_000_000 and pin.all()


@pytest.mark.parametrize("options", [{}, {"most_docs": 3}, {"most_attention": 5000.0, "rule": "dot"}])
def test_packing_holds_every_constraint(spark, options):
    import numpy as np
    import public_tokenizers as P

    rng = random.Random(3)
    rows = [(i, " ".join("word" for _ in range(rng.choice([0, 1, 5, 20, 20, 63, 200])))) for i in range(400)] + [(None, None), (1, "twice"), (1, "twice")]
    path = P.path("word_bpe_49k.json")
    got = packed(frame(spark, rows), path, size=64, **options).collect()
    coder = WordIds(path)
    want = []
    for i, t in rows:
        ids = coder.encode([t])[0] + b"\0\0\0\0"
        want += [(i or -1, k, at // 4, len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256])) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64 and len(b) <= options.get("most_docs", 64) and sum(n * n for _, n in b) <= options.get("most_attention", 64**2)
    if not options:
        assert len(bins) <= 1.02 * -(-sum(w[3] for w in want) // 64) + 1


def test_plan_is_near_the_lower_bound():
    rng = random.Random(4)
    counts = {n: rng.randrange(1, 2000) for n in range(1, 2049, 7)}
    table = plan(counts, (2048, 2048, 2048.0**2))
    last = max(r[3] + 1 for r in table)
    assert last <= 1.05 * sum(k * n for k, n in counts.items()) / 2048


def test_idle_workers_drop_what_they_hold(spark):
    import time

    import public_tokenizers as P

    from nearfold.llm import common, packing

    docs = spark.range(8).selectExpr("id AS doc_id", "concat('some words ', id) AS text").repartition(4)
    assert packing.pieces(docs, P.path("word_bpe_49k.json")).count() == 8
    held = lambda cols: [[len(packing._coders) for _ in cols[0]]]
    seen = lambda: {r.n for r in common.map_batches(docs.select("doc_id"), held, "n int", held="words").collect()}
    assert 1 in seen()  # the next task has the words
    time.sleep(3)
    assert seen() == {0}

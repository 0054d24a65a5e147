"""The pipeline's near copies against brute force over sets of five-word shingles."""

import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from nearfold.llm import similar

STAGE = dict(cp.STAGES)["near_dedup"]
SCHEMA = "doc_id long, text string"


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def groups(spark, rows, **options):
    return {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"z{rng.randrange(10**6)}"
    return out


def test_shingles_are_sets_of_five_words():
    for t in ["", None, "a b", "a b c d e", "a b c d e f", "A b C d E f a b c d e f", "x " * 9000]:
        assert len(similar.shingles(t)) == len(shingle_set(t))
    assert (similar.shingles("A b\tc D e f") == similar.shingles("a B  c d E F")).all()


@pytest.mark.parametrize("small", [1, 12])  # 1: all buckets go by pivots and rare shingles
def test_groups_match_brute_force(spark, small):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "ONE  two"), (6, "one two three")]
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 400]))]
        for k in (0, 1, 2, 4, 8):
            rows.append((len(rows) + 1, " ".join(edited(rng, base, k))))
    chain = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    for _ in range(40):  # neighbours are alike, the ends aren't
        rows.append((len(rows) + 1, " ".join(chain)))
        chain = edited(rng, chain, 3)
    hub = [f"h{rng.randrange(10**6)}" for _ in range(150)]
    rows += [(len(rows) + 1 + k, " ".join(edited(rng, hub, rng.randrange(6)))) for k in range(80)]
    want = brute(rows)
    assert groups(spark, rows, small=small) == want and 20 < len(set(want.values())) < len(rows) - 100


def test_stage_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = STAGE(spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (None, text), (3, text + " more"), (3, text + " more"), (9, "solo one two three")]
    kept = STAGE(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [3, 9]
    only = spark.createDataFrame([(None, text), (None, text), (5, text)], SCHEMA)
    assert [r.doc_id for r in STAGE(spark, only, "").collect()] == [5] and STAGE(spark, only.filter("doc_id IS NULL"), "").count() == 1


def test_a_common_passage_links_nothing(spark):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(30)])) for i in range(60)]
    rows += [(100 + i, t + " tail") for i, (_, t) in enumerate(rows[:5])]
    want = brute(rows)
    assert groups(spark, rows, small=2) == want and len(set(want.values())) == 60


def test_signatures_meet_at_the_threshold():
    """Of pairs at a similarity just over 0.8 all but one in thousands share a variant."""
    rng = random.Random(3)
    met = 0
    for _ in range(300):
        both = [rng.getrandbits(63) for _ in range(160)]
        a = similar.variants(similar.symbols(np.array(both + [rng.getrandbits(63) for _ in range(20)], np.uint64))[None])[0]
        b = similar.variants(similar.symbols(np.array(both + [rng.getrandbits(63) for _ in range(20)], np.uint64))[None])[0]
        met += bool(set(a.tolist()) & set(b.tolist()))
    assert met >= 299


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """Near copies are held against a few texts each, not against all that share a variant; SimHash's links are among the pairs."""
    rng = random.Random(2)
    base = [f"n{rng.randrange(10**6)}" for _ in range(200)]
    rows = spark.createDataFrame([(i, " ".join(edited(rng, base, rng.randrange(3)))) for i in range(150)], "node long, text string")
    counts, linked = [], similar._linked
    monkeypatch.setattr(similar, "_linked", lambda met, *rest: (counts.append(met.count()), linked(met, *rest))[1])
    roots = similar.similar_roots(rows, "text")
    assert roots.count() == 150 and roots.select("root").distinct().count() == 1
    assert sum(counts) <= 6 * 150 and similar._by_simhash(rows, "text").count() > 0


def test_parities_keep_every_pair_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n, apart in ((9, 1), (90, 10), (90, 11), (900, 100), (900, 101), (5000, 3)):  # a ninth of both sizes: 0.8
        both = rng.integers(0, 2**63, n - apart, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, apart, dtype=np.uint64)])) for _ in range(2))
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        rows.append((j >= 0.8, len(x), len(y), similar.parities(x).tolist(), similar.parities(y).tolist()))
    got = spark.createDataFrame(rows, "near boolean, m long, n long, x array<long>, y array<long>").withColumn("kept", similar._alike("x", "y", "m", "n")).collect()
    assert all(r.kept for r in got if r.near) and sum(r.near for r in got) == 4


def test_a_shared_passage_leaves_few_pairs(spark):
    """Texts that share two thirds of their words meet on every shingle of the passage."""
    from nearfold.llm.common import numbered

    passage = " ".join(f"common{k}" for k in range(100))
    texts = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(50))) for i in range(60)]
    texts += [(100 + i, t.replace(f"own{i}x49", "changed")) for i, t in texts[:5]]
    rows, name = numbered(spark.createDataFrame(texts, "id long, text string"))
    rows = rows.withColumnRenamed(name, "node").cache()
    sigs = similar._signatures(rows, "text").cache()
    met = similar._rare(sigs.selectExpr("node", "node AS root", "n"), sigs, rows, "text").distinct()
    ids = {r.node: r.id for r in rows.collect()}
    assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in met.collect()} == {(i, 100 + i) for i in range(5)}


def _rare_input(spark, texts):
    from nearfold.llm.common import numbered

    rows, name = numbered(spark.createDataFrame(texts, "id long, text string"))
    rows = rows.withColumnRenamed(name, "node").cache()
    return rows, similar._signatures(rows, "text").cache()


def test_rare_shingles_of_a_large_group_make_few_rows(spark):
    """Near copies meet on many shingles, but a pair makes one row at most, and the links connect them all."""
    rng = random.Random(4)
    base = [f"n{rng.randrange(10**6)}" for _ in range(200)]
    rows, sigs = _rare_input(spark, [(i, " ".join(edited(rng, base, 2))) for i in range(60)])
    met = similar._rare(sigs.selectExpr("node", "node AS root", "n"), sigs, rows, "text").cache()
    assert 60 <= met.count() <= 60 * 59 // 2
    roots = similar._merged(None, similar._linked(met, sigs, rows, "text"))
    assert roots.count() == 60 and roots.select("root").distinct().count() == 1


@pytest.mark.parametrize("rarest", [0, 1, 16])
def test_pairs_apart_meet_on_one_shingle(spark, monkeypatch, rarest):
    """Pairs that no link settles are made once if both rows list a shared shingle, and at least once if they list none."""
    rng = random.Random(6)
    texts = []
    for _ in range(4):
        base = [f"n{rng.randrange(10**6)}" for _ in range(60)]
        texts += [(len(texts) + k, " ".join(base[5 * k :] + [f"e{len(texts)}x{k}x{j}" for j in range(5 * k)])) for k in range(4)]
    monkeypatch.setattr(similar, "RAREST", rarest)
    monkeypatch.setattr(similar, "_near", lambda x, y: similar.F.lit(True))
    monkeypatch.setattr(similar, "_alike", lambda x, y, m, n: similar.F.lit(True))
    monkeypatch.setattr(similar, "_linked", lambda met, *rest: met.limit(0).toDF("u", "v"))
    rows, sigs = _rare_input(spark, texts)
    met = [tuple(sorted((r.a, r.b))) for r in similar._rare(sigs.selectExpr("node", "node AS root", "n"), sigs, rows, "text").collect()]
    ids = {r.node: r.id for r in rows.collect()}
    sets = {i: shingle_set(t) for i, t in texts}
    linked = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    assert linked and linked <= {tuple(sorted((ids[a], ids[b]))) for a, b in met}
    assert rarest < 16 or len(met) == len(set(met))


def test_links_are_connected_alike_in_one_task_and_by_joins(spark):
    rng = random.Random(8)
    edges = [tuple(sorted(rng.sample(range(400), 2))) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2040)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(edges, "u long, v long")
    for most in (None, 0):
        assert {r.node: r.root for r in similar._merged(None, table, most).collect()} == root
    assert similar._merged(None, table.limit(0)).count() == 0

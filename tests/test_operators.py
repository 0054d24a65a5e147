"""Hand-sized cases for each rule of the operators."""

import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions.hashing import PRIME, hash_seeds
from nearfold.operators import bpr, interactions, jaccard, kmeans, metrics, minhash, recommend, reports, text
from nearfold.plans import stages
from nearfold.plans.stages import dense_index, maybe_broadcast, topk
from nearfold.sources import files


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    with gzip.open(d / "meta.jsonl.gz", "wt") as f:
        for r in [{"parent_asin": "A", "title": "one", "price": 3}, {"parent_asin": "B"}, {"parent_asin": "A", "title": "uno"}, {"parent_asin": "C", "title": "three"}]:
            f.write(json.dumps(r) + "\n")
    for name, rows in {"train": ["u1,A,3.0,10", "u2,B,2.0,11", "u1,B,NaN,12", "u1,A,5.0,13", ",A,5.0,14", "u3,Z,4.0,15"], "valid": ["u1,C,4.0,20", "u9,A,4.0,21"], "test": ["u2,A,,30"]}.items():
        with gzip.open(d / f"{name}.csv.gz", "wt") as f:
            f.write("user_id,parent_asin,rating,timestamp\n" + "\n".join(rows) + "\n")
    return d


def test_sources(spark, data):
    meta = files.read_json_lines(spark, str(data / "meta.jsonl.gz"), max_rows=3)
    assert [(r.parent_asin, r.title) for r in meta.orderBy("row_id").collect()] == [("A", "one"), ("B", None), ("A", "uno")]
    with pytest.raises(FileNotFoundError, match="reviews"):
        files.load_interactions(spark, str(data / "none.csv.gz"), str(data / "meta.jsonl.gz"))
    with gzip.open(data / "bad.jsonl.gz", "wt") as f:
        f.write('{"parent_asin": \n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(data / "bad.jsonl.gz")).collect()


def test_interactions_of_files(spark, data):
    got = files.load_interactions(spark, str(data / "train.csv.gz"), str(data / "meta.jsonl.gz")).collect()
    assert sorted((r.user_idx, r.product_idx, r.title, r.timestamp) for r in got if r.title) == [(0, 0, "one", 10), (0, 0, "one", 13), (0, 0, "uno", 10), (0, 0, "uno", 13)]
    assert {(r.user_idx, r.product_idx, r.title) for r in got if not r.title} == {(1, 1, None), (0, 1, None), (2, 2, None)}  # Z is kept without a title
    train, valid, test = files.load_splits(spark, *[str(data / f"{n}.csv.gz") for n in ("train", "valid", "test")], str(data / "meta.jsonl.gz"))
    assert {(r.user_idx, r.product_idx) for r in valid.collect()} == {(0, 2)} and {(r.user_idx, r.product_idx, r.title) for r in test.collect()} == {(1, 0, "one"), (1, 0, "uno")}
    assert all(r.product_idx < 3 for r in train.collect())
    assert tuple(interactions.id_space(train, [valid, test]).first()) == (2, 3)


def test_rating_filter_and_nulls(spark):
    rows = [(1, 1, 2.0), (1, 2, 3.0), (1, 3, float("nan")), (1, 4, None), (None, 5, 5.0)]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    kept = interactions.with_ids(interactions.positive(df), "user", "item")
    assert [tuple(r) for r in kept.collect()] == [(1, 2, 3.0)]
    assert [tuple(r) for r in metrics.histogram(df.filter("not isnan(rating)"), "rating").collect()] == [(2.0, 1), (3.0, 1), (5.0, 1)]
    assert tuple(metrics.totals(df, "user").first()) == (5, 1)


def test_samples_and_slices(spark):
    df = spark.range(100).withColumn("t", F.col("id") % 7)
    one = [r.id for r in interactions.sample_rows(df, ["id"], 10).collect()]
    assert one == [r.id for r in interactions.sample_rows(df.repartition(7), ["id"], 10).collect()] and len(set(one)) == 10
    assert interactions.sample_rows(df, ["id"], 1000).count() == 100 and len(interactions.sample_keys(df, "t", 3).collect()) == 3
    assert [r.id for r in interactions.prefix(df, ["id"], 4).collect()] == [0, 1, 2, 3]
    assert {(r.t, r.id) for r in interactions.first_per_key(df, "t", ["id"]).collect()} == {(i, i) for i in range(7)}
    assert sorted((r.id, r.idx) for r in dense_index(df.repartition(5), [F.desc("id")]).select("id", "idx").collect()) == [(i, 99 - i) for i in range(100)]
    assert [r.id for r in topk(df, ["t"], [F.desc("id")], 1).filter("t = 0").collect()] == [98]
    assert maybe_broadcast(df, 5) is df
    assert [r.idx for r in interactions.map_ids(df, spark.createDataFrame([(3, 9)], "t long, idx long"), "t").limit(1).collect()] == [9]


PAIRS = [(1, u) for u in range(8)] + [(2, u) for u in range(8)] + [(3, u) for u in range(4, 12)] + [(4, 99)] + [(5, 500)]


def test_exact_jaccard(spark):
    pairs = jaccard.item_user_pairs(spark.createDataFrame(PAIRS + PAIRS[:3], "item long, user long"), "item", "user")
    got = {(r.item, r.other): (r.score, r["rank"]) for r in jaccard.exact_jaccard_topk(pairs).collect()}
    assert got == {(1, 2): (1.0, 1), (2, 1): (1.0, 1), (1, 3): (round(4 / 12, 6), 2), (2, 3): (round(4 / 12, 6), 2), (3, 1): (round(4 / 12, 6), 1), (3, 2): (round(4 / 12, 6), 2)}
    only = jaccard.exact_jaccard_topk(pairs, 1, spark.createDataFrame([(3,), (4,)], "item long")).collect()
    assert [(r.item, r.other) for r in only] == [(3, 1)]
    empty = F.array().cast("array<int>")
    assert spark.range(1).select(jaccard.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), jaccard.jaccard(empty, empty)).first()[:] == (1 / 3, 0.0)


def test_equal_signatures_are_folded(spark):
    rng = random.Random(3)
    rows = [(i, u) for i in range(120) for u in rng.sample(range(40), rng.choice([1, 1, 2, 3]))] + [(i, 7) for i in range(1000, 1030)]
    sigs = minhash.signatures(spark.createDataFrame(rows, "item long, user long")).cache()
    want = minhash.lsh_topk(minhash.bands(sigs), sigs, 4).collect()
    assert sorted(minhash.similar_topk(sigs, 4).collect()) == sorted(want)
    crowd = spark.range(10_000).select(F.col("id").alias("item"), F.lit(1).alias("user"))
    got = minhash.similar_topk(minhash.signatures(crowd), 3)
    assert got.count() == 30_000 and got.filter("score <> 1").count() == 0
    assert [r.other for r in got.filter("item = 1").orderBy("rank").collect()] == [0, 2, 3]
    assert minhash.similar_topk(sigs.filter("false")).count() == 0


@pytest.mark.parametrize("rows", [2, 4])
def test_pairs_are_scored_in_parts(spark, rows):
    """A few bands and a part of the pairs at a time give what all at once give; signatures aren't made before the shuffle."""
    rng = random.Random(8)
    pairs = spark.createDataFrame([(i, u) for i in range(90) for u in {rng.randrange(12) for _ in range(rng.choice([1, 3, 6]))}], "item long, user long")
    sigs = minhash.signatures(pairs)
    plan = sigs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("partial_min")  # printed from the top
    sigs = sigs.cache()
    want = minhash.lsh_topk(minhash.bands(sigs, 64 // rows, rows), sigs, 4).select("item", "other", "score", "rank").collect()
    assert sorted(minhash.similar_topk(sigs, 4, 64 // rows, rows, band_rows=700, pair_bytes=20_000).collect()) == sorted(want)


def test_exact_jaccard_in_parts(spark):
    rng = random.Random(6)
    pairs = spark.createDataFrame([(i, u) for i in range(60) for u in rng.sample(range(25), rng.choice([1, 2, 5]))], "item long, user long")
    want = sorted(jaccard.exact_jaccard_topk(pairs, 4).collect())
    assert sorted(jaccard.exact_jaccard_topk(pairs, 4, meetings=150).collect()) == want and len(want) > 100


def test_a_summary_deletes_the_tables_it_made_on_its_way(spark, tmp_path):
    from nearfold.plans.queries import QUERIES

    sc, old = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        got = QUERIES["benchmark_summary"](spark, "/root/testdata/sf0.001").collect()
        left = [f for f in tmp_path.glob("*/rdd-*") if any(f.glob("part-*"))]
        pairs = stages.settled(spark.range(9))
        assert stages.settled(pairs) is pairs and stages.settled_alone(lambda: stages.settled(spark.range(7))).count() == 7
    finally:
        if old:
            sc._jsc.sc().setCheckpointDir(old)
    assert len(got) == 1 and len(left) == 4  # pairs, the truth and what two bandings found


def test_lists_meet_as_pairs_do(spark):
    rows = [(i, u) for u in range(6) for i in range(0, 40, u + 1)] + [(77, 99), (78, 100), (79, 100)]
    pairs = spark.createDataFrame(rows, "item long, user long")
    lists = jaccard._lists(pairs)
    got = [r for n in range(3) for r in jaccard._meet_lists(lists, 3, n).collect()]
    assert sorted(got) == sorted(jaccard.similar_pairs(pairs).collect()) and len(got) > 100


def test_saved_index_answers_like_the_index(spark, tmp_path):
    pairs = spark.createDataFrame([(i, u) for i in range(1, 30) for u in range(i % 5, i % 5 + 4)], "item long, user long")
    sigs = minhash.signatures(pairs)
    index = minhash.bands(sigs)
    minhash.save_index(str(tmp_path), sigs, index, spark.createDataFrame([(1, "t")], "item long, title string"))
    for item in (3, 29, 999):
        want = minhash.lsh_topk(index, sigs, 5, minhash.query_or_first(sigs, item)).collect()
        assert sorted(minhash.query_index(spark, str(tmp_path), item).collect()) == sorted(want)


def test_ranks_follow_unrounded_scores(spark):
    pairs = spark.createDataFrame([(1, u) for u in range(3000)] + [(2, u) for u in range(1, 3000)] + [(3, u) for u in range(3000)], "item long, user long")
    got = jaccard.exact_jaccard_topk(pairs, 2, spark.createDataFrame([(1,)], "item long"), digits=2).collect()
    assert [(r.other, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 1), (2, 2)]


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(1, "é" * 50, ["ab"] * 10, None), (2, None, None, 1.0)], "a long, b string, `c.d` array<string>, e double")
    assert stages.small_enough(df, 2) and not stages.small_enough(df, 1)
    assert stages.small_enough(df, 2, 264) and not stages.small_enough(df, 2, 263)
    assert stages.small_enough(df.filter("false"), 0, 0)


def test_kept_folder_goes(spark):
    with stages.kept_folder(spark, "x") as path:
        spark.range(3).write.parquet(path)
        assert stages.computed(spark.read.parquet(path)).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_dense_cosine_blocks(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)] + [(7, [1.0, 1.0, 1.0])]
    bad = [(90, None), (91, [0.0, 0.0, 0.0]), (92, [None, 1.0, 1.0]), (93, [float("nan"), 1.0, 1.0]), (94, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(3,), (11,), (90,), (999,), (3,)], "vec_id long")
    unit = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in rows]
    want = []
    for q in (3, 11):
        qv = next(v for i, v in unit if i == q)
        best = sorted((-round(sum(a * b for a, b in zip(qv, v)), 5), i) for i, v in unit if i != q)[:4]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    for sent in (10_000, 0):  # sent, then by blocks
        got = text.dense_cosine_topk(frame, asked, 4, sent_queries=sent).collect()
        assert sorted((r["query"], r.other, r.score, r["rank"]) for r in got) == sorted(want)
    assert text.dense_cosine_topk(frame, asked.filter("false")).count() == 0


def test_minhash_index(spark, tmp_path):
    pairs = spark.createDataFrame(PAIRS, "item long, user long")
    sigs = minhash.signatures(pairs)
    seeds = hash_seeds()
    assert len(set(seeds)) == 128
    by = {r["item"]: r.sig for r in sigs.collect()}
    assert by[3] == [min((a * u + b) % PRIME for u in range(4, 12)) for a, b in seeds]
    index = minhash.bands(sigs)
    assert index.count() == 5 * 64
    top = minhash.lsh_topk(index, sigs).collect()
    assert next(r.score for r in top if (r["item"], r.other) == (1, 2)) == 1.0 and not [r for r in top if r["item"] in (4, 5)]
    assert all(float(r.score * 128).is_integer() for r in top)
    minhash.save_index(str(tmp_path), sigs, index, spark.createDataFrame([(1, "t")], "item long, title string"))
    s2, i2, t2 = minhash.load_index(spark, str(tmp_path))
    again = minhash.lsh_topk(i2, s2, 5, minhash.query_or_first(s2, 250)).collect()
    assert {(r["item"], r.other, r.score) for r in again} == {(r["item"], r.other, r.score) for r in top if r["item"] == 1}
    q = spark.createDataFrame([(1,), (4,), (77,)], "item long")
    lines = [r.line for r in reports.neighbour_lines(minhash.lsh_topk(index, sigs, 5, q), q).collect()]
    assert lines[0] == "Query 1" and lines[1] == "   1. 2  score=1.0000" and lines[-1] == "  (No candidates found)"
    titled = reports.with_titles(minhash.lsh_topk(i2, s2, 5, q), t2).collect()
    assert {(r.item_title, r.other_title) for r in titled if r["item"] == 1} == {("t", "Unknown Title")}
    assert sum(r["size"] * r.buckets for r in minhash.bucket_sizes(index).collect()) == 5 * 64


def test_recalls(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "item long, other long")
    assert metrics.recall_at_k(pairs([(1, 2), (3, 9)]), pairs([(1, 2), (1, 3), (3, 4)])).first()[0] == 0.25
    assert metrics.recall_at_k(pairs([]), pairs([])).first()[0] == 0.0
    users = lambda rows: spark.createDataFrame(rows, "user long, item long")
    assert metrics.user_recall_at_k(users([(1, 5)]), users([(1, 5), (1, 5)])).first()[0] == 0.5
    assert metrics.user_recall_at_k(users([(1, 5)]), users([])).first()[0] == 0.0
    assert [r.winner for r in metrics.comparison({"s": 1.0, "r": 1.0}, {"s": 2.0, "r": 1.0}, spark, {"s"}).collect()] == ["ours", "tie"]


DOCS = [(1, "Red green blue"), (2, "red GREEN blue"), (3, None), (4, "the of a"), (5, "blue sky"), (6, "x y z")]


def test_tfidf(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    w = text.tfidf(docs)
    got = {(r.doc, r.term): r.weight for r in w.collect()}
    assert {d for d, _ in got} == {1, 2, 5} == {r.doc for r in text.nonempty(w).collect()}
    idf = lambda df: math.log(7 / (1 + df)) + 1
    norm = math.sqrt(2 * idf(2) ** 2 + idf(3) ** 2)
    assert math.isclose(got[1, "red"], idf(2) / norm) and math.isclose(got[1, "blue"], idf(3) / norm)
    assert [(r.term, r.n) for r in text.vocabulary(text.term_counts(docs, "doc_id", "text"), 2).collect()] == [("blue", 3), ("green", 2)]
    q = spark.createDataFrame([(1,), (3,)], "doc long")
    top = [(r["query"], r.other, r.score) for r in text.cosine_topk(w, q, 5).orderBy("query", "rank").collect()]
    assert top[0] == (1, 2, 1.0) and top[1][:2] == (1, 5) and len(top) == 2
    padded = text.cosine_topk(w, q, 5, docs.select(F.col("doc_id").alias("doc"))).orderBy("query", "rank").collect()
    assert [(r["query"], r.other) for r in padded] == [(1, 2), (1, 5), (1, 3), (1, 4), (1, 6), (3, 1), (3, 2), (3, 4), (3, 5), (3, 6)]
    lib = {r.doc_id: r.features for r in text.ml_tfidf(docs).collect()}
    assert math.isclose(max(lib[5].toArray()), max(got[5, "sky"], got[5, "blue"])) and lib[3].numNonzeros() == 0


def test_kmeans(spark):
    rows = [(i, [float(i % 3) * 10 + (i // 3) * 0.1, 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    m = kmeans.KMeans(3, 20, 1e-9).fit(df)
    assert all(b <= a + 1e-9 for a, b in zip(m.steps, m.steps[1:])) and m.inertia <= m.steps[-1] + 1e-9
    strict = kmeans.KMeans(3, 1, 1e-9, strict_labels=True).fit(df)
    assert strict.inertia <= strict.steps[0] + 1e-9
    tie = kmeans.assign(spark.createDataFrame([(1, [5.0, 0.0])], "id long, v array<double>"), [(0, [0.0, 0.0]), (1, [10.0, 0.0])]).first()
    assert (tie.cluster, tie.dist) == (0, 25.0)
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)], "id long, v array<double>")
    full = kmeans.KMeans(3, 5).fit(same)
    assert full.inertia == 0.0 and all(x == x for _, v in full.centers for x in v)
    curve = [r.inertia for r in kmeans.elbow(df, (1, 3)).orderBy("k").collect()]
    assert curve[1] < curve[0] and m.transform(df).count() == 30 and kmeans.KMeans(3, 5).fit_predict(df).count() == 30
    samples = kmeans.cluster_samples(spark.createDataFrame([(0, "b", 2), (0, None, 1), (0, "a", 3)], "cluster int, title string, n int"), ["n"], 1)
    terms = kmeans.cluster_terms(spark.createDataFrame([(1, "t", 1.0), (2, "s", 0.5)], "doc long, term string, weight double"), spark.createDataFrame([(1, 0), (2, 0)], "id long, cluster int"))
    assert [r.line for r in reports.cluster_lines(terms, samples).collect()] == ["Cluster 0: t, s", "  - b"]


def test_reports_are_written(spark, tmp_path):
    reports.write_elbow(spark.createDataFrame([(2, 1.5), (1, 3.0)], "k int, inertia double"), str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["k,inertia", "1,3.0", "2,1.5"]
    reports.write_lines(spark.createDataFrame([(2, 0, "b"), (1, 0, "a")], "item long, line_no int, line string"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_recommend(spark, sent):
    factors = lambda rows: spark.createDataFrame(rows, "id long, factor array<double>, bias double")
    users, items = factors([(1, [1.0, 0.0], 0.5), (2, [0.0, 1.0], 0.0)]), factors([(k, [float(k), 1.0], 0.0) for k in range(4)])
    seen = spark.createDataFrame([(1, 3), (1, 3), (1, 88)], "user long, item long")
    got = [tuple(r) for r in recommend.recommend_topk(users, items, seen, 2, sent_bytes=sent).orderBy("user", "rank").collect()]
    assert got == [(1, 2, 2.5, 1), (1, 1, 1.5, 2), (2, 0, 1.0, 1), (2, 1, 1.0, 2)]
    everything = spark.createDataFrame([(1, k) for k in range(4)], "user long, item long")
    assert {r.user for r in recommend.recommend_topk(users, items, everything, 9, sent_bytes=sent).collect()} == {2}


@pytest.mark.parametrize("sent", [1 << 20, 2000])
def test_recommend_copies_no_rows(spark, sent):
    """Beyond what is sent at once no row is shuffled once a block of the other side; results are those of brute force."""
    rng = np.random.default_rng(4)
    pool, bias = rng.integers(-3, 4, (9, 2)) / 4, rng.integers(0, 2, 300) / 8
    items = [(int(i), pool[j].tolist(), float(b)) for i, j, b in zip(rng.permutation(900)[:300], rng.integers(0, 9, 300), bias)]  # many are equal
    users = [(u, (rng.integers(-3, 4, 2) / 4).tolist(), u / 16) for u in range(40)]
    seen = [(u, int(i)) for u in range(40) for i in rng.choice(900, u * 6, replace=False)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, factor array<double>, bias double")
    got = recommend.recommend_topk(frame(users), frame(items), spark.createDataFrame(seen, "user long, item long"), 7, sent_bytes=sent)
    plan = got._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Generate" not in plan
    want = []
    for u, f, b in users:
        left = sorted((-round(float(np.dot(f, g)) + b + c, 6), i) for i, g, c in items if (u, i) not in set(seen))[:7]
        want += [(u, i, -s, k + 1) for k, (s, i) in enumerate(left)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_settled_drops_shuffle_files(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = shuffles.size()
    out = stages.settled(df)
    assert shuffles.size() <= before and out.count() == 7


def test_last_purchases_and_report(spark):
    df = spark.createDataFrame([(1, 7, 10), (1, 8, 10), (1, 9, 5), (2, 7, 1)], "user long, item long, timestamp long")
    last = recommend.last_n(df, 2, "user", "item", "timestamp")
    assert sorted((r.user, r["rank"], r["item"]) for r in last.collect()) == [(1, 1, 7), (1, 2, 8), (2, 1, 7)]
    out = recommend.sample_report(last.select("user", "item", "rank"), last.select("user", "item", "rank"), spark.createDataFrame([(7, "seven")], "item long, title string"))
    assert {(r.user, r.section, r["rank"], r.title) for r in out.filter("section = 'bought'").collect()} == {(1, "bought", 1, "seven"), (1, "bought", 2, "8"), (2, "bought", 1, "seven")}


def test_triples(spark):
    pos = spark.createDataFrame([(1, k) for k in range(5)] + [(2, 1), (2, 1)], "user long, item long")
    got = bpr.triples(pos, 5).collect()
    assert len(got) == 7 and all(0 <= r.neg < 5 for r in got)
    assert all(r.neg != 1 for r in got if r.user == 2)  # user 1 has seen every item: the last draw stands


def test_bpr_learns_and_resumes(spark, tmp_path):
    pos = spark.createDataFrame([(u, i) for u in range(20) for i in range(20) if u % 2 == i % 2 and (u + i) % 3], "user long, item long")
    ids = spark.range(20)
    m = bpr.BPR(d=4, rate=0.05, rounds=2).start(ids, ids)
    assert bpr.BPR().load(spark, str(tmp_path / "none")) == 0
    m.fit(pos, 20, 4, str(tmp_path / "m"))
    assert m.losses[-1] < m.losses[0]
    again = bpr.BPR()
    assert again.load(spark, str(tmp_path / "m")) == again.epoch > 0 and again.d == 4
    again.train_epoch(pos, 20)
    assert len(again.losses) == again.epoch
    own = recommend.score_pairs(pos, m.users, m.items).agg(F.avg("score")).first()[0]
    other = recommend.score_pairs(ids.crossJoin(spark.range(20).withColumnRenamed("id", "item")).withColumnRenamed("id", "user"), m.users, m.items).agg(F.avg("score")).first()[0]
    assert own > other
    model = bpr.als(bpr.interaction_matrix(pos), 4)
    assert model.userFactors.count() == 20

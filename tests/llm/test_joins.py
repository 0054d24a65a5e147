import datetime
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.llm import licenses, url_filter
from nearfold.llm.mtree import Regions, Tree, top_k


def brute_top(rows, k, asked):
    out = []
    for q, qv in rows:
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 10**9])
def test_tree_matches_brute_force_and_prunes(scale):
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (12, 6))
    x = (centres[rng.integers(0, 12, 2000)] + rng.integers(-6, 7, (2000, 6))) * scale
    x[:300] = x[0]
    tree = Tree(x, np.arange(2000), page=32, fan=8)
    for q in [0, 5, 299, 300, 777, 1999]:
        scores = x.astype(object) @ x[q].astype(object)
        order = sorted((i for i in range(2000) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert tree.search(x[q], q, 5) == [(int(scores[i]), i) for i in order]
        low = int(scores[order[2]])
        assert tree.search(x[q], q, 5, low) == [(int(scores[i]), i) for i in order if scores[i] >= low]
    far = Tree(x[300:], np.arange(300, 2000), page=32, fan=8)
    for q in range(300, 400):
        far.search(x[q], q, 5)
    assert far.computed < 100 * 1700 * 0.7


def test_top_k_over_shards_with_edges(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.013, 0.5]) for _ in range(4)]) for i in range(0, 900, 3)]
    good = list(rows) + [(2000, [0.1, 0.2]), (2050, [0.3, 0.4])]
    bad = [(50, None), (100, [None, 1.0, 1.0, 1.0]), (250, [float("nan"), 0.0, 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4)]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in good + bad + rows[:10]], "vec_id long, embedding array<float>, rank int, shard int, score long")
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in good]
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 50 == 0, shard=60, block=4).collect())
    assert got == brute_top(ints, 5, lambda q: q % 50 == 0)
    assert top_k(frame.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_as_of_evaluation(spark):
    d = datetime.date
    events = [("domain", "bad.com", "2024-02-01", "add", "x"), ("domain", "bad.com", "2024-03-01", "remove", "x"), ("domain", "bad.com", "2024-04-01", "add", "y"),
              ("url", "ok.com/a", "2024-01-01", "add", "u"), ("domain", "twice.com", "2024-01-05", "add", "t"), ("domain", "twice.com", "2024-01-05", "remove", "t"),
              ("domain", None, "2024-01-01", "add", "n"), ("domain", "com", None, "add", "n"), ("domain", "ok.com", "2024-01-01", None, "n")]
    events = spark.createDataFrame(events, "kind string, entry string, day string, action string, category string")
    rows = [(1, "http://bad.com/", d(2024, 1, 31)), (2, "http://Sub.BAD.com:80/x?q#f", d(2024, 2, 1)), (3, "http://bad.com", d(2024, 3, 1)), (4, "https://u:p@bad.com./", d(2024, 5, 1)),
            (5, "http://ok.com/a/b/?x", d(2024, 1, 1)), (6, "http://ok.com/ab", d(2024, 1, 1)), (7, "http://notbad.com", d(2024, 5, 1)), (8, "http://twice.com", d(2024, 2, 2)),
            (9, None, d(2024, 5, 1)), (10, "bad.com", d(2024, 5, 1)), (11, "http://bad.com", None), (None, "http://bad.com", d(2024, 5, 1)), (4, "https://u:p@bad.com./", d(2024, 5, 1))]
    captures = spark.createDataFrame([(i, u, x, "h", "e") for i, u, x in rows], "page_id long, url string, day date, host string, entry string")
    for most in (200_000, 0):  # broadcast, then shuffled
        got = url_filter.evaluate(captures, events, broadcast_rows=most).collect()
        assert len(got) == len(rows)
        assert {r.page_id for r in got if r.blocked} == {2, 4, 5, None} and sum(r.blocked for r in got) == 5
        by = {r.page_id: r for r in got}
        assert (by[4].category, by[4].since, by[2].host, by[5].entry) == ("y", d(2024, 4, 1), "sub.bad.com", "ok.com/a")
    assert url_filter.evaluate(captures.filter("false"), events).count() == 0
    assert not any(r.blocked for r in url_filter.evaluate(captures, events.filter("false")).collect())


def test_regions_prune_and_lose_nothing(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 5))
    x = np.floor(256 * (centres[rng.integers(0, 6, 700)] + rng.normal(0, 0.05, (700, 5)))) / 256
    x[100:400] = x[100]  # copies of one vector, more than a part holds
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)] + [(50, [float(a) for a in x[3]]), (50, [1.0, 2.0]), (7, [1.0, -2.0]), (150, [])]
    ints = [(i, [int(np.floor(256 * a)) for a in v]) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(frame, F.col("vec_id") % 50 == 0, shard=40, block=5, pivots=9).collect()
    want = {}
    for q, _, i, s in brute_top_all(ints, lambda q: q % 50 == 0):
        want.setdefault(q, []).append((-s, i))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted((q, n + 1, i, -s) for q, w in want.items() for n, (s, i) in enumerate(sorted(w)[:5]))
    regions = Regions([v * 256 for v in x[::70]])
    near, far = regions.place(x * 256)
    regions.learn([(5, int(r), int((near == r).sum()), float(far[near == r].max())) for r in set(near)])
    bound, scores = regions.products(x[:50] * 256)[1], (x * 256) @ (x[:50] * 256).T
    for column, r in enumerate(regions.known[5][0]):
        assert (scores[near == r].max(axis=0) <= bound[:, column]).all()
    assert (bound < np.sort(scores, axis=0)[-6][:, None]).mean() > 0.2  # regions that needn't be visited


def brute_top_all(rows, asked):
    """Every (query, 0, id, score) of rows with other ids and as many components."""
    return [(q, 0, i, sum(a * b for a, b in zip(qv, v))) for q, qv in rows if asked(q) for i, v in rows if i != q and len(v) == len(qv)]


def test_licence_forms_and_edges(spark):
    mit = licenses.LICENSES[0][1]
    variant = "Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + mit.replace("Software", "software").replace(",", " ,").replace(" ", "\n  ")
    rows = [(1, variant), (2, mit + " more"), (3, "a text\nreleased under the MIT licence!\n\rLicensed under CC BY-NC 4.0"), (4, None), (4, ""), (None, "Released under the MIT License."), (1, variant), (5, "x " * 50_000 + "\nReleased under the MIT License."), (6, "© 2020")]
    docs = spark.createDataFrame([(i, t, "k", "d", "n") for i, t in rows], "doc_id long, text string, key string, digest string, notices string")
    for most in (100_000, 0):
        got = licenses.scan(docs, broadcast_rows=most).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        assert [by[i].license_id for i in (1, 2, 3, 4, None, 5, 6)] == ["MIT", None, None, None, "MIT", None, None]
        assert [by[i].notices for i in (1, 3, 4, None, 5)] == ["", "CC-BY-NC-4.0,MIT", "", "MIT", "MIT"]
        assert by[4].text_digest is None and by[6].text_digest is None
    assert licenses.scan(docs.filter("false")).count() == 0


def test_licence_titles_and_clauses(spark):
    texts = dict(licenses.LICENSES[::-1])
    mit = licenses.LICENSES[0][1]
    three = texts["BSD-3-Clause"].replace("THIS SOFTWARE", "\n\nTHIS SOFTWARE")
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + mit), (2, "The MIT License (MIT)\r\n\r\n" + mit), (3, "BSD 3-Clause License\n\nCopyright (c) 2021, A\nAll rights reserved.\n\n" + three), (4, texts["BSD-2-Clause"]), (5, "Some License\n\n" + mit), (6, "MIT License")]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-2-Clause", 5: None, 6: None}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="the system keeps no licence texts")
def test_whole_licence_files(spark):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    read = lambda f: Path(f"/usr/share/common-licenses/{f}").read_text()
    rows = [(k, read(f)) for k, f in enumerate(files)] + [(99, read("GPL-3").replace("freedom", "fredom"))]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(files.values())), 99: None}


def test_licence_scan_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

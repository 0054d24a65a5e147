import itertools
import random
import zlib

import numpy as np
import pytest

from nearfold.llm import language, quality, toxicity
from nearfold.llm import queries as q

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, id string, score double, y int, _gone long, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "i", 0.5, 1, 1, 1) for i, t, lang in rows], SCHEMA)


def lang_rows():
    rng = random.Random(1)
    words = {"en": "the of and thing with from house water".split(), "ru": "это дом вода и мир человек слово".split(), "fr": "le la été où maison eau monde très".split()}
    return [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "fr", "ru"] * 20)]


@pytest.fixture(scope="module")
def lang_model(spark):
    return language.fit(frame(spark, lang_rows()))


def test_language_spans_and_edges(spark, lang_model):
    assert lang_model.names == ["en", "fr", "ru"]
    mixed = "the house of water and the thing from water " * 2 + "été très maison le monde la eau où été maison " * 2 + "человек и вода"
    rows = [(1, mixed, None), (2, None, None), (2, "", None), (3, "123 !!", None), (None, "это слово", None), (4, "中文 汉字", None), (4, "中文 汉字", None), (5, "the water " * 30_000, None)]
    got = language.identify(frame(spark, rows), lang_model, spans=True).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.doc_id == 1)
    assert [s.lang for s in one.spans] == ["en", "fr", "ru"] and mixed[one.spans[2].start : one.spans[2].end] == "человек и вода"
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3)] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in got if r.doc_id is None] == ["ru"]
    assert all(r.score == 0.1 for r in got if r.doc_id == 4)
    assert [r.lang_pred for r in got if r.doc_id == 5] == ["en"]
    kept = language.keep_identified(frame(spark, rows), lang_model)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5] and kept.columns == frame(spark, rows).columns


def test_viterbi_matches_all_paths(lang_model):
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = rng.integers(0, 6, 4)
        scores = rng.normal(0, 8, (counts.sum(), 3)).astype(np.float32)
        path = lang_model.label(scores, counts)
        ends = np.cumsum(counts)
        for c, e in zip(counts, ends):
            def value(p):
                return sum(scores[e - c + i, k] for i, k in enumerate(p)) - lang_model.penalty * sum(a != b for a, b in zip(p, p[1:]))

            best = max(map(value, itertools.product(range(3), repeat=int(c))))
            assert abs(value(path[e - c : e]) - best) < 1e-3


def test_decoding_in_blocks(monkeypatch, lang_model):
    rng = np.random.default_rng(3)
    counts = np.array([0, 2000, 7, 1, 512, 513])
    scores = rng.normal(0, 8, (counts.sum(), 3)).astype(np.float32)
    paths = []
    for block in (3, 64, 512, 10_000):
        monkeypatch.setattr(language, "BLOCK", block)
        paths.append(lang_model.label(scores, counts))
    assert all((p == paths[0]).all() for p in paths)


def test_words_change_with_the_script():
    words = lambda t: [w.decode() for w in language.split(t)]
    assert words("Hello мир l'été a1 ½") == ["Hello", "мир", "l'été", "a1", "½"]
    assert words("abcмир中文字符很长ภาษาไทย,x") == ["abc", "мир", "中文字符", "很长", "ภาษา", "ไทย,", "x"]
    text = "日本語のテキスト and more 中 ½\u3000x"
    assert "".join(words(text)) == text.replace(" ", "")


def test_no_letters_is_und(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house", "en"), ("中文汉字文", "zh"), ("ภาษาไทยภาษา", "th"), ("½ ² ①", None), ("Ⅷ ⅷ", None), ("the house 中文汉字中文汉字文", None), ("ภาษาไทย中文", None)])]
    model = language.fit(frame(spark, rows))
    got = {r.doc_id: r for r in language.identify(frame(spark, rows), model, spans=True).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "zh", "th", "und", "und"] and got[3].score == 0.0
    assert [s.lang for s in got[5].spans] == ["en", "zh"] and [s.lang for s in got[6].spans] == ["th", "zh"]


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "abc abd", "xx"), (2, "abc abd", "aa")]
    model = language.fit(frame(spark, rows))
    assert {r.lang_pred for r in language.identify(frame(spark, rows), model).collect()} == {"aa"}


def test_language_without_labels(spark):
    model = language.fit(frame(spark, [(1, "a b", None)]))
    assert [r.lang_pred for r in language.identify(frame(spark, [(1, "a b", None)]), model).collect()] == ["und"]
    assert language.identify(frame(spark, [(1, "a", None)]).filter("false"), model).count() == 0


def test_language_of_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q.op2_language(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_network_gradients():
    rng = np.random.default_rng(3)
    net = toxicity.Net({k: v.astype(np.float64) for k, v in toxicity._untrained(rng).items()}, None, None, (1, 1))
    x, y, weight = rng.normal(0, 1, (3, toxicity.WINDOW, toxicity.INPUTS)), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    mask = (np.arange(toxicity.WINDOW) < np.array([24, 5, 1])[:, None]).astype(float)

    def loss():
        z = net.run(net.projected(x.reshape(-1, toxicity.INPUTS)).reshape(3, toxicity.WINDOW, -1), mask)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    grads = net.gradients(x, mask, y, weight)
    grads["x"] = grads["x"].reshape(x.shape)
    for name, g in grads.items():
        w = x if name == "x" else net.w[name]
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(3)]:
            was = w[at]
            w[at] = was + 1e-2
            up = loss()
            w[at] = was - 1e-2
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3, name


def test_embeddings_are_learned(toxic_net):
    fresh = toxicity._untrained(np.random.default_rng(7))
    for name in ("word", "gram"):
        assert np.abs(toxic_net.w[name] - fresh[name]).max() > 0.01


def test_quality_gradients():
    rng = np.random.default_rng(9)
    w = quality.weights(rng)
    data, size, n = rng.integers(0, 256, (5, quality.CHUNK), dtype=np.uint8), np.array([512, 512, 40, 5, 300]), np.array([3, 1, 1])
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    grads, _ = quality.gradients(w, data, size, n, y, weight)
    for name, g in grads.items():
        for at in [tuple(rng.integers(0, k) for k in g.shape) for _ in range(6)]:
            was, loss = w[name][at], []
            for move in (1e-3, -1e-3):
                w[name][at] = was + move
                loss.append(quality.gradients(w, data, size, n, y, weight)[1])
            w[name][at] = was
            assert abs((loss[0] - loss[1]) / 2e-3 - g[at]) < 2e-3, name


def test_long_and_odd_texts_of_quality(spark):
    rng = random.Random(2)
    good, bad = (lambda: " ".join(rng.choice(["house", "water", "the"]) for _ in range(60))), (lambda: " ".join(rng.choice(["$$$", "!!", "CLICK"]) for _ in range(60)))
    net = quality.train([quality.chunked(good() if i % 2 else bad()) for i in range(200)], [i % 2 for i in range(200)])
    rows = [(1, good(), None), (2, bad(), None), (3, None, None), (4, "", None), (None, good() * 3000, None), (1, good(), None)]
    got = quality.score(frame(spark, rows), net).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and by[1] > 0.5 > by[2] and by[3] == by[4] and by[None] > 0.5 and all(0 <= r.score <= 1 for r in got)
    tables = net.tables()
    assert all(abs(r.score - quality.score_text(net, tables, t)) < 1e-6 for r, t in zip(sorted(got, key=lambda r: r.score), sorted([t for _, t, _ in rows], key=lambda t: quality.score_text(net, tables, t))))


def test_samples_are_bounded_with_repeated_ids(spark):
    from nearfold.llm.common import bounded_rows, labelled_sample

    docs = frame(spark, [(i % 3, f"t{i}", "en" if i % 2 else "fr") for i in range(60)] + [(None, "x", "en"), (50, None, "de")])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    got = labelled_sample(docs, labels, "toxic", F.lit(True), 1).collect()
    assert len(got) == 2 and sorted(r.y for r in got) == [0, 1]
    got = bounded_rows(docs, "doc_id", "lang", 2, "text").collect()
    assert sorted(r.group for r in got) == ["de", "en", "en", "fr", "fr"]


def test_windows_cover_and_overlap():
    for n in range(1, 200):
        at = toxicity.windows(n)
        seen = {i for a in at for i in range(a, min(n, a + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(at, at[1:]))
        assert len(at) == 1 + max(0, -(-(n - toxicity.WINDOW) // toxicity.STRIDE))
    for n in range(1, 3000, 7):
        at = quality.starts(n)
        assert at[-1] + quality.CHUNK >= n and all(np.diff(at) == quality.STRIDE)


@pytest.fixture(scope="module")
def toxic_net():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, y = [], []
    for i in range(240):
        ws = [word() for _ in range(rng.randrange(5, 80))]
        if i % 3 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(["vilest", "foulest"])
        texts.append(" ".join(ws))
        y.append(int(i % 3 == 0))
    return toxicity.train(texts, y)


def test_every_window_is_scored(spark, toxic_net):
    calm = "abcd efgh " * 3000
    rows = [(1, calm + "vilest", None), (2, calm, None), (3, calm + "vilest " + calm, None), (4, None, None), (4, "", None), (None, "Foulest!!", None), (2, calm, None)]
    got = toxicity.score(frame(spark, rows), toxic_net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].score > 0.5 and by[3].score > 0.5 and by[None].score > 0.5 and by[2].score < 0.5 and by[4].score == 0.0
    assert by[3].worst_word <= 6000 < by[3].worst_word + toxicity.WINDOW
    assert sorted(r.doc_id or 0 for r in toxicity.keep_clean(frame(spark, rows), toxic_net).collect()) == [2, 2, 4, 4]


def test_batch_scores_match_one_by_one(spark, toxic_net):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["abcd", "vilest", "efgh,", "xx"]) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), toxic_net).collect()}
    for i, t in enumerate(texts):
        ws = [w.encode() for w in t.split()]
        a = toxic_net.projected(toxic_net.inputs(toxicity.plain(ws)))
        best = 0.0
        for s in toxicity.windows(len(ws)):
            part = a[None, s : s + toxicity.WINDOW]
            best = max(best, float(toxicity._sigmoid(toxic_net.run(part, np.ones(part.shape[:2]))[0])))
        assert abs(got[i] - best) < 1e-4


@pytest.mark.parametrize("module,name", [(toxicity, "toxic"), (quality, "quality")])
def test_without_both_labels(spark, module, name):
    docs = frame(spark, [(1, "a", None), (2, None, None)])
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], f"doc_id long, {name} int")
    net = module.fit(docs, labels)
    assert {r.score for r in module.score(docs, net).collect()} == {0.0 if module is toxicity else 0.5}
    net = module.fit(docs, labels.filter("false"))
    assert module.score(docs.filter("false"), net).count() == 0


def test_pooled_chunks_match_brute_force():
    rng = np.random.default_rng(5)
    tables = rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32)
    for n in (1, 4, 5, 6, 511, 512, 513, 960, 961, 3000, 300_000):
        text = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        got = quality.pooled(tables, text)
        data = np.frombuffer(text.ljust(quality.WIDTH, b"\0"), np.uint8)
        assert len(got) == len(quality.starts(len(data)))
        for k, a in list(enumerate(quality.starts(len(data))))[:: max(1, len(got) // 5)]:
            part = data[a : a + quality.CHUNK]
            want = np.maximum(0, np.max([sum(tables[j][part[i + j]] for j in range(quality.WIDTH)) for i in range(len(part) - quality.WIDTH + 1)], axis=0))
            assert np.allclose(got[k], want, atol=1e-4)


@pytest.mark.parametrize("query,label,fold,least", [("op10_toxicity", "toxic", (5, 0), 0.88), ("op5_quality", "quality", (3, 1), 0.9)])
def test_held_out_accuracy(spark, query, label, fold, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = getattr(q, query)(spark, SF).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= least * len(held)


def test_small_bounds_give_the_same_scores(spark, toxic_net, monkeypatch):
    texts = [" ".join(f"word{(7 * i + k) % 90}" for k in range(i)) for i in range(60)] + [None, ""]
    docs = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    whole = toxicity._judge(docs, toxic_net)(texts)
    for name, value in (("HELD_WORDS", 5), ("LOOKED_UP", 100), ("RUN", 2)):
        monkeypatch.setattr(toxicity, name, value)
    assert toxicity._judge(docs, toxic_net)(texts)[0] == pytest.approx(whole[0], abs=1e-5)

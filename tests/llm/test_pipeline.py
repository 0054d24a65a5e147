"""The pipeline's stages against brute force on small documents."""

import re

import pytest

import corpus_pipeline as cp
from nearfold.llm import language, toxicity
from nearfold.llm.packing import WordIds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id", "en", None, None), (9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, "123 456", None, "x", 7)], base.schema)
    return base.unionByName(odd)


def ids(df):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())


def test_stages_have_the_contract(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"] and cp.ORACLE_SQL is None


def test_filters_keep_columns_and_clean_rows(spark, docs):
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.fit(docs, labels, usable=~toxicity.held_out())
    want = [-1 if r.doc_id is None else r.doc_id for r in toxicity.score(docs, net).collect() if r.score < 0.5]
    assert ids(kept) == sorted(want)
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert len(clean & set(ids(kept))) >= 0.97 * len(clean)
    named = cp.drop_unidentified(spark, docs, SF)
    assert named.columns == docs.columns
    gone = set(ids(docs)) - set(ids(named))
    assert {9001, 9002, 9003} <= gone and -1 in ids(named)
    model = language.fit(docs.filter(~language.held_out()))
    assert gone == {r.doc_id for r in language.identify(docs, model).collect() if r.doc_id is not None and (r.lang_pred == "und" or r.score < 0.25)}


def test_copies_leave_one_each(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = cp.drop_exact_copies(spark, docs, SF)
    least = {}
    for i, t in rows:
        if i is not None:
            key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            least[key] = min(least.get(key, i), i)
    assert kept.columns == docs.columns and ids(kept) == sorted([-1, *least.values()])


def test_rows_are_judged_for_themselves(spark, docs):
    """Repeated ids of different texts, null ids, and rows that repeat id and text."""
    some = docs.filter("doc_id < 40").collect()
    base = [r.asDict() for r in some]
    odd = [r | {"doc_id": None} for r in base] + [r | {"doc_id": 7} for r in base]
    both = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in base + odd], docs.schema)
    for stage in (cp.drop_toxic, cp.drop_unidentified):
        kept = [(r.doc_id, r.text) for r in stage(spark, both, SF).collect()]
        texts = {t for i, t in kept if i is None}
        assert 0 < len(texts) < len(base) + 1
        assert sorted(t or "" for i, t in kept if i is None) == sorted(r["text"] or "" for r in base if r["text"] in texts)
        assert {t for i, t in kept} == texts
    kept = cp.drop_exact_copies(spark, both, SF).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r.text) for r in kept) == sorted({norm(r["text"]) for r in base}) and all(r.doc_id is not None for r in kept)


def test_packing_and_whole_run(spark, docs):
    import public_tokenizers as P

    coder = WordIds(P.path("word_bpe_49k.json"))
    want = {r.doc_id: len(coder.encode([r.text])[0]) // 4 + 1 for r in docs.collect()}
    got = {}
    for r in cp.pack(spark, docs, SF).collect():
        assert r.offset + r.length <= 2048
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    out = cp.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and 0 < out.select("doc_id").distinct().count() < docs.count()


def test_empty_documents(spark, docs, tmp_path):
    none = docs.filter("false")
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0, name

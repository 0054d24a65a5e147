"""The registry: one query for each operator over the driver's tables, with SQL that repeats it on another engine.

Interactions are line items: user is the order's customer, item the part,
rating 1 + quantity mod 5, time the order's date. The order of rows is given by
ROW, which is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, hash_seeds, text_element
from ..operators import bpr, interactions, jaccard, kmeans, metrics, minhash, recommend, reports, text
from ..sources import files as sources
from .stages import computed, dense_index, kept_folder, settled, settled_alone, stable

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
WIDTH = 8  # of the factors that hashes stand in for


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = _table(spark, sf_dir, "lineitem").select(*ROW).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rating = (1 + F.col("l_quantity").cast("long") % 5).cast("double")
    return joined.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), rating.alias("rating"), F.col("o_orderdate").cast("date").alias("timestamp"), *ROW)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.leave_last_out(_rows(spark, sf_dir), "user", [F.desc("timestamp"), *ROW])


def _part(split: DataFrame, which: str) -> DataFrame:
    return split.filter(F.col("split") == which)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.item_user_pairs(interactions.positive(_rows(spark, sf_dir)), "item", "user")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent_asin"), F.col("p_name").alias("title"))


def _factors(ids: DataFrame, salt: int) -> DataFrame:
    """Factors and biases that any SQL engine can repeat."""
    f = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: ((F.col("id") * 7919 + k * 104729 + salt) % 2003) / 2003.0 - 0.5)
    return ids.select("id").distinct().select("id", f.alias("factor"), ((F.col("id") * 31 + salt) % 101 / 1010.0).alias("bias"))


def _int_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("int"))


_I = f"""i AS (
  SELECT o_custkey AS "user", l_partkey AS item, CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS rating, CAST(o_orderdate AS DATE) AS ts,
    row_number() OVER (ORDER BY {", ".join(ROW)}) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
_S = f"""{_I}, s AS (
  SELECT *, CASE row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, rn) WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS split FROM i
)"""
_P = f"""{_I}, p AS (SELECT DISTINCT item, "user" FROM i WHERE rating >= 3)"""
_JACCARD = f"""{_P}, n AS (SELECT item, count(*) AS n FROM p GROUP BY item),
c AS (SELECT a.item, b.item AS other, count(*) AS k FROM p a JOIN p b ON a."user" = b."user" AND a.item <> b.item GROUP BY ALL),
j AS (SELECT c.item, c.other, k / (x.n + y.n - k) AS score FROM c JOIN n x ON x.item = c.item JOIN n y ON y.item = c.other),
truth AS (SELECT item, other, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item ORDER BY j.score DESC, other) AS INTEGER) AS rank FROM j QUALIFY rank <= 5)"""


def _sigs(elements: str) -> str:
    """CTEs for signatures of a relation (item, x)."""
    seeds = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(hash_seeds()))
    return f"""h(k, a, b) AS (VALUES {seeds}),
m AS (SELECT item, k, min((a * (x % {PRIME}) + b) % {PRIME}) AS m FROM {elements}, h GROUP BY item, k),
sig AS (SELECT item, list(m ORDER BY k) AS sig FROM m GROUP BY item)"""


def _lsh(bands: int, rows: int, tag: str = "") -> str:
    return f"""b{tag} AS (SELECT item, k // {rows} AS band, string_agg(m::VARCHAR, '-' ORDER BY k) AS key FROM m WHERE k < {bands * rows} GROUP BY item, band),
cand{tag} AS (SELECT DISTINCT x.item, y.item AS other FROM b{tag} x JOIN b{tag} y USING (band, key) WHERE x.item <> y.item),
est{tag} AS (SELECT c.item, c.other, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 128 AS score
  FROM cand{tag} c JOIN sig x ON x.item = c.item JOIN sig y ON y.item = c.other),
top{tag} AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS INTEGER) AS rank FROM est{tag} QUALIFY rank <= 5)"""


_E = """e AS (SELECT item, "user" AS x FROM p)"""
_MINHASH = f"{_P}, {_E}, {_sigs('e')}"


def _tfidf_sql(table: str = "documents", key: str = "doc_id", body: str = "text") -> str:
    stop = ", ".join(f"'{w}'" for w in text.english())
    return rf"""t AS (SELECT {key} AS doc, unnest(regexp_extract_all(lower(coalesce({body}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {table}),
tf AS (SELECT doc, term, count(*) AS tf FROM t WHERE term NOT IN ({stop}) GROUP BY doc, term),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 50000),
raw AS (SELECT doc, term, tf * (ln((1 + (SELECT count(*) FROM {table})) / (1 + df)) + 1) AS raw FROM tf JOIN vocab USING (term)),
w AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS weight FROM raw)"""


_CENTRES = """pt AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS INTEGER) AS cluster, v AS c FROM pt QUALIFY cluster < 10),
d0 AS (SELECT id, v, cluster, greatest(list_dot_product(v, v) + list_dot_product(c, c) - 2 * list_dot_product(v, c), 0) AS dist FROM pt, c0),
a0 AS (SELECT id, v, cluster, dist FROM d0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cluster) = 1)"""


def _factor_sql(of: str, salt: int) -> str:
    return f"""SELECT id, [(id * 7919 + k * 104729 + {salt}) % 2003 / 2003.0::DOUBLE - 0.5 for k in [{", ".join(map(str, range(WIDTH)))}]] AS f, (id * 31 + {salt}) % 101 / 1010.0::DOUBLE AS bias FROM (SELECT DISTINCT {of} AS id FROM i)"""


_MODEL = f"""{_S}, uf AS ({_factor_sql('"user"', 1)}), vf AS ({_factor_sql("item", 2)}),
sc AS (SELECT uf.id AS "user", vf.id AS item, round(list_dot_product(uf.f, vf.f) + uf.bias + vf.bias, 6) AS score FROM uf, vf),
seen AS (SELECT DISTINCT "user", item FROM s WHERE split = 'train'),
un AS (SELECT * FROM sc ANTI JOIN seen USING ("user", item))"""
_TRIPLES = f"""{_P.replace(_I, _S)}, pr AS (SELECT "user", item FROM s WHERE split = 'train' AND rating >= 3),
own AS (SELECT DISTINCT "user", item FROM pr), ni AS (SELECT max(item) + 1 AS n FROM s),
dr AS (SELECT own."user", own.item, a, CAST('0x' || substr(md5(concat_ws('|', '42', '0', own."user", own.item, a)), 1, 8) AS BIGINT) % n AS neg FROM own, ni, range(101) r(a)),
ok AS (SELECT dr.*, o2.item IS NULL AS free FROM dr LEFT JOIN own o2 ON o2."user" = dr."user" AND o2.item = dr.neg),
pick AS (SELECT "user", item, neg FROM ok QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY NOT (free OR a = 100), a) = 1),
tr AS (SELECT pr."user", pr.item AS pos, pick.neg FROM pr JOIN pick USING ("user", item))"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query(f"""WITH {_I}, u AS (SELECT "user", CAST(row_number() OVER (ORDER BY min(rn)) - 1 AS BIGINT) AS user_idx FROM i GROUP BY 1),
q AS (SELECT item, CAST(row_number() OVER (ORDER BY min(rn)) - 1 AS BIGINT) AS product_idx FROM i GROUP BY 1), t AS (SELECT DISTINCT p_partkey, p_name FROM part)
SELECT user_idx, product_idx, p_name AS title, rating, ts AS timestamp FROM i JOIN u USING ("user") JOIN q USING (item) LEFT JOIN t ON p_partkey = item""")
def interactions_joined(spark, d):
    rows = _rows(spark, d).withColumnsRenamed({"user": "user_id", "item": "parent_asin"})
    return interactions.build_interactions(rows, _meta(spark, d), tuple(ROW))


@_query(f"WITH {_I} SELECT item, CAST(row_number() OVER (ORDER BY min(rn)) - 1 AS BIGINT) AS idx FROM i GROUP BY item")
def factorize_first_seen(spark, d):
    return interactions.factorize(_rows(spark, d), "item", ROW)


@_query(f"""WITH {_S}, u AS (SELECT "user", CAST(row_number() OVER (ORDER BY min(rn)) - 1 AS BIGINT) AS user_idx FROM s WHERE split = 'train' GROUP BY 1),
q AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS product_idx FROM (SELECT DISTINCT p_partkey FROM part)), t AS (SELECT DISTINCT p_partkey, p_name FROM part)
SELECT split, user_idx, product_idx, p_name AS title, rating, ts AS timestamp FROM s JOIN u USING ("user") JOIN q ON q.p_partkey = item JOIN t ON t.p_partkey = item""")
def eval_split_mapped(spark, d):
    s = _split(spark, d).withColumnsRenamed({"user": "user_id", "item": "parent_asin"})
    names = ("train", "valid", "test")
    parts = interactions.map_eval_splits(*[_part(s, n) for n in names], _meta(spark, d), tuple(ROW), ("parent_asin",))
    a, b, c = (p.withColumn("split", F.lit(n)) for p, n in zip(parts, names))
    return a.unionByName(b).unionByName(c)


@_query(f'WITH {_I} SELECT "user", item, rating FROM i WHERE rating >= 3')
def rating_filter(spark, d):
    return interactions.with_ids(interactions.positive(_rows(spark, d)), "user", "item").select("user", "item", "rating")


@_query(f"WITH {_I} SELECT rating, count(*) AS n FROM i GROUP BY rating")
def rating_histogram(spark, d):
    return metrics.histogram(_rows(spark, d), "rating")


@_query(f'WITH {_I} SELECT count(*) AS n_rows, count(DISTINCT "user") AS n_distinct FROM i')
def distinct_users(spark, d):
    return metrics.totals(_rows(spark, d), "user")


@_query(f"""WITH {_S} SELECT (SELECT max("user") + 1 FROM s WHERE split = 'train') AS n_users, (SELECT max(item) + 1 FROM s) AS n_items""")
def id_space(spark, d):
    s = _split(spark, d)
    return interactions.id_space(_part(s, "train"), [_part(s, "valid"), _part(s, "test")], "user", "item")


@_query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500")
def exact_sample_n(spark, d):
    return interactions.sample_rows(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 500)


@_query(f"WITH {_I} SELECT item FROM (SELECT DISTINCT item FROM i WHERE rating >= 3) ORDER BY md5('42|' || item), item LIMIT 10")
def sample_item_keys(spark, d):
    return interactions.sample_keys(interactions.positive(_rows(spark, d)), "item", 10)


@_query(f'WITH {_I} SELECT "user", item, rating FROM i ORDER BY rn LIMIT 5000')
def prefix_slice(spark, d):
    return interactions.prefix(_rows(spark, d), ROW, 5000).select("user", "item", "rating")


@_query(f'WITH {_I} SELECT item, arg_min("user", rn) AS "user", arg_min(rating, rn) AS rating FROM i GROUP BY item')
def first_row_per_item(spark, d):
    return interactions.first_per_key(_rows(spark, d).select("item", "user", "rating", *[c for c in ROW]), "item", ROW).select("item", "user", "rating")


@_query(f"""WITH {_S}, u AS (SELECT "user", CAST(row_number() OVER (ORDER BY min(rn)) - 1 AS BIGINT) AS idx FROM s WHERE split = 'train' AND rating = 5 GROUP BY 1)
SELECT s."user", s.item, u.idx FROM s LEFT JOIN u ON u."user" = s."user" WHERE split <> 'train'""")
def id_lookup(spark, d):
    """Evaluation rows with the ids of users that rated 5 in training; others have none."""
    s = _split(spark, d)
    ids = interactions.factorize(_part(s, "train").filter("rating = 5"), "user", ROW)
    return interactions.map_ids(s.filter("split <> 'train'").select("user", "item"), ids, "user", keep_missing=True).select("user", "item", "idx")


@_query(f"WITH {_S} SELECT item, count(*) AS n FROM (SELECT item FROM s WHERE split = 'train' UNION ALL SELECT item FROM s WHERE split = 'valid' UNION ALL SELECT item FROM s WHERE split = 'test') GROUP BY item")
def item_id_union(spark, d):
    s = _split(spark, d)
    a, b, c = (_part(s, n).select("item") for n in ("train", "valid", "test"))
    return a.unionByName(b).unionByName(c).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@_query(f'WITH {_I} SELECT "user", item, ts AS timestamp FROM i WHERE rating = 5')
def equality_mask(spark, d):
    return _rows(spark, d).filter("rating = 5").select("user", "item", "timestamp")


@_query("SELECT DISTINCT p_name AS title FROM part")
def distinct_titles(spark, d):
    return interactions.distinct_values(_meta(spark, d), "title")


@_query(f"""WITH {_P} SELECT item, count(*) AS n, string_agg("user"::VARCHAR, ',' ORDER BY "user") AS users FROM p GROUP BY item""")
def item_user_sets(spark, d):
    s = jaccard.sets_of(_pairs(spark, d), "item", "user")
    return s.select("item", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("users"))


@_query(f"""WITH {_S}, x AS (SELECT DISTINCT "user", item FROM s WHERE split = 'train') SELECT "user", count(*) AS n, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM x GROUP BY 1""")
def user_seen_sets(spark, d):
    s = jaccard.sets_of(_part(_split(spark, d), "train"), "user", "item")
    return s.select("user", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("items"))


@_query(f"""WITH {_S}, x AS (SELECT DISTINCT "user", item FROM s WHERE split = 'train' AND rating >= 3) SELECT "user", count(*) AS n, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM x GROUP BY 1""")
def user_positive_sets(spark, d):
    s = jaccard.sets_of(interactions.positive(_part(_split(spark, d), "train")), "user", "item")
    return s.select("user", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("items"))


@_query(f"""WITH {_S} SELECT "user", count(*) AS n, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM s WHERE split <> 'train' GROUP BY 1""")
def eval_item_lists(spark, d):
    s = jaccard.lists_of(_split(spark, d).filter("split <> 'train'"), "user", "item")
    return s.select("user", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("items"))


@_query(f"WITH {_JACCARD} SELECT item, other, score, rank FROM truth")
def exact_jaccard_topk(spark, d):
    return _int_rank(jaccard.exact_jaccard_topk(_pairs(spark, d)))


@_query(f"""WITH {_JACCARD}, q AS (SELECT item FROM (SELECT DISTINCT item FROM p) ORDER BY md5('42|' || item), item LIMIT 20) SELECT item, other, score, rank FROM truth SEMI JOIN q USING (item)""")
def jaccard_ground_truth(spark, d):
    """Brute force for a sample of 20 items against all."""
    pairs = stable(_pairs(spark, d))
    return _int_rank(jaccard.exact_jaccard_topk(pairs, 5, stable(interactions.sample_keys(pairs, "item", 20))))


@_query(f"WITH {_MINHASH} SELECT item, list_aggregate(sig, 'string_agg', ',') AS sig FROM sig")
def minhash_signatures(spark, d):
    return minhash.signatures(_pairs(spark, d)).select("item", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@_query(f"WITH {_MINHASH}, {_lsh(64, 2)} SELECT CAST(band AS INTEGER) AS band, key, item FROM b")
def lsh_bands(spark, d):
    return minhash.bands(minhash.signatures(_pairs(spark, d)))


@_query(f"WITH {_MINHASH}, {_lsh(64, 2)} SELECT item, other FROM cand")
def lsh_candidates(spark, d):
    return minhash.candidates(stable(minhash.bands(minhash.signatures(_pairs(spark, d)))))


def _index(spark, d, bands=64, rows=2):
    sigs = stable(minhash.signatures(_pairs(spark, d)))
    return stable(minhash.bands(sigs, bands, rows)), sigs


@_query(f"WITH {_MINHASH}, {_lsh(64, 2)} SELECT item, other, score, rank FROM top")
def lsh_topk(spark, d):
    return _int_rank(minhash.similar_topk(minhash.signatures(_pairs(spark, d))))


@_query(f"""WITH {_MINHASH}, {_lsh(64, 2)}, one AS (SELECT coalesce(max(CASE WHEN item = 250 THEN item END), min(item)) AS item FROM sig)
SELECT item, other, score, rank FROM top SEMI JOIN one USING (item)""")
def lsh_query_one(spark, d):
    index, sigs = _index(spark, d)
    return _int_rank(minhash.lsh_topk(index, sigs, 5, minhash.query_or_first(sigs, 250)))


@_query(SQL["lsh_query_one"])
def lsh_query_saved(spark, d):
    """The same from an index that is saved, then read: the query itself reads one band key a band and the signatures these meet."""
    index, sigs = _index(spark, d)
    with kept_folder(spark, "index") as path:
        minhash.save_index(path, sigs, index, _meta(spark, d).withColumnRenamed("parent_asin", "item"))
        return computed(_int_rank(minhash.query_index(spark, path, 250)))


_RECALL = "(SELECT coalesce(avg(r), 0) FROM (SELECT count(x.other) / count(*) AS r FROM truth LEFT JOIN {} x ON x.item = truth.item AND x.other = truth.other GROUP BY truth.item))"


@_query(f"WITH {_JACCARD}, {_E}, {_sigs('e')}, {_lsh(64, 2)} SELECT round({_RECALL.format('top')}, 6) AS recall")
def lsh_recall_at_5(spark, d):
    pairs = settled(_pairs(spark, d))
    found = settled(minhash.similar_topk(minhash.signatures(pairs)))
    return metrics.recall_at_k(found, jaccard.exact_jaccard_topk(pairs)).select(F.round("recall", 6).alias("recall"))


@_query(f"WITH {_MINHASH}, {_lsh(25, 5)} SELECT item, other, score, rank FROM top")
def lsh_comparator(spark, d):
    """The banding that a threshold of 0.5 asks for."""
    return _int_rank(minhash.similar_topk(minhash.signatures(_pairs(spark, d)), 5, 25, 5))


@_query(f"WITH {_MINHASH}, {_lsh(64, 2)} SELECT size, count(*) AS buckets FROM (SELECT count(*) AS size FROM b GROUP BY band, key) GROUP BY size")
def lsh_bucket_sizes(spark, d):
    return minhash.bucket_sizes(_index(spark, d)[0])


@_query(f"""WITH {_JACCARD}, {_E}, {_sigs('e')}, {_lsh(64, 2)}, {_lsh(25, 5, '5')}, r AS (SELECT round({_RECALL.format('top')}, 6) AS ours, round({_RECALL.format('top5')}, 6) AS other)
SELECT 'recall_at_5' AS metric, ours, other, CASE WHEN ours = other THEN 'tie' WHEN ours > other THEN 'ours' ELSE 'other' END AS winner FROM r""")
def benchmark_summary(spark, d):
    pairs = settled(_pairs(spark, d))
    truth = settled_alone(lambda: jaccard.exact_jaccard_topk(pairs).select("item", "other"))
    # signatures are made anew for each banding: kept beside its tables they take more disk than all pairs
    found = lambda b, r: settled_alone(lambda: minhash.similar_topk(minhash.signatures(pairs), 5, b, r).select("item", "other"))
    value = lambda b, r: round(metrics.recall_at_k(found(b, r), truth).first()[0], 6)
    return metrics.comparison({"recall_at_5": value(64, 2)}, {"recall_at_5": value(25, 5)}, spark, set())


@_query(rf"""WITH t AS (SELECT DISTINCT doc_id AS item, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
e AS (SELECT item, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {PRIME} AS x FROM t), {_sigs('e')}, {_lsh(16, 8)} SELECT item, other, score, rank FROM top""")
def doc_near_dup_lsh(spark, d):
    t = _table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.explode(text.tokens(F.col("text"))).alias("term"))
    sigs = stable(minhash.signatures(t.select("item", text_element(F.col("term")).alias("x")), element="x"))
    return _int_rank(minhash.similar_topk(sigs, 5, 16, 8))


@_query(f"WITH {_tfidf_sql()} SELECT term, n, df FROM vocab")
def tfidf_vocab(spark, d):
    return text.vocabulary(text.term_counts(_table(spark, d, "documents"), "doc_id", "text"))


@_query(f"WITH {_tfidf_sql()} SELECT doc, term, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark, d):
    return text.tfidf(_table(spark, d, "documents")).withColumn("weight", F.round("weight", 6))


@_query(f"WITH {_tfidf_sql()} SELECT DISTINCT doc FROM w")
def tfidf_nonempty(spark, d):
    return text.nonempty(text.tfidf(_table(spark, d, "documents")))


_TOP_COSINE = """q AS (SELECT doc FROM (SELECT DISTINCT doc FROM w) ORDER BY md5('42|' || doc), doc LIMIT 10),
cs AS (SELECT a.doc AS query, b.doc AS other, round(sum(a.weight * b.weight), 6) AS score FROM w a SEMI JOIN q ON q.doc = a.doc JOIN w b ON b.term = a.term AND b.doc <> a.doc GROUP BY ALL)"""


@_query(f"WITH {_tfidf_sql()}, {_TOP_COSINE} SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS INTEGER) AS rank FROM cs QUALIFY rank <= 5")
def tfidf_cosine_topk(spark, d):
    w = stable(text.tfidf(_table(spark, d, "documents")))
    return _int_rank(text.cosine_topk(w, interactions.sample_keys(w, "doc", 10)))


@_query(f"""WITH {_tfidf_sql()}, {_TOP_COSINE}, al AS (SELECT q.doc AS query, doc_id AS other, coalesce(score, 0) AS score FROM q JOIN documents ON doc_id <> q.doc LEFT JOIN cs ON cs.query = q.doc AND cs.other = doc_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS INTEGER) AS rank FROM al QUALIFY rank <= 5""")
def tfidf_cosine_padded(spark, d):
    docs = _table(spark, d, "documents")
    w = stable(text.tfidf(docs))
    return _int_rank(text.cosine_topk(w, interactions.sample_keys(w, "doc", 10), all_docs=docs.select(F.col("doc_id").alias("doc"))))


@_query()
def tfidf_library(spark, d):
    """Documents with the number of terms the library's pipeline gives weight."""
    out = text.ml_tfidf(_table(spark, d, "documents"))
    return out.select("doc_id", F.udf(lambda v: int(v.numNonzeros()), "int")("features").alias("terms"))


@_query("""WITH pt AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT * FROM pt ORDER BY md5('42|' || id), id LIMIT 10),
cs AS (SELECT q.id AS query, pt.id AS other, round(list_dot_product(q.v, pt.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(pt.v, pt.v))), 5) AS score FROM q JOIN pt ON pt.id <> q.id)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS INTEGER) AS rank FROM cs QUALIFY rank <= 5""")
def emb_cosine_topk(spark, d):
    v = _table(spark, d, "embeddings")
    return _int_rank(text.dense_cosine_topk(v, interactions.sample_keys(v, "vec_id", 10)))


def _points(spark, d):
    return stable(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")))


@_query("""SELECT CAST(dense_rank() OVER (ORDER BY md5('42|' || vec_id), vec_id) - 1 AS INTEGER) AS cluster, CAST(k AS INTEGER) AS dim, CAST(embedding[k + 1] AS DOUBLE) AS value
FROM (SELECT * FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 10), range(64) r(k)""")
def kmeans_init(spark, d):
    rows = [(c, i, x) for c, v in kmeans.initial_centroids(_points(spark, d), 10) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "cluster int, dim int, value double")


@_query(f"WITH {_CENTRES} SELECT id, cluster, round(dist, 6) AS dist FROM a0")
def kmeans_assign_step(spark, d):
    p = _points(spark, d)
    return kmeans.assign(p, kmeans.initial_centroids(p, 10)).select("id", "cluster", F.round("dist", 6).alias("dist"))


@_query(f"WITH {_CENTRES}, l AS (SELECT cluster, CAST(k AS INTEGER) AS dim, v[k + 1] AS x FROM a0, range(64) r(k)) SELECT cluster, dim, round(avg(x), 6) AS value FROM l GROUP BY ALL")
def kmeans_update_step(spark, d):
    p = _points(spark, d)
    return kmeans.means(kmeans.assign(p, kmeans.initial_centroids(p, 10))).withColumn("value", F.round("value", 6))


@_query(f"WITH {_CENTRES} SELECT round(sum(dist), 6) AS inertia FROM a0")
def kmeans_inertia(spark, d):
    p = _points(spark, d)
    return kmeans.inertia(kmeans.assign(p, kmeans.initial_centroids(p, 10))).select(F.round("inertia", 6).alias("inertia"))


@_query(f"""WITH {_CENTRES} SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY id) AS INTEGER) AS rank, p_name AS title FROM a0 JOIN part ON p_partkey = id WHERE p_name IS NOT NULL QUALIFY rank <= 5""")
def cluster_samples(spark, d):
    p = _points(spark, d)
    a = kmeans.assign(p, kmeans.initial_centroids(p, 10)).select("id", "cluster")
    titles = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return _int_rank(kmeans.cluster_samples(a.join(titles, "id"), ["id"]))


@_query(f"""WITH {_tfidf_sql()}, cl AS (SELECT doc_id AS doc, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS cluster FROM documents),
g AS (SELECT cluster, term, sum(weight) AS s FROM w JOIN cl USING (doc) GROUP BY ALL), z AS (SELECT cluster, count(*) AS n FROM cl GROUP BY cluster),
f AS (SELECT cluster, term, round(s / n, 6) AS weight FROM g JOIN z USING (cluster))
SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS INTEGER) AS rank, term, weight FROM f QUALIFY rank <= 10""")
def cluster_top_terms(spark, d):
    """Languages stand in for clusters, so that the result can be repeated."""
    docs = _table(spark, d, "documents")
    number = dense_index(docs.select("lang").distinct(), [F.asc_nulls_last("lang")], "cluster").select(F.col("lang").alias("_lang"), F.col("cluster").cast("int").alias("cluster"))
    clusters = docs.join(F.broadcast(number), F.col("lang").eqNullSafe(F.col("_lang"))).select(F.col("doc_id").alias("id"), "cluster")  # a language a row
    return _int_rank(kmeans.cluster_terms(text.tfidf(docs), clusters))


def _lloyd(k: int, steps: int, points: str = "pt", tag: str = "") -> str:
    """CTEs: c{tag}_0 .. c{tag}_{steps}, the centroids before and after each step, from the first k points in hash order. Clusters are taken to stay filled."""
    out = [f"c{tag}_0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS INTEGER) AS cluster, v AS c FROM {points} QUALIFY cluster < {k})"]
    for i in range(steps):
        out += [
            f"a{tag}_{i} AS MATERIALIZED ({_nearest(f'c{tag}_{i}', points)})",
            f"c{tag}_{i + 1} AS MATERIALIZED (SELECT cluster, list(x ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(v[dim]) AS x FROM a{tag}_{i}, range(1, 65) r(dim) GROUP BY ALL) GROUP BY cluster)",
        ]
    return ",\n".join(out)


def _nearest(centres: str, points: str = "pt") -> str:
    distance = "greatest(list_dot_product(v, v) + list_dot_product(c, c) - 2 * list_dot_product(v, c), 0)"
    return f"SELECT id, v, cluster, {distance} AS dist FROM {points}, {centres} QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, cluster) = 1"


_PT = _CENTRES.split(",\nc0")[0]


def _labels(df: DataFrame) -> DataFrame:
    return df.select("id", "cluster", F.round("dist", 6).alias("dist"))


@_query(f"WITH {_PT}, {_lloyd(10, 20)} SELECT id, cluster, round(dist, 6) AS dist FROM ({_nearest('c_20')})")
def kmeans_fit(spark, d):
    """All 20 steps, which a tolerance of 0 asks for."""
    return _labels(kmeans.KMeans(10, 20, 0.0).fit(_table(spark, d, "embeddings"), "vec_id", "embedding").labels)


@_query(f"WITH {_PT}, {_lloyd(10, 5)} SELECT id, a_4.cluster, round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) ** 2)), 6) AS dist FROM a_4 JOIN c_5 ON c_5.cluster = a_4.cluster")
def kmeans_strict(spark, d):
    """Labels from before the last update."""
    return _labels(kmeans.KMeans(10, 5, 0.0, strict_labels=True).fit(_table(spark, d, "embeddings"), "vec_id", "embedding").labels)


@_query(f"WITH {_PT}, few AS (SELECT * FROM pt ORDER BY id LIMIT 10000), {_lloyd(10, 5, 'few')} SELECT id, cluster, round(dist, 6) AS dist FROM ({_nearest('c_5')})")
def kmeans_transform(spark, d):
    """Fitted on the first 10,000 rows, which is the feature; every row is assigned."""
    v = _table(spark, d, "embeddings")
    model = kmeans.KMeans(10, 5, 0.0).fit(interactions.prefix(v, ["vec_id"], 10_000), "vec_id", "embedding")
    return _labels(model.transform(v, "vec_id", "embedding"))


_ELBOW = (5, 10, 20)


@_query(f"WITH {_PT}, " + ", ".join(_lloyd(k, 8, "pt", str(k)) for k in _ELBOW) + " " + " UNION ALL ".join(f"SELECT {k} AS k, round(sum(dist), 4) AS inertia FROM ({_nearest(f'c{k}_8')})" for k in _ELBOW))
def kmeans_elbow(spark, d):
    return kmeans.elbow(_table(spark, d, "embeddings"), _ELBOW, 8, 0.0, 42, "vec_id", "embedding").withColumn("inertia", F.round("inertia", 4))


@_query()
def kmeans_library(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = stable(_table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return kmeans.library_kmeans(v, 10, (42, 43)).transform(v).select("vec_id", "cluster")


def _positives(spark, d):
    return interactions.positive(_part(_split(spark, d), "train")).select("user", "item")


def _n_items(spark, d):
    return _rows(spark, d).agg(F.max("item") + 1).first()[0]


@_query(f'WITH {_TRIPLES} SELECT "user", pos, neg FROM tr')
def bpr_triples(spark, d):
    return bpr.triples(_positives(spark, d), _n_items(spark, d))


def _model(spark, d):
    rows = _rows(spark, d)
    users = settled(_factors(rows.select(F.col("user").alias("id")), 1))
    items = settled(_factors(rows.select(F.col("item").alias("id")), 2))
    return users, items


@_query(f"""WITH {_TRIPLES}, uf AS ({_factor_sql('"user"', 1)}), vf AS ({_factor_sql("item", 2)}), nf AS (SELECT * FROM vf),
x AS (SELECT list_dot_product(uf.f, nf.f) + nf.bias - list_dot_product(uf.f, vf.f) - vf.bias AS x FROM tr JOIN uf ON uf.id = "user" JOIN vf ON vf.id = pos JOIN nf ON nf.id = neg)
SELECT round(avg(greatest(x, 0) + ln(1 + exp(-abs(x)))), 6) AS loss FROM x""")
def bpr_loss(spark, d):
    users, items = _model(spark, d)
    t = bpr.triples(_positives(spark, d), _n_items(spark, d))
    t = recommend.score_pairs(t.withColumnRenamed("pos", "item"), users, items).withColumnsRenamed({"score": "pos_score", "item": "pos"})
    t = recommend.score_pairs(t.withColumnRenamed("neg", "item"), users, items).withColumnRenamed("score", "neg_score")
    return bpr.mean_loss(t).select(F.round("loss", 6).alias("loss"))


@_query(f'WITH {_MODEL} SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INTEGER) AS rank FROM un QUALIFY rank <= 10')
def bpr_score_topk(spark, d):
    return _int_rank(recommend.recommend_topk(*_model(spark, d), _part(_split(spark, d), "train")))


@_query(f"""WITH {_MODEL}, rec AS (SELECT "user", item FROM un QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) <= 50),
a AS (SELECT "user", item FROM s WHERE split = 'valid'), h AS (SELECT a."user", count(DISTINCT rec.item) / count(*) AS r FROM a LEFT JOIN rec ON rec."user" = a."user" AND rec.item = a.item GROUP BY 1)
SELECT round(coalesce(avg(r), 0), 6) AS recall FROM h""")
def recall_at_k(spark, d):
    s = _split(spark, d)
    valid = settled(_part(s, "valid").select("user", "item"))
    recs = recommend.recommend_topk(*_model(spark, d), _part(s, "train"), 50)
    return metrics.user_recall_at_k(recs, valid).select(F.round("recall", 6).alias("recall"))


_LAST = """SELECT "user", CAST(row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, item, rn) AS INTEGER) AS rank, item, ts AS timestamp FROM s WHERE split = 'train' QUALIFY rank <= 5"""


@_query(f"WITH {_S} {_LAST}")
def last_n_purchases(spark, d):
    return _int_rank(recommend.last_n(_part(_split(spark, d), "train"), 5, "user", "item", "timestamp", tuple(ROW)))


@_query(f"""WITH {_MODEL}, who AS (SELECT "user" FROM (SELECT DISTINCT "user" FROM s WHERE split = 'test') ORDER BY md5('42|' || "user"), "user" LIMIT 5), la AS ({_LAST}),
rec AS (SELECT "user", item, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INTEGER) AS rank FROM un QUALIFY rank <= 10),
b AS (SELECT "user", 'bought' AS section, rank, item FROM la UNION ALL SELECT "user", 'recommended', rank, item FROM rec)
SELECT "user", section, rank, coalesce(p_name, item::VARCHAR) AS title FROM b SEMI JOIN who USING ("user") LEFT JOIN part ON p_partkey = item""")
def sample_recommendations(spark, d):
    s = _split(spark, d)
    who = stable(interactions.sample_keys(_part(s, "test"), "user", 5))
    users, items = _model(spark, d)
    train = _part(s, "train").join(F.broadcast(who), "user", "left_semi")
    recs = recommend.recommend_topk(users.join(F.broadcast(who), F.col("id") == F.col("user"), "left_semi"), items, train)
    recent = recommend.last_n(train, 5, "user", "item", "timestamp", tuple(ROW))
    titles = _meta(spark, d).withColumnRenamed("parent_asin", "item")
    return _int_rank(recommend.sample_report(recs, recent, titles))


@_query(f'WITH {_I} SELECT item, "user", count(*) AS n FROM i GROUP BY ALL')
def interaction_matrix(spark, d):
    return bpr.interaction_matrix(_rows(spark, d))


@_query()
def bpr_train_epoch(spark, d):
    """Two epochs at width 8; (epoch, loss)."""
    pos = stable(_positives(spark, d))
    rows = _rows(spark, d)
    model = bpr.BPR(d=8, rate=0.01, rounds=2).start(rows.select(F.col("user").alias("id")), spark.range(_n_items(spark, d)))
    losses = [(k, model.train_epoch(pos, _n_items(spark, d))) for k in range(2)]
    return spark.createDataFrame(losses, "epoch int, loss double")


@_query()
def als_comparator(spark, d):
    model = bpr.als(bpr.interaction_matrix(_rows(spark, d)), 16)
    return model.userFactors.select("id", F.size("features").alias("width"))


@_query(f"""WITH {_MINHASH}, {_lsh(64, 2)}, q AS (SELECT item FROM (SELECT DISTINCT item FROM sig) ORDER BY md5('42|' || item), item LIMIT 10), r AS (SELECT * FROM top SEMI JOIN q USING (item))
SELECT item, 0 AS line_no, 'Query ' || item AS line FROM q
UNION ALL SELECT item, rank, printf('  %2d. %d  score=%.4f', rank, other, round(score, 4)) FROM r
UNION ALL SELECT item, 1, '  (No candidates found)' FROM q ANTI JOIN r USING (item)""")
def lsh_report(spark, d):
    index, sigs = _index(spark, d)
    q = stable(interactions.sample_keys(sigs, "item", 10))
    return reports.neighbour_lines(stable(minhash.lsh_topk(index, sigs, 5, q)), q)


@_query(f"""WITH {_tfidf_sql()}, {_TOP_COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS rank FROM cs QUALIFY rank <= 5)
SELECT doc AS item, 0 AS line_no, 'Query ' || doc AS line FROM q
UNION ALL SELECT query, rank, printf('  %2d. %d  score=%.4f', rank, other, round(score, 4)) FROM r
UNION ALL SELECT doc, 1, '  (No candidates found)' FROM q ANTI JOIN r ON r.query = q.doc""")
def tfidf_report(spark, d):
    w = stable(text.tfidf(_table(spark, d, "documents")))
    q = stable(interactions.sample_keys(w, "doc", 10))
    return reports.neighbour_lines(stable(text.cosine_topk(w, q).withColumnRenamed("query", "item")), q.withColumnRenamed("doc", "item"))


@_query(f"""WITH {_CENTRES}, named AS (SELECT id, cluster, p_name AS title FROM a0 JOIN part ON p_partkey = id), {_tfidf_sql("named", "id", "title")},
g AS (SELECT cluster, term, sum(weight) AS s FROM w JOIN named ON id = doc GROUP BY ALL), z AS (SELECT cluster, count(*) AS n FROM named GROUP BY cluster),
f AS (SELECT cluster, term, round(s / n, 6) AS weight FROM g JOIN z USING (cluster)),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank FROM f QUALIFY rank <= 10)
SELECT cluster, 0 AS line_no, 'Cluster ' || cluster || ': ' || string_agg(term, ', ' ORDER BY rank) AS line FROM top GROUP BY cluster
UNION ALL SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY id) AS INTEGER) AS line_no, '  - ' || title FROM named WHERE title IS NOT NULL QUALIFY line_no <= 5""")
def cluster_report(spark, d):
    p = _points(spark, d)
    titles = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    named = stable(kmeans.assign(p, kmeans.initial_centroids(p, 10)).select("id", "cluster").join(titles, "id"))
    terms = kmeans.cluster_terms(text.tfidf(named, "id", "title"), named)
    return reports.cluster_lines(terms, kmeans.cluster_samples(named, ["id"])).withColumn("line_no", F.col("line_no").cast("int"))


def _files(rows: DataFrame, path: str) -> str:
    """rows as gz CSV with a header; user_id, parent_asin, rating, timestamp."""
    cols = [F.col("user").cast("string").alias("user_id"), F.col("item").cast("string").alias("parent_asin"), "rating", F.unix_date("timestamp").alias("timestamp")]
    rows.select(*cols).write.option("header", True).option("compression", "gzip").csv(path)
    return path


def _meta_file(spark, d, path: str) -> str:
    _meta(spark, d).select(F.col("parent_asin").cast("string"), "title").write.option("compression", "gzip").json(path)
    return path


_TITLE = "t AS (SELECT DISTINCT p_partkey, p_name FROM part)"
_BY_TITLE = "count(*) AS n, count(DISTINCT \"user\") AS users, CAST(min(datediff('day', DATE '1970-01-01', ts)) AS BIGINT) AS earliest"


@_query(f"""WITH {_I}, {_TITLE} SELECT p_name AS title, rating, {_BY_TITLE} FROM i LEFT JOIN t ON p_partkey = item GROUP BY ALL""")
def sources_interactions(spark, d):
    """Interactions out of gz CSV and gz JSON lines, by title and rating."""
    with kept_folder(spark, "sources") as path:
        got = sources.load_interactions(spark, _files(_rows(spark, d), f"{path}/reviews"), _meta_file(spark, d, f"{path}/meta"))
        return computed(_by_title(got, "title", "rating"))


@_query(f"""WITH {_S}, {_TITLE} SELECT split, p_name AS title, {_BY_TITLE} FROM s JOIN t ON p_partkey = item SEMI JOIN (SELECT "user" FROM s WHERE split = 'train') k ON k."user" = s."user" GROUP BY ALL""")
def sources_splits(spark, d):
    """Training, validation and test rows out of three gz CSV files and metadata, by title."""
    s = stable(_split(spark, d))
    with kept_folder(spark, "sources") as path:
        names = ("train", "valid", "test")
        got = sources.load_splits(spark, *[_files(_part(s, n), f"{path}/{n}") for n in names], _meta_file(spark, d, f"{path}/meta"))
        a, b, c = (p.withColumn("split", F.lit(n)) for p, n in zip(got, names))
        return computed(_by_title(a.unionByName(b).unionByName(c), "split", "title"))


def _by_title(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_idx").alias("users"), F.min("timestamp").cast("long").alias("earliest"))


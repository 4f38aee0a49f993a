"""Queries of ranked retrieval. Query sets are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import ranking as R
from gneiss.runtime import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_records").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("content").alias("content")).select(F.col("chunk_id").alias("item_id"), "content")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the traces whose id, a hexadecimal number, is divisible by 50 in its last digits."""
    t = table(spark, d, "traces").where(F.conv(F.substring("request_id", -12, 12), 16, 10).cast("long") % 50 == 0)
    return t.groupBy("request_id").agg(F.min("request.question").alias("question")).select(F.col("request_id").alias("query_id"), "question")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


def bm25_top(spark, d):
    return R.top_k(R.bm25_search(chunks(spark, d), questions(spark, d), 10), 10).select("query_id", "item_id", "rank", F.round("score", 5).alias("score"))


def body_bm25(spark, d):
    """BM25 over the text without its first line, the generated or printed header."""
    items = chunks(spark, d).withColumn("content", F.regexp_replace("content", r"^[^\n]*\n", ""))
    return R.top_k(R.bm25_search(items, questions(spark, d), 5), 5).select("query_id", "item_id", "rank", F.round("score", 5).alias("score"))


def dense_top(spark, d):
    return R.top_k(R.dense_search(vectors(spark, d), vector_queries(spark, d), 10), 10).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


def term_stats(spark, d):
    c = R.term_counts(chunks(spark, d), "item_id", "content")
    return c.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _lists(spark, d):
    """Two rankings of the same vectors: by dot product and by negative distance in one axis."""
    v, q = vectors(spark, d), vector_queries(spark, d)
    dense = R.top_k(R.dense_search(v, q, 40), 40)
    half = lambda df: df.withColumn("vector", F.slice("vector", 1, 32))
    other = R.top_k(R.dense_search(half(v), half(q), 40), 40)
    return {"dense": dense, "half": other}


def fused(spark, d):
    f = R.rrf(_lists(spark, d), 60, {"dense": 1.2, "half": 1.0})
    return R.top_k(f.withColumnRenamed("fusion_score", "score"), 10).select("query_id", "item_id", "rank", F.round("score", 9).alias("score"), F.array_join("retriever_sources", ",").alias("sources"))


def margin(spark, d):
    return R.fusion_margin(R.rrf(_lists(spark, d), 60, {"dense": 1.2, "half": 1.0}))


def unique_ranks(spark, d):
    """Ranks of retrieval results by query; repeated chunks take one rank."""
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null and score is not null").select("query_id", F.col("chunk_id").alias("item_id"), "score")
    return R.ranked(r).select("query_id", "item_id", F.round("score", 9).alias("score"), "rank")


def capped(spark, d):
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null and score is not null").select("query_id", F.col("chunk_id").alias("item_id"), "score")
    best = r.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return R.top_k(best, 3).select("query_id", "item_id", "rank")


def overflow(spark, d):
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null").select("query_id", "chunk_id").distinct()
    return R.bounded(r, ["query_id"], 4)


def quota(spark, d):
    """Six results a query, split over three arms by content type and place."""
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null and score is not null and page is not null")
    r = r.select("query_id", F.col("chunk_id").alias("item_id"), "score", (F.col("page") % 3).alias("arm")).groupBy("query_id", "item_id", "arm").agg(F.max("score").alias("score"))
    return R.quota_split(r, "arm", 4, 3).select("query_id", "arm", "item_id", "rank")


def confidence(spark, d):
    """Confidence of retrieval results against the question's words; linear and logistic."""
    q = table(spark, d, "traces").where("request_id is not null").groupBy(F.col("request_id").alias("query_id")).agg(F.min("request.question").alias("question"))
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.min("content").alias("content"), F.max("score").alias("cos"), F.max(F.size("retriever_sources")).alias("src"))
    long = lambda c: F.filter(X.tokens(F.col(c)), lambda t: F.length(t) >= 3)
    rows = r.join(q, "query_id").select(
        "query_id", "chunk_id", F.round(X.overlap(long("question"), X.tokens(F.coalesce("content", F.lit("")))), 9).alias("lexical_overlap"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("cos", F.lit(0.0)))).alias("dense_cosine"), (F.col("src") > 1).cast("double").alias("agreement"),
    )
    return rows.select("query_id", "chunk_id", F.round("lexical_overlap", 6).alias("lexical_overlap"), R.linear_confidence().alias("linear"), R.linear_confidence({"lexical_overlap": 2.0, "dense_cosine": 1.5, "agreement": 0.5}, -1.0, True).alias("logistic"))


def lexical_rerank(spark, d):
    q = table(spark, d, "traces").where("request_id is not null").groupBy(F.col("request_id").alias("query_id")).agg(F.min("request.question").alias("question"))
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.min("content").alias("content"))
    s = r.join(q, "query_id").select("query_id", F.col("chunk_id").alias("item_id"), F.round(X.overlap(X.tokens(F.col("question")), X.tokens(F.coalesce("content", F.lit("")))), 9).alias("score"))
    return R.top_k(s, 3).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


def hybrid_search(spark, d):
    h = R.hybrid(chunks(spark, d), questions(spark, d))
    return h.select("query_id", "item_id", "rank", F.round("confidence", 4).alias("confidence"), "abstention")


def union_once(spark, d):
    """Order-preserving union of two lists: first place of each item."""
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null")
    a = r.where("rank <= 3").select("query_id", "chunk_id", F.col("rank").alias("pos"))
    b = r.where("score >= 0.4").select("query_id", "chunk_id", (F.col("rank") + 100).alias("pos"))
    return a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))


def both_sets(spark, d):
    e, r = table(spark, d, "evidence_records").select("chunk_id"), table(spark, d, "retrieval_results").select("chunk_id")
    return e.intersect(r)


def only_evidence(spark, d):
    return table(spark, d, "evidence_records").select("chunk_id").where("chunk_id is not null").distinct().join(table(spark, d, "retrieval_results").select("chunk_id").distinct(), "chunk_id", "left_anti")


def set_overlap(spark, d):
    """Share of the question's words found in the answer."""
    q = table(spark, d, "traces").where("request_id is not null").groupBy("request_id").agg(F.min("request.question").alias("q"))
    a = table(spark, d, "saved_answers").where("request_id is not null").groupBy("request_id").agg(F.min("response.answer.answer").alias("a"))
    return q.join(a, "request_id").select("request_id", F.round(X.overlap(X.tokens(F.col("q")), X.tokens(F.coalesce("a", F.lit("")))), 6).alias("overlap"))


QUERIES = {
    "RNK-01": bm25_top, "RNK-02": dense_top, "RNK-03": fused, "RNK-04": body_bm25, "RNK-05": hybrid_search, "RNK-10": lexical_rerank, "AGG-01": term_stats, "MA-04": confidence, "WIN-01": unique_ranks, "WIN-14": margin,
    "TOP-02": capped, "TOP-04": overflow, "TOP-05": quota, "SET-02": union_once, "SET-03": both_sets, "SET-05": only_evidence, "SET-06": set_overlap,
}

_FOLD = f"regexp_replace(translate(x, '{X.ACCENTED}', '{X.BASE}'), '[^ -~]', '', 'g')"


def tokens_sql(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


_NORM = "list_concat(t, list_filter(list_transform(t, lambda x: " + _FOLD + "), lambda y: y <> '' AND NOT list_contains(t, y)))"
_CH = "ch AS (SELECT chunk_id AS item_id, min(content) AS content FROM evidence_records WHERE chunk_id IS NOT NULL GROUP BY 1)"
_QS = "qs AS (SELECT request_id AS query_id, min(request.question) AS question FROM traces WHERE ('0x' || right(request_id, 12))::BIGINT % 50 = 0 GROUP BY 1)"


def _bm25_sql(body: str, k: int) -> str:
    return f"""
WITH {_CH}, {_QS}, tk AS (SELECT item_id, {tokens_sql(body)} AS t FROM ch), nt AS (SELECT item_id, {_NORM} AS t FROM tk),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM nt),
tf AS (SELECT item_id, len(any_value(t)) AS length, term, count(*) AS tf FROM (SELECT item_id, t, unnest(t) AS term FROM nt) GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qk AS (SELECT query_id, {tokens_sql('question')} AS t FROM qs), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_NORM}) AS term FROM qk) GROUP BY ALL),
sc AS (SELECT query_id, item_id, round(sum(qtf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc WHERE score > 0)
SELECT query_id, item_id, rank::INT AS rank, round(score, 5) AS score FROM rk WHERE rank <= {k}"""


_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _dense_sql(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id::VARCHAR AS item_id, round(list_dot_product(({a})::DOUBLE[], ({b})::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0))"


_LISTS = "WITH " + _dense_sql("d1", "q.embedding", "v.embedding") + ", " + _dense_sql("d2", "q.embedding[1:32]", "v.embedding[1:32]") + """, f AS (
SELECT query_id, item_id, round(sum(w / (60.0::DOUBLE + rank)), 9) AS score, string_agg(s, ',' ORDER BY s) AS sources FROM (
  SELECT query_id, item_id, rank, 1.2::DOUBLE AS w, 'dense' AS s FROM d1 WHERE rank <= 40 UNION ALL SELECT query_id, item_id, rank, 1.0::DOUBLE, 'half' FROM d2 WHERE rank <= 40) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS nxt FROM f) """

_RES = "SELECT query_id, chunk_id AS item_id, max(score) AS score FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2"
_OVER = "(len(list_intersect(list_distinct({a}), {b})) / greatest(1, len(list_distinct({a})))::DOUBLE)"
_QT = "q AS (SELECT request_id AS query_id, min(request.question) AS question FROM traces WHERE request_id IS NOT NULL GROUP BY 1)"
_A3 = "list_filter(" + tokens_sql("question") + ", lambda x: length(x) >= 3)"
_TC = tokens_sql("coalesce(content, '')")

ORACLES = {
    "RNK-01": _bm25_sql("content", 10),
    "RNK-04": _bm25_sql("regexp_replace(content, '^[^\\n]*\\n', '')", 5),
    "RNK-02": "WITH " + _dense_sql("d1", "q.embedding", "v.embedding") + " SELECT query_id, item_id, rank::INT AS rank, round(score, 6) AS score FROM d1 WHERE rank <= 10",
    "RNK-03": _LISTS + "SELECT query_id, item_id, rank::INT AS rank, score, sources FROM r WHERE rank <= 10",
    "WIN-14": _LISTS + "SELECT query_id, item_id, round(score - coalesce(nxt, 0), 9) AS margin FROM r WHERE rank = 1",
    "AGG-01": f"WITH {_CH}, tk AS (SELECT item_id, {tokens_sql('content')} AS t FROM ch), x AS (SELECT item_id, unnest({_NORM}) AS term FROM tk) SELECT term, count(DISTINCT item_id) AS df, count(*) AS cf FROM x GROUP BY term",
    "WIN-01": f"SELECT query_id, item_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM ({_RES})",
    "TOP-02": f"SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM ({_RES})) WHERE rank <= 3",
    "TOP-04": "WITH r AS (SELECT DISTINCT query_id, chunk_id FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL) SELECT query_id, chunk_id FROM r WHERE query_id IN (SELECT query_id FROM r GROUP BY 1 HAVING count(*) <= 4)",
    "TOP-05": "WITH r AS (SELECT query_id, chunk_id AS item_id, page % 3 AS arm, max(score) AS score FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND page IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, item_id)::INT AS rank FROM r) SELECT query_id, arm, item_id, rank FROM n WHERE rank <= 1 + (arm < 1)::INT",
    "MA-04": f"""WITH {_QT}, r AS (SELECT query_id, chunk_id, min(content) AS content, max(score) AS cos, max(len(retriever_sources)) AS src FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT query_id, chunk_id, round({_OVER.format(a=_A3, b=_TC)}, 9) AS lo, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(cos, 0))) AS dc, (src > 1)::DOUBLE AS ag FROM r JOIN q USING (query_id))
SELECT query_id, chunk_id, round(lo, 6) AS lexical_overlap, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.55::DOUBLE * lo + 0.35::DOUBLE * dc + 0.1::DOUBLE * ag)), 6) AS linear, round(1 / (1 + exp(-(-1.0::DOUBLE + 2.0::DOUBLE * lo + 1.5::DOUBLE * dc + 0.5::DOUBLE * ag))), 6) AS logistic FROM f""",
    "RNK-10": f"""WITH {_QT}, r AS (SELECT query_id, chunk_id, min(content) AS content FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT query_id, chunk_id AS item_id, round({_OVER.format(a=tokens_sql('question'), b=_TC)}, 9) AS score FROM r JOIN q USING (query_id)), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s)
SELECT query_id, item_id, rank, round(score, 6) AS score FROM n WHERE rank <= 3""",
    "SET-02": "WITH r AS (SELECT * FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL) SELECT query_id, chunk_id, min(pos)::INT AS pos FROM (SELECT query_id, chunk_id, rank AS pos FROM r WHERE rank <= 3 UNION ALL SELECT query_id, chunk_id, rank + 100 FROM r WHERE score >= 0.4::DOUBLE) GROUP BY 1, 2",
    "SET-03": "SELECT chunk_id FROM evidence_records INTERSECT SELECT chunk_id FROM retrieval_results",
    "SET-05": "SELECT chunk_id FROM evidence_records WHERE chunk_id IS NOT NULL EXCEPT SELECT chunk_id FROM retrieval_results",
    "SET-06": f"WITH q AS (SELECT request_id, min(request.question) AS q FROM traces WHERE request_id IS NOT NULL GROUP BY 1), a AS (SELECT request_id, min(response.answer.answer) AS a FROM saved_answers WHERE request_id IS NOT NULL GROUP BY 1) SELECT request_id, round({_OVER.format(a=tokens_sql('q'), b=tokens_sql(chr(99) + 'oalesce(a, ' + chr(39) * 2 + ')'))}, 6) AS overlap FROM q JOIN a USING (request_id)",
}

"""Queries that read requests, re-sort results and pick excerpts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.functions import requests as Q
from gneiss.functions import text as X
from gneiss.operators.ranking import exact_route
from gneiss.operators.tables import year_binding
from gneiss.queries.aggregates import fold_sql
from gneiss.queries.ranking import tokens_sql
from gneiss.runtime import table


def _q(spark, d):
    return table(spark, d, "traces").where("request_id is not null").groupBy("request_id").agg(F.min("request.question").alias("q"), F.max(F.size("request.doc_ids")).alias("docs"))


def _r(spark, d):
    return table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id", "doc_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.min("content").alias("content"), F.min("content_type").alias("content_type"), F.min("page").alias("page"))


def routes(spark, d):
    return _q(spark, d).select("request_id", Q.route(F.col("q"), F.col("docs") > 1).alias("route"))


def intents(spark, d):
    return _q(spark, d).select("request_id", Q.temporal_intent(F.col("q")).alias("intent"))


def version_keys(spark, d):
    return table(spark, d, "evidence_records").where("document_version is not null").select(Q.version_key(F.col("document_version")).alias("version")).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def question_keys(spark, d):
    """Questions that several traces ask."""
    return _q(spark, d).groupBy(Q.question_key(F.col("q")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fingerprints(spark, d):
    r = table(spark, d, "results").where("run_id is not null and case_id is not null")
    return r.select(Q.request_fingerprint(F.col("run_id"), F.col("case_id"), F.col("status"), F.col("final_answer")).alias("fingerprint")).distinct()


def batch_sizes(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("done"), F.round(F.sum("value"), 4).alias("elapsed"))
    return e.select("user_id", Q.batch_size(F.col("done"), F.col("elapsed"), 600.0, 40).alias("batch"))


def initialisms(spark, d):
    """Initialisms that a single institution's name has."""
    n = table(spark, d, "documents").where("institution is not null").select("institution", Q.initialism(F.col("institution")).alias("short")).where("short is not null").distinct()
    return n.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("short"))).where("k = 1").select("short", "institution")


def global_rerank(spark, d):
    """Results of a query over all documents in one order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return _r(spark, d).select("query_id", "chunk_id", F.row_number().over(w).alias("rank"))


def priority(spark, d):
    """Tables first, then early pages, then by score."""
    w = Window.partitionBy("query_id").orderBy((F.col("content_type") != "table").cast("int"), (F.col("page") > 10).cast("int"), F.desc("score"), "chunk_id")
    return _r(spark, d).where("content_type is not null and page is not null").select("query_id", "chunk_id", F.row_number().over(w).alias("place"))


def per_document(spark, d):
    """Two best results of each document of a query."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id")
    return _r(spark, d).where("doc_id is not null").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("query_id", "doc_id", "chunk_id", "rank")


def retriever_lists(spark, d):
    """The lists of all retrievers as rows."""
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null and retriever_ranks is not null")
    return r.select("query_id", "chunk_id", F.explode("retriever_ranks").alias("retriever", "rank")).distinct()


def excerpts(spark, d):
    """Sentence of each result that holds most of the question's words; the earlier of equals."""
    q = table(spark, d, "traces").where("request_id is not null").groupBy(F.col("request_id").alias("query_id")).agg(F.min("request.question").alias("q"))
    r = _r(spark, d).select("query_id", "chunk_id", F.posexplode_outer(X.sentences(F.col("content"))).alias("pos", "sentence")).where("sentence is not null").join(q, "query_id")
    s = r.withColumn("score", F.round(X.overlap(X.tokens(F.coalesce("q", F.lit(""))), X.tokens(F.col("sentence"))), 6))
    w = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "pos")
    return s.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "chunk_id", "pos", "score")


def exact_code(spark, d):
    """Route of every question by its codes over the whole evidence."""
    q = _q(spark, d).select(F.col("request_id").alias("query_id"), F.col("q").alias("question"))
    e = table(spark, d, "evidence_records").where("chunk_id is not null").select(F.col("chunk_id").alias("item_id"), "doc_id", "content")
    return exact_route(e, q, 5)[0]


def linked_rows(spark, d):
    """Table chunks and text chunks of one document that mention the same code."""
    e = table(spark, d, "evidence_records").where("doc_id is not null and chunk_id is not null").groupBy("chunk_id", "doc_id", "content_type").agg(F.min("content").alias("content"))
    c = e.select("chunk_id", "doc_id", "content_type", F.explode_outer(X.detected_codes(F.col("content"))).alias("code")).where("code is not null")
    a = c.where("content_type = 'table'").select("doc_id", "code", F.col("chunk_id").alias("table_chunk"))
    b = c.where("content_type = 'text'").select("doc_id", "code", F.col("chunk_id").alias("text_chunk"))
    return a.join(b, ["doc_id", "code"]).select("doc_id", "code", "table_chunk", "text_chunk").distinct()


def year_cells(spark, d):
    """Yearly totals of nations, claimed from the finished orders, against the cells of three tables,
    one an order status: the claim is bound only where all tables have one value for it."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    cells = o.groupBy("o_orderstatus", "n_name", F.concat(F.lit("FY "), F.year("o_orderdate").cast("string")).alias("header")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    asked = o.where("o_orderstatus = 'F'").groupBy(F.upper("n_name").alias("label"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return year_binding(cells, "n_name", "header", "value", asked).select("label", "year", "status")


QUERIES = {
    "RNK-07": routes, "DT-03": intents, "FN-15": version_keys, "SNK-09": question_keys, "FN-27": fingerprints, "MA-16": batch_sizes, "FN-07": initialisms, "WIN-02": global_rerank, "TOP-03": priority, "TOP-06": per_document, "SET-01": retriever_lists, "FN-14": excerpts, "RNK-06": exact_code, "JN-04": linked_rows, "LK-18": year_cells,
}

_Q = "q AS (SELECT request_id, min(request.question) AS q, max(len(request.doc_ids)) AS docs FROM traces WHERE request_id IS NOT NULL GROUP BY 1)"
_R = "r AS (SELECT query_id, chunk_id, doc_id, max(coalesce(score, 0)) AS score, min(content) AS content, min(content_type) AS content_type, min(page) AS page FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3)"
_F = fold_sql("coalesce(q, '')")
_SENT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '')"
_QT, _ST = tokens_sql("coalesce(q, '')"), tokens_sql("sentence")

ORACLES = {
    "RNK-07": f"WITH {_Q} SELECT request_id, CASE WHEN regexp_matches(regexp_replace(coalesce(q, ''), '[\\x{{C0}}-\\x{{1FFF}}\\x{{FF10}}-\\x{{FF5A}}]', '_', 'g'), '{X.CODE}') THEN 'exact_code' WHEN docs > 1 THEN 'filtered_hybrid_rrf' ELSE 'hybrid_rrf' END AS route FROM q",
    "DT-03": f"WITH {_Q}, f AS (SELECT request_id, {_F} AS f FROM q) SELECT request_id, CASE WHEN len(list_distinct(regexp_extract_all(f, '\\b(?:19|20)\\d{{2}}\\b'))) >= 2 AND regexp_matches(f, '\\b(?:compare|difference|so sanh|khac nhau|comparer)\\b') THEN 'compare' WHEN regexp_matches(f, '\\b(?:class of|cohort|khoa|academic year|nam hoc|promotion) (?:19|20)\\d{{2}}\\b') THEN 'explicit_period' WHEN regexp_matches(f, '\\b(?:as of|on|from|tinh den|ngay) \\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}') THEN 'as_of' WHEN regexp_matches(f, '\\b(?:latest|newest|current|currently|moi nhat|hien hanh|actuel|actuelle)\\b') THEN 'latest' ELSE 'none' END AS intent FROM f",
    "FN-15": f"SELECT regexp_replace({fold_sql('document_version')}, '[^a-z0-9]', '', 'g') AS version, count(*) AS n FROM evidence_records WHERE document_version IS NOT NULL GROUP BY 1",
    "SNK-09": f"WITH {_Q} SELECT sha256(trim(regexp_replace(lower(coalesce(q, '')), '\\s+', ' ', 'g'))) AS key, count(*) AS n FROM q GROUP BY 1 HAVING count(*) > 1",
    "FN-27": "SELECT DISTINCT sha256(concat_ws(chr(31), run_id, case_id, coalesce(status, chr(0)), coalesce(final_answer, chr(0)))) AS fingerprint FROM results WHERE run_id IS NOT NULL AND case_id IS NOT NULL",
    "MA-16": "WITH e AS (SELECT user_id, count(*) AS done, round(sum(value), 4) AS elapsed FROM events GROUP BY 1) SELECT user_id, CASE WHEN elapsed > 0 THEN greatest(1, least(40, floor(600.0::DOUBLE * done / elapsed))) ELSE 1 END::INT AS batch FROM e",
    "FN-07": "WITH n AS (SELECT DISTINCT institution, list_filter(regexp_split_to_array(trim(institution), '\\s+'), lambda x: regexp_matches(x, '^\\p{L}')) AS w FROM documents WHERE institution IS NOT NULL), s AS (SELECT institution, upper(array_to_string(list_transform(w, lambda x: x[1:1]), '')) AS short FROM n WHERE len(w) BETWEEN 3 AND 6) SELECT short, institution FROM s QUALIFY count(*) OVER (PARTITION BY short) = 1",
    "WIN-02": f"WITH {_R} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM r",
    "TOP-03": f"WITH {_R} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY (content_type <> 'table')::INT, (page > 10)::INT, score DESC, chunk_id)::INT AS place FROM r WHERE content_type IS NOT NULL AND page IS NOT NULL",
    "TOP-06": f"WITH {_R} SELECT query_id, doc_id, chunk_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id)::INT AS rank FROM r WHERE doc_id IS NOT NULL QUALIFY rank <= 2",
    "SET-01": "SELECT DISTINCT query_id, chunk_id, unnest(map_keys(retriever_ranks)) AS retriever, unnest(map_values(retriever_ranks)) AS rank FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND retriever_ranks IS NOT NULL",
    "FN-14": f"WITH {_R}, q AS (SELECT request_id AS query_id, min(request.question) AS q FROM traces WHERE request_id IS NOT NULL GROUP BY 1), x AS (SELECT query_id, chunk_id, {_SENT} AS s FROM r), y AS (SELECT query_id, chunk_id, unnest(generate_series(0, len(s) - 1)) AS pos, unnest(s) AS sentence FROM x), z AS (SELECT query_id, chunk_id, pos, round(len(list_intersect(list_distinct({_QT}), {_ST})) / greatest(1, len(list_distinct({_QT})))::DOUBLE, 6) AS score FROM y JOIN q USING (query_id)) SELECT query_id, chunk_id, pos::INT AS pos, score FROM z QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, pos) = 1",
    "RNK-06": f"WITH {_Q}, a AS (SELECT DISTINCT request_id AS query_id, upper(unnest(regexp_extract_all(regexp_replace(coalesce(q, ''), '[\\x{{C0}}-\\x{{1FFF}}\\x{{FF10}}-\\x{{FF5A}}]', '_', 'g'), '{X.CODE}'))) AS code FROM q), h AS (SELECT DISTINCT chunk_id, doc_id, upper(unnest(regexp_extract_all(regexp_replace(coalesce(content, ''), '[\\x{{C0}}-\\x{{1FFF}}\\x{{FF10}}-\\x{{FF5A}}]', '_', 'g'), '{X.CODE}'))) AS code FROM evidence_records WHERE chunk_id IS NOT NULL), f AS (SELECT query_id, count(DISTINCT chunk_id) AS candidates, count(DISTINCT doc_id) AS documents FROM a JOIN h USING (code) GROUP BY 1), n AS (SELECT request_id AS query_id, count(code) AS codes FROM q LEFT JOIN a ON a.query_id = q.request_id GROUP BY 1) SELECT query_id, codes, coalesce(candidates, 0) AS candidates, coalesce(documents, 0) AS documents, CASE WHEN codes = 0 THEN 'hybrid_rrf' WHEN candidates IS NULL THEN 'no_candidate' WHEN codes = 1 AND documents = 1 AND candidates <= 5 THEN 'exact_code' ELSE 'ambiguous' END AS route FROM n LEFT JOIN f USING (query_id)",
    "JN-04": f"WITH e AS (SELECT chunk_id, doc_id, content_type, min(content) AS content FROM evidence_records WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT DISTINCT chunk_id, doc_id, content_type, upper(unnest(regexp_extract_all(content, '{X.CODE}'))) AS code FROM e) SELECT DISTINCT a.doc_id, a.code, a.chunk_id AS table_chunk, b.chunk_id AS text_chunk FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.code = b.code AND a.content_type = 'table' AND b.content_type = 'text'",
    "LK-18": "WITH o AS (SELECT o_orderstatus, n_name, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), k AS (SELECT n_name, y, count(DISTINCT v) AS n, min(v) AS v FROM o GROUP BY 1, 2) SELECT o.n_name AS label, o.y::INT AS year, CASE WHEN n > 1 THEN 'ambiguous' WHEN k.v = o.v THEN 'bound' ELSE 'different' END AS status FROM o JOIN k ON o.n_name = k.n_name AND o.y = k.y WHERE o_orderstatus = 'F'",
}

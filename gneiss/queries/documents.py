"""Queries of tables in text, claims and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import tables as T
from gneiss.operators import verify as V
from gneiss.queries.aggregates import fold_sql
from gneiss.runtime import table


def _chunks(spark, d):
    return table(spark, d, "evidence_records").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("content").alias("content"))


# Headers of course tables in folded form.
ROLES = {"code": ["code", "ma"], "credits": ["credits", "credit", "tin chi"]}


def text_tables(spark, d):
    t = T.table_rows(_chunks(spark, d), "chunk_id", "content")
    return t.select("chunk_id", "row", F.size("cells").alias("width"), F.array_join("cells", "|", "").alias("cells"))


def course_credits(spark, d):
    r = T.role_rows(T.table_rows(_chunks(spark, d), "chunk_id", "content"), "chunk_id", ROLES)
    return T.proven_values(r, ["code"], "credits").select("code", F.col("value").alias("credits"))


def credit_sums(spark, d):
    """Sum of the credits of each table; none where a cell can't be read."""
    r = T.role_rows(T.table_rows(_chunks(spark, d), "chunk_id", "content"), "chunk_id", ROLES).withColumn("v", X.normalize_number(F.col("credits")))
    return r.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("courses"), F.when(F.count("v") == F.count(F.lit(1)), F.sum("v")).alias("credits"))


def json_tables(spark, d):
    """Tables written as JSON behind a text and read back."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.array(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.col("p_size").cast("string")))).alias("rows"))
    c = p.select("p_brand", F.concat(F.lit("Parts of the brand\n"), F.to_json(F.struct(F.array(F.lit("key"), F.lit("size")).alias("headers"), "rows"))).alias("content"))
    t = c.select("p_brand", T.json_table(F.col("content")).alias("t"))
    return t.select("p_brand", F.size("t.rows").alias("n"), F.aggregate("t.rows", F.lit(0).cast("bigint"), lambda s, r: s + r[1].cast("bigint")).alias("size"))


def ratios(spark, d):
    y = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice").where("y in (1995, 1996)").groupBy("o_custkey", "y").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return T.ratio(y, ["o_custkey"], "y", "v").select("o_custkey", F.round("ratio", 6).alias("ratio"))


def batches(spark, d):
    """Lines of the chunks packed into batches of 600 characters."""
    from gneiss.operators.windows import lines_of

    l = lines_of(_chunks(spark, d), "chunk_id", "content").withColumn("pos", F.col("pos").cast("long"))
    return T.row_batches(l, ["chunk_id"], "pos", "line", 600).groupBy("chunk_id", "batch").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


def _claims(spark, d):
    a = table(spark, d, "saved_answers").where("request_id is not null").select("request_id", F.posexplode_outer("response.answer.claims").alias("i", "c")).where("c.text is not null")
    return a.groupBy(F.concat_ws("-", "request_id", "i").alias("claim_id"), F.col("request_id").alias("scope")).agg(F.min("c.text").alias("text"), F.min_by("c.citation_ids", "c.text").alias("citation_ids"))


def _evidence(spark, d):
    return table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null").groupBy(F.col("query_id").alias("scope"), F.col("chunk_id").alias("item_id")).agg(F.min("content").alias("content"))


def cited_chunks(spark, d):
    """Chunks that the claims' short citation names stand for, by the rank of the request's results."""
    r = table(spark, d, "retrieval_results").where("query_id is not null").select(F.col("query_id").alias("scope"), F.col("chunk_id").alias("item_id"), F.coalesce("rank", F.lit(1_000_000)).alias("rank"))
    known = V.handles(r, "scope", "item_id", [F.col("rank")], "L")
    cited = _claims(spark, d).select("claim_id", "scope", F.explode_outer(F.array_distinct("citation_ids")).alias("handle")).where("handle is not null")
    return V.restore_handles(cited, known, "scope", "handle", "item_id").select("claim_id", "handle", "item_id", "error")


def claim_markers(spark, d):
    return _claims(spark, d).select("claim_id", F.array_join(F.array_sort(V.markers(F.col("text"))), ",").alias("markers"))


def aligned(spark, d):
    return V.align(_claims(spark, d), _evidence(spark, d)).select("claim_id", "best", "status", "evidence")


def decisions(spark, d):
    a = V.align(_claims(spark, d), _evidence(spark, d))
    f = table(spark, d, "saved_answers").where("request_id is not null").groupBy(F.col("request_id").alias("scope")).agg(
        F.max(F.coalesce(F.col("http_status") != 200, F.lit(True))).alias("provider_error"), F.lit(False).alias("invalid_citation"), F.lit(False).alias("has_conflict"), F.lit(False).alias("ambiguous"),
        F.max(F.coalesce("response.answer.abstained", F.lit(False))).alias("provider_abstained"),
    )
    return V.decide(a, f)


def reasons(spark, d):
    """Internal abstention reasons of the saved answers, mapped to public ones."""
    # Public reason of each internal one.
    public = {"no_evidence_found": "insufficient_evidence", "no_candidate": "insufficient_evidence", "below_score_threshold": "insufficient_evidence", "provider_error": "provider_error", "ambiguous_question": "ambiguous_question"}
    m = F.create_map(*[F.lit(x) for kv in public.items() for x in kv])
    r = F.col("response.answer.abstention_reason")
    a = table(spark, d, "saved_answers").where(r.isNotNull())
    return a.groupBy(F.coalesce(F.try_element_at(m, r), F.lit("unsupported_claim")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def contract(spark, d):
    """Errors of the saved answers against the public contract: an answer needs text, a claim
    and a citation, an abstention a reason and none of these."""
    a = table(spark, d, "saved_answers").where("request_id is not null").groupBy("request_id").agg(F.max_by(F.struct("response"), F.struct("saved_at", F.xxhash64("response"))).alias("r")).select("request_id", F.col("r.response.answer").alias("a"))
    ab = F.coalesce("a.abstained", F.lit(False))
    has = F.col("a").isNotNull()
    e = F.array_compact(F.array(
        F.when(~has, "no_answer"), F.when(has & F.col("a.schema_version").isNull(), "no_schema_version"), F.when(has & ~ab & (X.strip(F.coalesce("a.answer", F.lit(""))) == ""), "empty_answer"), F.when(has & ~ab & (F.coalesce(F.size("a.claims"), F.lit(0)) == 0), "no_claim"),
        F.when(has & ~ab & (F.coalesce(F.size("a.citations"), F.lit(0)) == 0), "no_citation"), F.when(has & ab & F.col("a.abstention_reason").isNull(), "no_reason"),
    ))
    return a.select("request_id", F.array_join(e, ",").alias("errors"))


QUERIES = {"TBX-02": text_tables, "JS-02": course_credits, "LK-11": credit_sums, "JS-01": json_tables, "MA-10": ratios, "JS-04": batches, "VF-08": cited_chunks, "VF-14": claim_markers, "VF-01": aligned, "VF-02": decisions, "VF-10": reasons, "JS-08": contract}

_L = "c AS (SELECT chunk_id, min(content) AS content FROM evidence_records WHERE chunk_id IS NOT NULL GROUP BY 1), x AS (SELECT chunk_id, regexp_split_to_array(content, '[\\n\\f]') AS a FROM c), l AS (SELECT chunk_id, unnest(generate_series(0, len(a) - 1)) AS pos, unnest(a) AS line FROM x)"
_T = _L + ", p AS (SELECT chunk_id, pos, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda y: trim(y)) AS cells FROM l WHERE contains(line, '|')), q AS (SELECT *, pos - row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS t FROM p WHERE len(cells) >= 2), r AS (SELECT *, count(*) OVER (PARTITION BY chunk_id, t) AS n, max(len(cells)) OVER (PARTITION BY chunk_id, t) AS w, row_number() OVER (PARTITION BY chunk_id, t ORDER BY pos) - 1 AS row FROM q), tb AS (SELECT * FROM r WHERE n >= 2)"
_H = ", h AS (SELECT chunk_id, t, list_transform(cells, lambda y: " + fold_sql("y") + ") AS h FROM tb WHERE row = 0), b AS (SELECT tb.chunk_id, tb.t, tb.row, tb.cells[list_position(list_transform(h, lambda y: y IN ('code', 'ma')), true)] AS code, tb.cells[list_position(list_transform(h, lambda y: y IN ('credits', 'credit', 'tin chi')), true)] AS credits FROM tb JOIN h USING (chunk_id, t) WHERE tb.row > 0 AND len(list_filter(h, lambda y: y IN ('code', 'ma'))) = 1 AND len(list_filter(h, lambda y: y IN ('credits', 'credit', 'tin chi'))) = 1), v AS (SELECT *, try_cast(credits AS DOUBLE) AS v FROM b)"

ORACLES = {
    "TBX-02": f"WITH {_T} SELECT chunk_id, row::INT AS row, w::INT AS width, array_to_string(list_transform(cells, lambda y: y), '|') || repeat('|', (w - len(cells))::INT) AS cells FROM tb",
    "JS-02": f"WITH {_T}{_H} SELECT code, CASE WHEN min(v) = max(v) AND count(v) = count(*) THEN min(v) END AS credits FROM v GROUP BY 1",
    "LK-11": f"WITH {_T}{_H} SELECT chunk_id, count(*) AS courses, CASE WHEN count(v) = count(*) THEN sum(v) END AS credits FROM v GROUP BY 1",
    "JS-01": "SELECT p_brand, count(*)::INT AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1",
    "MA-10": "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY 1, 2) SELECT a.o_custkey, round(b.v / a.v, 6) AS ratio FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.y = 1995 AND b.y = 1996 WHERE a.v <> 0",
    "JS-08": """WITH l AS (SELECT request_id, response, row_number() OVER (PARTITION BY request_id ORDER BY saved_at DESC) AS n FROM saved_answers WHERE request_id IS NOT NULL), a AS (SELECT request_id, response.answer AS a, coalesce(response.answer.abstained, false) AS ab FROM l WHERE n = 1)
SELECT request_id, concat_ws(',', CASE WHEN a IS NULL THEN 'no_answer' END, CASE WHEN a IS NOT NULL AND a.schema_version IS NULL THEN 'no_schema_version' END, CASE WHEN a IS NOT NULL AND NOT ab AND regexp_full_match(coalesce(a.answer, ''), '[\\s\\p{Z}]*') THEN 'empty_answer' END, CASE WHEN a IS NOT NULL AND NOT ab AND coalesce(len(a.claims), 0) = 0 THEN 'no_claim' END,
  CASE WHEN a IS NOT NULL AND NOT ab AND coalesce(len(a.citations), 0) = 0 THEN 'no_citation' END, CASE WHEN a IS NOT NULL AND ab AND a.abstention_reason IS NULL THEN 'no_reason' END) AS errors FROM a""",
    "VF-08": "WITH c AS (SELECT request_id, unnest(response.answer.claims) AS c, unnest(generate_series(0, len(response.answer.claims) - 1)) AS i FROM saved_answers WHERE request_id IS NOT NULL), m AS (SELECT request_id, request_id || '-' || i AS claim_id, arg_min(c.citation_ids, c.text) AS ids FROM c WHERE c.text IS NOT NULL GROUP BY 1, 2), u AS (SELECT DISTINCT request_id, claim_id, unnest(ids) AS handle FROM m), f AS (SELECT query_id, chunk_id, min(coalesce(rank, 1000000)) AS o FROM retrieval_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2), h AS (SELECT query_id, chunk_id, 'L' || row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) AS handle FROM f) SELECT claim_id, u.handle, chunk_id AS item_id, CASE WHEN chunk_id IS NULL THEN 'unknown_handle' END AS error FROM u LEFT JOIN h ON h.query_id = u.request_id AND h.handle = u.handle WHERE u.handle IS NOT NULL",
    "VF-10": "SELECT CASE response.answer.abstention_reason WHEN 'no_evidence_found' THEN 'insufficient_evidence' WHEN 'no_candidate' THEN 'insufficient_evidence' WHEN 'below_score_threshold' THEN 'insufficient_evidence' WHEN 'provider_error' THEN 'provider_error' WHEN 'ambiguous_question' THEN 'ambiguous_question' ELSE 'unsupported_claim' END AS reason, count(*) AS n FROM saved_answers WHERE response.answer.abstention_reason IS NOT NULL GROUP BY 1",
}

"""Queries of joins, relations and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import joins as J
from gneiss.operators.hierarchy import canonical_code
from gneiss.runtime import table


def _bands(spark):
    return spark.range(24).select(F.concat(F.lit("band"), F.col("id").cast("string")).alias("band"), (F.col("id") * 25000.0).alias("lo"), (F.col("id") * 25000.0 + 24999.995).alias("hi"))


def in_band(spark, d):
    """Price band of each order, where exactly one band holds it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return J.unique_match(J.interval_join(o, _bands(spark), "o_totalprice", "lo", "hi", 25000.0), ["o_orderkey"]).select("o_orderkey", "band")


def in_pages(spark, d):
    """Retrieved chunks whose page lies in the page range of an evidence row of its document."""
    e = table(spark, d, "evidence_records").where("doc_id is not null and size(page_range) > 0").select(F.col("doc_id").alias("doc"), F.array_min("page_range").alias("lo"), F.array_max("page_range").alias("hi")).distinct()
    r = table(spark, d, "retrieval_results").where("doc_id is not null and page is not null").select("chunk_id", "doc_id", "page").distinct()
    hit = J.interval_join(r, e, "page", "lo", "hi", 4.0).where("doc_id = doc")
    return hit.groupBy("chunk_id", "doc_id", "page").agg(F.count(F.lit(1)).alias("ranges"))


def cohort(spark, d):
    """Suppliers by the parts' size range that covers their nation key, open ends included."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.when(F.max("p_size") < 50, F.max("p_size")).alias("hi")).withColumn("hi", F.coalesce("hi", F.lit(9999)))
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 2).alias("v"))
    return J.interval_join(s, p, "v", "lo", "hi", 100.0).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("brands"), F.min("p_brand").alias("first_brand"))


def asof_order(spark, d):
    """For every event the latest order of the customer with the event's user id."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return J.asof_join(e, o, "user_id", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", F.col("asof_o_orderkey").alias("order_key"))


def heading_scope(spark, d):
    """For every chunk the nearest chunk of its document, on the same page or before, that opens
    a section."""
    e = table(spark, d, "evidence_records").where("doc_id is not null and chunk_id is not null and page is not null").groupBy("chunk_id", "doc_id").agg(F.min("page").alias("page"), F.min("content").alias("content"))
    heads = e.where(F.col("content").rlike(r"^\d+(\.\d+)*\.? \p{Lu}")).groupBy("doc_id", "page").agg(F.max("chunk_id").alias("head"))
    return J.asof_join(e.select("chunk_id", "doc_id", "page"), heads, "doc_id", "page", "page", ["head"]).select("chunk_id", F.col("asof_head").alias("head"))


def _versions(spark, d):
    """Orders of a customer as versions: each is effective until the next one of another day."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("start")).agg(F.max("o_orderkey").alias("version"))
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("start")
    return o.withColumn("end", F.lead("start").over(w)).withColumn("replaces", F.array_compact(F.array(F.lag("version").over(w))))


_AT = "1997-06-15"


def effective(spark, d):
    return J.effective_at(_versions(spark, d), "start", "end", F.lit(_AT).cast("date")).select("o_custkey", "version", "start", "end")


def not_superseded(spark, d):
    return J.without_superseded(_versions(spark, d).where(F.col("start") <= F.lit(_AT).cast("date")), "version", "replaces").select("o_custkey", "version")


def resolve_version(spark, d):
    """Status of the version question for each customer at a date, in a fixed order of checks."""
    v = _versions(spark, d)
    all_of = v.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    ok = J.effective_at(v, "start", "end", F.lit(_AT).cast("date")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.min("version").alias("version"))
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(all_of, "o_custkey", "left").join(ok, "o_custkey", "left")
    status = F.when(F.col("n").isNull(), "insufficient_evidence").when(F.col("k").isNull(), "no_effective_version").when(F.col("k") > 1, "conflict").otherwise("resolved")
    return x.select(F.col("o_custkey").alias("c_custkey"), status.alias("status"), F.when(status == "resolved", F.col("version")).alias("version"))


def hydrated(spark, d):
    ids = table(spark, d, "retrieval_results").where("chunk_id is not null").select("chunk_id").distinct()
    return J.hydrate(ids, table(spark, d, "evidence_records"), "chunk_id", ["doc_id", "source_name"])


def neighbours(spark, d):
    """Previous and next chunk of each chunk on its document's pages."""
    from pyspark.sql import Window

    e = table(spark, d, "evidence_records").where("doc_id is not null and chunk_id is not null and page is not null").groupBy("doc_id", "chunk_id").agg(F.min("page").alias("page"))
    w = Window.partitionBy("doc_id").orderBy("page", "chunk_id")
    return e.select("chunk_id", F.lag("chunk_id").over(w).alias("before"), F.lead("chunk_id").over(w).alias("after"))


def proofs(spark, d):
    """Retrieved chunks whose whole text and page the evidence row of the same id bears out."""
    e = table(spark, d, "evidence_records").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("content").alias("body"), F.min("page").alias("p"))
    r = table(spark, d, "retrieval_results").where("chunk_id is not null and content is not null").select("chunk_id", "page", F.col("content").alias("quote")).distinct()
    return r.join(e, "chunk_id").where(F.col("body").contains(F.col("quote")) & (F.col("p") == F.col("page"))).select("chunk_id", "page").distinct()


def citations(spark, d):
    """Errors of every retrieved row taken as a citation: unknown chunk, other document, page
    out of range, quote not in the text. The quote is the whole text of the row."""
    e = table(spark, d, "evidence_records").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("doc_id").alias("d"), F.min("content").alias("body"), F.min("page").alias("p"))
    r = table(spark, d, "retrieval_results").select("query_id", "chunk_id", "doc_id", "page", F.col("content").alias("quote")).distinct()
    j = r.join(e, "chunk_id", "left")
    known = F.col("d").isNotNull()
    errors = F.array_compact(F.array(F.when(~known, "unknown_chunk"), F.when(known & ~F.col("d").eqNullSafe(F.col("doc_id")), "other_document"), F.when(known & ~F.col("p").eqNullSafe(F.col("page")), "other_page"), F.when(known & ~F.coalesce(F.col("body").contains(F.col("quote")), F.lit(False)), "quote_not_found")))
    return j.select("query_id", "chunk_id", "page", F.array_join(errors, ",").alias("errors"))


def predictions(spark, d):
    """Saved answers beside result rows by case, with which side is missing."""
    a = table(spark, d, "saved_answers").where("case_id is not null").groupBy("case_id").agg(F.count(F.lit(1)).alias("answers"))
    r = table(spark, d, "results").where("case_id is not null").groupBy("case_id").agg(F.count(F.lit(1)).alias("results"))
    return a.join(r, "case_id", "full_outer").select("case_id", F.coalesce("answers", F.lit(0)).alias("answers"), F.coalesce("results", F.lit(0)).alias("results"))


def spans(spark, d):
    """Longest numbers in the questions, each where it stands: digit runs and codes, without those
    inside longer ones."""
    q = table(spark, d, "traces").where("request_id is not null").groupBy("request_id").agg(F.min("request.question").alias("q"))
    digits, codes = (J.mentions(q, "request_id", "q", p) for p in ("[0-9]+", "[A-Z]{4}[0-9]{4}"))
    return J.maximal_spans(digits.unionByName(codes), "request_id", "begin", "end").select("request_id", F.col("begin").alias("b"), F.col("end").alias("e"), F.col("word").alias("w"))


def _edges(spark, d):
    return table(spark, d, "edges").where("doc is not null").select("doc", canonical_code(F.col("dependent")).alias("dependent"), canonical_code(F.col("prerequisite")).alias("prerequisite"))


def direct(spark, d):
    e = _edges(spark, d)
    return J.relation_lookup(e, e.select("doc", F.col("dependent").alias("code")), "direct")


def chain(spark, d):
    e = _edges(spark, d)
    return J.relation_lookup(e, e.select("doc", F.col("dependent").alias("code")), "chain2")


def inverse(spark, d):
    """All dependents of each code; codes whose rows leave the prerequisite open are blocked."""
    e = _edges(spark, d)
    blocked = e.where("prerequisite is null and dependent is not null").select("doc", F.col("dependent").alias("code")).distinct()
    return J.relation_lookup(e, e.select("doc", F.col("prerequisite").alias("code")).where("code is not null"), "inverse", blocked=blocked)


def owners(spark, d):
    """Documents that mention every code of a question."""
    q = table(spark, d, "traces").where("request_id is not null").groupBy("request_id").agg(F.min("request.question").alias("q"))
    codes = q.select("request_id", F.explode_outer(X.detected_codes(F.col("q"))).alias("code")).where("code is not null")
    docs = table(spark, d, "evidence_records").where("doc_id is not null").select("doc_id", F.explode_outer(X.detected_codes(F.col("content"))).alias("code")).where("code is not null").distinct()
    need = codes.groupBy("request_id").agg(F.count(F.lit(1)).alias("need"))
    return codes.join(docs, "code").groupBy("request_id", "doc_id").agg(F.count(F.lit(1)).alias("have")).join(need, "request_id").where("have = need").select("request_id", "doc_id")


def groups(spark, d):
    e = _edges(spark, d).where("dependent is not null")
    key = lambda c: F.concat_ws("/", "doc", c)
    return J.components(e.select(key("dependent").alias("a"), F.when(F.col("prerequisite").isNotNull(), key("prerequisite")).otherwise(key("dependent")).alias("b")))


def scoped(spark, d):
    """Documents a trace names that exist, by trace; unknown ones are listed apart."""
    t = table(spark, d, "traces").where("request_id is not null").select("request_id", F.explode_outer("request.doc_ids").alias("doc_id")).where("doc_id is not null").distinct()
    known = table(spark, d, "evidence_records").where("doc_id is not null").select("doc_id").distinct().withColumn("known", F.lit(True))
    return t.join(known, "doc_id", "left").groupBy("request_id").agg(F.count("known").alias("authorized"), F.count_if(F.col("known").isNull()).alias("unknown"))


QUERIES = {
    "JN-12": in_band, "SRC-12": in_pages, "JN-13": cohort, "JN-14": effective, "FLT-07": asof_order, "WIN-09": heading_scope, "JN-15": not_superseded, "LK-19": resolve_version, "JN-03": hydrated, "JN-05": neighbours, "JN-16": proofs, "VF-03": citations,
    "JN-20": predictions, "JN-19": spans, "JN-06": direct, "JN-07": chain, "JN-08": inverse, "FLT-10": owners, "FLT-15": groups, "FLT-13": scoped,
}

_CODE = "nullif(upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '')"
_E = f"e AS (SELECT doc, {_CODE.format(c='dependent')} AS dependent, {_CODE.format(c='prerequisite')} AS prerequisite FROM edges WHERE doc IS NOT NULL), s AS (SELECT DISTINCT * FROM e WHERE dependent IS NOT NULL AND prerequisite IS NOT NULL), one AS (SELECT doc, dependent, min(prerequisite) AS found FROM s GROUP BY 1, 2 HAVING count(*) = 1)"
_V = "o AS (SELECT o_custkey, o_orderdate::DATE AS start, max(o_orderkey) AS version FROM orders GROUP BY 1, 2), v AS (SELECT *, lead(start) OVER w AS \"end\", lag(version) OVER w AS replaces FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY start))"
_CH = "e AS (SELECT doc_id, chunk_id, min(page) AS page, min(content) AS content FROM evidence_records WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2)"

ORACLES = {
    "JN-12": "SELECT o_orderkey, 'band' || floor(o_totalprice / 25000)::INT AS band FROM orders WHERE o_totalprice BETWEEN floor(o_totalprice / 25000) * 25000.0::DOUBLE AND floor(o_totalprice / 25000) * 25000.0::DOUBLE + 24999.995::DOUBLE AND o_totalprice < 600000 AND o_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1)",
    "SRC-12": "WITH e AS (SELECT DISTINCT doc_id AS doc, list_min(page_range) AS lo, list_max(page_range) AS hi FROM evidence_records WHERE doc_id IS NOT NULL AND len(page_range) > 0), r AS (SELECT DISTINCT chunk_id, doc_id, page FROM retrieval_results WHERE doc_id IS NOT NULL AND page IS NOT NULL) SELECT chunk_id, doc_id, page, count(*) AS ranges FROM r JOIN e ON doc = doc_id AND page BETWEEN lo AND hi GROUP BY ALL",
    "JN-13": "WITH p AS (SELECT p_brand, min(p_size) AS lo, CASE WHEN max(p_size) < 50 THEN max(p_size) ELSE 9999 END AS hi FROM part GROUP BY 1) SELECT s_suppkey, count(*) AS brands, min(p_brand) AS first_brand FROM supplier JOIN p ON s_nationkey * 2 BETWEEN lo AND hi GROUP BY 1",
    "FLT-07": "WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT event_id, k AS order_key FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate",
    "WIN-09": f"WITH {_CH}, h AS (SELECT doc_id, page, max(chunk_id) AS head FROM e WHERE regexp_matches(content, '^\\d+(\\.\\d+)*\\.? \\p{{Lu}}') GROUP BY 1, 2) SELECT chunk_id, (SELECT arg_max(head, h.page) FROM h WHERE h.doc_id = e.doc_id AND h.page <= e.page) AS head FROM e",
    "JN-14": f"WITH {_V} SELECT o_custkey, version, start, \"end\" FROM v WHERE start <= DATE '{_AT}' AND (\"end\" IS NULL OR DATE '{_AT}' < \"end\")",
    "JN-15": f"WITH {_V}, k AS (SELECT * FROM v WHERE start <= DATE '{_AT}') SELECT o_custkey, version FROM k WHERE version NOT IN (SELECT replaces FROM k WHERE replaces IS NOT NULL)",
    "LK-19": f"WITH {_V}, n AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE start <= DATE '{_AT}' AND (\"end\" IS NULL OR DATE '{_AT}' < \"end\")) AS k, min(version) FILTER (WHERE start <= DATE '{_AT}' AND (\"end\" IS NULL OR DATE '{_AT}' < \"end\")) AS version FROM v GROUP BY 1) SELECT c_custkey, CASE WHEN n IS NULL THEN 'insufficient_evidence' WHEN k = 0 THEN 'no_effective_version' WHEN k > 1 THEN 'conflict' ELSE 'resolved' END AS status, CASE WHEN k = 1 THEN version END AS version FROM customer LEFT JOIN n ON c_custkey = o_custkey",
    "JN-03": "WITH r AS (SELECT chunk_id, min(doc_id) AS doc_id, min(source_name) AS source_name, count(DISTINCT (coalesce(doc_id, chr(0)), coalesce(source_name, chr(0)))) > 1 AS conflict FROM evidence_records WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT DISTINCT i.chunk_id, r.doc_id, r.source_name, conflict FROM retrieval_results i LEFT JOIN r USING (chunk_id) WHERE i.chunk_id IS NOT NULL",
    "JN-05": f"WITH {_CH} SELECT chunk_id, lag(chunk_id) OVER w AS before, lead(chunk_id) OVER w AS after FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY page, chunk_id)",
    "JN-16": "WITH e AS (SELECT chunk_id, min(content) AS body, min(page) AS p FROM evidence_records WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT DISTINCT chunk_id, page FROM retrieval_results JOIN e USING (chunk_id) WHERE contains(body, content) AND p = page",
    "VF-03": "WITH e AS (SELECT chunk_id, min(doc_id) AS d, min(content) AS body, min(page) AS p FROM evidence_records WHERE chunk_id IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT query_id, chunk_id, doc_id, page, content AS quote FROM retrieval_results) SELECT query_id, chunk_id, page, concat_ws(',', CASE WHEN d IS NULL THEN 'unknown_chunk' END, CASE WHEN d IS NOT NULL AND d IS DISTINCT FROM doc_id THEN 'other_document' END, CASE WHEN d IS NOT NULL AND p IS DISTINCT FROM page THEN 'other_page' END, CASE WHEN d IS NOT NULL AND NOT coalesce(contains(body, quote), false) THEN 'quote_not_found' END) AS errors FROM r LEFT JOIN e USING (chunk_id)",
    "JN-20": "WITH a AS (SELECT case_id, count(*) AS answers FROM saved_answers WHERE case_id IS NOT NULL GROUP BY 1), r AS (SELECT case_id, count(*) AS results FROM results WHERE case_id IS NOT NULL GROUP BY 1) SELECT case_id, coalesce(answers, 0) AS answers, coalesce(results, 0) AS results FROM a FULL JOIN r USING (case_id)",
    "JN-19": "WITH q AS (SELECT request_id, min(request.question) AS q FROM traces WHERE request_id IS NOT NULL GROUP BY 1), p AS (SELECT request_id, unnest([{'p': regexp_split_to_array(q, '[0-9]+'), 'm': regexp_extract_all(q, '[0-9]+')}, {'p': regexp_split_to_array(q, '[A-Z]{4}[0-9]{4}'), 'm': regexp_extract_all(q, '[A-Z]{4}[0-9]{4}')}]) AS x FROM q), i AS (SELECT request_id, x, unnest(generate_series(1, len(x.m))) AS i FROM p), s AS (SELECT request_id, 1 + list_sum(list_transform(x.p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(x.m[1:i - 1], lambda y: length(y))), 0) AS b, x.m[i] AS w FROM i), t AS (SELECT request_id, b, b + length(w) AS e, w FROM s) SELECT request_id, b::INT AS b, e::INT AS e, w FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.request_id = t.request_id AND u.b <= t.b AND u.e >= t.e AND (u.b, u.e) <> (t.b, t.e))",
    "JN-06": f"WITH {_E} SELECT DISTINCT e.doc, e.dependent AS code, found FROM e JOIN one ON one.doc = e.doc AND one.dependent = e.dependent",
    "JN-07": f"WITH {_E} SELECT a.doc, a.dependent AS code, a.found AS via, b.found FROM one a JOIN one b ON a.doc = b.doc AND a.found = b.dependent WHERE b.found <> a.dependent AND b.found <> a.found",
    "JN-08": f"WITH {_E}, k AS (SELECT DISTINCT doc, dependent AS code FROM e WHERE prerequisite IS NULL AND dependent IS NOT NULL), i AS (SELECT doc, prerequisite AS code, dependent AS found, count(*) OVER (PARTITION BY doc, prerequisite) AS n FROM s ANTI JOIN k ON k.doc = s.doc AND k.code = s.prerequisite) SELECT doc, code, found FROM i WHERE n <= 40",
    "FLT-10": f"WITH q AS (SELECT request_id, min(request.question) AS q FROM traces WHERE request_id IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT request_id, upper(unnest(regexp_extract_all(q, '{X.CODE}'))) AS code FROM q), d AS (SELECT DISTINCT doc_id, upper(unnest(regexp_extract_all(content, '{X.CODE}'))) AS code FROM evidence_records WHERE doc_id IS NOT NULL), n AS (SELECT request_id, count(*) AS need FROM c GROUP BY 1) SELECT request_id, doc_id FROM c JOIN d USING (code) JOIN n USING (request_id) GROUP BY request_id, doc_id, need HAVING count(*) = need",
    "FLT-15": "WITH RECURSIVE " + _E.split(", s AS")[0] + ", x AS (SELECT doc || '/' || dependent AS a, doc || '/' || coalesce(prerequisite, dependent) AS b FROM e WHERE dependent IS NOT NULL), l AS (SELECT DISTINCT a, b FROM x UNION SELECT b, a FROM x), r AS (SELECT DISTINCT a AS node, a AS component FROM l UNION SELECT l.b, r.component FROM r JOIN l ON l.a = r.node) SELECT node, min(component) AS component FROM r GROUP BY 1",
    "FLT-13": "WITH t AS (SELECT DISTINCT request_id, unnest(request.doc_ids) AS doc_id FROM traces WHERE request_id IS NOT NULL), k AS (SELECT DISTINCT doc_id, true AS known FROM evidence_records WHERE doc_id IS NOT NULL) SELECT request_id, count(known) AS authorized, count(*) FILTER (WHERE known IS NULL) AS unknown FROM t LEFT JOIN k USING (doc_id) WHERE doc_id IS NOT NULL GROUP BY 1",
}

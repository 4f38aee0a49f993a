"""Queries of aggregates and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import aggregates as A
from gneiss.runtime import table


def _li(spark, d):
    return table(spark, d, "lineitem")


def unanimous_tax(spark, d):
    """Tax of each order line where all its rows agree."""
    return _li(spark, d).groupBy("l_orderkey", "l_linenumber").agg(A.unanimous(F.col("l_tax")).alias("tax"))


def unanimous_total(spark, d):
    return A.unanimous_sum(_li(spark, d), ["l_orderkey"], "l_linenumber", "l_quantity").select("l_orderkey", F.round("total", 4).alias("total"), "keys")


def difference(spark, d):
    """Difference of the quantities of the first two lines of an order, where both are unanimous."""
    one = _li(spark, d).where("l_linenumber in (1, 2)").groupBy("l_orderkey", "l_linenumber").agg(A.unanimous(F.col("l_quantity")).alias("q"))
    both = one.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("q"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("q"))).alias("b"))
    return both.where("a is not null and b is not null").select("l_orderkey", F.round(F.col("a") - F.col("b"), 4).alias("difference"))


def conflicts(spark, d):
    return A.numeric_conflicts(table(spark, d, "saved_answers").select("request_id", F.col("response.answer.answer").alias("a")), "request_id", "a")


def versions(spark, d):
    """Documents with more than one version, or rows without any provenance."""
    e = table(spark, d, "evidence_records").where("doc_id is not null")
    return e.groupBy("doc_id").agg(F.count_distinct("document_version").alias("versions"), F.count_if(F.col("source_hash").isNull() & F.col("document_version").isNull()).alias("unproven")).where("versions > 1 or unproven > 0")


def service_metrics(spark, d):
    return A.metric_summary(table(spark, d, "events"), ["event_type"], "value").select("event_type", "n", *[F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")])


def nearest_rank(spark, d):
    r = table(spark, d, "responses").where("latency_ms > 0 and latency_ms < double('inf')")
    return A.metric_summary(r, ["scope"], "latency_ms", (50, 95), False)


def _scored(spark, d):
    """Retrieval score of a query's best result against whether it was answered."""
    best = table(spark, d, "retrieval_results").where("score is not null and query_id is not null").groupBy("query_id").agg(F.max("score").alias("score"))
    a = table(spark, d, "saved_answers").where("request_id is not null").groupBy(F.col("request_id").alias("query_id")).agg(F.max((~F.coalesce("response.answer.abstained", F.lit(True))).cast("int")).alias("label"))
    return best.join(a, "query_id")


def brier(spark, d):
    return A.calibration(_scored(spark, d), "score", "label")


def sweep(spark, d):
    r = A.threshold_sweep(_scored(spark, d), "score", "label", 0.3, 0.9)
    return r.select("threshold", F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"))


def isotonic(spark, d):
    """Steps of the fit; neighbouring blocks of one value are one step of the function."""
    return A.isotonic(_scored(spark, d), "score", "label").groupBy("value").agg(F.max("threshold").alias("threshold"))


def type_votes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.document_type(F.col("text")).alias("document_type"))


def one_label(spark, d):
    return table(spark, d, "evidence_records").where("doc_id is not null").groupBy("doc_id").agg(A.labelled(F.when(F.col("document_version") != "", F.col("document_version")), F.col("chunk_id")).alias("version"))


def state_counts(spark, d):
    return table(spark, d, "attempts").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def health(spark, d):
    """Daily windows of the result runs under the rollout budgets."""
    r = table(spark, d, "results").where("run_id is not null and latency_seconds > 0 and latency_seconds < double('inf')").select("run_id", F.to_date("recorded_at").alias("day"), F.round(F.col("latency_seconds") * 1000, 3).alias("ms"), F.coalesce((F.col("status") == "FAIL").cast("double"), F.lit(0.0)).alias("fail"))
    m = A.metric_summary(r, ["run_id", "day"], "ms", (95, 99), False)
    w = m.join(r.groupBy("run_id", "day").agg(F.round(F.avg("fail"), 6).alias("error_rate")), ["run_id", "day"]).withColumnRenamed("n", "requests").withColumn("baseline_error_rate", F.lit(0.35))
    return A.canary(w, "run_id", "day").select("run_id", "day", "requests", "state", "reason", "promoted")


def graph_counts(spark, d):
    e = table(spark, d, "edges").where("doc is not null and dependent is not null")
    code = lambda c: F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    rows = e.select("doc", code("dependent").alias("a"), F.nullif(code("prerequisite"), F.lit("")).alias("b")).distinct()
    return rows.groupBy("doc").agg(F.count_distinct("a").alias("dependents"), F.count("b").alias("edges"), F.count_if(F.col("b").isNull()).alias("open"))


def node_conflicts(spark, d):
    """Codes of a document that name more than one prerequisite."""
    e = table(spark, d, "edges").where("doc is not null and dependent is not null")
    code = lambda c: F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return e.select("doc", code("dependent").alias("code"), code("prerequisite").alias("p")).where("p != ''").groupBy("doc", "code").agg(F.count_distinct("p").alias("variants"), F.count_distinct("doc").alias("docs")).where("variants > 1")


def headers(spark, d):
    e = table(spark, d, "evidence_records").where("chunk_id is not null and doc_id is not null").groupBy("chunk_id", "doc_id").agg(F.min("page").alias("page"), F.min("content").alias("content"))
    return A.recurring_lines(e, "doc_id", "page", "content")


def corpus_hash(spark, d):
    return A.fingerprint(table(spark, d, "evidence_records").where("doc_id is not null"), ["doc_id"], ["chunk_id", "content"])


def page_totals(spark, d):
    """Pages by document; a document with an unknown page has none rather than a partial total."""
    e = table(spark, d, "evidence_records").where("doc_id is not null")
    return e.groupBy("doc_id").agg(F.when(F.count("page") == F.count(F.lit(1)), F.count_distinct("page")).alias("pages"))


def compliance(spark, d):
    """Share of passed rows and of runs' cases in which every row passed."""
    r = table(spark, d, "results").where("run_id is not null and case_id is not null and status is not null")
    by = r.groupBy("run_id", "case_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("status").startswith("PASS")).alias("p"))
    return by.groupBy("run_id").agg(F.sum("k").alias("n"), F.round(F.sum("p") / F.sum("k"), 6).alias("row_pass"), F.round(F.avg((F.col("p") == F.col("k")).cast("double")), 6).alias("case_pass"))


def timings(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("calls"))


QUERIES = {
    "AGG-04": unanimous_tax, "AGG-05": unanimous_total, "AGG-06": difference, "AGG-08": conflicts, "AGG-09": versions, "AGG-10": service_metrics, "AGG-11": nearest_rank, "AGG-12": brier, "AGG-13": sweep, "AGG-14": isotonic,
    "AGG-15": type_votes, "AGG-16": one_label, "AGG-17": state_counts, "AGG-18": health, "AGG-19": graph_counts, "AGG-20": node_conflicts, "AGG-21": headers, "AGG-22": corpus_hash, "AGG-23": page_totals, "AGG-24": compliance, "AGG-25": timings,
}


def fold_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({c}), '{X.ACCENTED}', '{X.BASE}'), '\p{{M}}+', '', 'g'), '\s+', ' ', 'g'))"


_U = "CASE WHEN min({v}) = max({v}) AND count({v}) = count(*) THEN min({v}) END"
_SC = """sc AS (SELECT b.query_id, score, label FROM (SELECT query_id, max(score) AS score FROM retrieval_results WHERE score IS NOT NULL AND query_id IS NOT NULL GROUP BY 1) b
JOIN (SELECT request_id AS query_id, max((NOT coalesce(response.answer.abstained, true))::INT) AS label FROM saved_answers WHERE request_id IS NOT NULL GROUP BY 1) a USING (query_id))"""
_CODE = "upper(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_DT = "CASE " + "".join(
    f"WHEN n{i} > 0 AND " + " AND ".join([f"n{i} >= n{j}" for j in range(6) if j > i] + [f"n{i} > n{j}" for j in range(6) if j < i] or ["true"]) + f" THEN '{t}' " for i, (t, _) in enumerate(X.DOCUMENT_TYPES)
) + "ELSE 'unknown' END"

ORACLES = {
    "AGG-04": f"SELECT l_orderkey, l_linenumber, {_U.format(v='l_tax')} AS tax FROM lineitem GROUP BY 1, 2",
    "AGG-05": f"SELECT l_orderkey, round(CASE WHEN count(v) = count(*) AND count(*) <= 10 THEN sum(v) END, 4) AS total, count(*) AS keys FROM (SELECT l_orderkey, l_linenumber, {_U.format(v='l_quantity')} AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "AGG-06": f"WITH o AS (SELECT l_orderkey, l_linenumber, {_U.format(v='l_quantity')} AS q FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1, 2) SELECT a.l_orderkey, round(a.q - b.q, 4) AS difference FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 WHERE a.q IS NOT NULL AND b.q IS NOT NULL",
    "AGG-09": "SELECT doc_id, count(DISTINCT document_version) AS versions, count(*) FILTER (WHERE source_hash IS NULL AND document_version IS NULL) AS unproven FROM evidence_records WHERE doc_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT document_version) > 1 OR count(*) FILTER (WHERE source_hash IS NULL AND document_version IS NULL) > 0",
    "AGG-10": "WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value)) SELECT event_type, max(n) AS n, " + ", ".join(f"round(min(value) FILTER (WHERE r = least(n, greatest(1, round_even({p / 100}::DOUBLE * n + 0.5::DOUBLE, 0)::BIGINT))), 3) AS p{p}" for p in (50, 95, 99)) + " FROM v GROUP BY 1",
    "AGG-11": "WITH v AS (SELECT scope, latency_ms AS value, row_number() OVER (PARTITION BY scope ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY scope) AS n FROM responses WHERE latency_ms > 0 AND isfinite(latency_ms)) SELECT scope, max(n) AS n, min(value) FILTER (WHERE r = (n * 50 + 99) // 100) AS p50, min(value) FILTER (WHERE r = (n * 95 + 99) // 100) AS p95 FROM v GROUP BY 1",
    "AGG-12": f"WITH {_SC}, b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS k, sum(score) AS ss, sum(label) AS sy, sum((score - label) * (score - label)) AS sq FROM sc WHERE score BETWEEN 0 AND 1 GROUP BY 1) SELECT sum(k)::BIGINT AS n, round(sum(sq) / sum(k), 6) AS brier, round(sum(abs(ss - sy)) / sum(k), 6) AS ece FROM b",
    "AGG-13": f"WITH {_SC}, c AS (SELECT DISTINCT s FROM (SELECT score AS s FROM sc UNION ALL SELECT 0.0::DOUBLE)), m AS (SELECT s, (SELECT sum(label) FROM sc WHERE score >= s) / (SELECT sum(label) FROM sc)::DOUBLE AS recall, (SELECT sum(1 - label) FROM sc WHERE score >= s) / (SELECT sum(1 - label) FROM sc)::DOUBLE AS fpr FROM c) SELECT round(s, 8) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM m WHERE recall >= 0.3::DOUBLE AND fpr <= 0.9::DOUBLE ORDER BY s DESC LIMIT 1",
    "AGG-14": f"""WITH {_SC}, g AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)) AS s, count(*) AS n, sum(label) AS y FROM sc GROUP BY 1), c AS (SELECT s, sum(n) OVER (ORDER BY s) AS cn, sum(y) OVER (ORDER BY s) AS cy, n, y FROM g),
m AS (SELECT a.s AS s, b.s AS lo, min((e.cy - (b.cy - b.y)) / (e.cn - (b.cn - b.n))::DOUBLE) AS m FROM c a JOIN c b ON b.s <= a.s JOIN c e ON e.s >= a.s GROUP BY 1, 2), f AS (SELECT s, round(max(m), 8) AS value FROM m GROUP BY 1)
SELECT max(s) AS threshold, value FROM f GROUP BY value""",
    "AGG-15": f"WITH f AS (SELECT doc_id, {fold_sql('text')} AS f FROM documents), n AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(f, '{p}')) AS n{i}" for i, (_, p) in enumerate(X.DOCUMENT_TYPES)) + f" FROM f) SELECT doc_id, {_DT} AS document_type FROM n",
    "AGG-16": "WITH v AS (SELECT doc_id, chunk_id, nullif(document_version, '') AS x FROM evidence_records WHERE doc_id IS NOT NULL) SELECT doc_id, CASE WHEN min(lower(x)) = max(lower(x)) THEN arg_min(x, chunk_id) FILTER (WHERE x IS NOT NULL) END AS version FROM v GROUP BY 1",
    "AGG-17": "SELECT status, count(*) AS n FROM attempts GROUP BY 1",
    "AGG-18": """WITH r AS (SELECT run_id, recorded_at::DATE AS day, round(latency_seconds * 1000, 3) AS ms, coalesce((status = 'FAIL')::INT, 0)::DOUBLE AS fail FROM results WHERE run_id IS NOT NULL AND latency_seconds > 0 AND isfinite(latency_seconds)),
k AS (SELECT run_id, day, ms, fail, row_number() OVER (PARTITION BY run_id, day ORDER BY ms) AS r, count(*) OVER (PARTITION BY run_id, day) AS n FROM r),
m AS (SELECT run_id, day, max(n) AS requests, min(ms) FILTER (WHERE r = (n * 95 + 99) // 100) AS p95, min(ms) FILTER (WHERE r = (n * 99 + 99) // 100) AS p99, round(avg(fail), 6) AS e FROM k GROUP BY 1, 2),
s AS (SELECT *, (p95 > 1000 OR p99 > 2000)::INT AS slow FROM m), t AS (SELECT *, slow + lag(slow, 1, 0) OVER w + lag(slow, 2, 0) OVER w AS three FROM s WINDOW w AS (PARTITION BY run_id ORDER BY day)),
q AS (SELECT *, CASE WHEN requests < 100 THEN NULL WHEN e > 0.35::DOUBLE THEN 'error_rate_regression' WHEN three = 3 THEN 'latency_budget_three_windows' END AS bad FROM t),
f AS (SELECT *, arg_min(bad, day) OVER (PARTITION BY run_id ORDER BY day) AS held FROM q),
h AS (SELECT *, CASE WHEN held IS NOT NULL THEN 'rollback' WHEN requests < 100 OR slow = 1 THEN 'waiting' ELSE 'healthy' END AS state FROM f),
i AS (SELECT *, sum((state <> 'healthy')::INT) OVER (PARTITION BY run_id ORDER BY day) AS island FROM h),
n AS (SELECT *, sum((state = 'healthy')::INT) OVER (PARTITION BY run_id, island ORDER BY day) AS nth FROM i)
SELECT run_id, day, requests, state, coalesce(held, CASE WHEN requests < 100 THEN 'insufficient_observations' END) AS reason, sum((state = 'healthy' AND nth % 3 = 0)::INT) OVER (PARTITION BY run_id ORDER BY day) AS promoted FROM n""",
    "AGG-19": f"WITH r AS (SELECT DISTINCT doc, {_CODE.format(c='dependent')} AS a, nullif({_CODE.format(c='prerequisite')}, '') AS b FROM edges WHERE doc IS NOT NULL AND dependent IS NOT NULL) SELECT doc, count(DISTINCT a) AS dependents, count(b) AS edges, count(*) FILTER (WHERE b IS NULL) AS open FROM r GROUP BY 1",
    "AGG-20": f"SELECT doc, code, count(DISTINCT p) AS variants, count(DISTINCT doc) AS docs FROM (SELECT doc, {_CODE.format(c='dependent')} AS code, {_CODE.format(c='prerequisite')} AS p FROM edges WHERE doc IS NOT NULL AND dependent IS NOT NULL) WHERE p <> '' GROUP BY 1, 2 HAVING count(DISTINCT p) > 1",
    "AGG-21": """WITH e AS (SELECT chunk_id, doc_id, min(page) AS page, min(content) AS content FROM evidence_records WHERE chunk_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT doc_id, page, unnest(list_filter(regexp_split_to_array(content, '[\\n\\f]'), lambda x: trim(x) <> '')[1:2]) AS line FROM e), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM e GROUP BY 1)
SELECT doc_id AS doc, trim(line) AS line, count(DISTINCT page) AS pages FROM l JOIN n USING (doc_id) GROUP BY doc_id, trim(line), n HAVING count(DISTINCT page) >= greatest(3, (n + 1) // 2)""",
    "AGG-22": "WITH h AS (SELECT DISTINCT doc_id, sha256(concat_ws(chr(31), coalesce(chunk_id, chr(0)), coalesce(content, chr(0)))) AS h FROM evidence_records WHERE doc_id IS NOT NULL), p AS (SELECT doc_id, h[1:2] AS p, sha256(string_agg(h, '' ORDER BY h)) AS s FROM h GROUP BY 1, 2) SELECT doc_id, sha256(string_agg(p || s, '' ORDER BY p || s)) AS fingerprint FROM p GROUP BY 1",
    "AGG-23": "SELECT doc_id, CASE WHEN count(page) = count(*) THEN count(DISTINCT page) END AS pages FROM evidence_records WHERE doc_id IS NOT NULL GROUP BY 1",
    "AGG-24": "WITH b AS (SELECT run_id, case_id, count(*) AS k, count(*) FILTER (WHERE starts_with(status, 'PASS')) AS p FROM results WHERE run_id IS NOT NULL AND case_id IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2) SELECT run_id, sum(k)::BIGINT AS n, round(sum(p) / sum(k), 6) AS row_pass, round(avg((p = k)::INT), 6) AS case_pass FROM b GROUP BY 1",
    "AGG-25": "SELECT user_id, event_type, round(sum(value), 4) AS total, count(*) AS calls FROM events GROUP BY 1, 2",
}

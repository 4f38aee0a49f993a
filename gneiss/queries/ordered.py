"""Queries of ordered state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import windows as W
from gneiss.runtime import table


def _chunks(spark, d):
    return table(spark, d, "evidence_records").where("chunk_id is not null").groupBy("chunk_id").agg(F.min("content").alias("content"))


def _lines(spark, d):
    return W.lines_of(_chunks(spark, d), "chunk_id", "content")


def headings(spark, d):
    return _lines(spark, d).select("chunk_id", "pos", X.heading_level(F.col("line")).alias("level")).where("level > 0")


def section_islands(spark, d):
    return W.sections(_lines(spark, d), "chunk_id").select("chunk_id", "pos", "section", "offset")


def paths(spark, d):
    """Open headings over every line of the documents' chunks."""
    s = W.sections(_lines(spark, d), "chunk_id")
    return W.heading_paths(s, "chunk_id").where("level = 0").groupBy("chunk_id", F.array_join("heading_path", " > ").alias("heading")).agg(F.count(F.lit(1)).alias("lines"))


def runs(spark, d):
    """Numbered runs in the saved answers."""
    a = table(spark, d, "saved_answers").where("request_id is not null").groupBy("request_id").agg(F.min("response.answer.answer").alias("a"))
    return W.numbered_runs(W.lines_of(a, "request_id", "a"), "request_id").select("request_id", "pos", "number")


def marker(spark, d):
    """Last purchase value of a user since the last login-like event, carried along."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    top = "purchase"
    out = W.carry(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == top, F.col("value")), F.col("event_type") == "click", "carried")
    return out.select("event_id", "carried")


def subtotals(spark, d):
    """Total of the values of a user up to each event within the island of its marker."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    i = e.withColumn("island", F.sum((F.col("event_type") == "click").cast("int")).over(w))
    return i.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("subtotal"))


def minute(spark, d):
    """Requests and values of each user in the trailing hour."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return W.rolling(e, ["user_id"], "ts", 3600, {"requests": "1", "total": "value"}).select("event_id", F.col("requests").cast("long").alias("requests"), F.round("total", 4).alias("total"))


def daily_quota(spark, d):
    """Calls and tokens by scope and day of a zone."""
    r = table(spark, d, "responses").where("scope is not null").groupBy("cache_key", "scope", "recorded_at", "usage").agg(F.count(F.lit(1)).alias("copies"))
    day = F.to_date(F.from_utc_timestamp(F.col("recorded_at").cast("timestamp"), "Asia/Bangkok"))
    used = F.coalesce(F.get_json_object("usage", "$.input_tokens").try_cast("long"), F.lit(0)) + F.coalesce(F.get_json_object("usage", "$.output_tokens").try_cast("long"), F.lit(0))
    return r.groupBy("scope", day.alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.sum(used).alias("tokens"))


def latest_attempt(spark, d):
    """Status and turn of the latest attempt of each digest, of equally late ones the highest turn."""
    a = table(spark, d, "attempts").where("digest is not null").select("digest", "recorded_at", "turn", "status")
    return W.latest(a, ["digest"], [F.col(c).desc_nulls_last() for c in ("recorded_at", "turn", "status")])


def samples(spark, d):
    e = table(spark, d, "events")
    return W.last_n(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 256).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def running_max(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.max("value").over(w).alias("peak"))


def topic_chain(spark, d):
    """Topics of the conversations: a question without any code depends on those before it."""
    q = F.get_json_object("request", "$.question")
    t = table(spark, d, "attempts").where("case_id is not null and turn is not null").groupBy("case_id", "turn").agg(F.min(q).alias("q"))
    dependent = F.size(X.detected_codes(F.coalesce("q", F.lit("")))) == 0
    return W.topics(t, "case_id", "turn", dependent).select("case_id", "turn", "topic", "anchor")


def budget(spark, d):
    """Characters granted to each retrieved chunk of a query when 1,500 are shared out."""
    r = table(spark, d, "retrieval_results").where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.max(F.coalesce(F.length("content"), F.lit(0))).alias("demand"))
    return W.water_fill(r.withColumn("floor", F.lit(100)), "query_id", "demand", "floor", "chunk_id", 1500).select("query_id", "chunk_id", "share")


QUERIES = {
    "FN-18": headings, "WIN-04": section_islands, "WIN-06": lambda s, d: section_islands(s, d).groupBy("chunk_id", "section").agg(F.max("offset").alias("last_offset")), "WIN-03": paths, "WIN-05": runs, "WIN-08": marker, "AGG-07": subtotals, "WIN-11": minute, "DT-05": daily_quota,
    "WIN-12": latest_attempt, "WIN-13": samples, "WIN-15": running_max, "WIN-10": topic_chain, "MA-17": budget,
}

_L = "c AS (SELECT chunk_id, min(content) AS content FROM evidence_records WHERE chunk_id IS NOT NULL GROUP BY 1), x AS (SELECT chunk_id, regexp_split_to_array(content, '[\\n\\f]') AS a FROM c), l AS (SELECT chunk_id, unnest(generate_series(0, len(a) - 1)) AS pos, unnest(a) AS line FROM x)"
_S = "trim(line)"
_N = f"regexp_matches({_S}, '^(?:\\d+(?:\\.\\d+)*\\.?\\s+\\p{{L}}|(?i:điều|article|chương|chapter|mục|section)\\s+(?i:[\\divxlc])+)')"
_LV = f"""lv AS (SELECT chunk_id, pos, line, CASE WHEN {_S} = '' THEN 0 WHEN starts_with({_S}, '#') THEN least(6, length(regexp_extract({_S}, '^(#+)', 1))) WHEN len(regexp_extract_all({_S}, '\\p{{L}}')) = 0 THEN 0
WHEN regexp_matches({_S}, '^[A-Za-z]{{2,5}}\\s*\\d{{3,5}}[A-Za-z]?$') OR regexp_matches({_S}, '^\\d+(?:[.,]\\d+)?\\s*(?i:credits?|tín\\s+chỉ|ects|tc)[.!]?$') THEN 0
WHEN {_N} THEN CASE WHEN len(regexp_split_to_array({_S}, '\\s+')) <= 12 AND NOT regexp_matches({_S}, '[.;,?!]$') THEN least(6, len(regexp_extract_all(regexp_extract({_S}, '^(\\d+(?:\\.\\d+)*)', 1), '\\.')) + 1) ELSE 0 END
WHEN len(regexp_split_to_array({_S}, '\\s+')) <= 12 AND length({_S}) >= 4 AND len(regexp_extract_all({_S}, '\\p{{Lu}}')) >= len(regexp_extract_all({_S}, '\\p{{L}}')) * 0.82::DOUBLE AND NOT regexp_matches({_S}, '[.;,?!]$') THEN 1 ELSE 0 END AS level FROM l)"""
_SEC = "s AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY chunk_id ORDER BY pos) AS section FROM lv), o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY chunk_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)"

ORACLES = {
    "FN-18": f"WITH {_L}, {_LV} SELECT chunk_id, pos, level FROM lv WHERE level > 0",
    "WIN-04": f"WITH {_L}, {_LV}, {_SEC} SELECT chunk_id, pos, section::BIGINT AS section, off::BIGINT AS \"offset\" FROM o",
    "WIN-06": f"WITH {_L}, {_LV}, {_SEC} SELECT chunk_id, section::BIGINT AS section, max(off)::BIGINT AS last_offset FROM o GROUP BY 1, 2",
    "WIN-03": f"WITH {_L}, {_LV}, w AS (SELECT chunk_id, pos, level, " + ", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER v AS p{k}, last_value(CASE WHEN level = {k} THEN trim(line) END IGNORE NULLS) OVER v AS h{k}" for k in range(1, 7)) + " FROM lv WINDOW v AS (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT chunk_id, heading, count(*) AS lines FROM (SELECT chunk_id, concat_ws(' > ', " + ", ".join(f"CASE WHEN p{k} > greatest(-1, {', '.join([f'coalesce(p{j}, -1)' for j in range(1, k)] or ['-1'])}) THEN h{k} END" for k in range(1, 7)) + ") AS heading FROM w WHERE level = 0) GROUP BY 1, 2",
    "WIN-05": "WITH a AS (SELECT request_id, min(response.answer.answer) AS a FROM saved_answers WHERE request_id IS NOT NULL GROUP BY 1), x AS (SELECT request_id, regexp_split_to_array(a, '[\\n\\f]') AS a FROM a), l AS (SELECT request_id, unnest(generate_series(0, len(a) - 1)) AS pos, unnest(a) AS line FROM x), n AS (SELECT request_id, pos, regexp_extract(line, '^\\s*(\\d{1,9})[.)]\\s+\\S', 1)::BIGINT AS number FROM l WHERE regexp_matches(line, '^\\s*(\\d{1,9})[.)]\\s+\\S')), r AS (SELECT *, count(*) OVER (PARTITION BY request_id, pos - number) AS k FROM n) SELECT request_id, pos, number FROM r WHERE k >= 2",
    "WIN-08": "WITH i AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM i",
    "AGG-07": "WITH i AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) SELECT user_id, island::BIGINT AS island, count(*) AS n, round(sum(value), 4) AS subtotal FROM i GROUP BY 1, 2",
    "WIN-11": "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW)",
    "DT-05": "WITH r AS (SELECT DISTINCT cache_key, scope, recorded_at, usage FROM responses WHERE scope IS NOT NULL) SELECT scope, (recorded_at + INTERVAL 7 HOUR)::DATE AS day, count(*) AS calls, sum(coalesce(try_cast(CASE WHEN json_valid(usage) THEN usage ->> '$.input_tokens' END AS BIGINT), 0) + coalesce(try_cast(CASE WHEN json_valid(usage) THEN usage ->> '$.output_tokens' END AS BIGINT), 0))::BIGINT AS tokens FROM r GROUP BY 1, 2",
    "WIN-12": "SELECT digest, recorded_at, turn, status FROM attempts WHERE digest IS NOT NULL QUALIFY row_number() OVER (PARTITION BY digest ORDER BY recorded_at DESC NULLS LAST, turn DESC NULLS LAST, status DESC NULLS LAST) = 1",
    "WIN-13": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM r WHERE n <= 256 GROUP BY 1",
    "WIN-15": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM events",
    "WIN-10": f"WITH t AS (SELECT case_id, turn, min(CASE WHEN json_valid(request) THEN request ->> '$.question' END) AS q FROM attempts WHERE case_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, NOT regexp_matches(coalesce(q, ''), '{X.CODE}') AS dep FROM t) SELECT case_id, turn, sum((NOT dep)::INT) OVER w AS topic, last_value(CASE WHEN NOT dep THEN turn END IGNORE NULLS) OVER w AS anchor FROM s WINDOW w AS (PARTITION BY case_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
}

"""Queries of sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions.text import hash_embedding
from gneiss.runtime import table
from gneiss.sources.readers import visible_text
from gneiss.sources.store import incremental, manifest
from gneiss.streaming import ingest as S
from gneiss.streaming.quota import admissions


def corpus_manifest(spark, d):
    return manifest(table(spark, d, "evidence_records").where("doc_id is not null"), "doc_id", ["chunk_id", "content"])


def reuse(spark, d):
    """Vectors of the evidence texts given those of the retrieved ones: how many are new."""
    e, r = table(spark, d, "evidence_records").select("content"), table(spark, d, "retrieval_results").select("content")
    known = incremental(r, None, "content", hash_embedding)
    both = incremental(e, known, "content", hash_embedding)
    mark = known.select("text_hash", F.lit(1).alias("k"))
    return both.select("text_hash").join(mark, "text_hash", "left").agg(F.count(F.lit(1)).alias("texts"), F.count("k").alias("reused"))


def registry(spark, d):
    """Documents with their columns of metadata only."""
    return table(spark, d, "documents").select("doc_id", "source", "institution", "doc_kind", "n_chars")


def visible(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(visible_text(F.col("text"))).alias("chars"))


def hourly(spark, d):
    """Event-time hours of the event stream. The stream has ended, so the last hours, which its
    watermark still holds open, are not in the result: a batch would close them."""
    out = S.run_once(S.windowed(S.table_stream(spark, d, "events"), "ts", ["event_type"], "1 hour", "3650 days").select("start", "event_type", "n", F.round("total", 4).alias("total")), "append")
    return out


def hourly_batch(spark, d):
    out = S.windowed(table(spark, d, "events"), "ts", ["event_type"])
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def governed(spark, d):
    """Calls of each scope admitted under quotas, decided in a stateful stream; how many of each
    day were admitted or refused, and why."""
    r = S.table_stream(spark, d, "responses")
    tokens = F.coalesce(F.get_json_object("usage", "$.input_tokens").try_cast("long"), F.lit(0)) + F.coalesce(F.get_json_object("usage", "$.output_tokens").try_cast("long"), F.lit(0))
    calls = r.select("scope", F.col("cache_key").alias("call"), (F.col("created_at") * 1_000_000).cast("long").alias("at"), tokens.alias("tokens"))
    out = S.run_once(admissions(calls, rpm=4, tpm=4_000, rpd=60, tpd=40_000, spacing=2_000_000, zone="Asia/Bangkok"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_micros("at"), "Asia/Bangkok"))
    return out.groupBy("scope", day.alias("day"), F.coalesce("reason", F.lit("admitted")).alias("decision")).agg(F.count(F.lit(1)).alias("calls"))


def progressive(spark, d):
    """Rows ingested by kind, batch by batch, through a stream into the shared folder."""
    out = S.run_once(S.table_stream(spark, d, "documents", 1).select("doc_id", "doc_kind"))
    return out.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"SNK-04": corpus_manifest, "RNK-16": reuse, "SRC-14": registry, "SRC-03": visible, "ST-05": governed, "events_hourly": hourly_batch, "ST-01": progressive}

ORACLES = {
    "RNK-16": "WITH r AS (SELECT DISTINCT sha256(content) AS h FROM retrieval_results WHERE content IS NOT NULL), e AS (SELECT DISTINCT sha256(content) AS h FROM evidence_records WHERE content IS NOT NULL) SELECT count(*) AS texts, count(r.h) AS reused FROM e LEFT JOIN r ON e.h = r.h",
    "SRC-14": "SELECT doc_id, source, institution, doc_kind, n_chars FROM documents",
    "events_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "ST-01": "SELECT doc_kind, count(*) AS n FROM documents GROUP BY 1",
    "SNK-04": "WITH h AS (SELECT DISTINCT doc_id, sha256(concat_ws(chr(31), coalesce(chunk_id, chr(0)), coalesce(content, chr(0)))) AS h FROM evidence_records WHERE doc_id IS NOT NULL), p AS (SELECT doc_id, h[1:2] AS p, sha256(string_agg(h, '' ORDER BY h)) AS s FROM h GROUP BY 1, 2), d AS (SELECT doc_id, sha256(string_agg(p || s, '' ORDER BY p || s)) AS fingerprint FROM p GROUP BY 1), g AS (SELECT sha256(doc_id || chr(31) || fingerprint) AS h FROM d), q AS (SELECT h[1:2] AS p, sha256(string_agg(h, '' ORDER BY h)) AS s FROM g GROUP BY 1) SELECT doc_id, fingerprint FROM d UNION ALL SELECT NULL, sha256(string_agg(p || s, '' ORDER BY p || s)) FROM q",
}

"""Rebuilding conversations from message rows (problem 7).

Every turn points at the turn before it. Pointer jumping (the core hierarchy operator)
resolves these links to turn 0 in a logarithmic number of joins; turns that never get there
are orphans and make their conversation broken. It also sums, along the path, how many
earlier turns have a reply, which fixes the length and the positions of each stored history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.hierarchy import hierarchy
from gneiss.runtime import cut, hash128, table

_REQUEST = "struct<question string, history array<struct<role string, content string>>>"
_RESPONSE = "struct<answer struct<answer string>>"
#: White space, invisible and control characters: a text of only these is blank.
_BLANK = r"^[\s\p{Z}\p{Cf}\p{Cc}­͏ᅟᅠㅤ︀-️]*$"
LIST_PART = 1000


def _blank(c: Column) -> Column:
    return c.rlike(_BLANK)


def turns(attempts: DataFrame) -> DataFrame:
    """The counting row of each attempt, one a digest, parsed.

    Of rows with one digest the latest ``recorded_at`` counts; on a tie the one with a
    response, then by content. A row with a NULL digest is an attempt of its own (exact
    repeats once). Rows with a NULL case_id belong to no conversation and are left out.
    """
    rows = attempts.select("digest", "case_id", F.col("turn").cast("int").alias("turn"), "request", "response", "recorded_at").where("case_id is not null")
    content = F.xxhash64("case_id", "turn", "request", "response")
    rows = rows.withColumn("_key", F.coalesce("digest", F.concat(F.lit("row "), content.cast("string"))))
    best = F.max_by(F.struct("case_id", "turn", "request", "response"), F.struct(F.coalesce("recorded_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("response").isNotNull(), content))
    latest = rows.groupBy("_key").agg(best.alias("r")).select("r.*")
    q, a = F.from_json("request", _REQUEST), F.from_json("response", _RESPONSE)
    return latest.select(
        "case_id",
        "turn",
        (F.try_parse_json("request").isNotNull() & (F.col("response").isNull() | F.try_parse_json("response").isNotNull())).alias("readable"),
        q.getField("question").alias("question"),
        F.transform(F.coalesce(q.getField("history"), F.array().cast("array<struct<role string, content string>>")), lambda m: m.getField("content")).alias("history"),
        a.getField("answer").getField("answer").alias("answer"),
    )


def judge(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(case_id, reason)`` for every conversation, reason NULL where it is whole, and the
    resolved turns ``(case_id, turn, replies)`` with the number of earlier replies."""
    numbered = parsed.where("turn is not null").groupBy("case_id", "turn").agg(F.max(F.col("answer").isNotNull().cast("int")).alias("replies"))
    links = numbered.select(
        F.col("case_id").alias("tree"), F.col("turn").cast("string").alias("node"), F.when(F.col("turn") != 0, (F.col("turn") - 1).cast("string")).alias("parent"), "replies"
    )
    resolved = hierarchy(links, paths=False, measures=["replies"]).select(
        F.col("tree").alias("case_id"), F.col("node").cast("int").alias("turn"), "orphan", F.col("sum_replies").cast("int").alias("replies")
    )
    # one row a stored history message, compared with the message the sequence has there
    said = parsed.where("turn is not null").join(resolved.where("not orphan"), ["case_id", "turn"])
    spoken = said.where("answer is not null").select("case_id", F.posexplode(F.array("question", "answer")).alias("side", "content"), "replies")
    sequence = spoken.select("case_id", (F.col("replies") * 2 + F.col("side")).alias("pos"), hash128(F.coalesce("content", F.lit("\0"))).alias("is"))
    stored = said.select("case_id", F.posexplode("history").alias("pos", "content")).select("case_id", "pos", hash128(F.coalesce("content", F.lit("\0"))).alias("was"))
    wrong = stored.join(sequence, ["case_id", "pos"], "left").groupBy("case_id").agg(F.max(F.coalesce(F.col("was") != F.col("is"), F.lit(True)).cast("int")).alias("strayed"))
    length = said.groupBy("case_id").agg(F.max((F.size("history") != F.col("replies") * 2).cast("int")).alias("misfit"))
    orphans = resolved.groupBy("case_id").agg(F.max(F.col("orphan").cast("int")).alias("orphans"))
    facts = parsed.groupBy("case_id").agg(
        F.max((~F.col("readable") | F.col("turn").isNull() | F.col("question").isNull()).cast("int")).alias("unreadable"),
        F.count(F.lit(1)).alias("n"),
        F.max("turn").alias("last"),
        F.max(F.col("answer").isNull().cast("int")).alias("silent"),
        F.max((F.coalesce(_blank(F.col("question")), F.lit(False)) | F.coalesce(_blank(F.col("answer")), F.lit(False))).cast("int")).alias("blank"),
    )
    all_of = facts.join(orphans, "case_id", "left").join(length, "case_id", "left").join(wrong, "case_id", "left")
    reason = (
        F.when((F.col("unreadable") == 1) | (F.coalesce("orphans", F.lit(0)) == 1) | (F.col("n") != F.col("last") + 1), "broken")
        .when(F.col("silent") == 1, "missing_reply")
        .when(F.col("blank") == 1, "empty")
        .when((F.coalesce("misfit", F.lit(0)) == 1) | (F.coalesce("strayed", F.lit(0)) == 1), "broken")
    )
    return all_of.select("case_id", reason.alias("reason")), resolved


def conversations(attempts: DataFrame) -> DataFrame:
    """Whole conversations as ordered messages ``(case_id, position, role, content)``."""
    parsed = cut(turns(attempts))
    verdict, _ = judge(parsed)
    kept = verdict.where("reason is null").select("case_id")
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return (
        parsed.join(kept, "case_id", "left_semi")
        .select("case_id", "turn", F.posexplode(both).alias("side", "m"))
        .select("case_id", (F.col("turn") * 2 + F.col("side")).alias("position"), "m.role", "m.content")
    )


def conversation_lists(messages: DataFrame, part: int = LIST_PART) -> DataFrame:
    """``(case_id, part, messages)``: ordered lists of at most ``part`` messages, so that no
    task collects an unbounded conversation. Nearly every conversation is one part."""
    cell = F.struct("position", "role", "content")
    lists = messages.groupBy("case_id", F.floor(F.col("position") / part).cast("int").alias("part")).agg(F.sort_array(F.collect_list(cell)).alias("m"))
    return lists.select("case_id", "part", F.transform("m", lambda m: F.struct(m.getField("role").alias("role"), m.getField("content").alias("content"))).alias("messages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to drop with their reason."""
    verdict, _ = judge(cut(turns(table(spark, sf_dir, "attempts"))))
    return verdict.where("reason is not null").select("case_id", "reason")


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered messages of every whole conversation."""
    return conversations(table(spark, sf_dir, "attempts"))


def p7_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as lists, written as JSON text."""
    return conversation_lists(conversations(table(spark, sf_dir, "attempts"))).select("case_id", "part", F.size("messages").alias("n_messages"), F.to_json("messages").alias("messages"))


QUERIES = {"p7_found": p7_found, "p7_messages": p7_messages, "p7_lists": p7_lists}

_SQL = r"""
WITH states AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY recorded_at DESC, (response IS NOT NULL) DESC) AS rn FROM attempts WHERE case_id IS NOT NULL
), t AS (
  SELECT case_id, turn, coalesce(json_valid(request), false) AND (response IS NULL OR json_valid(response)) AS readable,
         CASE WHEN json_valid(request) THEN request END AS req, CASE WHEN json_valid(response) THEN response END AS res
  FROM states WHERE rn = 1
), p AS (
  SELECT case_id, turn, readable, req ->> '$.question' AS q, res ->> '$.answer.answer' AS a, json_extract_string(req, '$.history[*].content') AS h FROM t
), s AS (
  SELECT *, flatten(coalesce(list(CASE WHEN a IS NULL THEN [] ELSE [q, a] END) OVER (PARTITION BY case_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS expected,
         regexp_full_match(q, '[\s\p{Z}\p{Cf}\p{Cc}]*') OR regexp_full_match(a, '[\s\p{Z}\p{Cf}\p{Cc}]*') AS blank FROM p
), v AS (
  SELECT case_id, bool_or(NOT readable OR turn IS NULL OR q IS NULL) OR count(*) <> max(turn) + 1 OR count(DISTINCT turn) <> count(*) OR min(turn) <> 0 AS broken,
         bool_or(a IS NULL) AS silent, coalesce(bool_or(blank), false) AS blank, bool_or(coalesce(h, []) IS DISTINCT FROM expected) AS strayed
  FROM s GROUP BY case_id
), verdict AS (
  SELECT case_id, CASE WHEN broken THEN 'broken' WHEN silent THEN 'missing_reply' WHEN blank THEN 'empty' WHEN strayed THEN 'broken' END AS reason FROM v
)
"""

ORACLES = {
    "p7_found": _SQL + "SELECT case_id, reason FROM verdict WHERE reason IS NOT NULL",
    "p7_messages": _SQL
    + """SELECT case_id, (turn * 2)::INT AS position, 'user' AS role, q AS content FROM p JOIN verdict USING (case_id) WHERE reason IS NULL
UNION ALL SELECT case_id, (turn * 2 + 1)::INT, 'assistant', a FROM p JOIN verdict USING (case_id) WHERE reason IS NULL""",
}

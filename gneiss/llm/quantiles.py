"""Percentiles of very large numeric columns (problem 6).

Spark's KLL aggregate is a hierarchy of randomized compactors: a full level is sorted and
every other value, from a random start, moves one level up with twice the weight. Sketches
merge level by level, so sketches of separate days, files or partitions combine into the
sketch of their union. With parameter ``k`` the rank of an answer is off by at most about
``2.3 / k ** 0.9`` of n with 99 % probability (0.13 % for the default); up to ``k`` values
the answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.runtime import hash128, table

DEFAULT_K = 4096


def usable(rows: DataFrame, groups: Sequence[Column], key: Sequence[Column], value: Column) -> DataFrame:
    """One row ``(*groups, value)`` for each key of a group whose value is finite and above 0.

    NULL, NaN, infinite, zero and negative values are left out before the shuffle. Repeated
    rows of one key count once, with the largest value where they differ. A row of which all
    key columns are NULL can't be told from another and counts once per group and value.
    """
    v = value.cast("double")
    h = hash128(*key)
    known = F.coalesce(*[k.isNotNull() & F.lit(True) for k in key]) if len(key) == 1 else F.greatest(*[k.isNotNull() for k in key])
    slim = rows.where((v > 0) & (v < F.lit(float("inf"))) & ~F.isnan(v)).select(
        *groups, h.getField("a").alias("_a"), F.when(known, h.getField("b")).otherwise(F.xxhash64(v)).alias("_b"), v.alias("value")
    )
    names = [c for c in slim.columns if c not in ("_a", "_b", "value")]
    return slim.groupBy(*names, "_a", "_b").agg(F.max("value").alias("value")).drop("_a", "_b")


def sketch(rows: DataFrame, groups: Sequence[str], value: str = "value", k: int = DEFAULT_K) -> DataFrame:
    """One mergeable sketch a group. Values are compacted in every task before the shuffle, so
    a group that holds most rows moves no more data than any other. NULL values are ignored;
    a group without values has none (no row for an empty input)."""
    return rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"), F.count(value).alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str], k: int = DEFAULT_K) -> DataFrame:
    """Combine sketches, of days or files say, into one a group."""
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], pcts: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """``(*groups, n, pct, value)``: the least value whose rank reaches ``pct`` percent."""
    ranks = F.array(*[F.lit(p / 100.0) for p in pcts])
    return sketches.select(*groups, "n", F.posexplode(F.kll_sketch_get_quantile_double("sketch", ranks)).alias("_at", "value")).select(
        *groups, "n", F.element_at(F.array(*[F.lit(int(p)) for p in pcts]), F.col("_at") + 1).alias("pct"), "value"
    )


def latencies(spark: SparkSession, sf_dir: str, day: bool = False) -> DataFrame:
    """Usable latencies of the three tables as ``(source_table, grp[, day], value)``."""

    def part(name: str, grp: str, key: list[str], value: str, when: str) -> DataFrame:
        at = [F.to_date(when).alias("day")] if day else []
        return usable(table(spark, sf_dir, name), [F.lit(name).alias("source_table"), F.col(grp).alias("grp"), *at], [F.col(c) for c in key], F.col(value))

    return (
        part("responses", "scope", ["cache_key"], "latency_ms", "recorded_at")
        .unionByName(part("results", "run_id", ["run_id", "case_id"], "latency_seconds", "recorded_at"))
        .unionByName(part("saved_answers", "run_id", ["request_id"], "elapsed_seconds", "saved_at"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose percentile is above the limit of their table."""
    groups = ["source_table", "grp"]
    found = percentiles(sketch(latencies(spark, sf_dir).where(F.col("grp").isNotNull()), groups), groups)
    limits = table(spark, sf_dir, "latency_limits").select("source_table", F.col("pct").cast("int").alias("pct"), "max_value")
    # nine rows, fixed
    return found.join(F.broadcast(limits), ["source_table", "pct"]).where(F.col("value") > F.col("max_value")).select("source_table", "grp", "pct").distinct()


def p6_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of separate days merged into percentiles a group: count and values, rounded."""
    groups = ["source_table", "grp"]
    daily = sketch(latencies(spark, sf_dir, day=True), [*groups, "day"])
    return percentiles(merge(daily, groups), groups).select(*groups, "n", "pct", F.round("value", 3).alias("value"))


QUERIES = {"p6_found": p6_found, "p6_daily": p6_daily}

ORACLES = {
    "p6_found": """
WITH v AS (
  SELECT 'responses' AS source_table, scope AS grp, cache_key AS k, max(latency_ms) AS v FROM responses WHERE latency_ms > 0 AND isfinite(latency_ms) GROUP BY ALL
  UNION ALL SELECT 'results', run_id, run_id || '/' || case_id, max(latency_seconds) FROM results WHERE latency_seconds > 0 AND isfinite(latency_seconds) GROUP BY ALL
  UNION ALL SELECT 'saved_answers', run_id, request_id, max(elapsed_seconds) FROM saved_answers WHERE elapsed_seconds > 0 AND isfinite(elapsed_seconds) GROUP BY ALL
), r AS (
  SELECT source_table, grp, v, row_number() OVER (PARTITION BY source_table, grp ORDER BY v) AS at, count(*) OVER (PARTITION BY source_table, grp) AS n FROM v WHERE grp IS NOT NULL
)
SELECT r.source_table, r.grp, l.pct FROM r JOIN latency_limits l ON l.source_table = r.source_table AND r.at = (r.n * l.pct + 99) // 100 WHERE r.v > l.max_value""",
}

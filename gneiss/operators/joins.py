"""Joins with semantics beyond equality: intervals, as-of, proofs, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.runtime import cut, hash128


def interval_join(values: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of ``values`` with the ``ranges`` for which lo <= value <= hi (NULL hi: no end is
    taken as lo). Ranges are copied to the buckets of ``width`` they touch, so the join is an
    equi-join on the bucket; choose ``width`` near the usual length of a range."""
    end = F.coalesce(F.col(hi), F.col(lo))
    r = ranges.where(F.col(lo).isNotNull() & (end >= F.col(lo))).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(end / width))))
    v = values.withColumn("_b", F.floor(F.col(value) / width))
    on = (v["_b"] == r["_b"]) & (v[value] >= r[lo]) & (v[value] <= F.coalesce(r[hi], r[lo]))
    return v.join(r, on, how).drop("_b")


def unique_match(joined: DataFrame, key: Sequence[str]) -> DataFrame:
    """Only those keys that matched exactly once."""
    return joined.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("_n = 1").drop("_n")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, take: Sequence[str]) -> DataFrame:
    """Each left row with ``take`` of the latest right row of the same ``by`` at or before its
    time (NULL without one). Both sides are sorted once by key and time in one shuffle, and the
    last right row is carried along; at equal times right rows come first, the one with the
    greatest values last. Left rows with NULL key or time keep NULLs."""
    carried = F.struct(F.col(right_time).alias("_at"), *[F.col(c) for c in take])
    r = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(F.col(by).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_r"))
    l = left.select(F.col(by).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    hit = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    return out.select("_l.*", *[F.when(hit, F.col(f"_m.{c}")).alias(f"asof_{c}") for c in take])


def effective_at(versions: DataFrame, start: str, end: str, at: Column) -> DataFrame:
    """Versions valid at a time: start <= at < end, an unknown end being open."""
    return versions.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


def without_superseded(eligible: DataFrame, key: str, replaces: str) -> DataFrame:
    """Leave out rows that another eligible row says it replaces."""
    gone = eligible.select(F.explode_outer(replaces).alias(key)).where(F.col(key).isNotNull()).distinct()
    return eligible.join(gone, key, "left_anti")


def hydrate(ids: DataFrame, records: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """Join ids to their records; a key whose records differ in ``identity`` is marked
    ``conflict`` instead of being resolved silently."""
    one = records.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(c) for c in identity], (F.count_distinct(hash128(*[F.col(c) for c in identity])) > 1).alias("conflict"))
    return ids.join(one, key, "left")


def mentions(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``(key, begin, end, word)`` of every match of ``pattern`` in a text, however often a word is
    repeated. Positions count characters from 1, ``end`` is exclusive. The text is cut at its
    matches, so that a match begins after all pieces and matches before it. ``key`` names one row;
    NULL or empty texts have no match; ``pattern`` must not match an empty string."""
    words = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    parts = rows.select(F.col(key), F.posexplode(F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(words)).alias("gap"), words.alias("word"))).alias("at", "m"))
    upto = F.sum(F.length("m.gap") + F.length("m.word")).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("end", (upto + 1).cast("int")).select(key, (F.col("end") - F.length("m.word")).alias("begin"), "end", F.col("m.word").alias("word"))


def maximal_spans(spans: DataFrame, group: str, begin: str, end: str) -> DataFrame:
    """Spans that no longer span of the group contains: a span is inside another exactly if the
    furthest end among those that start before it, or with it but reach further, covers it."""
    w = Window.partitionBy(group).orderBy(begin, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.dropDuplicates([group, begin, end]).withColumn("_far", F.max(end).over(w)).where(F.col("_far").isNull() | (F.col("_far") < F.col(end))).drop("_far")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: connected components named by their least node, by alternating
    large-star and small-star contraction, a logarithmic number of rounds in practice. Each
    round is written to the shared folder; only a count reaches the driver. Self links name
    their node; NULLs are ignored."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = cut(e.select("u").union(e.select("v")).distinct().withColumnRenamed("u", "node"))
    e = cut(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        new = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def relation_lookup(edges: DataFrame, asked: DataFrame, kind: str, most: int = 40, blocked: DataFrame | None = None) -> DataFrame:
    """Answer many relation requests at once. ``edges`` is (doc, dependent, prerequisite),
    ``asked`` (doc, code). ``direct`` needs exactly one edge, ``chain2`` exactly one at either
    hop and no return to the start, ``inverse`` lists all dependents unless the document or code
    is ``blocked`` (doc, code; '*' for all) or there are more than ``most``. Requests that fail
    a rule have no row."""
    e = edges.where("doc is not null and dependent is not null and prerequisite is not null").select("doc", "dependent", "prerequisite").distinct()
    q = asked.select("doc", "code").distinct()
    if kind == "inverse":
        hit = q.join(e, (q["doc"] == e["doc"]) & (q["code"] == e["prerequisite"])).select(q["doc"], q["code"], F.col("dependent").alias("found"))
        if blocked is not None:
            bad = blocked.select("doc", F.col("code").alias("_c"))
            hit = hit.join(bad, (hit["doc"] == bad["doc"]) & ((bad["_c"] == hit["code"]) | (bad["_c"] == "*")), "left_anti")
        return hit.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc", "code"))).where(F.col("_n") <= most).drop("_n")
    one = e.groupBy("doc", "dependent").agg(F.count(F.lit(1)).alias("_n"), F.min("prerequisite").alias("found")).where("_n = 1").drop("_n")
    first = q.join(one, (q["doc"] == one["doc"]) & (q["code"] == one["dependent"])).select(q["doc"], q["code"], "found")
    if kind == "direct":
        return first
    second = one.select(F.col("doc").alias("_d"), F.col("dependent").alias("_m"), F.col("found").alias("_f"))
    return first.join(second, (first["doc"] == second["_d"]) & (first["found"] == second["_m"])).where("_f != code and _f != found").select("doc", "code", F.col("found").alias("via"), F.col("_f").alias("found"))

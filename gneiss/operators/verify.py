"""Verification of claims against cited evidence, and the decision that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import detected_codes, fold, overlap, tokens

SUPPORTED, PARTIAL, MARKED, CONFLICT = 0.55, 0.25, 0.8, 0.35


def markers(text: Column) -> Column:
    """Exact marks of a text that its evidence must share: codes, numbers outside words,
    polarity and bounds, each as kind:value."""
    f = fold(F.coalesce(text, F.lit("")))
    codes = F.transform(detected_codes(F.coalesce(text, F.lit(""))), lambda c: F.concat(F.lit("code:"), F.lower(c)))
    numbers = F.transform(F.regexp_extract_all(f, F.lit(r"(?<![\p{L}\p{N}_.,])(\d+(?:[.,]\d+)?)(?![\p{L}\p{N}_])"), F.lit(1)), lambda n: F.concat(F.lit("value:"), F.replace(n, F.lit(","), F.lit("."))))
    one = lambda p, m: F.when(f.rlike(p), F.array(F.lit(m))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(one(r"\b(?:at least|minimum|toi thieu|it nhat|au moins)\b", "qualifier:minimum"), one(r"\b(?:at most|maximum|toi da|nhieu nhat|au plus)\b", "qualifier:maximum"), one(r"\b(?:not|never|khong|chua|ne|pas)\b", "polarity:negative"))
    return F.array_distinct(F.concat(codes, numbers, flags))


def _polarity(text: Column) -> Column:
    """``negative`` or ``positive`` where a text says that something is not, or is, required."""
    f = fold(F.coalesce(text, F.lit("")))
    negative = f.rlike(r"\b(?:not (?:required?|requires|mandatory)|khong (?:bat buoc|can))\b")
    return F.when(negative, "negative").when(f.rlike(r"\b(?:required?|requires|must|bat buoc|phai|can)\b"), "positive")


def _literal(text: Column) -> Column:
    """The words of a clause without its negations, and whether their number is odd."""
    t = F.lower(F.replace(text, F.lit("\u2019"), F.lit("'")))
    for short, full in ((r"\bcan't\b", "can not"), (r"\bwon't\b", "will not"), (r"\bshan't\b", "shall not"), (r"\b([a-z]+)n't\b", "$1 not")):
        t = F.regexp_replace(t, short, full)
    words = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    no = lambda w: w.isin("not", "never", "không", "chẳng", "chưa")
    return F.struct(F.array_join(F.filter(words, lambda w: ~no(w)), " ").alias("core"), (F.size(F.filter(words, no)) % 2).alias("odd"))


def _cover(candidates: Column, words: Column, marks: Column) -> Column:
    """Items taken greedily from ``candidates (o, item, words, marks)``, best overlap first, until
    their words reach SUPPORTED of the claim's and their marks are all of the claim's."""
    enough = lambda w, m: (overlap(words, w) >= SUPPORTED) & (F.size(F.array_except(marks, m)) == 0)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("items"), none.alias("words"), none.alias("marks"))

    def step(a, x):
        new = (F.size(F.array_except(x["words"], a["words"])) > 0) | (F.size(F.array_except(F.array_intersect(x["marks"], marks), a["marks"])) > 0)
        grown = F.struct(F.concat(a["items"], F.array(x["item"])).alias("items"), F.array_union(a["words"], x["words"]).alias("words"), F.array_union(a["marks"], x["marks"]).alias("marks"))
        return F.when(new & ~enough(a["words"], a["marks"]), grown).otherwise(a)

    share = lambda a: F.when((F.size(F.array_except(marks, a["marks"])) == 0), F.round(overlap(words, a["words"]), 9)).otherwise(0.0)
    return F.aggregate(candidates, start, step, lambda a: F.struct(a["items"].alias("items"), share(a).alias("share")))


def align(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(claim_id, text, best, status, evidence)`` of ``claims (claim_id, scope, text)`` against
    the ``evidence (scope, item_id, content)`` of the same scope. A claim with ``citation_ids``
    meets only the items they name, and is unsupported if one of them is missing; without them,
    or where none names an item of the scope, it meets all items. A candidate counts by the share
    of the claim's words it holds, only if it has all the claim's marks and doesn't say the
    opposite polarity, then at least 0.8; several candidates also count together, by what a greedy
    cover holds of the claim. A candidate that shares words but contradicts the marks makes a
    conflict, and one with the same clause but for a negation contradicts the claim outright. Several equal
    candidates below PARTIAL are ambiguous. A claim without any evidence is unsupported."""
    none = F.array().cast("array<string>")
    c = claims if "citation_ids" in claims.columns else claims.withColumn("citation_ids", none)
    c = c.withColumn("_ids", F.array_distinct(F.coalesce("citation_ids", none)))
    named = evidence.select("scope", F.col("item_id").alias("_id")).where("_id is not null").distinct()
    hits = c.select("claim_id", "scope", F.explode("_ids").alias("_id")).join(named, ["scope", "_id"]).groupBy("claim_id", "scope").agg(F.count(F.lit(1)).alias("_named"))
    c = c.join(hits, ["claim_id", "scope"], "left").withColumn("_mapped", F.col("_named").isNotNull())
    c = c.withColumn("_missing", F.coalesce(F.col("_named") < F.size("_ids"), F.lit(False)))
    c = c.withColumn("_ct", F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).withColumn("_cm", F.filter(markers(F.col("text")), lambda m: ~m.startswith("polarity:")))
    c = c.withColumn("_cp", _polarity(F.col("text"))).withColumn("_cl", _literal(F.coalesce("text", F.lit(""))))
    body = F.coalesce("content", F.lit(""))
    e = evidence.withColumn("_et", F.array_distinct(tokens(body))).withColumn("_em", markers(F.col("content"))).withColumn("_ep", _polarity(F.col("content")))
    e = e.withColumn("_el", F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), _literal)).select(F.col("scope").alias("_scope"), "item_id", "_et", "_em", "_ep", "_el")
    j = c.join(e, (F.col("scope") == F.col("_scope")) & (~F.col("_mapped") | F.array_contains("_ids", F.col("item_id"))), "left").withColumn("_ov", F.round(F.coalesce(overlap(F.col("_ct"), F.col("_et")), F.lit(0.0)), 9))
    em = F.coalesce("_em", none)
    opposite = F.coalesce(F.col("_cp") != F.col("_ep"), F.lit(False))
    ok = (F.size(F.array_except("_cm", em)) == 0) & F.col("item_id").isNotNull() & ~opposite
    score = F.when(ok & (F.size("_cm") > 0), F.greatest(F.col("_ov"), F.lit(MARKED))).when(ok, F.col("_ov")).otherwise(0.0)
    against = ~ok & (F.col("_ov") >= CONFLICT) & ((F.size(em) > 0) | opposite)
    denied = (F.size(F.split(F.col("_cl.core"), " ")) >= 2) & F.exists(F.coalesce("_el", F.array().cast("array<struct<core: string, odd: int>>")), lambda x: (x["core"] == F.col("_cl.core")) & (x["odd"] != F.col("_cl.odd")))
    useful = F.col("item_id").isNotNull() & ~opposite & ((F.col("_ov") >= 0.2) | F.arrays_overlap("_cm", em))
    part = F.when(useful, F.struct((-F.col("_ov")).alias("o"), F.col("item_id").alias("item"), F.col("_et").alias("words"), em.alias("marks")))
    g = j.withColumn("_s", score).groupBy("claim_id", "scope", "text").agg(
        F.max("_s").alias("_one"), F.max(against.cast("int")).alias("_against"), F.max(denied.cast("int")).alias("_denied"), F.min_by("item_id", F.struct(-F.col("_s"), "item_id")).alias("evidence"),
        F.collect_list(F.col("_s")).alias("_all"), F.sort_array(F.collect_list(part)).alias("_parts"), F.first("_ct").alias("_ct"), F.first("_cm").alias("_cm"), F.first("_missing").alias("_missing"),
    )
    g = g.withColumn("_cover", _cover(F.col("_parts"), F.col("_ct"), F.col("_cm")))
    covers = (F.size("_cover.items") > 1) & (F.col("_cover.share") >= SUPPORTED)
    best = F.when((F.col("_denied") == 1) | F.col("_missing"), 0.0).when(covers, F.greatest("_one", "_cover.share")).otherwise(F.col("_one"))
    g = g.withColumn("evidence", F.when(covers & (F.col("_one") < F.col("_cover.share")), F.element_at("_cover.items", 1)).otherwise(F.col("evidence"))).withColumn("best", best)
    several = (F.col("best") > 0) & (F.size(F.filter("_all", lambda x: x == F.col("_one"))) > 1)
    status = F.when(F.col("_denied") == 1, "contradicted").when(F.col("best") >= SUPPORTED, "supported").when(F.col("best") >= PARTIAL, "partial").when(F.col("_against") == 1, "contradicted").when(several, "ambiguous").otherwise("unsupported")
    return g.select("claim_id", "scope", "text", F.round("best", 6).alias("best"), status.alias("status"), F.when(F.col("best") > 0, F.col("evidence")).alias("evidence"))


def handles(results: DataFrame, by: str, item: str, order: Sequence[Column], prefix: str = "ev") -> DataFrame:
    """``(by, item, handle)``: short names of the items of each request, numbered from 1 in the order in
    which they first come."""
    first = results.where(F.col(by).isNotNull() & F.col(item).isNotNull()).groupBy(by, item).agg(F.min(F.struct(*order)).alias("_o"))
    return first.select(by, item, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(by).orderBy("_o", item))).alias("handle"))


def restore_handles(cited: DataFrame, known: DataFrame, by: str, handle: str, item: str) -> DataFrame:
    """``cited`` with the ``item`` that each handle names in its own request, and ``error`` for a handle,
    or NULL, that names none there; full item ids are no handles."""
    k = known.select(F.col(by).alias("_by"), F.col("handle").alias("_h"), F.col(item))
    j = cited.join(k, (cited[by] == k["_by"]) & (cited[handle] == k["_h"]), "left").drop("_by", "_h")
    return j.withColumn("error", F.when(F.col(item).isNull(), "unknown_handle"))


def decide(aligned: DataFrame, flags: DataFrame) -> DataFrame:
    """``(scope, status, reason)`` for every row of ``flags (scope, provider_error,
    invalid_citation, has_conflict, ambiguous, provider_abstained)`` by ordered rules."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    c = aligned.groupBy("scope").agg(has("contradicted").alias("contradicted"), has("ambiguous").alias("unclear"), F.bool_or(F.col("status").isin("unsupported", "partial")).alias("weak"))
    d = flags.join(c, "scope", "left")
    t = lambda x: F.coalesce(F.col(x), F.lit(False))
    reason = (
        F.when(t("provider_error"), "provider_error").when(t("invalid_citation"), "invalid_citation").when(t("contradicted"), "contradicted_claim").when(t("has_conflict"), "conflicting_evidence")
        .when(t("unclear") | t("ambiguous"), "ambiguous_question").when(t("weak"), "unsupported_claim").when(t("provider_abstained"), "provider_abstained")
    )
    return d.select("scope", F.when(reason.isNull(), "answered").otherwise("abstained").alias("status"), reason.alias("reason"))

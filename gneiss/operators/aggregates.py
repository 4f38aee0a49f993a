"""Fail-closed aggregates, calibration and service metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimous(value: Column) -> Column:
    """The one value of a group, or NULL where values differ or any is NULL."""
    return F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1))), F.min(value))


def labelled(value: Column, place: Column) -> Column:
    """First spelling of the one value that a group has apart from case and NULLs, else NULL."""
    low = F.lower(value)
    return F.when(F.min(low) == F.max(low), F.min_by(value, F.when(value.isNotNull(), place)))


def unanimous_sum(rows: DataFrame, group: Sequence[str], key: str, value: str, most: int = 10) -> DataFrame:
    """Sum over the distinct keys of a group of their unanimous values; NULL where any key is
    ambiguous or there are more than ``most`` keys."""
    one = rows.groupBy(*group, key).agg(unanimous(F.col(value)).alias("_v"))
    return one.groupBy(*group).agg(F.when((F.count("_v") == F.count(F.lit(1))) & (F.count(F.lit(1)) <= most), F.sum("_v")).alias("total"), F.count(F.lit(1)).alias("keys"))


def numeric_conflicts(rows: DataFrame, group: str, text: str) -> DataFrame:
    """``(signature, docs, variants)`` of sentences that agree but for their numbers and state
    more than one set of them. The signature is the folded sentence with numbers masked; digits
    within words, such as codes, belong to it."""
    from gneiss.functions.text import fold, sentences

    s = rows.select(F.col(group).alias("g"), F.explode_outer(sentences(F.col(text))).alias("s")).where("s is not null").select("g", fold(F.col("s")).alias("s"))
    number = r"(?<![\p{L}\p{N}_])[+-]?\d+(?:[.,]\d+)?(?![\p{L}\p{N}_])"
    parts = s.select("g", F.regexp_replace("s", number, "#").alias("signature"), F.array_join(F.regexp_extract_all("s", F.lit(f"({number})"), F.lit(1)), " ").alias("numbers")).where("numbers != ''")
    distinct = parts.groupBy("signature", "numbers").agg(F.count_distinct("g").alias("d"))
    return distinct.groupBy("signature").agg(F.sum("d").alias("docs"), F.count(F.lit(1)).alias("variants")).where("variants > 1")


def metric_summary(rows: DataFrame, group: Sequence[str], value: str, pcts: Sequence[int] = (50, 95, 99), ties_to_even: bool = True) -> DataFrame:
    """Exact percentiles ``(*group, n, p50, ...)``. With ``ties_to_even`` the place is
    round(p/100 * n + 0.5), halves to even, as a service metric reports it; without, it is the
    nearest rank ceil(p/100 * n). NULL and NaN values and rows with a NULL group are left out.

    Values are counted by value, then by ranges of value; only the range that holds a place is
    put in order, so no task sorts a whole group."""
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", value_range(F.col(value)))
    w = Window.partitionBy(*group)
    ranges = counts.groupBy(*group, "_b").agg(F.sum("_c").alias("_k"))
    ranges = ranges.withColumn("n", F.sum("_k").over(w)).withColumn("_u", F.sum("_k").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))

    def place(p: int) -> Column:
        raw = F.bround(F.lit(p / 100.0) * F.col("n") + 0.5) if ties_to_even else F.floor((F.col("n") * F.lit(p) + 99) / 100)
        return F.least(F.col("n"), F.greatest(F.lit(1), raw.cast("long")))

    wanted = ranges.select(*group, "_b", "n", "_u", "_k", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), place(p).alias("at")) for p in pcts])).alias("t")).where("t.at <= _u and t.at > _u - _k")
    wanted = wanted.select(*group, "_b", "n", F.col("t.p").alias("_p"), (F.col("t.at") - (F.col("_u") - F.col("_k"))).alias("_at"))
    inside = counts.join(wanted, [*group, "_b"]).withColumn("_run", F.sum("_c").over(Window.partitionBy(*group, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).where("_run >= _at")
    return inside.groupBy(*group).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_p") == p, F.col(value))).alias(f"p{p}") for p in pcts])


def value_range(v: Column, fine: int = 128) -> Column:
    """Number of a range of values, ascending with the value: about ``fine`` ranges to each factor
    of e."""
    x = v.cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * fine).cast("long")


def calibration(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row ``(n, brier, ece)`` for scores in [0, 1] against 0/1 labels; other scores and NULLs
    are left out. The last of the equal bins is closed at 1."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    ok = rows.where(F.col(score).between(0, 1) & F.col(label).isNotNull()).select(F.col(score).alias("s"), F.col(label).cast("double").alias("y"))
    by = ok.groupBy(F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("s").alias("ss"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("s") - F.col("y"), 2)).alias("sq"))
    return by.agg(F.sum("k").alias("n"), F.round(F.sum("sq") / F.sum("k"), 6).alias("brier"), F.round(F.sum(F.abs(F.col("ss") - F.col("sy"))) / F.sum("k"), 6).alias("ece"))


def threshold_sweep(rows: DataFrame, score: str, label: str, min_recall: float = 0.85, max_fpr: float = 0.05) -> DataFrame:
    """The highest threshold among 0 and the scores that keeps recall and false-positive rate,
    as ``(threshold, recall, fpr)``; no row if none does or a class is missing. Scores are
    counted first, the ordered pass runs over distinct scores."""
    by = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    by = by.unionByName(rows.sparkSession.createDataFrame([(0.0, 0, 0)], "s double, p long, q long")).groupBy("s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    by = by.withColumn("_b", value_range(F.col("s"), 4096))
    down = Window.partitionBy("_b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # over ranges of score, some thousands
    ranges = by.groupBy("_b").agg(F.sum("p").alias("rp"), F.sum("q").alias("rq")).select("_b", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("up"), F.coalesce(F.sum("rq").over(above), F.lit(0)).alias("uq"))
    total = by.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    run = by.join(ranges, "_b").select("s", (F.col("up") + F.sum("p").over(down)).alias("ap"), (F.col("uq") + F.sum("q").over(down)).alias("aq")).crossJoin(F.broadcast(total)).where("tp > 0 and tq > 0")  # total: one row
    ok = run.select(F.round("s", 8).alias("threshold"), (F.col("ap") / F.col("tp")).alias("recall"), (F.col("aq") / F.col("tq")).alias("fpr")).where((F.col("recall") >= min_recall) & (F.col("fpr") <= max_fpr))
    return ok.orderBy(F.desc("threshold"), F.desc("recall"), "fpr").limit(1)


def isotonic(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Step-function isotonic fit ``(threshold, value)``: pooled adjacent violators over the
    distinct clamped scores. Partitions of a score range pool on their own first, which leaves
    the blocks of the whole unchanged; what remains is pooled once more. Values are rounded to
    eight places."""
    import pandas as pd

    clean = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    by = clean.groupBy(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))).alias("hi")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("y"))

    def pool(batches):
        blocks: list[list[float]] = []
        for pdf in batches:
            for hi, n, y in pdf.sort_values("hi").itertuples(index=False):
                blocks.append([hi, n, y])
                while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] > blocks[-1][2] * blocks[-2][1]:
                    h, n1, y1 = blocks.pop()
                    blocks[-1] = [h, blocks[-1][1] + n1, blocks[-1][2] + y1]
        yield pd.DataFrame(blocks, columns=["hi", "n", "y"])

    schema = "hi double, n double, y double"
    local = by.repartitionByRange("hi").sortWithinPartitions("hi").mapInPandas(pool, schema)
    merged = local.repartition(1).sortWithinPartitions("hi").mapInPandas(pool, schema)
    return merged.select(F.col("hi").alias("threshold"), F.round(F.col("y") / F.col("n"), 8).alias("value"))


def isotonic_predict(rows: DataFrame, score: str, steps: DataFrame) -> DataFrame:
    """Add ``calibrated``: the value of the first threshold not below the score, else the last.
    A fit has at most as many steps as distinct scores in [0, 1] at eight places; the steps are
    gathered into one array row."""
    arr = steps.agg(F.sort_array(F.collect_list(F.struct("threshold", "value"))).alias("_steps"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    hit = F.filter("_steps", lambda x: x["threshold"] >= s)
    return rows.crossJoin(F.broadcast(arr)).withColumn("calibrated", F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.try_element_at("_steps", F.lit(-1))["value"])).drop("_steps")


def fingerprint(rows: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-independent SHA-256 of a group's distinct rows, through the hashes of its rows."""
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)
    part = rows.select(*group, one.alias("_h")).distinct().groupBy(*group, F.substring("_h", 1, 2).alias("_p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), ""), 256).alias("_s"))
    return part.groupBy(*group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("_p", "_s"))), ""), 256).alias("fingerprint"))  # at most 256 parts


def recurring_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``(doc, line, pages)``: lines among the first two of a page that recur on at least
    max(3, half) of the document's pages."""
    lines = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode_outer(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\n\f]"), lambda x: F.trim(x) != ""), 1, 2)).alias("pos", "line")).where("line is not null")
    n = pages.groupBy(F.col(doc).alias("doc")).agg(F.count_distinct(page).alias("n"))
    found = lines.groupBy("doc", F.trim("line").alias("line")).agg(F.count_distinct("page").alias("pages"))
    return found.join(n, "doc").where(F.col("pages") >= F.greatest(F.lit(3), F.floor((F.col("n") + 1) / 2))).select("doc", "line", "pages")


def canary(windows: DataFrame, by: str, order: str) -> DataFrame:
    """Health of ordered metric windows: ``state`` rollback with its reason, healthy or waiting, and
    ``promoted``, how many traffic steps have been earned so far.

    Budgets are checked in a fixed order; three latency failures in a row roll back, and a rollback
    holds for all later windows with its first reason. Every three healthy windows in a row earn a
    step; a window that waits starts the count anew."""
    w = Window.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    slow = (F.col("p95") > 1000) | (F.col("p99") > 2000)
    d = windows.withColumn("_slow", slow.cast("int"))
    three = (F.col("_slow") + F.lag("_slow", 1, 0).over(w) + F.lag("_slow", 2, 0).over(w)) == 3
    few = F.col("requests") < 100
    d = d.withColumn("_bad", F.when(~few & (F.col("error_rate") > F.col("baseline_error_rate")), "error_rate_regression").when(~few & three, "latency_budget_three_windows"))
    d = d.withColumn("_first", F.first("_bad", ignorenulls=True).over(upto))
    d = d.withColumn("state", F.when(F.col("_first").isNotNull(), "rollback").when(few | (F.col("_slow") == 1), "waiting").otherwise("healthy"))
    d = d.withColumn("reason", F.coalesce("_first", F.when(few, "insufficient_observations")))
    # runs of healthy windows: islands between the others
    d = d.withColumn("_island", F.sum((F.col("state") != "healthy").cast("int")).over(upto))
    nth = F.sum((F.col("state") == "healthy").cast("int")).over(Window.partitionBy(by, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    earned = (F.col("state") == "healthy") & (F.col("_nth") % 3 == 0)
    return d.withColumn("_nth", nth).withColumn("promoted", F.sum(earned.cast("int")).over(upto)).drop("_slow", "_bad", "_first", "_island", "_nth")

"""Ordered state: islands, heading stacks, running sums, rolling windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import heading_level


def lines_of(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, line)`` of every line of every item."""
    return items.select(F.col(key), F.posexplode_outer(F.split(F.coalesce(text, F.lit("")), r"[\n\f]")).alias("pos", "line"))


def sections(lines: DataFrame, key: str) -> DataFrame:
    """Add ``level`` (0 for body lines), ``section`` (number of headings so far) and ``offset``
    (characters of the section before the line)."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("level", heading_level(F.col("line"))).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    before = Window.partitionBy(key, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def heading_paths(leveled: DataFrame, key: str, depth: int = 6) -> DataFrame:
    """Add ``heading_path``: for each line the open heading of every level, a heading closing all
    deeper ones. A level's last heading is open if none of a lesser level came after it."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = leveled
    for k in range(1, depth + 1):
        d = d.withColumn(f"_p{k}", F.max(F.when(F.col("level") == k, F.col("pos"))).over(w)).withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.trim("line")), ignorenulls=True).over(w))
    open_ = lambda k: F.col(f"_p{k}").isNotNull() & F.coalesce(F.col(f"_p{k}") > F.greatest(F.lit(-1), *[F.coalesce(f"_p{j}", F.lit(-1)) for j in range(1, k)]), F.lit(True)) if k > 1 else F.col("_p1").isNotNull()
    path = F.array_compact(F.array(*[F.when(open_(k), F.col(f"_h{k}")) for k in range(1, depth + 1)]))
    return d.withColumn("heading_path", path).drop(*[f"_{x}{k}" for x in "ph" for k in range(1, depth + 1)])


def numbered_runs(lines: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Lines of at least ``least`` consecutively numbered list entries, with their ``run``."""
    n = F.regexp_extract("line", r"^\s*(\d{1,9})[.)]\s+\S", 1)
    d = lines.withColumn("number", F.when(n != "", n.cast("long"))).where("number is not null")
    d = d.withColumn("run", F.col("pos") - F.col("number")).withColumn("_o", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    w = Window.partitionBy(key, "run")
    return d.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).select(key, "pos", "number", "run")


def carry(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, reset: Column, out: str) -> DataFrame:
    """Last non-NULL ``value`` since the last row where ``reset`` holds (that row included)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_island", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))
    inner = Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.last(value, ignorenulls=True).over(inner)).drop("_island")


def rolling(rows: DataFrame, by: Sequence[str], at: str, seconds: int, sums: dict[str, str]) -> DataFrame:
    """Add sums over the trailing ``seconds`` up to and with each row; rows of one instant count
    together. ``sums`` maps new columns to expressions."""
    stamp = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn("_us", stamp).withColumns({k: F.sum(F.expr(v)).over(w) for k, v in sums.items()}).drop("_us")


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a group, the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def last_n(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 2048) -> DataFrame:
    """The last ``n`` samples of every series; retention is the feature."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def topics(turns: DataFrame, conversation: str, order: str, dependent: Column) -> DataFrame:
    """Number the topics of a conversation: a turn that depends on none before starts one. Adds
    ``topic``, and ``anchor``, the order of the turn that started it."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    starts = ~F.coalesce(dependent, F.lit(False))
    return turns.withColumn("topic", F.sum(starts.cast("int")).over(w)).withColumn("anchor", F.last(F.when(starts, F.col(order)), ignorenulls=True).over(w))


def water_fill(demands: DataFrame, by: str, demand: str, floor: str, order: str, budget: int) -> DataFrame:
    """Add ``share``: every demand gets min(demand, max(floor, level)) for the greatest whole
    level within ``budget``; what is left goes one each to the first still short, by ``order``.

    The level is found exactly from running sums over the distinct points where a demand
    saturates or leaves its floor; nothing iterates."""
    w = Window.partitionBy(by)
    d = demands.withColumn("_f", F.least(demand, floor)).withColumn("_need", F.sum(demand).over(w))
    # used(level) is piecewise linear: slope +1 where a demand leaves its floor, -1 where it is met
    events = d.select(by, F.explode(F.array(F.struct(F.col("_f").alias("x"), F.lit(1).alias("s")), F.struct(F.col(demand).alias("x"), F.lit(-1).alias("s")))).alias("e"), "_need").select(by, "e.x", "e.s")
    points = events.groupBy(by, "x").agg(F.sum("s").alias("s"))
    base = d.groupBy(by).agg(F.sum("_f").alias("_base"))
    up = Window.partitionBy(by).orderBy("x")
    p = points.withColumn("slope", F.sum("s").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_px", F.lag("x").over(up)).withColumn("_ps", F.lag("slope").over(up))
    p = p.withColumn("_grown", F.sum(F.coalesce((F.col("x") - F.col("_px")) * F.col("_ps"), F.lit(0))).over(up.rowsBetween(Window.unboundedPreceding, 0))).join(base, by)
    fit = p.where(F.col("_base") + F.col("_grown") <= budget)
    top = fit.groupBy(by).agg(F.max_by(F.col("x") + F.when(F.col("slope") > 0, F.floor((F.lit(budget) - F.col("_base") - F.col("_grown")) / F.col("slope"))).otherwise(0), "x").alias("_level"))
    d = d.join(top, by, "left")
    share = F.when(F.col("_need") <= budget, F.col(demand)).otherwise(F.least(F.col(demand), F.greatest(F.col(floor), F.coalesce("_level", F.lit(0)))))
    d = d.withColumn("share", share.cast("long")).withColumn("_left", F.lit(budget) - F.sum("share").over(w))
    short = F.sum((F.col("share") < F.col(demand)).cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("share", F.col("share") + ((F.col("share") < F.col(demand)) & (short <= F.col("_left"))).cast("long")).drop("_f", "_need", "_level", "_left")

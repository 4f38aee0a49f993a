"""Mixing sources to target weights (problem 9).

Entropy balancing: among all rates (expected copies) of the documents that give every source
its share of the tokens, those nearest in entropy to keeping each document once are
exponentially tilted in the documents' tokens and capped at the source's repeats. The tilt of
each source is the solution of a convex dual, found by Newton steps whose sums run over the
distributed table. Rates are rounded to copies so that every source keeps its total to about
one document.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.tokens import DEFAULT, TOKENIZERS, distinct_texts, token_count
from gneiss.operators.aggregates import value_range
from gneiss.runtime import cut, ship, table

#: Documents of one source and size are split into so many blocks.
BLOCKS = 64
#: Starting points tried for the rounding of each source.
STARTS = 32


def measured(documents: DataFrame, path: str = f"{TOKENIZERS}/{DEFAULT}") -> DataFrame:
    """``(doc_id, variant, copy, source, tokens)`` of every document row with a text."""
    ship(documents.sparkSession)
    d = distinct_texts(documents)
    sized = d.select("doc_id", "variant", "copies", "source", token_count(path)("text").alias("tokens"))
    return sized.select("doc_id", "variant", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "source", "tokens")


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).collect()  # a fixed table
    return {r["source"]: (float(r["share"]), int(r["most"])) for r in rows}


def solve(sizes: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = 60) -> tuple[dict[str, float], dict[str, float]]:
    """Tilt and token target of each source. ``sizes`` is ``(source, tokens, n)``, the number of
    documents of a source by size, which holds all the dual needs. Without ``total`` the mix is
    as large as the shares allow: the source that its repeats exhaust first sets it."""
    sums = {r["source"]: (float(r["t"]), int(r["n"])) for r in sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect() if r["source"] in targets}
    open_ = {s: targets[s] for s in sums}
    if not open_:
        return {}, {}
    share = sum(v[0] for v in open_.values())
    bound = [sums[s][0] * most / (w / share) for s, (w, most) in open_.items()]
    size = min(bound) if total is None else total
    goal = {s: min(sums[s][0] * most, size * w / share) for s, (w, most) in open_.items()}
    mean = {s: sums[s][0] / sums[s][1] for s in open_}
    tilt = {s: math.log(max(goal[s] / sums[s][0], 1e-12)) for s in open_}
    lo, hi = {s: -700.0 for s in open_}, {s: 700.0 for s in open_}
    spark = sizes.sparkSession
    active = set(open_)
    for s in open_:
        if goal[s] >= sums[s][0] * open_[s][1] * (1 - 1e-12):  # every document as often as allowed
            tilt[s] = 700.0
            active.discard(s)
    for _ in range(rounds):
        if not active:
            break
        state = spark.createDataFrame([(s, tilt[s], mean[s], float(open_[s][1])) for s in sorted(active)], "source string, tilt double, mean double, most double")
        z = F.col("tilt") * F.col("tokens") / F.col("mean")
        rate = F.least(F.col("most"), F.exp(F.least(z, F.lit(700.0))))
        free = rate < F.col("most")
        sums_now = (
            sizes.join(F.broadcast(state), "source")  # one row a source of the fixed table
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("tokens") * rate).alias("value"), F.sum(F.when(free, F.col("n") * F.col("tokens") * F.col("tokens") * rate / F.col("mean")).otherwise(0.0)).alias("slope"))
            .collect()
        )
        for r in sums_now:
            s, off = r["source"], r["value"] - goal[r["source"]]
            if abs(off) <= 1e-9 * goal[s] or hi[s] - lo[s] < 1e-13:
                active.discard(s)
                continue
            lo[s], hi[s] = (lo[s], min(hi[s], tilt[s])) if off > 0 else (max(lo[s], tilt[s]), hi[s])
            step = tilt[s] - off / r["slope"] if r["slope"] > 0 else math.nan
            # a Newton step that leaves the bracket is replaced by halving it
            tilt[s] = step if lo[s] < step < hi[s] else (max(lo[s], tilt[s] - 8) + min(hi[s], tilt[s] + 8)) / 2
    return tilt, goal


def mixed(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``(doc_id, variant, copy, source, tokens, copies)`` of the documents the mix holds.

    Fractional parts of the rates are rounded systematically along the documents of a source in
    order of size: what one size leaves over is carried to the next, so totals are kept to about
    one document; what is still missing is made up by single copies of documents of fitting size,
    which matters for sources of few documents. Documents of one size are told apart in hashed blocks, so that no task needs a
    whole source or all copies of a text. Sources without a target are no part of the mix; an
    empty input gives an empty mix."""
    spark = sized.sparkSession
    sized = cut(sized)
    of = _targets(targets)
    sizes = cut(sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    tilt, goal = solve(sizes, of, total)
    info = {r["source"]: float(r["m"]) for r in sizes.groupBy("source").agg((F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("m")).collect() if r["source"] in tilt}
    state = spark.createDataFrame([(s, float(v), info[s], of[s][1]) for s, v in sorted(tilt.items())], "source string, tilt double, mean double, most int")
    rate = F.least(F.col("most").cast("double"), F.exp(F.least(F.col("tilt") * F.col("tokens") / F.col("mean"), F.lit(700.0))))
    block = F.pmod(F.xxhash64("doc_id", "variant", "copy"), F.lit(BLOCKS)).cast("int")
    d = sized.join(F.broadcast(state.select("source")), "source").withColumn("block", block)
    # the rate depends on source and tokens alone; so do whole and fractional part
    cells = d.groupBy("source", "tokens", "block").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(state), "source").withColumn("rate", rate)
    cells = cells.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    # running sums of the parts in order of size: over ranges of size, then within each range
    cells = cells.withColumn("range", value_range(F.col("tokens")))
    fraction = F.col("n") * F.col("part")
    ranges = cells.groupBy("source", "range").agg(F.sum(fraction).alias("f"))
    ranges = ranges.select("source", "range", (F.sum("f").over(Window.partitionBy("source").orderBy("range")) - F.col("f")).alias("below"))
    inside = F.sum(fraction).over(Window.partitionBy("source", "range").orderBy("tokens", "block").rowsBetween(Window.unboundedPreceding, 0))
    cells = cut(cells.join(ranges, ["source", "range"]).withColumn("upto", F.col("below") + inside))
    extra = lambda u: F.floor(F.col("upto") + u) - F.floor(F.col("upto") - F.col("n") * F.col("part") + u)
    # of some starting points of the rounding, the one whose total comes nearest to the target
    tried = cells.select("source", "tokens", "n", "whole", "upto", "part", F.explode(F.array(*[F.lit((k + 0.5) / STARTS) for k in range(STARTS)])).alias("u"))
    sums = tried.groupBy("source", "u").agg(F.sum(F.col("tokens") * (F.col("whole") * F.col("n") + extra(F.col("u")))).alias("t"))
    goals = spark.createDataFrame([(s, float(g)) for s, g in sorted(goal.items())], "source string, goal double")
    start = sums.join(F.broadcast(goals), "source").groupBy("source").agg(F.min_by(F.struct("u", "t"), F.struct(F.abs(F.col("t") - F.col("goal")), "u")).alias("s"))
    start = cut(start.select("source", "s.u", "s.t"))  # one row a source
    cells = cells.join(F.broadcast(start.select("source", "u")), "source").withColumn("k", (F.col("whole") * F.col("n") + extra(F.col("u"))).cast("long"))
    moves = _adjusted(cells, goal, {r["source"]: float(r["t"]) for r in start.collect()})
    cells = cells.join(F.broadcast(moves), ["source", "tokens", "block"], "left").withColumn("k", F.col("k") + F.coalesce("move", F.lit(0)))
    d = d.join(cells.select("source", "tokens", "block", "n", "k", "most"), ["source", "tokens", "block"])
    place = F.row_number().over(Window.partitionBy("source", "tokens", "block").orderBy(F.xxhash64("variant", "doc_id", "copy"), "doc_id", "variant", "copy"))
    d = d.withColumn("copies", F.least(F.col("most").cast("long"), F.floor(F.col("k") / F.col("n")) + (place <= F.col("k") % F.col("n")).cast("long")).cast("int"))
    return d.where("copies > 0").select("doc_id", "variant", "copy", "source", "tokens", "copies")


#: So many cells a source, spread by hash, take part in the last adjustments of its total; sources
#: of fewer cells, where single documents matter, take part with all.
MOVES = 2048


def _adjusted(cells: DataFrame, goal: dict[str, float], total: dict[str, float]) -> DataFrame:
    """``(source, tokens, block, move)``: copies more or fewer in some cells, by which the totals come
    as near to the goals as changes of one or two copies at a time lead."""
    spark = cells.sparkSession
    w = Window.partitionBy("source").orderBy(F.xxhash64("tokens", "block"), "tokens", "block")
    some = cells.select("source", "tokens", "block", "k", (F.col("n") * F.col("most")).alias("most")).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= MOVES)
    of: dict[str, list] = {}
    for r in some.orderBy("source", "_at").collect():  # at most MOVES a source of the fixed table
        of.setdefault(r["source"], []).append(r)
    rows = []
    for s, found in sorted(of.items()):
        change = nearest([int(r["tokens"]) for r in found], [int(r["k"]) for r in found], [int(r["most"]) for r in found], goal[s] - total[s])
        rows += [(s, int(r["tokens"]), int(r["block"]), int(m)) for r, m in zip(found, change) if m]
    return spark.createDataFrame(rows, "source string, tokens int, block int, move long")


def nearest(tokens: list[int], copies: list[int], most: list[int], missing: float, rounds: int = 500) -> list[int]:
    """Changes of ``copies``, between 0 and ``most``, whose tokens add up to nearly ``missing``: the best
    change of one or two copies is made as long as one brings the sum nearer."""
    t, k, cap = np.array(tokens, dtype=np.int64), np.array(copies, dtype=np.int64), np.array(most, dtype=np.int64)
    first = k.copy()
    for _ in range(rounds):
        # what one copy more or fewer adds; each possible twice where two are left
        up, down = np.flatnonzero(k < cap), np.flatnonzero(k > 0)
        up2, down2 = np.flatnonzero(k + 1 < cap), np.flatnonzero(k > 1)
        at = np.concatenate([up, up2, down, down2])
        sign = np.concatenate([np.ones(len(up) + len(up2), np.int64), -np.ones(len(down) + len(down2), np.int64)])
        if not len(at):
            break
        step = t[at] * sign
        order = np.argsort(step, kind="stable")
        at, sign, step = at[order], sign[order], step[order]
        single = int(np.abs(step - missing).argmin())
        best, moves = abs(step[single] - missing), [single]
        near = np.searchsorted(step, missing - step)
        for shift in (-2, -1, 0, 1):
            j = np.clip(near + shift, 0, len(step) - 1)
            gap = np.where(j == np.arange(len(step)), np.inf, np.abs(step + step[j] - missing))
            i = int(gap.argmin())
            if gap[i] < best:
                best, moves = gap[i], [i, int(j[i])]
        if best >= abs(missing) - 1e-9:
            break
        for i in moves:
            k[at[i]] += sign[i]
            missing -= step[i]
    return (k - first).tolist()


def report(mix: DataFrame, targets: DataFrame, sized: DataFrame) -> DataFrame:
    """Target and actual share, documents, copies and tokens of every source with a target; and what
    the mix leaves out: the documents and tokens that it doesn't hold even once. Sources without a
    target come out with share 0 and all they have left out."""
    by = mix.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies").cast("long") * F.col("tokens")).alias("tokens"), F.sum(F.col("tokens").cast("long")).alias("_once"))
    there = sized.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("tokens").cast("long")).alias("_t"))
    total = by.agg(F.sum("tokens").alias("total"))
    one = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        one.join(there, "source", "full_outer").join(by, "source", "left").crossJoin(F.broadcast(total))  # one row
        .select("source", zero("target_share").alias("target_share"), zero("max_repeats").alias("max_repeats"), *[zero(c).alias(c) for c in ("documents", "copies", "tokens")], (zero("tokens") / F.col("total")).alias("actual_share"), (zero("_n") - zero("documents")).alias("left_out_documents"), (zero("_t") - zero("_once")).alias("left_out_tokens"))
    )


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mixed(measured(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual beside target shares, and what was left out."""
    sized, targets = cut(measured(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "mix_targets")
    return report(mixed(sized, targets), targets, sized)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}

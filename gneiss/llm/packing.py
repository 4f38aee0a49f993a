"""Filling fixed-capacity containers with items (problem 8).

Hierarchical residual packing: every partition packs its items best fit, largest first; bins
that are nearly full are done. The underfull ones become the items of the next round, over new
partitions of bounded size. From then on only bins that are at most half full can still be put
together, as no two others fit into one; a partition leaves at most one of them a capacity, so
each round has far fewer, down to one task. In the end at most one bin of each capacity is not
more than half full, whatever the number of items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.tokens import DEFAULT, TOKENIZERS, count_tokens, cuts, distinct_texts
from gneiss.runtime import cut, ship, table

#: A bin filled to this share is done; so many items or bins are packed in one task.
NEARLY_FULL, PER_TASK = 0.995, 20_000
_MEMBER = "struct<doc_id: bigint, variant: bigint, copy: int, part: int, begin: int, end: int, tokens: int>"
_BIN = f"pack_kind string, capacity int, size int, members array<{_MEMBER}>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: items, largest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > sizes[i]:
            insort(room, (free - sizes[i], b))
    return bins


def items(documents: DataFrame, sizes: DataFrame, path: str) -> DataFrame:
    """Every document as one bin of one item for each capacity, or, where it alone exceeds the
    capacity, as pieces of it. Words, not texts, are tokenized, each once in a worker."""
    kinds = sorted((r["pack_kind"], int(r["capacity_tokens"])) for r in sizes.where("pack_kind is not null and capacity_tokens > 0").select("pack_kind", "capacity_tokens").distinct().collect())  # a fixed table

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"])
            counts = count_tokens(texts, path)
            for lo in range(0, len(texts), 500):
                out = []
                for i in range(lo, min(lo + 500, len(texts))):
                    d, v, text, n = pdf["doc_id"].iat[i], pdf["variant"].iat[i], texts[i], counts[i]
                    d = None if d != d else int(d)
                    for kind, capacity in kinds:
                        pieces = [(0, len(text), n)] if n <= capacity else cuts(text, capacity, path)
                        for c in range(int(pdf["copies"].iat[i])):
                            out += [(kind, capacity, t, [(d, int(v), c, p, b, e, t)]) for p, (b, e, t) in enumerate(pieces)]
                yield pd.DataFrame(out, columns=["pack_kind", "capacity", "size", "members"])

    return distinct_texts(documents).select("doc_id", "variant", "copies", "text").mapInPandas(run, _BIN)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's round: all its bins, merged best fit by kind."""
    held: dict[tuple[str, int], tuple[list[int], list]] = {}
    for pdf in batches:
        for kind, capacity, size, members in zip(pdf["pack_kind"], pdf["capacity"], pdf["size"], pdf["members"]):
            s, m = held.setdefault((kind, capacity), ([], []))
            s.append(int(size))
            m.append([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in members])
    for (kind, capacity), (s, m) in sorted(held.items()):
        # a fixed order makes the result the same in every run of a lost task
        order = sorted(range(len(s)), key=lambda i: (-s[i], [tuple(-1 if y is None else y for y in x) for x in m[i][:1]]))
        s, m = [s[i] for i in order], [m[i] for i in order]
        done = best_fit(s, capacity)
        for lo in range(0, len(done), 2000):
            yield pd.DataFrame([(kind, capacity, sum(s[i] for i in b), [x for i in b for x in m[i]]) for b in done[lo : lo + 2000]], columns=["pack_kind", "capacity", "size", "members"])


def pack(bins: DataFrame, per_task: int = PER_TASK, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Packed bins ``(pack_kind, capacity, size, members)`` of ``bins`` of one item each. Bins of
    size 0 are packed too; an empty input gives none."""
    first = lambda salt: F.xxhash64(F.lit(salt), "pack_kind", F.col("members")[0]["doc_id"], F.col("members")[0]["variant"], F.col("members")[0]["copy"], F.col("members")[0]["part"])
    rest = cut(bins)
    left = rest.count()
    finished: list[DataFrame] = []
    turn = 0
    while left:
        tasks = -(-left // per_task)
        spread = rest.repartition(tasks, first(turn)) if tasks > 1 else rest.coalesce(1)  # of at most per_task
        packed = cut(spread.mapInPandas(_pack, _BIN))
        # first every underfull bin goes on, later those that can still meet their like
        done = F.lit(True) if tasks == 1 else F.col("size") >= F.col("capacity") * nearly_full if turn == 0 else F.col("size") * 2 > F.col("capacity")
        finished.append(packed.where(done))
        rest = packed.where(~done)
        left, turn = rest.count(), turn + 1
    out = finished[0] if finished else rest
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def packed_documents(documents: DataFrame, sizes: DataFrame, path: str = f"{TOKENIZERS}/{DEFAULT}", per_task: int = PER_TASK) -> DataFrame:
    """``(pack_kind, bin, doc_id, variant, copy, part, begin, end, tokens)``: each document, or
    piece of an oversized one, in one bin a kind. ``bin`` is named after the bin's first member."""
    ship(documents.sparkSession)
    bins = pack(items(documents, sizes, path), per_task)
    m = F.col("members")[0]
    name = F.concat_ws("-", F.col("pack_kind"), F.coalesce(m["doc_id"].cast("string"), F.lit("null")), F.hex(m["variant"]), m["copy"].cast("string"), m["part"].cast("string"))
    return bins.select("pack_kind", name.alias("bin"), F.explode("members").alias("m")).select("pack_kind", "bin", "m.*")


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped into containers of each capacity."""
    return packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of used space by kind."""
    sizes = table(spark, sf_dir, "pack_sizes")
    by = p8_bins(spark, sf_dir).groupBy("pack_kind").agg(F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    return by.join(F.broadcast(sizes), "pack_kind").select("pack_kind", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))


QUERIES = {"p8_bins": p8_bins, "p8_fill": p8_fill}

"""Splitting oversized items at natural boundaries (problem 5).

Content-defined chunking: a rolling hash over the last 48 characters marks landmarks that
depend on nearby text only. Between a minimum and the maximum size a piece ends at the
natural boundary nearest to a landmark, so an edit moves only the cuts next to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.runtime import ship, table

LIMIT, OVERLAP = 2400, 240
_WINDOW, _MASK_BITS = 48, 9
_LEVELS = ("paragraph", "sentence", "word")
_ENDS = {
    "paragraph": re.compile(r"\n[^\S\n\f]*\n\s*|(?<![^\S\f])[^\S\f]*+\f\s*"),
    "sentence": re.compile(r"\n[^\S\n\f]*\n\s*|(?<![^\S\f])[^\S\f]*+\f\s*|(?<=[.!?])\s+"),
    "word": re.compile(r"\s+"),
}


def units(text: str, level: str) -> list[tuple[int, int]]:
    """``(end, next start)`` of every unit of ``text`` between the boundaries of ``level``."""
    ends = [(m.start(), m.end()) for m in _ENDS[level].finditer(text)]
    return [*ends, (len(text), len(text))]


def boundary_of(text: str, limit: int = LIMIT) -> str:
    """First level at which no unit is longer than ``limit``, else 'none'."""
    for level in _LEVELS:
        at = 0
        for end, begin in units(text, level):
            if end - at > limit:
                break
            at = begin
        else:
            return level
    return "none"


def landmarks(text: str) -> np.ndarray:
    """Positions after which the rolling hash of the last characters has its low bits zero."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(code)
    if n <= _WINDOW:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n - _WINDOW + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(_WINDOW):
            h = h * np.uint64(6364136223846793005) + code[k : n - _WINDOW + 1 + k] + np.uint64(1)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return np.flatnonzero((h & np.uint64((1 << _MASK_BITS) - 1)) == 0) + _WINDOW


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """Boundary level and pieces ``(begin, fresh, end)``: the piece is ``text[begin:end]``, of
    which ``text[begin:fresh]`` repeats the piece before. No piece is longer than ``limit``,
    no repeat than ``overlap``; the fresh parts cover the text but for blanks at the cuts."""
    if len(text) <= limit:
        return "whole", [(0, 0, len(text))]
    level = boundary_of(text, limit)
    marks = landmarks(text)
    if level == "none":
        # units at word level where they fit, hard cuts inside longer ones
        raw, at = [], 0
        for end, begin in units(text, "word"):
            while end - at > limit:
                near = marks[bisect_right(marks, at + limit // 2) : bisect_right(marks, at + limit)]
                at = int(near[0]) if len(near) else at + limit
                raw.append((at, at))
            raw.append((end, begin))
            at = begin
    else:
        raw = units(text, level)
    ends, nexts = [e for e, _ in raw], [b for _, b in raw]
    least, most = limit // 4, limit - overlap
    starts = sorted({0, *(b for _, b in units(text, "word"))})
    pieces, fresh = [], 0
    while fresh < len(text):
        lo, hi = bisect_left(ends, fresh + least), bisect_right(ends, fresh + most)
        if hi <= lo:  # no boundary in the preferred range: the last one before it, else the next
            lo, hi = bisect_right(ends, fresh), bisect_right(ends, fresh + limit)
            pick = hi - 1 if hi > lo else lo
        elif len(text) - fresh <= limit:
            pick = len(ends) - 1
        else:
            k = bisect_left(marks, fresh + least)
            mark = int(marks[k]) if k < len(marks) and marks[k] <= fresh + most else fresh + most
            pick = min(range(lo, hi), key=lambda j: (abs(ends[j] - mark), -j))
        end = ends[pick]
        room = min(overlap, limit - (end - fresh))
        begin = fresh
        if pieces and room > 0:
            j = bisect_left(starts, fresh - room)
            begin = starts[j] if j < len(starts) and starts[j] < fresh else fresh
        if end > fresh:
            pieces.append((begin, fresh, end))
        fresh = nexts[pick]
    return level, pieces


_SCHEMA = "key {key}, piece int, boundary string, begin int, fresh int, end int, breaks_before int, breaks_inside int, breaks int, text string"


_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["key"], pdf["content"]):
                if text is None:
                    continue
                level, pieces = split(text, limit, overlap)
                total = text.count("\f")
                for k, (begin, fresh, end) in enumerate(pieces):
                    before = text.count("\f", 0, begin)
                    out.append((i, k, level, begin, fresh, end, before, text.count("\f", begin, end), total, text[begin:end]))
            yield pd.DataFrame(out, columns=_NAMES)

    return run


def split_items(items: DataFrame, key: str, content: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces ``(key, piece, boundary, begin, fresh, end, breaks_before, breaks_inside, breaks, text)``
    of the distinct (key, content) rows. Items up to ``limit`` come out as one piece with
    boundary 'whole'; NULL content gives none. Positions are code points; ``breaks`` are form
    feeds, which end pages. Items are split where they lie, without a shuffle of their text
    beyond removing repeats."""
    ship(items.sparkSession)
    rows = items.select(F.col(key).alias("key"), F.col(content).alias("content")).distinct()
    schema = _SCHEMA.format(key=rows.schema["key"].dataType.simpleString())
    return rows.mapInPandas(_split_batches(limit, overlap), schema).withColumnRenamed("key", key)


def located(pieces: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Add ``heading_path`` and each piece's own ``page_from`` and ``page_to``.

    ``chunks`` has one row a key with ``heading_path``, ``page_range`` and ``page``. A reversed
    range is turned round, one of a single element is that page, NULL or empty falls back to
    ``page``. Where the content has a form feed for every page turn of the range, pages are
    counted by them, else in proportion to the position."""
    own = F.coalesce(F.when(F.size("page_range") > 0, F.col("page_range")), F.array("page"))
    lo, hi = F.array_min(own), F.array_max(own)
    at = pieces.join(chunks, key, "left").withColumn("_lo", lo).withColumn("_n", F.coalesce(hi - lo + 1, F.lit(1)))
    last = F.max("end").over(_whole(key))
    exact = F.col("breaks") == F.col("_n") - 1
    share = lambda pos: F.least(F.col("_n") - 1, F.floor(F.col(pos) * F.col("_n") / F.greatest(F.col("_last"), F.lit(1)))).cast("int")
    at = at.withColumn("_last", last)
    return at.select(
        *pieces.columns,
        "heading_path",
        F.when(exact, F.col("_lo") + F.col("breaks_before")).otherwise(F.col("_lo") + share("begin")).cast("int").alias("page_from"),
        F.when(exact, F.col("_lo") + F.col("breaks_before") + F.col("breaks_inside")).otherwise(F.col("_lo") + share("end")).cast("int").alias("page_to"),
    )


def _whole(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def chunk_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, heading_path, page_range, page)``: the chunk's row of evidence_records, else
    the metadata of its retrieval results."""
    one = lambda c: F.min_by(c, F.struct(F.col(c).isNull(), F.to_json(F.struct(c)))).alias(c)
    ev = table(spark, sf_dir, "evidence_records").groupBy("chunk_id").agg(one("heading_path"), one("page_range"), F.min("page").alias("page"))
    meta = F.from_json("metadata", "struct<page_range array<int>, heading_path array<string>>")
    rr = table(spark, sf_dir, "retrieval_results").select("chunk_id", "page", meta.alias("m")).select("chunk_id", "page", "m.heading_path", "m.page_range")
    rr = rr.groupBy("chunk_id").agg(one("heading_path"), one("page_range"), F.min("page").alias("page"))
    e, r = ev.alias("e"), rr.alias("r")
    both = e.join(r, F.col("e.chunk_id") == F.col("r.chunk_id"), "full_outer")
    return both.select(*[F.coalesce(f"e.{c}", f"r.{c}").alias(c) for c in ("chunk_id", "heading_path", "page_range", "page")])


def oversized_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "retrieval_results").where(F.length("content") > LIMIT)
    return split_items(long, "chunk_id", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks with the level of boundary at which they were cut."""
    return oversized_pieces(spark, sf_dir).select("chunk_id", "boundary").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized chunks with headings and pages."""
    found = located(oversized_pieces(spark, sf_dir), chunk_places(spark, sf_dir))
    return found.select("chunk_id", "piece", "boundary", "begin", "fresh", "end", F.array_join("heading_path", " > ").alias("heading"), "page_from", "page_to", "text")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}

ORACLES = {
    "p5_found": r"""
WITH long AS (SELECT DISTINCT chunk_id, content FROM retrieval_results WHERE length(content) > 2400),
u AS (
  SELECT chunk_id,
    list_max([length(x) for x in regexp_split_to_array(content, '\n[^\S\n\f]*\n\s*|\s*\f\s*')]) AS p,
    list_max([length(x) for x in regexp_split_to_array(regexp_replace(content, '([.!?])\s+', '\1' || chr(12), 'g'), '\n[^\S\n\f]*\n\s*|\s*\f\s*')]) AS s,
    list_max([length(x) for x in regexp_split_to_array(content, '\s+')]) AS w
  FROM long)
SELECT DISTINCT chunk_id, CASE WHEN p <= 2400 THEN 'paragraph' WHEN s <= 2400 THEN 'sentence' WHEN w <= 2400 THEN 'word' ELSE 'none' END AS boundary FROM u""",
}

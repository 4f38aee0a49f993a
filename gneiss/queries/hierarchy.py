"""Queries of the hierarchy operator (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.hierarchy import CYCLE, course_links, descendants, hierarchy
from gneiss.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every course of every document."""
    found = hierarchy(course_links(table(spark, sf_dir, "edges")), paths=False)
    return found.select(F.col("tree").alias("doc"), F.col("node").alias("code"), F.when(F.col("cyclic"), F.lit(CYCLE)).otherwise(F.col("root")).alias("root"), "depth")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path of every course that reaches a root, joined by ' > '."""
    found = hierarchy(course_links(table(spark, sf_dir, "edges"))).where("not cyclic")
    return found.select(F.col("tree").alias("doc"), F.col("node").alias("code"), F.array_join("path", " > ").alias("path"), "depth")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course under every course with its distance."""
    found = descendants(hierarchy(course_links(table(spark, sf_dir, "edges"))))
    return found.select(F.col("tree").alias("doc"), F.col("node").alias("code"), F.col("descendant").alias("under"), "distance")


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}

_LINKS = """
WITH RECURSIVE named AS (
  SELECT doc, upper(regexp_replace(dependent, '[^\\p{L}\\p{N}]', '', 'g')) AS node,
         nullif(upper(regexp_replace(prerequisite, '[^\\p{L}\\p{N}]', '', 'g')), '') AS parent, loaded_at
  FROM edges WHERE doc IS NOT NULL AND dependent IS NOT NULL
), rows_ AS (SELECT * FROM named WHERE node <> ''),
links AS (
  SELECT doc, node, max(parent) AS parent FROM (
    SELECT doc, node, parent FROM (
      SELECT *, row_number() OVER (PARTITION BY doc, node ORDER BY (parent IS NOT NULL) DESC, loaded_at DESC, parent DESC) AS rn FROM rows_) WHERE rn = 1
    UNION ALL SELECT doc, parent, NULL FROM rows_ WHERE parent IS NOT NULL) GROUP BY doc, node
), tree AS (
  SELECT doc, node, node AS root, 0 AS depth, node AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.doc, l.node, t.root, t.depth + 1, t.path || ' > ' || l.node FROM links l JOIN tree t ON l.doc = t.doc AND l.parent = t.node
)
"""

ORACLES = {
    "p1_found": _LINKS + "SELECT l.doc, l.node AS code, coalesce(t.root, 'CYCLE') AS root, coalesce(t.depth, -1)::INT AS depth FROM links l LEFT JOIN tree t ON l.doc = t.doc AND l.node = t.node",
    "p1_paths": _LINKS + "SELECT doc, node AS code, path, depth::INT AS depth FROM tree",
    "p1_descendants": _LINKS
    + """, pairs AS (
  SELECT doc, node AS code, node AS under, 0 AS distance FROM tree
  UNION ALL SELECT p.doc, p.code, l.node, p.distance + 1 FROM pairs p JOIN links l ON l.doc = p.doc AND l.parent = p.under)
SELECT doc, code, under, distance::INT AS distance FROM pairs WHERE distance > 0""",
}

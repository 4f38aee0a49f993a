"""Tables found in text: rows, headers, roles, sums and ratios that the source proves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import fold, normalize_number
from gneiss.operators.aggregates import unanimous
from gneiss.operators.windows import lines_of

JSON_TABLE = "struct<headers array<string>, rows array<array<string>>>"


def table_rows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, table, row, cells)`` of tables of pipe-separated lines: at least two lines in a
    row of at least two cells. ``row`` 0 is the header; short rows are filled with NULL cells up
    to the widest, empty cells keep their place. Items without a table have no row."""
    l = lines_of(items, key, text)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    l = l.where(F.col("line").contains("|")).withColumn("cells", cells).where(F.size("cells") >= 2)
    w = Window.partitionBy(key).orderBy("pos")
    l = l.withColumn("table", F.col("pos") - F.row_number().over(w))
    inner = Window.partitionBy(key, "table")
    l = l.withColumn("_n", F.count(F.lit(1)).over(inner)).withColumn("_w", F.max(F.size("cells")).over(inner)).where("_n >= 2")
    l = l.withColumn("row", F.row_number().over(inner.orderBy("pos")) - 1)
    padded = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("_w") - F.size("cells")))
    return l.select(key, "table", "row", padded.alias("cells"))


def json_table(content) -> F.Column:
    """Table of the JSON that starts with its headers inside a text; NULL if there is none or it
    can't be read."""
    at = F.locate('{"headers"', content)
    t = F.from_json(F.when(at > 0, F.substring(content, at, F.length(content))), JSON_TABLE)
    return F.when(t["headers"].isNotNull() & t["rows"].isNotNull(), t)


def _is_one_of(values: Sequence[str]):
    return lambda h: h.isin(*values)


def role_rows(rows: DataFrame, key: str, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """Body rows of ``table_rows`` with one column a role. A role belongs to the single header
    whose folded text is one of its aliases; a table in which a role matches no header, or
    several, has no rows here."""
    heads = rows.where("row = 0").select(key, "table", F.transform("cells", lambda c: fold(F.coalesce(c, F.lit("")))).alias("_heads"))
    for role, aliases in roles.items():
        hit = _is_one_of(aliases)
        heads = heads.withColumn(f"_n_{role}", F.size(F.filter("_heads", hit))).withColumn(f"_at_{role}", F.array_position(F.transform("_heads", hit), True))
    for role in roles:
        heads = heads.where(F.col(f"_n_{role}") == 1)
    body = rows.where("row > 0").join(heads, [key, "table"])
    return body.select(key, "table", "row", *[F.try_element_at("cells", F.col(f"_at_{r}").cast("int")).alias(r) for r in roles])


def proven_values(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Number of each key where all its rows agree on a readable one, else NULL."""
    return rows.groupBy(*by).agg(unanimous(normalize_number(F.col(value))).alias("value"))


def ratio(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Quotient of the values of the last and the first of exactly two rows of a group; none
    where a value is missing or the divisor is 0."""
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min_by(value, order).alias("old"), F.max_by(value, order).alias("new"))
    return g.where((F.col("_n") == 2) & F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != 0)).select(*by, "old", "new", (F.col("new") / F.col("old")).alias("ratio"))


def year_binding(cells: DataFrame, label: str, header: str, value: str, asked: DataFrame) -> DataFrame:
    """``asked (label, year, value)`` with ``status`` against table cells of a row label, a column header
    and a value: ``bound`` where the cells of the label, folded, under headers naming that year alone
    have one distinct value and it is the one asked, ``different`` where it is another,
    ``ambiguous`` where there are several or one can't be read, ``absent`` where there is none. A header
    that names two years belongs to neither."""
    years = F.array_distinct(F.regexp_extract_all(header, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)))
    c = cells.select(fold(F.col(label)).alias("_l"), F.when(F.size(years) == 1, years[0].cast("int")).alias("_y"), F.col(value).alias("_v")).where("_l is not null and _y is not null")
    one = c.groupBy("_l", "_y").agg(F.lit(True).alias("_any"), unanimous(F.col("_v")).alias("_one"))
    j = asked.join(one, (fold(asked["label"]) == one["_l"]) & (asked["year"] == one["_y"]), "left")
    status = F.when(F.col("_any").isNull(), "absent").when(F.col("_one").isNull(), "ambiguous").when(F.col("_one").eqNullSafe(asked["value"]), "bound").otherwise("different")
    return j.select(*[asked[x] for x in asked.columns], status.alias("status"))


def row_batches(rows: DataFrame, by: Sequence[str], order: str, text: str, budget: int) -> DataFrame:
    """Pack ordered rows greedily into batches of at most ``budget`` characters, never inside a
    row (a longer row stands alone). Adds ``batch``. A table's rows are folded in one pass over
    their lengths, 20 bytes a row; the texts do not move."""
    size = F.length(F.coalesce(text, F.lit("")))
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), size.alias("s")))).alias("r"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("u"), F.array().cast("array<struct<o: bigint, b: int>>").alias("out"))

    def step(a, x):
        fits = (a["u"] + x["s"] <= budget) | (a["u"] == 0)
        b = F.when(fits, a["b"]).otherwise(a["b"] + 1)
        return F.struct(b.alias("b"), F.when(fits, a["u"] + x["s"]).otherwise(x["s"]).alias("u"), F.concat(a["out"], F.array(F.struct(x["o"].cast("bigint").alias("o"), b.alias("b")))).alias("out"))

    at = packed.select(*by, F.aggregate("r", start, step, lambda a: a["out"]).alias("out")).select(*by, F.explode_outer("out").alias("x")).select(*by, F.col("x.o").alias(order), F.col("x.b").alias("batch"))
    return rows.join(at, [*by, order])

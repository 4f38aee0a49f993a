"""Sources: files checked before they are read, pages, registries, lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pdf_files(spark: SparkSession, path: str, max_mb: float = 50) -> DataFrame:
    """``(path, length, modified, error)`` of every file under ``path``; ``error`` tells why a
    file is not a readable PDF (name, size, magic number, trailer, encryption). Only the head and
    tail of a file leave the reader. Files of length 0 have no row; file sources skip them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head, tail = F.substring("content", 1, 5), F.decode(F.substring(F.col("content"), F.greatest(F.lit(1), F.col("length").cast("int") - 2047), F.lit(2048)), "ISO-8859-1")
    error = (
        F.when(~F.lower("path").endswith(".pdf"), "not_a_pdf_name")
        .when(F.col("length") > max_mb * 1024 * 1024, "too_large")
        .when(head != F.lit(b"%PDF-"), "bad_magic_number")
        .when(~tail.contains("%%EOF"), "no_trailer")
        .when(tail.contains("/Encrypt"), "encrypted")
    )
    return f.select("path", "length", F.col("modificationTime").alias("modified"), error.alias("error"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON lines; unreadable ones keep their text in ``_corrupt``."""
    s = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return spark.read.schema(T.StructType([*s.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)


def visible_text(html: F.Column) -> F.Column:
    """Text of a page of markup: without scripts, styles and comments, blocks on lines of their
    own, entities of the common kinds decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^<>]+>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\xA0]+", " "), r" ?\n\s*", "\n"), r"^\s+|\s+$", "")


def broken_font_map(text: F.Column) -> F.Column:
    """Whether most letters of a page are full-width forms with private-use signs between, as a
    wrong font map yields; such a page must be recognised anew."""
    wide, private, letters = F.regexp_count(text, F.lit(r"[Ａ-Ｚａ-ｚ]")), F.regexp_count(text, F.lit(r"\p{Co}")), F.regexp_count(text, F.lit(r"\p{L}"))
    return (wide >= F.greatest(F.lit(80), F.lit(0.8) * letters)) & (private >= 2)

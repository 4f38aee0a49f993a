"""Columns that read a request: route, temporal intent, keys, fingerprints, batch sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.text import detected_codes, fold


def route(question: Column, filtered: Column) -> Column:
    """Retrieval route: a code asks for the exact path, filters for the filtered hybrid."""
    return F.when(F.size(detected_codes(F.coalesce(question, F.lit("")))) > 0, "exact_code").when(F.coalesce(filtered, F.lit(False)), "filtered_hybrid_rrf").otherwise("hybrid_rrf")


def temporal_intent(question: Column) -> Column:
    """What a question asks of versions: compare, explicit_period, as_of, latest or none."""
    f = fold(F.coalesce(question, F.lit("")))
    years = F.size(F.array_distinct(F.regexp_extract_all(f, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))))
    return (
        F.when((years >= 2) & f.rlike(r"\b(?:compare|difference|so sanh|khac nhau|comparer)\b"), "compare")
        .when(f.rlike(r"\b(?:class of|cohort|khoa|academic year|nam hoc|promotion) (?:19|20)\d{2}\b"), "explicit_period")
        .when(f.rlike(r"\b(?:as of|on|from|tinh den|ngay) \d{1,2}[/-]\d{1,2}[/-]\d{4}"), "as_of")
        .when(f.rlike(r"\b(?:latest|newest|current|currently|moi nhat|hien hanh|actuel|actuelle)\b"), "latest")
        .otherwise("none")
    )


def version_key(label: Column) -> Column:
    """Version labels compare by their letters a to z and digits, without case and accents."""
    return F.regexp_replace(fold(label), "[^a-z0-9]", "")


def question_key(question: Column) -> Column:
    """Hash under which a question and its repeats in other case or spacing are one."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\s+", " ")), 256)


def request_fingerprint(*fields: Column) -> Column:
    """Hash of a request's fields in their order; NULL differs from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in fields]), 256)


def batch_size(done: Column, elapsed: Column, budget: float, most: int) -> Column:
    """Next batch from the measured pace, between 1 and ``most``; 1 without a measure."""
    return F.when(elapsed > 0, F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(budget) * done / elapsed)))).otherwise(1).cast("int")


def initialism(cell: Column) -> Column:
    """Initials of a cell of three to six words in upper case, else NULL."""
    w = F.filter(F.split(F.trim(cell), r"\s+"), lambda x: x.rlike(r"^\p{L}"))
    return F.when(F.size(w).between(3, 6), F.upper(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")))

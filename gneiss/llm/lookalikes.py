"""Visually identical text with different characters (problem 4).

Texts are brought to one form: widths, ligatures, invisible characters, kinds of blank and
hyphen and the composition of accents are unified for every text; look-alike letters are
replaced token by token, towards the token's dominant script, Latin, Cyrillic or Greek (that of
its text where all its letters look alike), and only where the repaired token is attested: it
occurs in the corpus in pure spelling, or is the repair of two different spellings.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.text import LATIN_FOR, LOOKALIKES, SCRIPT_PAIRS, look
from gneiss.runtime import cut, ship, table

_SCRIPTS = ("Latin", "Cyrillic", "Greek")
_TO = {"Latin": str.maketrans(LOOKALIKES, LATIN_FOR), **{s: str.maketrans(*reversed(SCRIPT_PAIRS[s.upper()])) for s in _SCRIPTS[1:]}}
#: Rows of one class of equal forms that meet in one task.
CLASS_PART = 2000


def _patterns():
    import regex

    pure = {s: regex.compile(rf"[\p{{{s}}}\p{{M}}\p{{N}}]+") for s in _SCRIPTS}
    letter = {s: regex.compile(rf"\p{{{s}}}") for s in _SCRIPTS}
    own = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}--[" + LOOKALIKES + "]]", regex.V1)  # letters that no other script has
    foreign = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}" + LOOKALIKES + "]")
    return regex.compile(r"[\p{L}\p{M}\p{N}]+"), foreign, own, letter, pure


def repairs(text: str, pats) -> tuple[list[tuple[str, str, int, int]], set[str]]:
    """Tokens of a text of one ``look`` that may be repaired, as ``(token, repaired, place of its
    script by dominance, place by the script of the text)``, and the words that attest others."""
    token, foreign, own, letter, pure = pats
    tokens = dict.fromkeys(token.findall(text))
    if not foreign.search(text):
        return [], {t.lower() for t in tokens}
    other = own.findall(text)
    scripts = [s for s in _SCRIPTS if s != "Latin"]
    count = {s: sum(bool(letter[s].match(ch)) for ch in other) for s in scripts}
    latin = len(letter["Latin"].findall(text)) >= len(other)
    home = "Latin" if latin else max(scripts, key=lambda s: count[s])
    by_text = sorted(_SCRIPTS, key=lambda s: s != home)
    out, words = [], set()
    for t in tokens:
        n = {s: len(letter[s].findall(t)) for s in _SCRIPTS}
        mixed = n["Latin"] > 0 and foreign.search(t) is not None
        alien = not mixed and n[home] == 0 and not (home == "Latin" and own.search(t))
        cases = [s for s in _SCRIPTS if (mixed or (alien and s == home)) and pure[s].fullmatch(t.translate(_TO[s]))]
        by_share = sorted(cases, key=lambda s: (-n[s], s != home))
        for s in cases:
            out.append((t, t.translate(_TO[s]), by_share.index(s), by_text.index(s)))
        if not cases and any(pure[s].fullmatch(t) for s in _SCRIPTS):
            words.add(t.lower())
    return out, words


def _print(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


_PARTS = "kind string, {names}spelling string, form string, look string, token string, fixed string, share int, home int"


def _take_apart(names: list[str], whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pats = _patterns()
        none = [None] * len(names)
        for pdf in batches:
            out: list[tuple] = []
            words: set[str] = set()
            known: dict[str, tuple[str, str | None, str | None]] = {}
            for row in pdf.itertuples(index=False):
                text = row[-1]
                if text not in known:
                    one = look(text)
                    found, some = repairs(one, pats)
                    words |= some
                    spelling = _print(text)
                    known[text] = spelling, None if found else _print(one), one if found or whole else None
                    out += [("case", *none, spelling, None, None, t, f, a, b) for t, f, a, b in found]
                out.append(("row", *row[:-1], *known[text], None, None, None, None))
            out += [("word", *none, None, None, None, w, None, None, None) for w in words]
            yield pd.DataFrame(out, columns=["kind", *names, "spelling", "form", "look", "token", "fixed", "share", "home"])

    return run


@F.pandas_udf(T.StringType())
def repaired(looks: pd.Series, fixes: pd.Series) -> pd.Series:
    """Replace the attested tokens in each text."""
    import regex

    token = regex.compile(r"[\p{L}\p{M}\p{N}]+")
    out = []
    for t, some in zip(looks, fixes):
        known = {} if some is None else {x["token"]: x["fixed"] for x in some}
        out.append(unicodedata.normalize("NFD", token.sub(lambda m: known.get(m[0], m[0]), t)) if known else t)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def print_of(texts: pd.Series) -> pd.Series:
    return texts.map(_print)


@F.pandas_udf(T.StringType())
def composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _forms(rows: DataFrame, text: str, whole: bool) -> DataFrame:
    """``rows`` without NULL texts, with ``spelling`` and ``form``, fingerprints of the text and of its
    form, and ``look``, the form itself, NULL where the text needed no repair unless ``whole``.

    One pass takes every text apart into its row, its tokens that may be repaired and, once a
    batch, its words; only these leave the text. The words meet the repairs in a shuffle join,
    and only texts that hold a repair are joined with what was decided."""
    spark = rows.sparkSession
    ship(spark)
    names = [c for c in rows.columns if c != text]
    given = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)
    parts = cut(rows.where(F.col(text).isNotNull()).select(*names, text).mapInPandas(_take_apart(names, whole), _PARTS.format(names=given)))
    cases = parts.where("kind = 'case'").select("spelling", "token", "fixed", "share", "home")
    wanted = cases.groupBy(F.lower("fixed").alias("word")).agg((F.min("token") != F.max("token")).alias("twice"))
    words = parts.where("kind = 'word'").select(F.col("token").alias("word")).distinct().withColumn("known", F.lit(True))
    attested = wanted.join(words, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"), "twice").where("known or twice")
    # a pure spelling in the corpus counts before two damaged ones, then the token's own script
    order = F.struct(~F.col("known"), F.when(F.col("known"), F.col("share")).otherwise(F.col("home")), "fixed")
    chosen = cases.distinct().withColumn("word", F.lower("fixed")).join(attested, "word").groupBy("spelling", "token").agg(F.min_by("fixed", order).alias("fixed"))
    fixes = chosen.groupBy("spelling").agg(F.collect_list(F.struct("token", "fixed")).alias("fixes"))  # bounded by the text's own words
    found = parts.where("kind = 'row'").select(*names, "spelling", "form", "look")
    bad = found.where("form is null").join(fixes, "spelling", "left").select(*names, "spelling", repaired("look", "fixes").alias("look"))
    return found.where("form is not null").unionByName(bad.select(*names, "spelling", print_of("look").alias("form"), "look"))


def one_form(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``form`` instead of ``text`` (decomposed, for comparing). NULL text gives NULL, an
    empty text an empty form. Texts are read once, and not compared with each other."""
    names = [c for c in rows.columns if c != text]
    nulls = rows.where(F.col(text).isNull()).select(*names, F.lit(None).cast("string").alias("form"))
    return _forms(rows, text, True).select(*names, F.col("look").alias("form")).unionByName(nulls)


def look_alike_pairs(rows: DataFrame, by: str, key: str = "key", text: str = "text") -> DataFrame:
    """``(by, key_a, key_b)`` of different keys of one ``by`` whose texts have one form but other code
    points; all texts of ``rows`` attest words.

    Each distinct (form, spelling, key) counts once. A class of many rows is cut into parts by key,
    each of which meets the whole class, so no task holds all pairs of a hot text. Rows with NULL
    key or text form no pair."""
    forms = _forms(rows.where(F.col(key).isNotNull()).select(by, F.col(key).alias("key"), F.col(text).alias("text")), "text", False)
    slim = forms.groupBy(by, "form", "spelling", "key").agg(F.lit(1).alias("_")).drop("_")
    classes = slim.groupBy(by, "form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi")
    slim = cut(slim.join(classes.select(by, "form", F.ceil(F.col("n") / CLASS_PART).cast("int").alias("parts")), [by, "form"]))
    a = slim.withColumn("part", F.pmod(F.xxhash64("key", "spelling"), F.col("parts")).cast("int")).withColumnRenamed("key", "key_a").drop("parts")
    b = slim.select(by, "form", F.col("key").alias("key_b"), F.col("spelling").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, [by, "form", "part"]).where("spelling != other and key_a < key_b").select(by, "key_a", "key_b").distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "traces").select(F.lit("traces").alias("source_table"), F.col("request_id").alias("key"), F.col("request.question").alias("text"))
    return questions.unionByName(table(spark, sf_dir, "evidence_records").select(F.lit("evidence_records").alias("source_table"), F.col("chunk_id").alias("key"), F.col("content").alias("text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of keys of one table whose texts look the same and differ in code points."""
    return look_alike_pairs(_texts(spark, sf_dir), "source_table")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every question and chunk."""
    return one_form(_texts(spark, sf_dir)).select("source_table", "key", composed("form").alias("form"))


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}

"""Repair of text from scanned pages (problem 2).

Lines are labelled by a hidden Markov model over layout features (shape of the line, place on
its page, whether it recurs through the document); its tables are counted over all lines of
the corpus, first from rule-made labels and then from its own decoding. Words divided over
lines are joined and misrecognised words replaced by the vocabulary of the clean text that has
the same skeleton, a spelling in which characters that scanners confuse are one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.text import plain
from gneiss.runtime import cut, keep, salted_join, ship, table

# What scanners confuse, each letter written in the strokes it can be read as.
_STROKES = {
    "m": "rrl", "n": "rl", "u": "ll", "d": "el", "w": "yy",
    "i": "l", "1": "l", "|": "l", "!": "l", "c": "e", "a": "o", "0": "o", "f": "t", "5": "s", "h": "b", "6": "b", "8": "b", "9": "g", "v": "y", "2": "z",
}
_STROKE_TABLE = str.maketrans(_STROKES)


def skeleton(word: str) -> str:
    """Spelling of a lower-case word in confusable strokes; accents stay."""
    return unicodedata.normalize("NFD", word).replace("rm", "nn").translate(_STROKE_TABLE)


# What a scanner makes of which letters.
_READ_AS = {
    "a": "o", "b": "6h", "c": "eo", "e": "co", "f": "t", "g": "9q", "h": "b", "i": "1lj!|", "l": "1i!|", "o": "0ace", "q": "9", "s": "5", "t": "f", "u": "v", "v": "y", "y": "v", "z": "2",
}
_READ_AS_MANY = [("n", "ri"), ("m", "rn"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("nn", "rm")]


def misread_as(right: str, wrong: str) -> bool:
    """Whether ``wrong`` arises from ``right`` by such replacements alone."""
    a, b = unicodedata.normalize("NFD", right), unicodedata.normalize("NFD", wrong)
    reach = {0: {0}}
    for i in range(len(a) + 1):
        for j in reach.get(i, ()):
            if i < len(a) and j < len(b) and (a[i] == b[j] or b[j] in _READ_AS.get(a[i], "")):
                reach.setdefault(i + 1, set()).add(j + 1)
            for x, y in _READ_AS_MANY:
                if a.startswith(x, i) and b.startswith(y, j):
                    reach.setdefault(i + len(x), set()).add(j + len(y))
    return len(b) in reach.get(len(a), ())


@F.pandas_udf(T.BooleanType())
def plausible(right: pd.Series, wrong: pd.Series) -> pd.Series:
    return pd.Series([misread_as(a, b) for a, b in zip(right, wrong)])


@F.pandas_udf(T.StringType())
def skeleton_of(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else skeleton(w))


_HYPHEN = "-‐‑¬­"
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_PREFIX = {skeleton(w) for w in ("p", "pp", "pg", "page", "pages", "trang", "tr", "seite", "folio", "fol")}
_NUMBER_LINE = re.compile(r"^([^\w]*)(?:([^\W\d_]{1,6})(?:(\.)\s*|\s+))?(\d{1,4}|[ivxlcdm]{1,8}|[\dlos]{1,4})(\s*(?:/|of|sur|de|trên)\s*\d+)?([^\w]*)$")
_SECTION = re.compile(r"^\d+(\.\d+)+\.?\s+\S|^\d+\.\s+\S")


def divided_end(line: str) -> str | None:
    """The part before the hyphen of a word that is divided at the end of ``line``."""
    s = line.rstrip()
    if not s or s[-1] not in _HYPHEN:
        return None
    part = s.rsplit(None, 1)[-1].rstrip(_HYPHEN)
    return part if part and part[-1].isalpha() else None


def _roman(s: str) -> int:
    total = 0
    for a, b in zip(s, [*s[1:], ""]):
        v = _ROMAN[a]
        total += -v if b and _ROMAN[b] > v else v
    return total


def number_line(line: str) -> tuple[str, int, bool] | None:
    """Kind of numeral, value and whether it is marked as a page number, for a line that holds
    only one number."""
    bare = line.strip().lower()
    m = _NUMBER_LINE.match(bare)
    if not m:
        return None
    before, prefix, dot, number, total, after = m.groups()
    if prefix and skeleton(prefix) not in _PREFIX:
        return None
    marked = bool(prefix or total or (before.strip() and after.strip()))
    if not marked and after.strip() == ".":
        return None
    if number.isdigit():
        return "arabic", int(number), marked
    if re.fullmatch(r"[ivxlcdm]+", number) and not (number == "l" and prefix):
        return "roman", _roman(number), marked
    if marked or any(ch.isdigit() for ch in number):
        return "arabic", int(number.translate(str.maketrans("los", "105"))), marked
    return None


_PARTS = re.compile(r"[^\W_]+")
_ROMAN_PART = re.compile(r"[ivxlc]{1,6}")


def signature(line: str) -> str:
    """What stays of a running line from page to page, however well recognised: its words in
    strokes, without a number of up to three digits at either end, or a Roman one that two blanks
    set apart. Nothing for a line without letters or digits."""
    low = line.strip().lower()
    parts = _PARTS.findall(low)
    if len(parts) > 1 and _paged(parts[0], low[low.find(parts[0]) + len(parts[0]) :].lstrip(")")):
        parts = parts[1:]
    if len(parts) > 1 and _paged(parts[-1], low[: low.rfind(parts[-1])].rstrip("(")[::-1]):
        parts = parts[:-1]
    return " ".join(_PARTS.findall(skeleton(" ".join(parts))))


def _paged(part: str, beside: str) -> bool:
    if part.isdigit():
        return len(part) <= 3
    return beside[:2].isspace() and len(beside) > 1 and _ROMAN_PART.fullmatch(part) is not None


def page_segments(text: str) -> list[list[str]]:
    """Lines of each page of a chunk, pages ending at form feeds."""
    return [p.split("\n") for p in text.replace("\r\n", "\n").replace("\r", "\n").split("\f")]


def _places(lines: list[str]) -> list[str]:
    at = [i for i, l in enumerate(lines) if l.strip()]
    where = ["mid"] * len(lines)
    for name, k in (("second", 1), ("penult", -2), ("first", 0), ("last", -1)):
        if len(at) >= (k + 1 if k >= 0 else -k):
            where[at[k]] = name
    return where


def is_wrapped(text: str) -> bool:
    """Whether lines are cut inside paragraphs, as in scans."""
    for lines in page_segments(text):
        for a, b in zip(lines, lines[1:]):
            if len(a.strip()) >= 25 and b.strip() and "|" not in a and not re.search(r"[.!?:]$", a.strip()) and not _SECTION.match(a):
                return True
    return False


# ---------------------------------------------------------------- document profiles
_EDGE_SCHEMA = "doc_id string, chunk_id string, kind string, sig string, ends boolean, place string, off int, times int, page long"


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines at page edges by signature and page offsets of number lines; of the lines between
    them how often each signature occurs in a batch."""
    for pdf in batches:
        out = []
        between: Counter = Counter()
        for doc, chunk, lo, hi, text in zip(pdf["doc_id"], pdf["chunk_id"], pdf["lo"], pdf["hi"], pdf["content"]):
            for s, lines in enumerate(page_segments(plain(text))):
                for i, (place, line) in enumerate(zip(_places(lines), lines)):
                    if not line.strip():
                        continue
                    n = number_line(line)
                    if n:
                        if lo == lo and lo == hi and place != "mid":
                            out.append((doc, chunk, n[0], "", False, place, int(lo) + s - n[1], 1, 0))
                    elif not _SECTION.match(line) and line.count("|") < 2 and divided_end(line) is None and (sig := signature(line)):
                        if place == "mid":
                            between[doc, sig] += 1
                        else:
                            out.append((doc, chunk, "line", sig, bool(re.search(r"[.!?;,]$", line.rstrip())), place, 0, 1, crc32("\n".join(lines[:i] + lines[i + 1 :]).encode("utf-8", "replace"))))
        out += [(doc, None, "line", sig, False, "mid", 0, n, None) for (doc, sig), n in between.items()]
        yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "kind", "sig", "ends", "place", "off", "times", "page"])


#: A line that does not end like a sentence and stands at page edges of this share of a document's
#: chunks is a running line; others, as those of a chapter, if they keep to one place of the page.
RECURS = 0.1


def profiles(chunks: DataFrame) -> DataFrame:
    """``(doc_id, sigs, arabic, roman)``: recurring edge lines and the usual page offsets.

    A running line stands on two chunks at least. It is told from text that happens to recur by
    its share of the chunks, or by its place: a running line is at its own place of the page in
    nine of ten cases, a line of text there in one of ten; the evidence must exceed what the number
    of different lines of the document makes likely by chance. Pages that are copies of one another
    count once there. Of page offsets the most
    frequent one counts, and any that is met more often than chance explains."""
    edges = keep(chunks.mapInPandas(_edges, _EDGE_SCHEMA))
    size = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lines = edges.where("kind = 'line'")
    at = ("first", "second", "penult", "last")
    held = lines.groupBy("doc_id", "sig").agg(F.count_distinct("chunk_id").alias("k"), F.bool_and(F.when(F.col("place") != "mid", F.col("ends"))).alias("ends"), F.sum(F.when(F.col("place") == "mid", F.col("times")).otherwise(0)).alias("mid"))
    seen = lines.where("place != 'mid'").select("doc_id", "sig", "place", "page").distinct()
    held = held.join(seen.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("edge"), *[F.count_if(F.col("place") == x).alias(x) for x in at]), ["doc_id", "sig"])
    kinds = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kinds"))
    own = F.greatest(*at)
    evidence = (2 * own - F.col("edge") - F.col("mid")) * math.log(0.9 / 0.1) - F.log(F.col("kinds").cast("double"))
    often = ~F.col("ends") & (F.col("k") >= F.col("n") * RECURS)
    sigs = held.where("k >= 2").join(size.join(kinds, "doc_id"), "doc_id").where(often | (evidence > 3.0)).groupBy("doc_id").agg(F.collect_list("sig").alias("sigs"))
    offs = edges.where("kind != 'line'").groupBy("doc_id", "kind", "off").agg(F.count_distinct("chunk_id").alias("k"))
    spread = offs.groupBy("doc_id", "kind").agg(F.count_if(F.col("k") == 1).alias("single"), (F.max("off") - F.min("off") + 1).alias("range"), F.max(F.struct("k", -F.abs("off"), "off")).alias("best"))
    # how many offsets would be met k times if numbers stood anywhere as often as those met once do
    times = F.least(F.col("k"), F.lit(20)).cast("int")
    chance = F.col("range") * F.pow(F.col("single") / F.col("range"), times) / F.factorial(times)
    offs = offs.where("k >= 2").join(spread, ["doc_id", "kind"]).where((F.col("off") == F.col("best.off")) | (chance < 0.01))
    offs = offs.groupBy("doc_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("off"))).alias(k) for k in ("arabic", "roman")])
    return size.select("doc_id").join(sigs, "doc_id", "left").join(offs, "doc_id", "left")


# ---------------------------------------------------------------- the line model
Model = tuple[np.ndarray, np.ndarray, np.ndarray]
STATES = ("break", "running", "number", "heading", "body")
_SHAPES = ("blank", "recurs", "own number", "other number", "section", "table", "full", "ends", "open")
_PLACES = ("first", "second", "penult", "last", "mid")
_CELLS = len(_SHAPES) * len(_PLACES)
# which shapes a state can have at all
_MAY = {"break": ("blank",), "running": ("recurs", "open"), "number": ("own number", "other number"), "heading": ("section", "open"), "body": _SHAPES[1:]}
_CAN = np.array([[shape in _MAY[state] for shape in _SHAPES for _ in _PLACES] for state in STATES])


def _features(text: str, lo: float, hi: float, sigs, arabic, roman, heads) -> list[list[tuple[str, int, int]]]:
    """For each page its lines with observation cell and rule-made state."""
    pages = page_segments(text)
    known = set(sigs) if sigs is not None else set()
    offsets = {"arabic": _numbers(arabic), "roman": _numbers(roman)}
    titles = {re.sub(r"\W+", " ", h.lower()).strip() for h in heads} if heads is not None else set()
    numbers = sum(1 for p in pages for l in p if l.strip() and (m := number_line(l)) and m[2])
    width = max((len(l.strip()) for p in pages for l in p), default=0)
    out = []
    for lines in pages:
        row = []
        for place, line in zip(_places(lines), lines):
            bare = line.strip()
            n = number_line(bare) if bare else None
            if not bare:
                shape, state = "blank", "break"
            elif n:
                usual = offsets[n[0]]
                span = range(int(lo), int(max(hi, lo + max(len(pages) - 1, numbers))) + 1) if lo == lo else ()
                own = any(p - n[1] in usual or p == n[1] for p in span) or (n[2] and not usual and place != "mid")
                shape, state = ("own number", "number") if own else ("other number", "body")
            elif re.sub(r"\W+", " ", bare.lower()).strip() in titles or _SECTION.match(bare):
                shape, state = "section", "heading"
            elif "|" in bare and bare.count("|") > 1:
                shape, state = "table", "body"
            elif signature(bare) in known:
                shape, state = "recurs", "running"
            else:
                shape = "ends" if re.search(r"[.!?]\W*$", bare) else "full" if len(bare) >= 0.75 * width else "open"
                state = "body"
            row.append((line, _SHAPES.index(shape) * len(_PLACES) + _PLACES.index(place), STATES.index(state)))
        out.append(row)
    return out


def _numbers(some) -> set[int]:
    return {int(x) for x in some} if some is not None else set()


_OBSERVED = "chunk_id string, content string, obs array<int>, rule array<int>, sizes array<int>"


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the lines of every chunk their observation cells and rule-made states, page by page."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            pages = _features(plain_lines(page_segments(row.content)), row.lo, row.hi, row.sigs, row.arabic, row.roman, row.heading_path)
            out.append((row.chunk_id, row.content, [o for p in pages for _, o, _ in p], [r for p in pages for _, _, r in p], [len(p) for p in pages]))
        yield pd.DataFrame(out, columns=["chunk_id", "content", "obs", "rule", "sizes"])


def _pages(cells, sizes) -> list[list[int]]:
    at = np.cumsum(sizes).tolist()
    flat = [int(x) for x in cells]
    return [flat[e - int(n) : e] for e, n in zip(at, sizes)]


def decoder(model: Model):
    """``viterbi`` that keeps the states of sequences it has met, as pages are often alike."""
    return lru_cache(maxsize=50_000)(lambda obs: viterbi(list(obs), *model))


def viterbi(obs: list[int], start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> list[int]:
    """Most likely states of one page (log probabilities)."""
    if not obs:
        return []
    score = start + emit[:, obs[0]]
    back = []
    for o in obs[1:]:
        step = score[:, None] + trans
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + emit[:, o]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _count_batches(model: Model | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        decode = None if model is None else decoder(model)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for obs, rule in zip(_pages(row.obs, row.sizes), _pages(row.rule, row.sizes)):
                    states = rule if decode is None else decode(tuple(obs))
                    c.update(("emit", s, o) for s, o in zip(states, obs))
                    c.update(("trans", a, b) for a, b in zip(states, states[1:]))
                    c.update(("start", s, 0) for s in states[:1])
        yield pd.DataFrame([(t, a, b, n) for (t, a, b), n in c.items()], columns=["what", "a", "b", "n"])

    return run


def train(described: DataFrame, rounds: int = 2) -> Model:
    """Count the model over all lines; the counts, at most a few hundred, come to the driver.
    The first round counts rule-made labels, each later one the model's own decoding."""
    model: Model | None = None
    for _ in range(rounds):
        rows = described.select("obs", "rule", "sizes").mapInPandas(_count_batches(model), "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
        k = len(STATES)
        start, trans, emit = np.ones(k), np.ones((k, k)), np.full((k, _CELLS), 0.05)
        for r in rows:
            if r["what"] == "start":
                start[r["a"]] += r["n"]
            else:
                (trans if r["what"] == "trans" else emit)[r["a"], r["b"]] += r["n"]
        emit[~_CAN] = 1e-12
        model = np.log(start / start.sum()), np.log(trans / trans.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True))
    return model


# ---------------------------------------------------------------- reading with the model
def bare_word(token: str) -> str:
    """Token without surrounding punctuation, lower case."""
    b, e = 0, len(token)
    while b < e and not token[b].isalnum():
        b += 1
    while e > b and not token[e - 1].isalnum() and not unicodedata.combining(token[e - 1]):
        e -= 1
    return token[b:e].lower()


def read_chunk(pages: list[list[str]], states: list[list[int]]) -> tuple[list[tuple[str, str]], list[list[str]], list[tuple[str, str]]]:
    """Furniture ``(kind, line)``, paragraphs as lists of lines, and the divided words as pairs
    of their parts. Page turns do not end a paragraph that runs on."""
    furniture, paragraphs, divided = [], [[]], []
    for page, labels in zip(pages, states):
        for line, s in zip(page, labels):
            name, bare = STATES[s], line.strip()
            if name == "break" or not bare:
                if paragraphs[-1]:
                    paragraphs.append([])
            elif name == "running":
                furniture.append(("running_line", bare))
            elif name == "number":
                furniture.append(("page_number", bare))
            elif name == "heading":
                paragraphs += [[bare], []]
            else:
                paragraphs[-1].append(bare)
        # blank lines around the turn of a page don't end a sentence that runs on
        if paragraphs and not paragraphs[-1] and len(paragraphs) > 1 and paragraphs[-2] and not re.search(r"[.!?:]\W*$", paragraphs[-2][-1]) and not _SECTION.match(paragraphs[-2][-1]):
            paragraphs.pop()
    paragraphs = [p for p in paragraphs if p]
    for p in paragraphs:
        for a, b in zip(p, p[1:]):
            if part := divided_end(a):
                divided.append((part, b.split()[0] if b.split() else ""))
    return furniture, paragraphs, divided


def is_word(w: str) -> bool:
    """Letters, at least as many as digits: no numbers, room or course codes."""
    digits = sum(ch.isdigit() for ch in w)
    letters = sum(ch.isalpha() for ch in w)
    return letters > 0 and letters >= digits and not re.search(r"\d{3}", w)


_FOUND_SCHEMA = "chunk_id string, kind string, value string, other string, n int"


def _find_batches(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = decoder(model)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                raw = page_segments(row.content)
                text = plain_lines(raw)
                furniture, paragraphs, divided = read_chunk(page_segments(text), [decode(tuple(p)) for p in _pages(row.obs, row.sizes)])
                if furniture:  # the line as stored
                    stored = {plain(l).strip(): l.strip() for p in raw for l in p if l.strip()}
                    out += [(row.chunk_id, k, stored.get(v, v), None, 1) for k, v in dict.fromkeys(furniture)]
                for a, b in dict.fromkeys(divided):
                    joined, hyphened = bare_word(a + b), bare_word(f"{a}-{b}")
                    if b[:1].isalpha() or b[1:2].isalpha():
                        out.append((row.chunk_id, "divided", joined, hyphened, 1))
                words: Counter = Counter()
                for p in paragraphs:
                    cut_before = False
                    for line in p:
                        tokens = line.split()
                        skip_last = divided_end(line) is not None
                        words.update(w for t in tokens[1 * cut_before : len(tokens) - skip_last] if (w := bare_word(t)))
                        cut_before = skip_last
                kind = "scanned" if is_wrapped(text) or furniture or divided else "clean"
                out += [(row.chunk_id, kind, w, None, n) for w, n in words.items() if is_word(w)]
            yield pd.DataFrame(out, columns=["chunk_id", "kind", "value", "other", "n"])

    return run


def plain_lines(pages: list[list[str]]) -> str:
    """Chunk text in one form, with divided words still marked: a soft hyphen at a line end is
    visible there and kept as a hyphen."""
    return "\f".join("\n".join(plain(re.sub(r"­\s*$", "-", l)) for l in p) for p in pages)


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks of both tables as ``(chunk_id, doc_id, lo, hi, heading_path, content)``.
    Of the spellings of one chunk_id's fields those of evidence_records win."""
    ev = table(spark, sf_dir, "evidence_records").select("chunk_id", "doc_id", "page", "page_range", "heading_path", "content", F.lit(0).alias("src"))
    meta = F.from_json("metadata", "struct<page_range array<int>, heading_path array<string>>")
    rr = table(spark, sf_dir, "retrieval_results").select("chunk_id", "doc_id", "page", meta.getField("page_range").alias("page_range"), meta.getField("heading_path").alias("heading_path"), "content", F.lit(1).alias("src"))
    both = ev.unionByName(rr).where("chunk_id is not null and content is not null")
    own = F.when(F.size("page_range") > 0, F.col("page_range"))
    best = both.groupBy("chunk_id", "content").agg(F.min_by(F.struct("doc_id", "page", "page_range", "heading_path"), F.struct("src", F.col("page").isNull(), F.xxhash64("doc_id", "page"))).alias("r"))
    flat = best.select("chunk_id", "content", "r.*")
    return flat.select(
        "chunk_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("page", F.array_min(own)).cast("double").alias("lo"), F.coalesce(F.greatest(F.array_max(own), "page"), "page").cast("double").alias("hi"), "heading_path", "content"
    )


def described_chunks(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, content, obs, rule, sizes)``: chunks with what their lines show, seen with the
    profile of their document; the rows of a document that holds many are spread."""
    known = salted_join(chunks, profiles(chunks), ["doc_id"], "left")
    return cut(known.mapInPandas(_observe, _OBSERVED))


def findings(described: DataFrame, model: Model) -> DataFrame:
    return cut(described.mapInPandas(_find_batches(model), _FOUND_SCHEMA))


#: A spelling that clean text never has counts as misread where its twin is this much more frequent.
TIMES = 20


def vocabulary(found: DataFrame) -> DataFrame:
    """``(word, clean, scanned)`` counts over all running text."""
    w = found.where("kind in ('clean', 'scanned')")
    one = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
    return w.groupBy(F.col("value").alias("word")).agg(one("clean"), one("scanned"))


def misreadings(vocab: DataFrame) -> DataFrame:
    """``(word, right)``: spellings that no clean text has, with the word of the same skeleton
    that clean text has most often (else a much more frequent scanned one)."""
    v = vocab.withColumn("skel", skeleton_of("word"))
    good = v.where("clean > 0 or scanned >= %d" % TIMES).select("skel", F.col("word").alias("right"), F.struct("clean", "scanned", "word").alias("rank"))
    pairs = v.where("clean = 0").join(good, "skel").where(F.col("right") != F.col("word")).where((F.col("rank.clean") > 0) | (F.col("rank.scanned") >= F.col("scanned") * TIMES))
    return pairs.where(plausible("right", "word")).groupBy("word").agg(F.max_by("right", "rank").alias("right"))


def repairs(found: DataFrame) -> DataFrame:
    """``(chunk_id, kind, value, was)``: every finding with its right value. A word divided at
    its own hyphen keeps it where the vocabulary knows that spelling better."""
    vocab = cut(vocabulary(found))
    wrong = keep(misreadings(vocab))
    misread = found.where("kind = 'scanned'").join(wrong, F.col("value") == F.col("word")).select("chunk_id", F.lit("misread").alias("kind"), F.col("right").alias("value"), F.col("word").alias("was"))
    weight = F.col("clean") * 1000 + F.col("scanned")
    j = vocab.select(F.col("word").alias("value"), weight.alias("wj"))
    h = vocab.select(F.col("word").alias("other"), weight.alias("wh"))
    cases = found.where("kind = 'divided'").select("value", "other").distinct().join(j, "value", "left").join(h, "other", "left")
    # neither spelling known: the joined one may be misread too
    skel = vocab.where("clean > 0").withColumn("skel", skeleton_of("word")).groupBy("skel").agg(F.max_by("word", "clean").alias("twin"))
    cases = cases.withColumn("skel", F.when(F.col("wj").isNull() & F.col("wh").isNull(), skeleton_of("value"))).join(skel, "skel", "left")
    right = F.when(F.coalesce("wh", F.lit(0)) > F.coalesce("wj", F.lit(0)), F.col("other")).when(F.col("wj").isNotNull(), F.col("value")).otherwise(F.coalesce("twin", "value"))
    cases = cases.select("value", "other", right.alias("right"))
    divided = found.where("kind = 'divided'").join(cases, ["value", "other"]).select("chunk_id", F.lit("broken_word").alias("kind"), F.col("right").alias("value"), F.col("value").alias("was"))
    lines = found.where("kind in ('running_line', 'page_number')").select("chunk_id", "kind", "value", F.col("value").alias("was"))
    return misread.unionByName(divided).unionByName(lines)


def scan_repairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Model]:
    ship(spark)
    described = described_chunks(all_chunks(spark, sf_dir))
    model = train(described)
    return repairs(findings(described, model)), described, model


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and page furniture of all chunks."""
    return scan_repairs(spark, sf_dir)[0].select("chunk_id", "kind", "value").distinct()


def _paragraph_batches(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = decoder(model)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                states = [decode(tuple(p)) for p in _pages(row.obs, row.sizes)]
                _, paragraphs, _ = read_chunk(page_segments(plain_lines(page_segments(row.content))), states)
                right = dict(zip(row.was, row.value)) if row.was is not None else {}
                for k, lines in enumerate(paragraphs):
                    text = lines[0]
                    for line in lines[1:]:
                        if (part := divided_end(text)) and line.split():
                            first, _, rest = line.partition(" ")
                            whole = right.get(bare_word(part + first), bare_word(part + first))
                            glue = "-" if whole == bare_word(f"{part}-{first}") != bare_word(part + first) else ""
                            text = text.rstrip().rstrip(_HYPHEN) + glue + first + (" " + rest if rest else "")
                        else:
                            text = f"{text} {line}"
                    words = []
                    for t in text.split(" "):
                        w = bare_word(t)
                        if w in right and right[w] != w and right[w].replace("-", "") != w:
                            new = right[w].upper() if t.isupper() and len(w) > 1 else right[w].capitalize() if t[:1].isupper() else right[w]
                            at = t.lower().find(w)
                            t = t[:at] + new + t[at + len(w) :]
                        words.append(t)
                    out.append((row.chunk_id, k, " ".join(words)))
            yield pd.DataFrame(out, columns=["chunk_id", "paragraph", "text"])

    return run


def repaired_paragraphs(fixes: DataFrame, described: DataFrame, model: Model) -> DataFrame:
    """``(chunk_id, paragraph, text)`` without page furniture, with words whole and right."""
    of = fixes.where("kind in ('misread', 'broken_word')").groupBy("chunk_id").agg(F.collect_list(F.struct("was", "value")).alias("f")).select("chunk_id", F.col("f.was").alias("was"), F.col("f.value").alias("value"))
    return described.join(of, "chunk_id", "left").mapInPandas(_paragraph_batches(model), "chunk_id string, paragraph int, text string")


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs of all chunks."""
    return repaired_paragraphs(*scan_repairs(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_paragraphs": p2_paragraphs}

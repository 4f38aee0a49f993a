"""Broken prompt and response pairs (problem 3).

A suffix automaton of the prompt measures how much of the response is copied from it; automata
of the parts of speech of declining, with rules over them, find refusals; a stack of delimiters
and end-of-sentence statistics of all answers find truncation; votes of function words find the
wrong language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.refusals import refuses
from gneiss.llm.text import folded, language, plain
from gneiss.runtime import cut, ship, table


class SuffixAutomaton:
    """All substrings of one text, as the smallest automaton that accepts its suffixes."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for ch in text:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, text: str, least: int) -> list[bool]:
        """For each character of ``text`` whether a match of at least ``least`` characters covers it."""
        out = [False] * len(text)
        state = length = done = 0
        for i, ch in enumerate(text):
            while state and ch not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if ch in self.next[state]:
                state = self.next[state][ch]
                length += 1
            if length >= least:
                for j in range(max(done, i - length + 1), i + 1):
                    out[j] = True
                done = i + 1
        return out


# Answers that stand for no answer, in folded form without punctuation.
PLACEHOLDERS = {"null", "none", "n a", "na", "nil", "nan", "undefined", "empty", "answer", "no answer", "tbd", "todo", "unknown", "rien", "neant", "vide", "trong", "khong co", "l"}

_MARKUP = re.compile(r"<[^<>]{0,200}>|\[\s*[A-Z]?\d+\s*\]")


def is_empty(answer: str) -> bool:
    """Nothing but blanks, invisible characters, punctuation, markup, citations or a placeholder."""
    left = re.sub(r"[\W_]+", " ", folded(_MARKUP.sub(" ", plain(answer)))).strip()
    return not left or left in PLACEHOLDERS


_LEAD = re.compile(r"^[^:\n]{1,40}:\s*")


def copies(question: str, answer: str) -> bool:
    """Whether the answer, apart from a short lead-in, consists of parts of the question and
    gives back nearly all of it. Questions of any length count, those without a letter or digit
    have nothing to copy."""
    # an instruction before a colon ("please answer in ...") is not part of what is asked
    forms = {question, _LEAD.sub("", question)}
    texts = {answer, _LEAD.sub("", answer, count=1)}
    given = [" " + re.sub(r"[\W_]+", " ", folded(_MARKUP.sub(" ", t))).strip() + " " for t in texts]
    for q in forms:
        q = re.sub(r"[\W_]+", " ", folded(q)).strip()
        if not q:
            continue
        padded = f" {q} "
        least = min(10, len(q))
        sam = None
        for a in given:
            if not a.strip() or not _may_copy(a, padded, least):
                continue
            sam = sam or SuffixAutomaton(padded)
            hit = sam.covered(a, least)
            if all(all(hit[m.start() : m.end()]) for m in re.finditer(r"\S+", a)):
                back = SuffixAutomaton(a).covered(q, min(10, len(a.strip()), len(q)))
                if sum(back) >= 0.8 * len(q):
                    return True
    return False


def _may_copy(a: str, q: str, least: int) -> bool:
    """What any full cover of ``a``, a text between two blanks, by runs of ``q`` of at least
    ``least`` characters must have: a run over its first letter and one over its last. The
    automaton of ``q`` is made for these alone."""
    n = len(a)
    return (a[:least] in q or a[1 : 1 + least] in q) and (a[n - least :] in q or a[max(0, n - 1 - least) : n - 1] in q)


_OPEN, _CLOSE = "([{“«„", ")]}”»“"
_DANGLING = re.compile(r"(^|\n)\s*(\d+[.)]|[-*•–])\s*$")
_ITEM = re.compile(r"^\s*(\d+[.)]|[-*•–])\s+\S")


def _shape(line: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d+", "9", re.sub(r"^\s*\d+[.)]", "-", line)))


def left_open(answer: str) -> bool:
    """An unclosed bracket, quotation, code fence or list marker, or a list entry cut short."""
    text = plain(answer).rstrip()
    stack: list[str] = []
    for ch in text:
        if ch in _OPEN:
            stack.append(_CLOSE[_OPEN.index(ch)])
        elif ch in _CLOSE and ch in stack:
            while stack.pop() != ch:
                pass
    if stack or text.count('"') % 2 or text.count("```") % 2 or _DANGLING.search(text):
        return True
    lines = text.split("\n")
    if len(lines) > 2 and _ITEM.match(lines[-1]) and _ITEM.match(lines[-2]) and not re.search(r"[.!?]$", lines[-1]):
        before, last = _shape(lines[-2]), _shape(lines[-1])
        return last != before and before.startswith(last)
    return bool(re.search(r"[,;:(«“/&]$|[^\W\d_]-$|\w(\.\.\.|…)$", text))


# Names of the languages in requests to answer in one.
_NAMED = {"en": r"english|anglais|tieng anh", "fr": r"french|francais|tieng phap", "vi": r"vietnamese|vietnamien|tieng viet"}
_ASKS = re.compile(r"\b(?:in|en|bang)\s+(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _NAMED.items()) + r")\b")
_QUOTED = re.compile(r"“[^”]{0,300}”|«[^»]{0,300}»|\"[^\"]{0,300}\"")


def _running(text: str) -> str:
    """Words of running text: without quoted titles and names inside a sentence."""
    text = _QUOTED.sub(" ", plain(text))
    if text.upper() == text:
        return text
    return re.sub(r"(?<=[\w,] )(?:[^\W\d_a-zà-ỹđ][\w'-]*(?:\s+(?:of|de|du|des)\s+(?=[A-ZÀ-Ỹ]))?\s*)+", " ", text)


def wrong_language(question: str, answer: str) -> bool:
    asked = _ASKS.search(folded(question))
    mine, theirs = language(_running(question)), language(_running(answer))
    return bool(mine and theirs and mine != theirs and not (asked and asked.group(theirs)))


def inspect(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair that shows without corpus statistics, or 'open?' where the answer
    ends in a word and statistics must tell."""
    if answer is None or is_empty(answer):
        return "empty"
    if question and copies(question, answer):
        return "copies_question"
    if refuses(answer):
        return "refusal"
    if left_open(answer):
        return "truncated"
    if question and wrong_language(question, answer):
        return "wrong_language"
    return "open?" if re.search(r"\w$", _MARKUP.sub(" ", plain(answer)).strip()) and not _ITEM.match(plain(answer).rstrip().split("\n")[-1]) else None


@F.pandas_udf(T.StringType())
def inspected(question: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([inspect(q, a) for q, a in zip(question, answer)], dtype=object)


_GRAM = 7
_CITED = re.compile(r"\[\s*[A-Z]?\d+\s*\]")
_SIGNS = re.compile(r"[^\W_]*\d[^\W_]*(?:[.,]\d+)*|[^\W\d_]+|[^\w\s]|_")
_ENDS = {".", "!", "?"}


def _tokens(text: str) -> list[str]:
    """Words, '#' for what holds a digit, and single signs; '<s>' first."""
    return ["<s>", *("#" if any(ch.isdigit() for ch in w) else w for w in _SIGNS.findall(_CITED.sub("", unicodedata.normalize("NFC", text)).lower()))]


def _run_hashes(token: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of one, two, ... tokens that end at each place; those longer than
    ``room``, the place's number within its text from 1, are no runs."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    out, h = [], np.zeros(len(token), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, _GRAM + 1):
            before = np.roll(token, n - 1)
            h = (h ^ before) * mix
            h ^= h >> np.uint64(29)
            out.append(np.where(room >= n, h, np.uint64(0)))
    return out


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Token hashes of all texts in a row, each place's number in its text, and the text it is of."""
    lists = [_tokens(t) for t in texts]
    size = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.array([w for x in lists for w in x], dtype=object)
    code, words = pd.factorize(flat)
    token = pd.util.hash_array(np.asarray(words, dtype=object), categorize=False)[code]
    of = np.repeat(np.arange(len(lists)), size)
    return token, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1, of, lists


def _count_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [t for t in pdf["answer"] if t]
        if not texts:
            continue
        token, place, of, lists = _coded(texts)
        flat = [w for x in lists for w in x]
        last = np.append(of[1:] != of[:-1], True)
        # 0: a full stop follows, 1: something else follows, 2: the text stops
        ended = np.fromiter((w in _ENDS for w in flat), dtype=bool, count=len(flat))
        kind = np.where(last, 2, np.where(np.append(ended[1:], False), 0, 1))
        word = np.fromiter((w != "<s>" and (w == "#" or w[0].isalpha()) for w in flat), dtype=bool, count=len(flat))
        runs = [(h[word & (place >= n)], kind[word & (place >= n)]) for n, h in enumerate(_run_hashes(token, place), 1)]
        gram, kinds = np.concatenate([g for g, _ in runs]), np.concatenate([k for _, k in runs])
        seen, at = np.unique(gram, return_inverse=True)
        yield pd.DataFrame({"gram": seen.view(np.int64), **{name: np.bincount(at, weights=kinds == k, minlength=len(seen)).astype(np.int64) for k, name in enumerate(("ends", "goes_on", "stops"))}})


def sentence_ends(texts: DataFrame) -> DataFrame:
    """``(gram, ends, goes_on, stops)`` for every run of one to seven words of ``(answer)``: how often
    a full stop follows, something else follows, or the text stops. Runs are counted in each
    batch before they are shuffled."""
    grams = texts.select("answer").mapInPandas(_count_runs, "gram long, ends long, goes_on long, stops long")
    return grams.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("ends", "goes_on", "stops")])


def _tail_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf[pdf["answer"].notna()]
        if not len(pdf):
            continue
        token, place, of, _ = _coded(list(pdf["answer"]))
        last = np.append(of[1:] != of[:-1], True)
        ids, room = pdf["request_id"].to_numpy()[of[last]], place[last]
        for n, h in enumerate(_run_hashes(token, place), 1):
            some = room >= n
            yield pd.DataFrame({"request_id": ids[some], "n": n, "whole": room[some] == n, "gram": h[last][some].view(np.int64)})


def unfinished(open_answers: DataFrame, ends: DataFrame) -> DataFrame:
    """Those ``(request_id)`` of ``(request_id, answer)`` whose last words, by their longest run
    that the corpus knows, are followed by a full stop in fewer than half of the cases. A whole
    answer of up to seven words that stops at the same place elsewhere too counts as finished."""
    tails = open_answers.select("request_id", "answer").mapInPandas(_tail_runs, "request_id string, n int, whole boolean, gram long")
    seen = tails.join(ends, "gram", "left")
    known = F.when((F.col("ends") + F.col("goes_on") > 0) | (F.col("whole") & (F.col("stops") > 1)), F.col("n"))
    finished = F.when(F.col("whole") & (F.col("stops") > 1), F.col("stops") + F.col("ends") >= F.col("goes_on")).otherwise(F.col("ends") >= F.col("goes_on"))
    verdict = seen.groupBy("request_id").agg(F.max_by(finished, known).alias("finished"))
    return verdict.where(~F.coalesce("finished", F.lit(False))).select("request_id")


def pairs(traces: DataFrame, saved: DataFrame) -> DataFrame:
    """``(request_id, question, answer)`` of request_ids present in both; of several rows of one
    request_id the latest counts, then the larger text. NULL request_ids pair with nothing."""
    q = traces.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.max_by(F.col("request.question"), F.struct("recorded_at", F.col("request.question"))).alias("question"))
    answer = F.col("response.answer.answer")
    a = saved.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.max_by(F.struct(answer.alias("answer")), F.struct("saved_at", answer)).alias("a"))
    return q.join(a, "request_id").select("request_id", "question", "a.answer")


def defects(found: DataFrame) -> DataFrame:
    """``(request_id, defect)`` for every defective row of ``(request_id, question, answer)``;
    question may be NULL. Statistics come from all answers."""
    ship(found.sparkSession)
    seen = cut(found.select("request_id", "answer", inspected("question", "answer").alias("defect")))
    ends = sentence_ends(seen.where(F.col("answer").isNotNull()))
    cut_short = unfinished(seen.where("defect = 'open?'"), ends).select("request_id", F.lit("truncated").alias("defect"))
    return seen.where("defect is not null and defect != 'open?'").select("request_id", "defect").unionByName(cut_short)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs with their defect."""
    return defects(pairs(table(spark, sf_dir, "traces"), table(spark, sf_dir, "saved_answers")))


QUERIES = {"p3_found": p3_found}

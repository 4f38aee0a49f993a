"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import json
import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a path that every worker can read.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


#: Fixed value: the pattern by which byte-level vocabularies of this family cut a text into words
#: before they pair bytes.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose size is remembered in a worker, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64


class WordSizes:
    """Sizes of words in tokens. A byte-level vocabulary without normalizer pairs bytes within
    words only, so a text has the sum of its words' tokens, and each word is encoded once."""

    def __init__(self, path: str) -> None:
        import regex

        self.tokenizer = tokenizer(path)
        self.split = regex.compile(_WORDS).findall
        self.size: dict[str, int] = {}

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the vocabulary file is of that kind."""
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        pre = t.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        return bool(plain) and t.get("normalizer") is None and (t.get("model") or {}).get("type") == "BPE" and all(x.get("special") for x in t.get("added_tokens", []))

    def of(self, words: list[str]) -> list[int]:
        size = self.size
        new = [w for w in dict.fromkeys(words) if w not in size]
        if not new:
            return [size[w] for w in words]
        if len(size) + len(new) > REMEMBERED:
            size.clear()
            new = list(dict.fromkeys(words))
        now = {w: len(e.ids) for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
        size.update((w, n) for w, n in now.items() if len(w) <= LONGEST)
        return [now[w] if w in now else size[w] for w in words]


@lru_cache(maxsize=2)
def word_sizes(path: str) -> WordSizes | None:
    return WordSizes(path) if WordSizes.fits(path) else None


def _batches(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of texts of at most ``most`` characters (a longer text alone)."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def count_tokens(texts: list[str], path: str) -> list[int]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
    words = word_sizes(path)
    if words is not None:
        return [sum(words.of(words.split(t))) for t in texts]
    t = tokenizer(path)
    return [len(e.ids) for some in _batches(texts) for e in t.encode_batch_fast(some, add_special_tokens=False)]


def token_count(path: str):
    """Column function for the number of tokens; NULL text counts 0."""

    @F.pandas_udf(T.IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens([t or "" for t in texts], path), dtype="int32")

    return run


def cuts(text: str, capacity: int, path: str) -> list[tuple[int, int, int]]:
    """``(begin, end, tokens)`` of pieces of at most ``capacity`` tokens that together are
    ``text``. Cuts lie before a blank where the last quarter of a piece has one, so that
    counting a piece anew gives its share of the whole."""
    words = word_sizes(path)
    if words is not None:
        parts = words.split(text)
        sizes = words.of(parts)
        upto, at = [0], [0]
        for w, n in zip(parts, sizes):
            upto.append(upto[-1] + n)
            at.append(at[-1] + len(w))
        out, begin = [], 0
        while begin < len(parts):
            end = bisect_right(upto, upto[begin] + capacity) - 1
            if end < len(parts):
                least = upto[begin] + (capacity * 3) // 4
                while end > begin and upto[end] > least and not parts[end][0].isspace():
                    end -= 1
                if end <= begin or upto[end] <= least:
                    break  # a word too long to be kept whole
            out.append((at[begin], at[end], upto[end] - upto[begin]))
            begin = end
        else:
            return out
    e = tokenizer(path).encode(text, add_special_tokens=False)
    at = e.offsets
    n, begin, out = len(e.ids), 0, []
    while begin < n:
        end = min(n, begin + capacity)
        if end < n:
            k = end
            while k > begin + (capacity * 3) // 4 and not text[at[k][0] : at[k][0] + 1].isspace():
                k -= 1
            if k > begin + (capacity * 3) // 4:
                end = k
            else:
                while end > begin + 1 and at[end][0] < at[end - 1][1]:  # not inside a character
                    end -= 1
        out.append((at[begin][0] if begin else 0, at[end][0] if end < n else len(text), end - begin))
        begin = end
    return out


def distinct_texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, variant, copies, source, text)``: rows of one doc_id with one text and source
    are one item with a number of copies; ``variant`` tells the texts of a doc_id apart. A NULL
    or empty text is no item, a NULL doc_id is an item like any other."""
    rows = documents.where(F.length("text") > 0).select("doc_id", "source", "text")
    return rows.groupBy("doc_id", "source", F.xxhash64("text", "source").alias("variant"), "text").agg(F.count(F.lit(1)).cast("int").alias("copies")).select("doc_id", "variant", "copies", "source", "text")

"""Subject areas of documents (problem 10).

A term model learned from labelled documents tells the subject of a sentence: the label of a
sentence is latent, restricted to its document's labels, and found by expectation
maximisation. From the subjects of its sentences, its source and its structure a chain of
logistic classifiers, one a subject, each seeing the decisions before it, gives calibrated
probabilities of label combinations; beam search finds the most likely one. Each classifier has
its own weights, for every earlier subject too; those of one model fitted to all subjects
together are the mean of their prior, towards which a subject with few documents is drawn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.text import plain
from gneiss.runtime import ship, spread, table

#: At most this many labelled documents, chosen by a hash of their ids, train the model.
MAX_LABELLED = 5_000
#: How firmly a subject's own weights are held to the common ones.
OWN = 3.0
_TAG = re.compile(r"<[^<>]{0,200}>")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    """Sentences of running text without markup; titles and bare lines are left out."""
    out = []
    for para in re.split(r"\n\s*\n", _TAG.sub("\n\n", plain(text))):
        para = " ".join(para.split())
        out += [s for s in re.split(r"(?<=[.!?])\s+", para) if s and (len(s.split()) > 3 or s[-1] in ".!?")]
    return out


def terms(sentence: str) -> set[str]:
    w = _WORD.findall(sentence.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:])), *(f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:]))}


@dataclass
class TermModel:
    """For each term its log odds of the subjects times its information, and that information;
    for each source how much it raises the log odds of the subjects."""

    vocabulary: dict[str, int]
    weight: np.ndarray
    info: np.ndarray
    sources: dict[str, np.ndarray]

    @cached_property
    def _codes(self) -> tuple[dict[str, int], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Numbers of the single words, their terms, and for runs of two and three words the sorted
        keys and their terms. The key of a run is made of the place of the run without its last word
        and that word: a run is known only where its parts are."""
        grams = sorted((tuple(t.split(" ")), i) for t, i in self.vocabulary.items())
        words = {g[0]: n for n, (g, _) in enumerate(x for x in grams if len(x[0]) == 1)}
        at = {g: words[g[0]] for g, _ in grams if len(g) == 1}
        tables = []
        for length in (2, 3):
            keyed = sorted((at[g[:-1]] * len(words) + words[g[-1]], i, g) for g, i in grams if len(g) == length and g[:-1] in at and g[-1] in words)
            at = {g: n for n, (_, _, g) in enumerate(keyed)}
            tables.append((np.array([x for x, _, _ in keyed], dtype=np.int64), np.array([i for _, i, _ in keyed], dtype=np.int64)))
        return words, np.array([i for g, i in grams if len(g) == 1], dtype=np.int64), tables

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_codes"}

    def scores(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For the sentences that hold known terms, their places and the mean log odds over their
        terms, weighed by information."""
        words, single, tables = self._codes
        some = [_WORD.findall(s.lower()) for s in found]
        code = np.fromiter((words.get(w, -1) for x in some for w in x), dtype=np.int64)
        of = np.repeat(np.arange(len(some)), [len(x) for x in some])
        known = code >= 0
        pairs = [of[known] * len(self.info) + single[code[known]]] if len(single) else []
        run, where = code, np.arange(len(code))
        for length, (keys, terms_of) in enumerate(tables, 1):
            # runs that end one word further, in the same sentence
            ok = (run >= 0) & (where + length < len(code))
            run, where = run[ok], where[ok]
            nxt = code[where + length]
            ok = (nxt >= 0) & (of[where + length] == of[where])
            key, where = run[ok] * len(words) + nxt[ok], where[ok]
            if not len(keys):
                break
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            run, where = place[hit], where[hit]
            pairs.append(of[where] * len(self.info) + terms_of[run])
        at = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)  # a term counts once a sentence
        if not len(at):
            return np.zeros(0, np.int64), np.zeros((0, self.weight.shape[1]))
        sentence, term = np.divmod(at, len(self.info))
        begin = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        total = np.add.reduceat(self.info[term].astype(np.float64), begin)
        ok = total > 1e-9
        return sentence[begin][ok], np.add.reduceat(self.weight[term].astype(np.float64), begin, axis=0)[ok] / total[ok, None]


def source_odds(sources: list[str | None], labels: list[list[int]], k: int, smooth: float = 5.0) -> dict[str, np.ndarray]:
    """Log odds of the subjects among a source's documents over those among all, drawn to 0 for
    sources of few documents."""
    has = np.zeros((len(labels), k))
    for i, own in enumerate(labels):
        has[i, own] = 1
    base = (has.sum(0) + 0.5) / (len(labels) + 1)
    of: dict[str, list[int]] = {}
    for i, s in enumerate(sources):
        of.setdefault(s or "", []).append(i)
    odds = {}
    for s, at in of.items():
        n = has[at].sum(0)
        odds[s] = np.log((n + smooth * base) / (len(at) - n + smooth * (1 - base))) - np.log(base / (1 - base))
    return odds


def fit_terms(docs: list[list[str]], labels: list[list[int]], sources: list[str | None], k: int, background: int | None, rounds: int = 8, smooth: float = 0.3) -> TermModel:
    """``background`` is a subject that any document may hold a sentence of."""
    by_source = source_odds(sources, labels, k)
    bags, of = [], []
    for d, text in enumerate(docs):
        for s in text:
            bags.append(terms(s))
            of.append(d)
    df = Counter(t for b in bags for t in b)
    voc = {t: i for i, t in enumerate(sorted(t for t, n in df.items() if n >= 2))}
    if not voc:
        return TermModel({}, np.zeros((0, k), np.float32), np.zeros(0, np.float32), by_source)
    kept = [[voc[t] for t in b if t in voc] for b in bags]
    lens = np.array([len(x) for x in kept])
    cols = np.array([i for x in kept for i in x], dtype=np.int32)
    rows = np.repeat(np.arange(len(bags)), lens)
    full = lens > 0
    begin = (np.cumsum(lens) - lens)[full]
    p = np.zeros((len(bags), k))
    for i, d in enumerate(of):
        p[i, labels[d]] = 0.8 / len(labels[d])
        if background is not None and background not in labels[d]:
            p[i, background] = 0.2
    p /= p.sum(1, keepdims=True)
    may = p > 0
    for _ in range(rounds):
        count = np.stack([np.bincount(cols, weights=p[rows, j], minlength=len(voc)) for j in range(k)], 1)
        total = p.sum(0)
        prior = (total + 1) / (total.sum() + k)
        n = count.sum(1, keepdims=True)
        q = (count + smooth * prior) / (n + smooth)
        odds = np.log(q / prior) * (n / (n + 1))
        info = np.maximum((q * np.log(q / prior)).sum(1), 0)
        weight = odds * info[:, None]
        z = np.zeros_like(p)
        z[full] = np.add.reduceat(weight[cols], begin, axis=0) / np.maximum(np.add.reduceat(info[cols], begin), 1e-9)[:, None]
        z = np.where(may, 6 * z, -1e9)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    return TermModel(voc, weight.astype(np.float32), info.astype(np.float32), by_source)


KINDS = ("", "course", "notice", "report", "rule")


def describe(texts: list[str | None], sources: list[str | None], kinds: list[str | None], model: TermModel, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of each subject in each document, and features of each document."""
    found = [sentences(t or "") for t in texts]
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    which, z = model.scores([s for x in found for s in x])
    d = len(found)
    of = np.repeat(np.arange(d), sizes)[which]
    best = z.argmax(1) if len(z) else np.zeros(0, np.int64)
    cell = of * k + best
    count = np.bincount(cell, minlength=d * k).reshape(d, k).astype(float)
    strength = np.bincount(cell, weights=z[np.arange(len(z)), best] if len(z) else None, minlength=d * k).reshape(d, k).astype(float)
    n = np.maximum(1, sizes)[:, None]
    share = count / n
    top = np.maximum(share.max(1, keepdims=True), 1e-9)
    odds = np.stack([model.sources.get(s or "", np.zeros(k)) for s in sources]) if d else np.zeros((0, k))
    own = np.stack([share, share >= 0.25, share >= 0.2, np.minimum(count, 6) / 6, count == 1, (count == 1) & (n > 1) & (n <= 8), share / top, (share == share.max(1, keepdims=True)) & (count > 0), strength / np.maximum(count, 1), np.abs(share - 0.5) < 0.26, share > 0.75, odds], 2).astype(float)
    m = n[:, 0]
    titled = np.array([bool(t) and len(t.split("\n", 1)[0].split()) <= 4 for t in texts])
    doc = np.stack([np.log1p(m), m == 1, m <= 4, m <= 8, titled, *(np.array([(x or "") == kind for x in kinds]) for kind in KINDS)], 1).astype(float)
    return own, doc


def _row(own: np.ndarray, doc: np.ndarray, before: np.ndarray, j: int) -> np.ndarray:
    """Input of the classifier at place ``j``: its subject's features, those of the document and
    the decisions on the subjects before it."""
    taken = before[:j].sum()
    return np.concatenate([own, own * doc[1], own * doc[2], doc * 0.3, [1.0, taken, taken >= 2, own[0] * (taken > 0), own[1] * (taken > 0)], before])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25, prior: np.ndarray | None = None) -> np.ndarray:
    """``prior`` is the mean of the weights' prior, 0 if not given."""
    mean = np.zeros(x.shape[1]) if prior is None else prior
    w = mean.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - mean)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class ChainModel:
    subjects: list[str]
    term_model: TermModel
    order: list[int]
    weights: np.ndarray  # a row for each place of the chain
    scale: tuple[float, float] = (0.0, 1.0)  # of the log odds of a combination, fitted on held-out documents

    def decode(self, own: np.ndarray, doc: np.ndarray, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Most likely set of subjects of each document, as flags, and its probability, by beam
        search along the chain over all documents at once."""
        w, k = self.weights, len(self.order)
        size, f, d = len(own), own.shape[2], doc.shape[1]
        # what of each subject's input (see _row) does not depend on the decisions before it
        o = own[:, self.order]
        at = 3 * f + d
        fixed = np.einsum("njf,jf->nj", o, w[:, :f]) + doc[:, 1, None] * np.einsum("njf,jf->nj", o, w[:, f : 2 * f]) + doc[:, 2, None] * np.einsum("njf,jf->nj", o, w[:, 2 * f : 3 * f])
        fixed = fixed + 0.3 * doc @ w[:, 3 * f : at].T + w[:, at]
        some = o[:, :, 0] * w[:, at + 3] + o[:, :, 1] * w[:, at + 4]
        lp = np.full((size, beam), -np.inf)
        lp[:, 0] = 0.0
        chosen = np.zeros((size, beam, k))
        for j in range(k):
            n = chosen.sum(2)
            v = fixed[:, j, None] + w[j, at + 1] * n + w[j, at + 2] * (n >= 2) + some[:, j, None] * (n > 0) + chosen @ w[j, at + 5 :]
            v = np.clip(v, -30.0, 30.0)
            # beam b grows into 2b, with the subject, and 2b + 1, without
            grown = np.stack([lp - np.log1p(np.exp(-v)), lp - np.log1p(np.exp(v))], 2).reshape(size, 2 * beam)
            best = np.argsort(-grown, axis=1, kind="stable")[:, :beam]
            lp = np.take_along_axis(grown, best, 1)
            chosen = np.take_along_axis(chosen, (best // 2)[:, :, None], 1)
            chosen[:, :, j] = best % 2 == 0
        flags = np.zeros((size, k), dtype=bool)
        flags[:, self.order] = chosen[:, 0] > 0
        return flags, np.exp(lp[:, 0])

    def calibrated(self, p: np.ndarray) -> np.ndarray:
        """Share of right combinations among those of probability ``p``."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a + b * log_odds(p), -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(q / (1 - q))


def background_subject(labels: list[list[int]], k: int) -> int | None:
    """The subject that the documents' common matter belongs to: its label stands beside others much
    more rarely (by two standard errors) than labels do, as it is given only to documents that
    have no other. None if there is none."""
    n, beside = np.zeros(k), np.zeros(k)
    for own in labels:
        n[own] += 1
        beside[own] += len(own) > 1
    rate = beside.sum() / max(1.0, n.sum())
    z = (beside - rate * n) / np.sqrt(np.maximum(rate * (1 - rate) * n, 1e-9))
    z[n == 0] = 0
    return int(z.argmin()) if z.min() < -2 else None


def train(rows: list[tuple[str, str | None, str | None, list[str]]], subjects: list[str]) -> ChainModel:
    """Fit on ``(text, source, kind, labels)``, all labels alike for any number of documents. One
    that no sentence bears out is not told from a rare subject's and stays: in the term model
    the labels of a sentence are latent, in the chain they are cases of a share of 0."""
    k, at = len(subjects), {s: i for i, s in enumerate(subjects)}
    rows = [(t, s, d, sorted({at[x] for x in l if x in at})) for t, s, d, l in rows]
    rows = [r for r in rows if r[3] and r[0]]
    texts = [sentences(r[0]) for r in rows]
    use = [i for i, t in enumerate(texts) if t]
    background = background_subject([rows[i][3] for i in use], k)
    model_of = lambda fit: fit_terms([texts[i] for i in fit], [rows[i][3] for i in fit], [rows[i][1] for i in fit], k, background)
    seen_by = lambda some, m: describe([rows[i][0] for i in some], [rows[i][1] for i in some], [rows[i][2] for i in some], m, k)
    # held-out features: each half is described by the model of the other half
    halves = [[i for i in use if i % 2 == part] for part in (0, 1)]
    features = [seen_by(halves[part], model_of(halves[1 - part])) for part in (0, 1)]
    term_model = model_of(use)
    count = Counter(l for i in use for l in rows[i][3])
    order = sorted(range(k), key=lambda s: (-count[s], subjects[s]))
    if not use:
        return ChainModel(subjects, term_model, order, np.zeros((k, len(_row(np.zeros(12), np.zeros(5 + len(KINDS)), np.zeros(k), 0)))))

    def chain(parts: Sequence[int]) -> np.ndarray:
        x: list[list[np.ndarray]] = [[] for _ in order]
        y: list[list[float]] = [[] for _ in order]
        for i, part, n in sorted((i, part, n) for part in parts for n, i in enumerate(halves[part])):
            own, doc = features[part][0][n], features[part][1][n]
            before = np.zeros(k)
            for j, s in enumerate(order):
                x[j].append(_row(own[s], doc, before, j))
                y[j].append(float(s in rows[i][3]))
                before[j] = y[j][-1]
        mean = fit_logistic(np.array(sum(x, [])), np.array(sum(y, [])))
        return np.stack([fit_logistic(np.array(a), np.array(b), OWN, prior=mean) for a, b in zip(x, y)])

    # how often a combination of some probability is right, seen on the half that its chain is not of
    odds, right = [], []
    for part in (0, 1):
        if halves[part] and halves[1 - part]:
            flags, p = ChainModel(subjects, term_model, order, chain([1 - part])).decode(*features[part])
            odds.append(log_odds(p))
            right += [float(set(np.flatnonzero(got)) == set(rows[i][3])) for i, got in zip(halves[part], flags)]
    x = np.concatenate(odds) if odds else np.zeros(0)
    scale = fit_logistic(np.stack([np.ones(len(x)), x], 1), np.array(right), 1.0, prior=np.array([0.0, 1.0])) if len(x) else np.array([0.0, 1.0])
    return ChainModel(subjects, term_model, order, chain([0, 1]), (float(scale[0]), float(scale[1])))


def subject_model(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MAX_LABELLED) -> ChainModel:
    """Train on at most ``most`` labelled documents."""
    subjects = sorted(r[0] for r in areas.where("subject is not null").select("subject").distinct().collect())  # the closed list
    of = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    rows = of.join(documents.select("doc_id", "text", "source", "doc_kind"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return train([(r["text"], r["source"], r["doc_kind"], list(r["labels"])) for r in rows], subjects)


def subjects_of(documents: DataFrame, model: ChainModel) -> DataFrame:
    """``(doc_id, subject, share, confidence)`` for every document row: each subject of the most
    likely combination, the share of sentences on it and the combination's probability. A NULL
    or empty text has none; repeated rows come out once."""
    spark = documents.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by MAX_LABELLED documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        k = len(m.subjects)
        for pdf in batches:
            pdf = pdf[pdf["text"].notna() & (pdf["text"] != "")]
            for lo in range(0, len(pdf), 256):
                some = pdf.iloc[lo : lo + 256]
                own, doc = describe(list(some["text"]), list(some["source"]), list(some["doc_kind"]), m.term_model, k)
                flags, p = m.decode(own, doc)
                flags[own[:, :, 0].max(1) <= 0] = False
                d, s = np.nonzero(flags)
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy()[d], "subject": np.array(m.subjects, dtype=object)[s], "share": own[d, s, 0], "confidence": m.calibrated(p)[d]})

    rows = spread(documents.where("doc_id is not null").select("doc_id", "text", "source", "doc_kind"), "doc_id")
    found = rows.mapInPandas(run, "doc_id long, subject string, share double, confidence double")
    return found.groupBy("doc_id", "subject").agg(F.max("share").alias("share"), F.max("confidence").alias("confidence"))


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ChainModel]:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels")
    return documents, labels, subject_model(documents, labels, table(spark, sf_dir, "subject_areas"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of the documents that have no label."""
    documents, labels, model = _all(spark, sf_dir)
    # the labelled ones are left out of the result, which is far smaller than the texts
    return subjects_of(documents, model).join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by subject over the whole corpus, weights split over a
    document's subjects."""
    documents, _, model = _all(spark, sf_dir)
    found = subjects_of(documents, model)
    size = documents.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    return found.join(n, "doc_id").join(size, "doc_id").groupBy("subject").agg(F.sum(1 / F.col("k")).alias("documents"), F.sum(F.col("chars") / F.col("k")).alias("chars"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}

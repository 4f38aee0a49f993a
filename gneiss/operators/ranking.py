"""Ranked retrieval for many queries in one plan: BM25, vectors, fusion, confidence.

Everything is keyed by ``query_id``; ties are broken by id, scores are rounded to nine places
before ranking so that the order of summation can't turn a tie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import with_tokens
from gneiss.runtime import keep, ship

K1, B = 1.5, 0.75
#: Terms in more than this share of the items are scored by pattern, all others by their postings.
COMMON_SHARE = 1 / 200


class Best:
    """The ``k`` best of many rows (queries), fed with blocks of scores. What is kept has at most
    ``k`` better ones known, so the result is whole but for what can't be among the ``k`` best; the
    items of a block stand in order of their ids, by which ties are cut. Used in the workers."""

    def __init__(self, rows: int, k: int, above: float = float("-inf")):
        import numpy as np

        self.k, self.above, self.scores = k, above, np.full((rows, k), -np.inf)
        self.kept: list = []
        self.held, self.most = 0, 4_000_000

    def edges(self):
        """The ``k``-th best score of every row so far."""
        return self.scores.min(axis=1)

    def add(self, first: int, s, item: int) -> None:
        """Scores of rows from ``first`` on (``s``, rows by items) for items from number ``item`` on."""
        import numpy as np

        k, (m, n) = self.k, s.shape
        edge = self.scores[first : first + m].min(axis=1)
        low = np.maximum(edge - 1e-9, self.above + 4e-10)  # before rounding
        if n > k and np.isneginf(edge).any():
            low = np.maximum(low, np.partition(s, n - k, axis=1)[:, n - k] - 1e-9)
        r, c = np.nonzero(s >= low[:, None])
        v = np.round(s[r, c], 9)
        some = (v >= edge[r]) & (v > self.above) if self.above > -np.inf else v >= edge[r]
        r, c, v = r[some], c[some], v[some]
        if not len(r):
            return
        r, c, v = _first(k, r, c, v)
        every, values = np.concatenate([np.repeat(np.arange(m), k), r]), np.concatenate([self.scores[first : first + m].ravel(), v])
        self.scores[first : first + m] = _first(k, every, every, values)[2].reshape(m, k)
        self.kept.append((r + first, c + item, v))
        self.held += len(r)
        if self.held > self.most:
            self.kept = [self.rows()]
            self.held = len(self.kept[0][0])
            self.most = max(self.most, 2 * self.held)

    def rows(self):
        """Arrays of row, item number and score."""
        import numpy as np

        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        r, c, v = (np.concatenate(x) for x in zip(*self.kept))
        some = v >= self.edges()[r]
        return r[some], c[some], v[some]


def _first(k: int, r, c, v):
    """The first ``k`` entries of every row ``r`` by score ``v`` descending, then ``c``."""
    import numpy as np

    o = np.lexsort((c, -v, r))
    r, c, v = r[o], c[o], v[o]
    some = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[some], c[some], v[some]


def _by_id(batch):
    """A batch in order of ``item_id``."""
    import pyarrow.compute as pc

    return batch.take(pc.array_sort_indices(batch.column("item_id"), null_placement="at_start"))


def _lists(column):
    """Values of a list column, start and length of every list (NULL: -1)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten()
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    return values, start, size


def term_counts(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``(item_id, length, term, tf)`` of every term of every item, counted by partial
    aggregation. Items without terms have no row; repeated items should be removed before."""
    toks = with_tokens(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text")), "_text")
    # the length is taken first: an array kept beside its own elements is copied for each of them;
    # and the outer form spares a filter on the array's size that would build it a second time
    return toks.withColumn("length", F.size("t")).select("item_id", "length", F.explode_outer("t").alias("term")).where("term is not null").groupBy("item_id", "length", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def corpus_stats(items: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: number of items and their mean length in tokens. Lengths are the sums of the
    term counts, so no text is read a second time; items without terms count with length 0."""
    n = items.agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_sum"))
    return n.crossJoin(F.broadcast(total)).select("n", (F.col("_sum") / F.greatest(F.lit(1), F.col("n"))).alias("avgdl"))  # one row each


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``(query_id, term, qtf)``: repeated query terms count."""
    return with_tokens(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("_text")), "_text").select("query_id", F.explode_outer("t").alias("term")).where("term is not null").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(counts: DataFrame, stats: DataFrame, terms: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """``(query_id, item_id, score)`` with score > 0. Document frequencies and mean length are
    those of the whole index; ``eligible`` (item_id) restricts results only. The postings meet
    the query terms before anything else, so only terms that were asked for are shuffled on."""
    wanted = terms.select("term").distinct()
    hit = counts.join(wanted, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if eligible is not None:
        hit = hit.join(eligible.select("item_id").distinct(), "item_id", "left_semi")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.greatest(F.col("length"), F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1e-9)))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", idf)  # stats: one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return hit.join(weighed, "term").groupBy("query_id", "item_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def bm25_search(items: DataFrame, queries: DataFrame, k: int, eligible: DataFrame | None = None, block: int = 50_000, share: float = COMMON_SHARE) -> DataFrame:
    """Exact ``(query_id, item_id, score)`` top ``k`` by BM25 of ``items (item_id, content)`` for
    ``queries (query_id, question)``, as ``top_k`` of ``bm25`` but without a row for every pair that
    shares a term. ``eligible`` restricts results only.

    Each item's counts of the terms asked for stay in one row. Common terms (in more than ``share`` of
    the items) make few combinations, whose scores are worked out once for all queries that hold
    the same one. Only items with a rarer term of a query are scored for that query itself, and
    since terms only add to a score, the ``k`` best of both together hold the ``k`` best of all.
    Queries come in blocks of about ``block``, of which the terms are collected."""
    spark = items.sparkSession
    ship(spark)
    bags = query_terms(queries.where("query_id is not null"), "query_id", "question").groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("term", "qtf"))).alias("bag"))
    bags = keep(bags.select("query_id", "bag.term", "bag.qtf"))
    n_blocks = -(-bags.count() // block)
    texts = with_tokens(items.select(F.col("item_id").cast("string").alias("item_id"), "content"), "content").select("item_id", "t")
    out = None
    for b in range(n_blocks):
        part = _bm25_block(texts, bags.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b), k, eligible, share)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id string, item_id string, score double") if out is None else out


def _bm25_block(texts: DataFrame, bags: DataFrame, k: int, eligible: DataFrame | None, share: float) -> DataFrame:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = texts.sparkSession
    asked = bags.toArrow().combine_chunks()  # the terms of one block of queries
    if not asked.num_rows:
        return spark.createDataFrame([], "query_id string, item_id string, score double")
    names = asked.column("query_id").combine_chunks()
    flat, start, size = _lists(asked.column("term").combine_chunks())
    qtf = asked.column("qtf").combine_chunks().flatten().to_numpy()
    vocabulary = pc.unique(flat)
    terms, whose = pc.index_in(flat, value_set=vocabulary).to_numpy(), np.repeat(np.arange(len(size)), size)
    known = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        for b in batches:
            values, _, size = _lists(b.column("t"))
            at = pc.fill_null(pc.index_in(values, value_set=known.value), -1).to_numpy()
            key = (np.repeat(np.arange(len(size)), size) * len(known.value) + at)[at >= 0]
            key, tf = np.unique(key, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(key // len(known.value), minlength=len(size)))]).astype("int32")
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype("int32"))) for x in (key % len(known.value), tf)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(size.astype("int32")), *lists], ["item_id", "length", "term", "tf"])

    postings = keep(texts.mapInArrow(count, "item_id string, length int, term array<int>, tf array<int>"))
    n, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = np.zeros(len(vocabulary))
    for r in postings.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # terms of this block's queries
        df[r["term"]] = r["df"]
    if eligible is not None:
        postings = postings.join(eligible.select(F.col("item_id").cast("string").alias("item_id")).distinct(), "item_id", "left_semi")

    common = df > share * n
    column = np.where(common, np.cumsum(common) - 1, -1)
    n_common = int(common.sum())
    # the combination of common terms of every query
    numbers: dict[tuple, int] = {}
    parts: list[list] = [[] for _ in range(len(names))]
    for q, t, f in zip(whose[common[terms]].tolist(), column[terms[common[terms]]].tolist(), qtf[common[terms]].tolist()):
        parts[q].append((t, f))
    pattern = np.array([numbers.setdefault(tuple(sorted(p)), len(numbers)) for p in parts])
    widest = max(1, *(len(p) for p in numbers))
    cols, times = np.full((len(numbers), widest), n_common), np.zeros((len(numbers), widest))  # beyond a combination's terms: a row of zeros
    for p, i in numbers.items():
        cols[i, : len(p)], times[i, : len(p)] = [t for t, _ in p], [f for _, f in p]
    # queries of every rarer term
    rare = np.flatnonzero(~common[terms] & (df[terms] > 0))
    rare = rare[np.argsort(terms[rare], kind="stable")]
    sent = spark.sparkContext.broadcast({
        "idf": np.log(1.0 + (n - df + 0.5) / (df + 0.5)), "column": column, "n_common": n_common, "avgdl": max(1e-9, total / max(1, n)), "pattern": pattern, "cols": cols, "times": times,
        "query": whose[rare], "qtf": qtf[rare].astype(float), "first": np.searchsorted(terms[rare], np.arange(len(df) + 1)),
    })

    def score(batches):
        x = sent.value
        n_patterns = len(x["cols"])
        best = Best(n_patterns, k, 0.0)
        ids, seen = [], 0
        for b in batches:
            step = max(64, 4_000_000 // (x["n_common"] + 1))
            for i in range(0, b.num_rows, step):
                c = _by_id(b.slice(i, step))
                values, _, size = _lists(c.column("term"))
                term, tf, doc = values.to_numpy(), c.column("tf").flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
                norm = K1 * (1 - B + B * np.maximum(c.column("length").to_numpy(), 1) / x["avgdl"])
                w = x["idf"][term] * tf * (K1 + 1) / (tf + norm[doc])
                col = x["column"][term]
                dense = np.zeros((x["n_common"] + 1, len(size)))
                dense[col[col >= 0], doc[col >= 0]] = w[col >= 0]
                for p in range(0, n_patterns, 64):
                    best.add(p, np.stack([t @ dense[a] for a, t in zip(x["cols"][p : p + 64], x["times"][p : p + 64])]), seen)
                ids.append(c.column("item_id"))
                yield from rarer(x, dense, term[col < 0], doc[col < 0], w[col < 0], best.edges(), c.column("item_id"))
                seen += len(size)
        if seen:
            r, c, v = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(r.astype("int32")), pa.concat_arrays(ids).take(pa.array(c)), pa.array(v)], ["g", "item_id", "score"])

    def rarer(x, dense, term, doc, w, edges, ids):
        """Scores of the queries that hold one of an item's rarer terms, by slices of whole items."""
        n_docs, many = dense.shape[1], x["first"][term + 1] - x["first"][term]
        at, until = 0, np.cumsum(many)
        while at < len(term):
            end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + 2_000_000)))
            end = int(np.searchsorted(doc, doc[end - 1], side="right"))
            m = many[at:end]
            j = np.repeat(x["first"][term[at:end]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            key, back = np.unique(x["query"][j] * n_docs + np.repeat(doc[at:end], m), return_inverse=True)
            s = np.bincount(back, weights=x["qtf"][j] * np.repeat(w[at:end], m), minlength=len(key))
            q, d = key // n_docs, key % n_docs
            p = x["pattern"][q]
            for c, t in zip(x["cols"][p].T, x["times"][p].T):
                s += t * dense[c, d]
            s = np.round(s, 9)
            some = (s >= edges[p]) & (s > 0)
            q, d, s = _first(k, q[some], d[some], s[some])
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array((q + len(x["cols"])).astype("int32")), ids.take(pa.array(d)), pa.array(s)], ["g", "item_id", "score"])
            at = end

    found = top_k(postings.mapInArrow(score, "g int, item_id string, score double"), k, "g")
    groups = np.concatenate([pattern, np.arange(len(names)) + len(numbers)])  # a query's results are those of its combination and its own
    of = spark.createDataFrame(pa.table({"g": pa.array(groups.astype("int32")), "query_id": pa.concat_arrays([names, names])}))
    both = found.join(F.broadcast(of), "g").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))  # of: one block of queries
    return top_k(both, k).select("query_id", "item_id", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """Exact ``(query_id, item_id, score)`` top ``k`` by dot product of ``(item_id, vector)`` for
    the stated query set ``(query_id, vector)``. The vectors are read once for as many queries as
    take 64 MB (``block`` at least); those meet them as dense matrices of ``block`` rows. A task keeps
    ``k`` candidates a query and only those are shuffled. Vectors of another length than the
    query's, NULL ones and NULL elements give no result."""
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id string, item_id string, score double"
    ids = queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("string").alias("query_id"), "vector")
    n_queries, widest = ids.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    n_passes = -(-n_queries // max(block, 64_000_000 // (8 * max(1, widest or 1))))
    numbered = ids.withColumn("_pass", F.pmod(F.xxhash64("query_id"), F.lit(max(1, n_passes))))
    vectors = vectors.select(F.col("item_id").cast("string").alias("item_id"), "vector")
    if n_passes > 1:
        vectors = keep(vectors)
    out = None
    for b in range(n_passes):
        rows = numbered.where(F.col("_pass") == b).select("query_id", "vector").toArrow().combine_chunks()  # 64 MB of vectors
        if not rows.num_rows:
            continue
        names, (values, start, size) = rows.column("query_id").combine_chunks(), _lists(rows.column("vector").combine_chunks())
        null, flat = np.asarray(values.is_null()), values.to_numpy(zero_copy_only=False)
        by_size: dict[int, tuple] = {}
        for n in set(size.tolist()):
            at = np.flatnonzero(size == n)
            cells = start[at][:, None] + np.arange(n)
            at, cells = at[~null[cells].any(axis=1)], cells[~null[cells].any(axis=1)]
            if len(at):
                by_size[n] = (names.take(pa.array(at)), flat[cells].astype(np.float64))
        sent = spark.sparkContext.broadcast(by_size)

        def scan(batches, sent=sent):
            best = {n: Best(len(q), k) for n, (_, q) in sent.value.items()}
            items, seen = [], 0
            for b in batches:
                b = _by_id(b)
                values, start, size = _lists(b.column("vector"))
                flat = values.to_numpy(zero_copy_only=False)
                for n, (_, q) in sent.value.items():
                    at = np.flatnonzero(size == n)
                    for i in range(0, len(at), 4096):
                        m = flat[start[at[i : i + 4096]][:, None] + np.arange(n)].astype(np.float64)  # NULL elements are NaN
                        whole = ~np.isnan(m).any(axis=1)
                        if whole.any():
                            m = m[whole].T
                            items.append(b.column("item_id").take(pa.array(at[i : i + 4096][whole])))
                            for j in range(0, len(q), block):
                                best[n].add(j, q[j : j + block] @ m, seen)
                            seen += m.shape[1]
            if seen:
                every = pa.concat_arrays(items)
                for n, (names, _) in sent.value.items():
                    r, c, v = best[n].rows()
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(r)), every.take(pa.array(c)), pa.array(v)], ["query_id", "item_id", "score"])

        part = vectors.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return top_k(out, k).select("query_id", "item_id", "score")


def ranked(scores: DataFrame, group: str = "query_id") -> DataFrame:
    """Add ``rank``: unique items by score descending, then id. An item listed twice keeps its
    best place and takes one rank."""
    best = scores.groupBy(group, "item_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "item_id")))


def top_k(scores: DataFrame, k: int, group: str = "query_id") -> DataFrame:
    """The ``k`` best items of each group with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "item_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(rankings: Mapping[str, DataFrame], k: float = 60, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, item_id, rank)`` lists: ``(query_id, item_id,
    fusion_score, retriever_ranks, retriever_sources)``."""
    if k <= 0 or any((weights or {}).get(n, 1.0) < 0 for n in rankings):
        raise ValueError("k must be positive and weights not negative")
    parts = [r.select("query_id", "item_id", "rank", F.lit(n).alias("retriever"), F.lit(float((weights or {}).get(n, 1.0))).alias("w")) for n, r in rankings.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "item_id").agg(
        F.round(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))), 9).alias("fusion_score"),
        F.sort_array(F.collect_list(F.struct("retriever", "rank"))).alias("_r"),  # one entry a retriever
    ).select("query_id", "item_id", "fusion_score", F.map_from_entries("_r").alias("retriever_ranks"), F.col("_r.retriever").alias("retriever_sources"))


def fusion_margin(fused: DataFrame) -> DataFrame:
    """Distance of the best fused score from the second, by query (the score itself if alone)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "item_id")
    return (
        fused.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("fusion_score").over(w)).where("_n = 1")
        .select("query_id", "item_id", F.round(F.col("fusion_score") - F.coalesce("_next", F.lit(0.0)), 9).alias("margin"))
    )


def quota_split(scores: DataFrame, arm: str, k: int, arms: int) -> DataFrame:
    """Top rows of each arm, ``k`` in all: every arm gets k // arms, the first k % arms one more.
    ``arm`` is numbered from 0."""
    w = Window.partitionBy("query_id", arm).orderBy(F.desc("score"), "item_id")
    quota = F.lit(k // arms) + (F.col(arm) < F.lit(k % arms)).cast("int")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)


# Weights of the linear confidence model, in order of its features.
LINEAR_WEIGHTS = {"lexical_overlap": 0.55, "dense_cosine": 0.35, "agreement": 0.10}


def linear_confidence(weights: Mapping[str, float] = LINEAR_WEIGHTS, intercept: float = 0.0, logistic: bool = False) -> Column:
    """Confidence from feature columns, clamped to [0, 1] and rounded to six places."""
    z = F.lit(float(intercept))
    for name, w in weights.items():
        z = z + F.lit(float(w)) * F.col(name)
    if logistic:
        z = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)), 6)


def accept(rows: DataFrame, threshold: float, fused: bool = True) -> DataFrame:
    """Apply an acceptance threshold to ``(query_id, ..., confidence)``: fused lists are kept or
    refused as a whole by their best confidence, others row by row."""
    if fused:
        return rows.withColumn("_best", F.max("confidence").over(Window.partitionBy("query_id"))).where(F.col("_best") >= threshold).drop("_best")
    return rows.where(F.col("confidence") >= threshold)


def with_abstentions(results: DataFrame, queries: DataFrame, reason: str = "no_candidate") -> DataFrame:
    """One row with an abstention reason for every query without results."""
    missing = queries.select("query_id").distinct().join(results.select("query_id").distinct(), "query_id", "left_anti")
    return results.withColumn("abstention", F.lit(None).cast("string")).unionByName(missing.withColumn("abstention", F.lit(reason)), allowMissingColumns=True)


def bounded(rows: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """Groups with more than ``most`` rows are refused whole, never cut."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") <= most).drop("_n")


def exact_route(items: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Route of every question by the codes it names, and the items that hold one of them.

    ``items (item_id, doc_id, content)``, ``questions (query_id, question)``. The first result is
    ``(query_id, codes, candidates, documents, route)``: ``exact_code`` where one code is named and one
    document has between one and ``k`` items with it; ``no_candidate`` where no item holds a code
    asked for; ``ambiguous`` where there are several codes or documents or too many items, which the
    hybrid search resolves with the exact list as a further ranker; ``hybrid_rrf`` without a code. The
    second is ``(query_id, item_id, doc_id)``. Texts are searched whole; NULL texts hold no code."""
    from gneiss.functions.text import detected_codes

    codes = lambda c: F.explode_outer(F.array_distinct(detected_codes(F.coalesce(F.col(c), F.lit("")))))
    asked = questions.select("query_id", codes("question").alias("code"))
    held = items.select("item_id", "doc_id", codes("content").alias("code")).where("code is not null")
    found = asked.where("code is not null").join(held, "code").select("query_id", "item_id", "doc_id").distinct()
    counts = found.groupBy("query_id").agg(F.count_distinct("item_id").alias("candidates"), F.count_distinct("doc_id").alias("documents"))
    n = asked.groupBy("query_id").agg(F.count("code").alias("codes")).join(counts, "query_id", "left").fillna(0, ["candidates", "documents"])
    route = (
        F.when(F.col("codes") == 0, "hybrid_rrf").when(F.col("candidates") == 0, "no_candidate")
        .when((F.col("codes") == 1) & (F.col("documents") == 1) & (F.col("candidates") <= k), "exact_code").otherwise("ambiguous")
    )
    return n.select("query_id", "codes", "candidates", "documents", route.alias("route")), found


#: Modes of ``hybrid``: which rankers take part.
MODES = {"hybrid_rrf": ("bm25", "dense"), "bm25": ("bm25",), "dense": ("dense",), "exact_code": ("bm25", "dense", "exact"), "body_rrf": ("bm25", "dense", "body")}


def hybrid(items: DataFrame, questions: DataFrame, k: int = 5, embedding=None, rrf_k: float = 3.0, candidates: int = 40, mode: str = "hybrid_rrf", eligible: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """Hybrid search of ``questions (query_id, question)`` over ``items (item_id, content)``: BM25
    and vectors, fused by reciprocal ranks with weights 1.0 and 1.2, with a confidence from
    lexical overlap, cosine and agreement. Refused and empty questions get an abstention row.

    ``mode`` is one of ``MODES``. ``body_rrf`` adds a ranking of the texts without their first line.
    ``exact_code`` needs ``doc_id`` in ``items``: questions of one unambiguous code get its items
    alone, ambiguous ones have the exact list as a further ranker, a code that no item holds
    abstains. ``eligible (item_id)`` restricts the results, not the statistics. Lists whose best
    confidence is below ``threshold`` are refused whole."""
    from gneiss.functions.text import hash_embedding, overlap, query_guard, tokens

    embedding = embedding or hash_embedding
    guarded = keep(questions.withColumn("guard", query_guard(F.col("question"))))
    asked = guarded.where("guard is null")
    rankers = MODES[mode]
    allowed = items if eligible is None else items.join(eligible.select("item_id").distinct(), "item_id", "left_semi")

    def lexical(some: DataFrame) -> DataFrame:
        return keep(top_k(bm25_search(some, asked, candidates, eligible), candidates))

    lists: dict[str, DataFrame] = {}
    if "bm25" in rankers:
        lists["bm25"] = lexical(items)
    if "body" in rankers:
        lists["body"] = lexical(items.withColumn("content", F.regexp_replace("content", r"\A[^\n]*\n", "")))
    if "dense" in rankers:
        vectors = allowed.select("item_id", embedding("content").alias("vector"))
        lists["dense"] = keep(top_k(dense_search(vectors, asked.select("query_id", embedding("question").alias("vector")), candidates), candidates))
    if "exact" in rankers:
        route, exact = exact_route(allowed, asked, k)
        scored = exact.join(lists["bm25"].select("query_id", "item_id", "score"), ["query_id", "item_id"], "left").fillna(0.0, ["score"])
        lists["exact"] = top_k(scored, candidates).select("query_id", "item_id", "score", "rank")
        # one unambiguous code: its items alone; a code that nothing holds: nothing
        alone = route.where("route in ('exact_code', 'no_candidate')").select("query_id")
        lists = {n: r if n == "exact" else r.join(alone, "query_id", "left_anti") for n, r in lists.items()}
    fused = rrf(lists, rrf_k, {"dense": 1.2})
    best = top_k(fused.withColumnRenamed("fusion_score", "score"), k)
    dense = lists["dense"] if "dense" in lists else lists["bm25"].where("false")
    cosine = dense.select("query_id", "item_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("dense_cosine"))
    rows = best.join(cosine, ["query_id", "item_id"], "left").join(items, "item_id").join(asked.select("query_id", "question"), "query_id")
    long = lambda c: F.filter(tokens(F.col(c)), lambda t: F.length(t) >= 3)
    rows = rows.withColumn("lexical_overlap", overlap(long("question"), tokens(F.col("content")))).withColumn("agreement", (F.size("retriever_sources") > 1).cast("double")).withColumn("dense_cosine", F.coalesce("dense_cosine", F.lit(0.0)))
    found = keep(rows.select("query_id", "item_id", "rank", "score", "retriever_sources", linear_confidence().alias("confidence")))
    weak = None
    if threshold > 0:
        kept = accept(found, threshold)
        weak = found.select("query_id").distinct().join(kept.select("query_id").distinct(), "query_id", "left_anti")
        found = kept
    refused = guarded.where("guard is not null").select("query_id", F.col("guard").alias("abstention"))
    if weak is not None:
        refused = refused.unionByName(weak.withColumn("abstention", F.lit("below_score_threshold")))
        asked = asked.join(weak, "query_id", "left_anti")
    return with_abstentions(found, asked).unionByName(refused, allowMissingColumns=True)

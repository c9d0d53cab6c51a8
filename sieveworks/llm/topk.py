"""Exact top-k inner products by MaxScore over integer vectors.

A query's terms are its dimensions. Within a shard (a batch of vectors) every term has postings,
the shard's values of that dimension, and a score bound, the most that any posting can add. Terms
are ordered by how far their bound lies above the least they add. The longest run of last terms that together
cannot lift a vector from the least of all scores to the query's current k-th score is non-essential; before there are k
scores, all terms are essential. The essential terms' postings are traversed for all vectors; the non-essential ones are
probed in groups, each time only for vectors that can still compete. Shards keep their best k; a merge over shards
gives the result.

While sums of products stay below 2**53, double arithmetic is exact; larger ones are summed as whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, table, written

#: Queries that one pass over the vectors carries; the bound of what is broadcast.
PASS = 8192
#: Terms probed at a time.
GROUP = 8
EXACT = float(2**53)


def usable(vector: Column) -> Column:
    """Vectors that are not null and hold neither nulls nor non-finite components."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one query against one shard: scores and rows of its best k that reach floor, ties to smaller ids.

    low, high: least and largest value of each dimension in the shard."""
    a, b = q * low, q * high
    least, most = np.minimum(a, b), np.maximum(a, b)
    terms = np.argsort(least - most, kind="stable")
    # what terms from place i on can add at most, and what that is above the least
    rest = np.concatenate([np.cumsum(most[terms][::-1])[::-1], [0.0]])
    slack = np.concatenate([np.cumsum((most - least)[terms][::-1])[::-1], [0.0]])
    # non-essential: the last terms whose slack does not lift the least score to the floor
    at = max(1, len(terms) - int(np.searchsorted(slack[::-1], floor - rest[0] + slack[0], side="left")) + 1) if floor > -np.inf else len(terms)
    at = min(at, len(terms))
    rows = np.flatnonzero(ids != own)
    part = v[:, terms[:at]] @ q[terms[:at]]
    part = part[rows]
    while True:
        if len(rows) > k:
            # the k-th of what the vectors reach at least: nothing below it can enter
            sure = np.partition(part, len(part) - k)[len(part) - k] + rest[at] - slack[at]
            floor = max(floor, sure)
        able = part + rest[at] >= floor
        rows, part = rows[able], part[able]
        if at >= len(terms) or not len(rows):
            break
        more = terms[at : at + GROUP]
        part = part + v[np.ix_(rows, more)] @ q[more]
        at += len(more)
    keep = np.lexsort((ids[rows], -part))[:k]
    return part[keep], rows[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int, *, ident: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row its k best of the other rows by id.

    Both frames hold ids and vectors; components become floor(scale * x). Unusable vectors take no part, as query or
    as candidate; neither do rows without id, nor candidates whose length differs from the query's. Repeated rows
    count as often as they stand, in any order. Queries go out in passes of PASS by hash, and each pass is written before the
    next begins, so what is collected and broadcast is bounded; every pass reads the vectors once. A score beyond 64 bits is an
    error. No queries or no vectors: no rows."""
    spark = vectors.sparkSession
    ready = lambda df: df.where(F.col(ident).isNotNull() & usable(F.col(vector))).select(F.col(ident).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    own, all_rows = ready(queries), ready(vectors)
    n = own.count()
    passes = max(1, -(-n // (PASS * 3 // 4)))
    slot = F.pmod(F.xxhash64("id"), F.lit(passes))
    out = None
    for i in range(passes):
        rows = own.where(slot == i).collect()
        run, shared = _shards(spark, [(r["id"], r["v"]) for r in rows], k)
        found = mapped(all_rows, run, "query_id long, vec_id long, score long", texts=False)
        if passes > 1:
            found = written(found, "topk-pass")
            shared.unpersist()
        out = found if out is None else out.union(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shards(spark: SparkSession, queries: list[tuple[int, list[float]]], k: int):
    sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # equal queries (repeated rows) are searched once
    seen = sorted({(i, tuple(v)) for i, v in queries})
    for size in {len(v) for _, v in seen}:
        some = [(i, v) for i, v in seen if len(v) == size]
        sizes[size] = np.array([i for i, _ in some], np.int64), np.array([v for _, v in some], np.float64).reshape(len(some), size)
    shared = spark.sparkContext.broadcast(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            column = batch.column("v")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            ids_all = batch.column("id").to_numpy()
            for size, (names, q) in shared.value.items():
                rows = np.flatnonzero(lengths == size)
                if not len(rows):
                    continue
                v = flat[starts[rows][:, None] + np.arange(size)[None, :]].reshape(len(rows), size)
                exact = not size or np.abs(v).max() * np.abs(q).max(initial=0) * size < EXACT
                ids = ids_all[rows]
                if not exact:
                    whole = [[int(x) for x in row] for row in v]
                low, high = (v.min(axis=0), v.max(axis=0)) if size else (np.zeros(0), np.zeros(0))
                for j in range(len(names)):
                    had = kept.get((size, j))
                    floor = float(had[0][-1]) if had is not None and len(had[0]) >= k else -np.inf
                    if size == 0:
                        at = np.flatnonzero(ids != names[j])
                        at = at[np.argsort(ids[at], kind="stable")][:k]
                        s = np.zeros(len(at))
                    elif not exact:
                        own = [int(x) for x in q[j]]
                        s = np.array([sum(map(mul, own, row)) for row in whole], np.int64)
                        at = np.flatnonzero(ids != names[j])
                        at = at[np.lexsort((ids[at], -s[at]))][:k]
                        s = s[at]
                    else:
                        s, at = best(q[j], v, ids, int(names[j]), k, floor, low, high)
                    got = ids[at]
                    s = s.astype(np.int64)
                    if had is not None:
                        s, got = np.concatenate([had[0], s]), np.concatenate([had[1], got])
                        order = np.lexsort((got, -s))[:k]
                        s, got = s[order], got[order]
                    kept[size, j] = s, got
        for (size, j), (s, got) in kept.items():
            names = shared.value[size][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), names[j])), pa.array(got), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run, shared


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 best for every row whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

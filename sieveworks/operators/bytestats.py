"""Byte statistics of files: histograms, entropy, nibble signatures, pairs, order-1 cost.

Bytes are counted inside Arrow batches with numpy, one pass over each text, so what leaves a task is counts (at
most 256 or 65,536 for a file or batch), not a row for every byte; counts are then summed relationally.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# functions of this module travel with the tasks, wherever the package is installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def entropy_bits(counts: np.ndarray) -> float:
    """Bits per symbol; 0 without symbols."""
    n = counts[counts > 0].astype(float)
    if not len(n):
        return 0.0
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def entropy_of_cells(column: str) -> Column:
    """Aggregate: the byte entropy of all cells together."""

    def run(v: pd.Series) -> float:
        return entropy_bits(np.bincount(np.frombuffer("".join(v.dropna()).encode(), np.uint8), minlength=256))

    return F.pandas_udf(run, "double")(F.col(column))


def per_file(files: DataFrame, of: Callable[[np.ndarray], list[tuple]], names: list[tuple[str, pa.DataType]], schema: str, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that `of` makes from the bytes of each file, after the file's id; null texts make none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, rows = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if t is not None:
                        found = of(np.frombuffer(t.encode(), np.uint8))
                        ids += [i] * len(found)
                        rows += found
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, kind) for c, (_, kind) in zip(columns, names, strict=True)]], names=["doc_id", *[n for n, _ in names]])

    return files.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(run, f"doc_id long, {schema}")


def histogram(files: DataFrame, **columns: str) -> DataFrame:
    """doc_id, byte, n."""

    def of(b: np.ndarray) -> list[tuple]:
        c = np.bincount(b, minlength=256)
        return [(int(x), int(c[x])) for x in np.flatnonzero(c)]

    return per_file(files, of, [("byte", pa.int64()), ("n", pa.int64())], "byte long, n long", **columns)


def entropy(files: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_bytes, distinct_bytes, entropy: empty files have entropy 0."""

    def of(b: np.ndarray) -> list[tuple]:
        c = np.bincount(b, minlength=256)
        return [(len(b), int((c > 0).sum()), round(entropy_bits(c), 6))]

    return per_file(files, of, [("n_bytes", pa.int64()), ("distinct_bytes", pa.int64()), ("entropy", pa.float64())], "n_bytes long, distinct_bytes long, entropy double", **columns)


def near_random(files: DataFrame, limit: float = 7.9, **columns: str) -> DataFrame:
    """Files of at least `limit` bits per byte: stored as they are."""
    return entropy(files, **columns).where(F.col("entropy") >= limit)


def signature(files: DataFrame, **columns: str) -> DataFrame:
    """doc_id, sig: the shares of the 16 upper halves of a byte; files without bytes have none."""

    def of(b: np.ndarray) -> list[tuple]:
        return [((np.bincount(b >> 4, minlength=16) / len(b)).tolist(),)] if len(b) else []

    return per_file(files, of, [("sig", pa.list_(pa.float64()))], "sig array<double>", **columns)


def signature_distance(files: DataFrame, **columns: str) -> DataFrame:
    """L1 distance of each file's signature to the mean signature of all files."""
    sig = signature(files, **columns)
    mean = sig.select(F.posexplode("sig").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("c"))
    both = sig.join(F.broadcast(mean))  # one row of 16 numbers
    return both.select("doc_id", F.round(F.aggregate(F.zip_with("sig", F.transform("c", lambda p: p["m"]), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x), 6).alias("distance"))


def pairs(files: DataFrame, *, overlapping: bool = True, **columns: str) -> DataFrame:
    """l, r, n: adjacent byte pairs within files; if not overlapping, a run of equal bytes counts half its length, rounded down."""

    def of(b: np.ndarray) -> list[tuple]:
        if len(b) < 2:
            return []
        code = b[:-1].astype(np.int64) * 256 + b[1:]
        c = np.bincount(code, minlength=65536)
        if not overlapping:
            ends = np.flatnonzero(np.concatenate([b[1:] != b[:-1], [True]]))
            runs = np.diff(np.concatenate([[-1], ends]))
            for v in np.unique(b[ends]):
                c[int(v) * 257] = int((runs[b[ends] == v] // 2).sum())
        some = np.flatnonzero(c)
        return list(zip((some >> 8).tolist(), (some & 255).tolist(), c[some].tolist(), strict=True))

    return per_file(files, of, [("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64())], "l long, r long, n long", **columns).groupBy("l", "r").agg(F.sum("n").alias("n"))


def pair_topk(files: DataFrame, k: int = 50, **columns: str) -> DataFrame:
    """The k most frequent pairs, ties to the larger pair: a report of k rows."""
    return pairs(files, **columns).orderBy(F.desc("n"), F.desc("l"), F.desc("r")).limit(k)


def order1_cost(files: DataFrame, **columns: str) -> DataFrame:
    """doc_id, bits: the adaptive order-1 code length, -log2((seen before + 1) / (context before + 256)) summed over the bytes.

    The sum has a closed form in the final counts: every context adds lgamma terms, whatever the order of its bytes."""

    def of(b: np.ndarray) -> list[tuple]:
        from math import lgamma, log

        if not len(b):
            return [(0.0,)]
        context = np.concatenate([[256], b[:-1].astype(np.int64)])
        _, own = np.unique(context * 256 + b, return_counts=True)
        _, total = np.unique(context, return_counts=True)
        nats = sum(lgamma(256 + n) - lgamma(256) for n in total.tolist()) - sum(lgamma(1 + n) for n in own.tolist())
        return [(round(nats / log(2), 3),)]

    return per_file(files, of, [("bits", pa.float64())], "bits double", **columns)


def changed_bytes(spark_pairs: DataFrame) -> DataFrame:
    """doc_id, changed: places at which texts a and b, of equal byte length, differ; null if the lengths differ."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None or len(x := x.encode()) != len(y := y.encode()):
                return None
            return int((np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)).sum())

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")

    return spark_pairs.select("doc_id", F.pandas_udf(run, "long")("a", "b").alias("changed"))

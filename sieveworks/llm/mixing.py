"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks by a hash of the id. Its target says how many words the mix takes:
whole passes over all blocks, then a permuted choice of further blocks, then, inside one more
block, single documents in hash order, so a target is met to within a document. The block draws
are the balls of an urn with one colour for each source; a tree splits them among the output
shards, each node giving its left half a multivariate-hypergeometric share, so every shard holds an
exact quota of every source. Shards then take disjoint ranges of each source's permuted draws, and
order their documents by a hash of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, split_words, table, written

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: The most (source, block) pairs: the bound of what the driver gathers and what is broadcast.
PAIRS = 1 << 18
#: Documents in a block, about, and words in an output shard.
BLOCK_DOCUMENTS, SHARD_WORDS = 256, 1 << 18


def size_of(text: Column) -> Column:
    return F.size(split_words(F.coalesce(text, F.lit("")), SPACE)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source, sources in order: weights repeat, share of all words in total, none above most
    times its source; what is cut off goes to the others by weight until none is above."""
    total, caps = share * sum(sizes), [most * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = min(total, sum(caps))
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * unit >= caps[i]]
        if not over:
            for i in free:
                out[i] = w[i] * unit
            break
        for i in over:
            out[i] = float(caps[i])
            left -= caps[i]
            free.discard(i)
    return out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source [sources] dealt to shards [shards, sources]; shard sizes differ by one at most."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    n = int(counts.sum())
    # of n draws in shards of floor or ceil size, the first n mod shards shards are the larger ones
    of_left = (n // shards) * left + min(left, n % shards)
    share = rng.multivariate_hypergeometric(counts, of_left, method="marginals") if n else np.zeros_like(counts)
    return np.vstack([split(share, left, rng), split(counts - share, shards - left, rng)])


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    draws: list[tuple[int, int]]  # (block, copy) in drawing order
    rest: float  # words that single documents of the open block shall add
    open_block: int | None
    open_copy: int


def choose(name: str | None, blocks: list[tuple[int, int]], target: float, rng: np.random.Generator) -> Source:
    """The draws of a source from its (block, words) pairs: each pass permutes the blocks anew."""
    size = sum(w for _, w in blocks)
    blocks = sorted(blocks)
    draws: list[tuple[int, int]] = []
    passes = int(target / size + 1e-9) if size else 0
    for copy in range(passes):
        draws += [(blocks[i][0], copy) for i in rng.permutation(len(blocks))]
    rest, opened = max(0.0, target - passes * size), None
    if size and rest >= 1:
        skipped = []
        for i in rng.permutation(len(blocks)):
            b, w = blocks[i]
            if w <= rest:
                draws.append((b, passes))
                rest -= w
            else:
                skipped.append((b, w))
        # the block nearest to what is missing, if it brings the sum nearer; else some of a block's documents
        b, w = min(skipped, key=lambda x: abs(x[1] - rest), default=(None, 0))
        if skipped and w < 2 * rest:
            draws.append((b, passes))
        elif skipped:
            opened = skipped[0][0]
    return Source(name, size, target, draws, rest, opened, passes)


def plan(docs: DataFrame, *, ident: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sized, chosen): every row's id, source, size; and for every source and block the draws.

    A size is the number of words, 0 for null and empty texts. A null source is a source of its own, the last. Rows of
    equal id (also null) are drawn together, each row with its size. At most PAIRS (source, block) pairs come to the driver;
    more than PAIRS sources are an error. No rows, or no words: nothing is drawn."""
    spark = docs.sparkSession
    sized = written(docs.select(F.col(ident).alias("id"), F.col(source).alias("src"), size_of(F.col(text)).alias("size")), "mixing-sizes")
    n, n_sources = sized.select(F.count("*"), F.count_distinct(F.coalesce(F.concat(F.lit("s"), "src"), F.lit("n")))).first()
    if n_sources > PAIRS:
        raise ValueError(f"more than {PAIRS} sources")
    blocks = max(1, min(PAIRS // max(1, n_sources), max(64, n // BLOCK_DOCUMENTS)))
    block, tie = block_of(F.col("id"), blocks, seed), tie_of(F.col("id"), seed)
    found: dict[str | None, list[tuple[int, int]]] = {}
    for r in sized.groupBy("src", block.alias("block")).agg(F.sum("size").alias("words")).collect():
        found.setdefault(r["src"], []).append((r["block"], r["words"]))
    names = sorted(found, key=lambda s: (s is None, s or ""))
    aims = targets([sum(w for _, w in found[s]) for s in names], weights, share, most)
    rng = np.random.default_rng(seed)
    chosen = [choose(s, found[s], t, rng) for s, t in zip(names, aims, strict=True)]
    cutoffs = _cutoffs(sized, chosen, block, tie)
    urn = np.array([len(c.draws) + (c.name in cutoffs) for c in chosen], np.int64)
    words = sum(c.target for c in chosen)
    shards = max(1, min(int(urn.sum()), math.ceil(words / SHARD_WORDS)))
    quotas = split(urn, shards, rng) if len(urn) else np.zeros((shards, 0), np.int64)
    rows = []
    for j, c in enumerate(chosen):
        order = [*c.draws, *([(c.open_block, c.open_copy)] if c.name in cutoffs else [])]
        place = np.repeat(np.arange(shards), quotas[:, j])
        turn = rng.permutation(len(order))  # the open block's draw takes any place
        of: dict[int, list[tuple[int, int, int | None]]] = {b: [] for b, _ in found[c.name]}
        for at, i in enumerate(turn.tolist()):
            b, copy = order[i]
            of[b].append((copy, int(place[at]), cutoffs[c.name] if i == len(c.draws) else None))
        rows += [(c.name, b, c.size, c.target, sorted(d, key=lambda x: x[:2])) for b, d in of.items()]
    schema = "src string, block long, source_size long, target double, draws array<struct<copy:int,shard:int,cutoff:long>>"
    table_ = spark.createDataFrame(rows, schema).withColumn("blocks", F.lit(blocks))
    return sized, table_


def block_of(ident: Column, blocks: int | Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(blocks) if isinstance(blocks, int) else blocks)


def tie_of(ident: Column, seed: int) -> Column:
    return F.xxhash64(ident, F.lit(seed + 1))


def _cutoffs(sized: DataFrame, chosen: list[Source], block: Column, tie: Column) -> dict[str | None, int]:
    """For each source with an open block the largest tie hash of the documents it adds; none if the first is too large."""
    opened = [(c.name, c.open_block, c.rest) for c in chosen if c.open_block is not None]
    if not opened:
        return {}
    small = sized.sparkSession.createDataFrame(opened, "name string, open_block long, rest double")
    rows = sized.withColumns({"block": block, "tie": tie}).join(F.broadcast(small), F.col("src").eqNullSafe(F.col("name")) & (F.col("block") == F.col("open_block")))
    w = Window.partitionBy("name").orderBy("tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("sum", F.sum("size").over(w)).where(F.col("sum") <= F.col("rest")).groupBy("name").agg(F.max("tie").alias("cutoff"))
    return {r["name"]: r["cutoff"] for r in ends.collect()}


def drawn(rows: DataFrame, chosen: DataFrame, *, ident: str, source: str, seed: int = 17) -> DataFrame:
    """rows with source_size, target and draws (copy, shard) of their block; a broadcast join, as chosen has PAIRS rows at most."""
    first = chosen.select("blocks").first()
    blocks = first["blocks"] if first else 1
    small = F.broadcast(chosen.drop("blocks").withColumnRenamed("src", "src__").withColumnRenamed("block", "block__"))
    out = rows.join(small, F.col(source).eqNullSafe(F.col("src__")) & (block_of(F.col(ident), blocks, seed) == F.col("block__")))
    tie = tie_of(F.col(ident), seed)
    return out.withColumn("draws", F.filter("draws", lambda x: x["cutoff"].isNull() | (tie <= x["cutoff"]))).drop("src__", "block__")


def mix(docs: DataFrame, *, ident: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, **how) -> DataFrame:
    """The mix itself: the columns of docs, each row once for every draw, in shards; rows of a shard stand together, shuffled."""
    _, chosen = plan(docs, ident=ident, source=source, text=text, seed=seed, **how)
    row = fresh("row", [])
    packed = docs.select(F.struct(*docs.columns).alias(row), F.col(ident).alias("id__"), F.col(source).alias("source__"))
    each = drawn(packed, chosen, ident="id__", source="source__", seed=seed).withColumn("d__", F.explode("draws"))
    each = each.select(row, "id__", F.col("d__.shard").alias("shard__"), F.col("d__.copy").alias("copy__"))
    each = each.repartition("shard__").sortWithinPartitions("shard__", F.xxhash64(F.lit(seed), "shard__", "copy__", "id__"))
    return each.select(f"{row}.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of the row that the mix takes, repeats counted."""
    sized, chosen = plan(table(spark, sf_dir, "documents"))
    out = drawn(sized, chosen, ident="id", source="src")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.transform("draws", lambda x: x["shard"]).alias("shards"))

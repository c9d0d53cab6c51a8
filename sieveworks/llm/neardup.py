"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Equal sets are one record. Every record has COORDINATES
minwise tokens (the least shingle under as many hash functions). A tree branches the records: at each
node one of the coordinates is selected, sometimes a second, so that 1 / similarity children are expected,
and records go to the child of their minwise token there. Such branching is critical: a pair at the threshold dies out
with depth, so trees end after DEPTH branchings, however large their nodes are. Over TREES trees that share the
coordinates, a pair at the threshold then meets in no node with a chance below one in a million.

Candidates are found by sketches (four bits of every minwise token, in four longs): a pair passes if so many agree that a
pair at the threshold fails with a chance below one in a million. First, records of small nodes are compared with each
other and those of larger ones with PIVOTS pivots; each record's best passing pair is confirmed on full shingle sets, and
confirmed pairs make components: these join most of what belongs together, by as many rows as there are records.

Pairs within a component cannot change it any more. Then every node that still holds several components is compared
exhaustively by sketches, save for pairs of one component; very large nodes in pairs of blocks. A node only tells which of its
components passing pairs connect, not the pairs. Components so connected are a family. A family is compared exactly and
whole, in pairs of blocks of records: intersections are products of incidence matrices, and each pair of blocks gives a
spanning forest of its links. Only pairs within the family's most common component are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fresh, give_back, mapped, split_words, table, written

SPACE = r"[\x20\x09-\x0D]+"
#: Branchings of a tree. More lose pairs at the threshold: with 10 trees 2e-4 after 3, 1e-3 after 4, 1e-2 after 7.
COORDINATES, TREES, DEPTH = 64, 20, 3
#: Nodes of at most SMALL records are compared whole in the first step, larger ones with PIVOTS pivots.
SMALL, PIVOTS = 24, 2
#: Records of a block of a node, and of a family, about; columns of an incidence matrix; records compared with all others at a time.
NODE_BLOCK, BLOCK, COLUMNS, ROWS = 4096, 1024, 2048, 256
#: Ids up to this many are broadcast, in rows of 8 bytes; beyond, the join shuffles.
BROADCAST_ROWS = 1 << 21


def shingle_sets(docs: DataFrame, k: int, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id and s: the distinct hashes of k-word shingles; fewer than k words are one shingle, no words none."""
    words = split_words(ascii_lower(F.col(text)), SPACE)
    grams = F.expr(
        f"case when size(w) = 0 then cast(array() as array<bigint>) when size(w) < {k} then array(xxhash64(w)) "
        f"else array_distinct(transform(sequence(0, size(w) - {k}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(k))}))) end"
    )
    return docs.select(F.col(ident).alias("id"), words.alias("w")).select("id", grams.alias("s"))


def signatures(sets: DataFrame) -> DataFrame:
    """id, n (set size), set_hash (of the sorted set), m (minwise tokens, 32 bits each, as binary), x0..x3 (sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20180607)
        mult = rng.integers(1, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)
        add = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
        shift = np.uint64(32)
        for b in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            column = b.column("s")
            flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            some = np.flatnonzero(lengths)
            least = np.full((COORDINATES, len(lengths)), np.uint32(0xFFFFFFFF))
            # a mixed 64-bit value per shingle, then for each coordinate multiply, add and keep the upper half
            v = flat ^ (flat >> shift)
            v *= np.uint64(0x9E3779B97F4A7C15)
            v ^= v >> np.uint64(29)
            if len(some):
                starts = (ends - lengths)[some]
                for c in range(COORDINATES):
                    least[c, some] = np.minimum.reduceat((v * mult[c] + add[c]) >> shift, starts).astype(np.uint32)
            total = np.zeros(len(lengths), np.uint64)
            other = np.zeros(len(lengths), np.uint64)
            if len(some):
                w = v * np.uint64(0xD6E8FEB86659FD93)
                total[some] = np.add.reduceat(v, starts)
                other[some] = np.bitwise_xor.reduceat(w ^ (w >> shift), starts)
            # four bits of each token, mixed so that near values differ
            bits = (least.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(60)
            longs = [reduce(lambda x, y: x | y, (bits[16 * g + i] << np.uint64(4 * i) for i in range(16))).view(np.int64) for g in range(4)]
            m = np.ascontiguousarray(least.T).astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(lengths), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)), pa.array([r.tobytes() for r in m], pa.binary()), *map(pa.array, longs)],
                names=["id", "n", "h1", "h2", "m", "x0", "x1", "x2", "x3"],
            )

    return mapped(sets, run, "id long, n long, h1 long, h2 long, m binary, x0 long, x1 long, x2 long, x3 long")


def passing(similarity: float) -> int:
    """How many of the 64 four-bit parts agree at least, for all but one in a million pairs at the similarity (Chernoff by exact sums)."""
    from math import comb

    p, total = similarity + (1 - similarity) / 16, 0.0
    for j in range(COORDINATES + 1):
        total += comb(COORDINATES, j) * p**j * (1 - p) ** (COORDINATES - j)
        if total > 1e-6:
            return j
    return COORDINATES


def agreeing(a: str, b: str) -> Column:
    """Of the sketches in struct columns a and b, how many four-bit parts agree."""
    ones = 0x1111111111111111

    def differ(i: int) -> Column:
        x = F.col(f"{a}.x{i}").bitwiseXOR(F.col(f"{b}.x{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones)))

    return F.lit(COORDINATES) - reduce(lambda p, q: p + q, (differ(i) for i in range(4)))


def branch(path: Column, similarity: float, level: int) -> Column:
    """The children of a node that a record goes to: hashes of the path, the selected coordinate and the minwise token there.

    One coordinate is always selected, a second for a share of the nodes that makes 1 / similarity on average."""
    first = F.pmod(F.xxhash64(path, F.lit(level), F.lit(1)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(F.xxhash64(path, F.lit(level), F.lit(2)), F.lit(COORDINATES)).cast("int")
    child = lambda c: F.xxhash64(path, c, F.col("m").substr(c * 4 + 1, F.lit(4)))
    two = F.pmod(F.xxhash64(path, F.lit(level), F.lit(3)), F.lit(10_000)) < int(10_000 * (1 / similarity - 1))
    return F.when(two & (first != second), F.array(child(first), child(second))).otherwise(F.array(child(first)))


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (id, c) with c lowered to the least label reachable over links (a, b).

    Links become edges between different labels; their components are found on that smaller graph, and labels follow."""
    l1, l2 = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    edges = links.join(l1, "a").join(l2, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("x"), F.least("ca", "cb").alias("y")).distinct()
    edges = written(edges, "edges", few=True)
    return labels if edges.isEmpty() else written(relabelled(labels, contracted(edges)), "labels")


def contracted(edges: DataFrame) -> DataFrame:
    """(x, y): for every label in edges (x > y) that is not the least of its component, the least label.

    Large-star and small-star steps in turn: every node links its larger, then its smaller-or-equal neighbours to its
    least neighbour, until nothing changes; hub sizes do not matter, as only least neighbours are aggregated. Each round
    is written to the shared folder."""
    before = None
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").union(low.select("x", F.col("m").alias("y")))
        last, edges = edges, written(small.distinct(), "stars", few=True)
        discard(last)
        # stars at rest: nothing that is linked to is itself linked on
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == before:
            return edges
        before = now


def relabelled(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return labels.join(moves.withColumnsRenamed({"x": "c", "y": "to"}), "c", "left").select("id", F.coalesce("to", "c").alias("c"))


def spokes(large: DataFrame) -> DataFrame:
    """Pairs (a, b) of the records of large nodes (path, rep) with the PIVOTS pivots of their nodes.

    Nodes of one group share their pivots: a record gathers those of all its nodes, and meets each of them once."""
    names = [f"p{i}" for i in range(PIVOTS)]
    pivots = large.groupBy("path").agg(*[F.min_by("rep", F.xxhash64("rep", F.lit(i))).alias(p) for i, p in enumerate(names)])
    own = large.join(pivots, "path").groupBy("rep").agg(reduce(F.array_union, map(F.collect_set, names)).alias("own"))
    each = own.select("rep", F.explode("own").alias("p")).where("rep <> p")
    return each.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) of record ids those whose full sets are similar: 100 * intersection >= 100 * similarity * union.

    Only the texts of documents in a pair are cut into shingles: their ids are broadcast up to BROADCAST_ROWS, beyond that joined by shuffle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = 2 * pairs.count() <= BROADCAST_ROWS
    some = docs.join(F.broadcast(ids) if few else ids, "id")
    sets = written(shingle_sets(some, k, ident="id", text="text"), "pair-sets")
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    percent = round(similarity * 100)
    return both.where((100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))) & (F.col("i") > 0)).select("a", "b")


def forest(sets: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) that join what the similar pairs of two blocks p and q (or of one, p = q) of id, c, s join; pairs of equal c are passed over."""
    column = sets.column("s").combine_chunks()
    ids, c, block = (sets.column(x).to_numpy() for x in ("id", "c", "block"))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), lengths)
    one, two = np.flatnonzero(block == sets.column("p")[0].as_py()), np.flatnonzero(block == sets.column("q")[0].as_py())
    _, word = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    # words of one record only take no part; the others are numbered anew
    often = np.bincount(word, minlength=1) > 1
    row, word = row[often[word]], (np.cumsum(often) - 1)[word[often[word]]]
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    common = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, int(often.sum()), COLUMNS):
        part = slice(*np.searchsorted(word, [at, at + COLUMNS]))
        has = np.zeros((len(ids), COLUMNS), np.float32)
        has[row[part], word[part] - at] = 1
        common += has[one] @ has[two].T
    both = lengths[one][:, None] + lengths[two][None, :] - common
    like = (100 * common >= round(similarity * 100) * both) & (common > 0) & (c[one][:, None] != c[two][None, :])
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[np.ix_(one, two)] = like
    linked |= linked.T
    links, new = [], np.ones(len(ids), bool)
    for root in range(len(ids)):
        stack = [root] if new[root] else []
        new[root] = False
        while stack:
            x = stack.pop()
            found = np.flatnonzero(linked[x] & new)
            new[found] = False
            stack.extend(found.tolist())
            links.append(np.stack([np.full(len(found), ids[x]), ids[found]]))
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    if len(ids) > ROWS:
        give_back()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def connected(c: np.ndarray, x: np.ndarray, floor: int) -> list[tuple[int, int]]:
    """Pairs of components that passing pairs of a node's records connect, as edges to one of them: each component is reached
    once. c: the records' components; x: their sketches, four longs each.

    Records of components reached so far are compared with all records of those not reached, until none is left."""
    names, label = np.unique(c, return_inverse=True)
    new = np.ones(len(names), bool)
    edges = []
    ones, one, two = np.uint64(0x1111111111111111), np.uint64(1), np.uint64(2)
    for root in range(len(names)):
        if not new[root]:
            continue
        new[root] = False
        todo = [np.flatnonzero(label == root)]
        while todo and new.any():
            rows = todo.pop()
            if len(rows) > ROWS:
                todo.append(rows[ROWS:])
                rows = rows[:ROWS]
            others = np.flatnonzero(new[label])
            differ = np.zeros((len(rows), len(others)), np.uint8)
            for i in range(x.shape[1]):
                y = x[rows, i][:, None] ^ x[others, i][None, :]
                y |= y >> two
                y |= y >> one
                differ += np.bitwise_count(y & ones)
            hit = np.unique(label[others[(differ <= COORDINATES - floor).any(axis=0)]])
            if len(hit):
                new[hit] = False
                edges += [(int(names[root]), int(names[h])) for h in hit]
                todo.append(np.flatnonzero(np.isin(label, hit)))
    return edges


def node_edges(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (node, c, x0..x3) that stand together by node: edges (x, y) of connected components."""
    floor = passing(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # rows of the node that the last batch ended with

        def of(rows: np.ndarray) -> list[tuple[int, int]]:
            return connected(rows[:, 1], rows[:, 2:].view(np.uint64), floor)

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (1, 0)], names=["x", "y"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy() for i in range(b.num_columns)], axis=1)
            cuts = (np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist()
            if kept and kept[-1][-1, 0] != rows[0, 0]:
                yield batch_of(of(np.concatenate(kept)))
                kept = []
            edges, start = [], 0
            for end in cuts:
                part = rows[start:end]
                edges += of(np.concatenate([*kept, part]) if kept else part)
                kept, start = [], end
            kept.append(rows[start:])
            yield batch_of(edges)
        if kept:
            yield batch_of(of(np.concatenate(kept)))

    return run


def families(nodes: DataFrame, labels: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """(id, c, f): records of components that passing pairs of a common node (path, rep, size) connect; f: the family."""
    marked = nodes.join(labels.select(F.col("id").alias("rep"), "c"), "rep")
    several = marked.groupBy("path").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("path")
    mixed = written(marked.join(several, "path"), "mixed", few=True)
    blocks = F.ceil(F.col("size") / NODE_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = mixed.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("rep", "c", F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("node"))
    met = met.join(sketch, "rep").select("node", "c", "x0", "x1", "x2", "x3").repartition("node").sortWithinPartitions("node")
    edges = mapped(met, node_edges(similarity), "x long, y long").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    edges = written(edges, "family-edges", few=True)
    discard(mixed)
    if edges.isEmpty():
        return labels.select("id", "c", F.col("c").alias("f")).limit(0)
    moves = contracted(edges)
    family = moves.select(F.col("x").alias("c"), F.col("y").alias("f")).union(moves.select("y", "y")).distinct()
    return written(labels.join(family, "c").select("id", "c", "f"), "families", few=True)


def family_links(family: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) within families (id, c, f): every family is compared exactly and whole.

    Blocks of records outside the family's most common component (numbered first) meet all blocks, the others only those."""
    each = family.groupBy("f", "c").agg(F.count("*").alias("k"))
    top = each.groupBy("f").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("size")).where("size > most")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    top = top.select("f", "top", blocks(F.col("size") - F.col("most")).alias("outer"), blocks(F.col("most")).alias("inner"))
    hashed = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    out = F.col("c") != F.col("top")
    own = F.when(out, hashed(F.col("outer"))).otherwise(F.col("outer") + hashed(F.col("inner")))
    last = F.when(out, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    placed = family.join(top, "f").select("f", "id", "c", own.alias("block"), last.alias("last"))
    few = family.count() <= BROADCAST_ROWS
    some = docs.join(F.broadcast(placed.select("id")) if few else placed.select("id"), "id")
    # written, so that the filter below does not cut every text anew for each of its words
    sets = written(shingle_sets(some, k, ident="id", text="text"), "family-sets")
    met = sets.where(F.size("s") > 0).join(F.broadcast(placed) if few else placed, "id")
    met = met.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    met = met.select("f", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "c", "s")
    links = written(met.groupBy("f", "p", "q").applyInArrow(lambda t: forest(t, similarity), "a long, b long").distinct(), "family-links", few=True)
    discard(sets)
    return links


def near_duplicates(docs: DataFrame, *, k: int = 5, similarity: float = 0.8, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of docs with an id: id, n (set size), component (the least id reachable over links, itself included).

    Two documents are linked if the Jaccard similarity of their shingle sets reaches `similarity`. Texts without words, null
    texts among them, have empty sets and no links. Ids must be integers and may repeat only with equal texts: `keyed` makes
    such ids where they are not. Rows without id are left out. An empty table gives no rows."""
    source = docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    sigs = written(signatures(shingle_sets(source, k, ident="id")), "signatures")
    # equal sets are one record, named by the least id; its sketch is that of any of them
    key = ["n", "h1", "h2"]
    records = sigs.where("n > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.first("m").alias("m"), *[F.first(f"x{i}").alias(f"x{i}") for i in range(4)])
    records = written(records, "records")
    labels = records.select(F.col("rep").alias("id"), F.col("rep").alias("c"))
    text_of = source.select("id", "text")
    floor = passing(similarity)
    nodes = records.select("rep", "m", F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)])).alias("path"))
    for level in range(DEPTH):
        nodes = nodes.select("rep", "m", F.explode(branch(F.col("path"), similarity, level)).alias("path"))
    nodes = nodes.select("path", "rep").withColumn("size", F.count("*").over(Window.partitionBy("path"))).where("size > 1")
    nodes = written(nodes, "nodes")
    sketch = records.select("rep", "x0", "x1", "x2", "x3")
    packed = sketch.select("rep", F.struct("rep", "x0", "x1", "x2", "x3").alias("r"))
    small = written(nodes.where(F.col("size") <= SMALL).join(packed, "rep").select("path", "r"), "small")
    large = nodes.where(F.col("size") > SMALL).select("path", "rep")

    def of(ids: DataFrame, name: str) -> DataFrame:
        return ids.join(packed.select(F.col("rep").alias(name), F.col("r").alias(f"r{name}")), name)

    def alike(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("alike", agreeing("ra", "rb")).where(F.col("alike") >= floor).select("a", "b", "alike")

    pairs = small.select("path", F.col("r").alias("ra")).join(small.select("path", F.col("r").alias("rb")), "path").where("ra.rep < rb.rep")
    pairs = alike(pairs.select(F.col("ra.rep").alias("a"), F.col("rb.rep").alias("b"), "ra", "rb"))
    pairs = pairs.union(alike(of(of(spokes(large), "a"), "b")))
    # each record's best pair with a smaller one
    best = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", -F.col("a"))).alias("a")).select("a", "b"), "best-pairs", few=True)
    labels = components(confirmed(best, text_of, k, similarity), labels)
    discard(small)
    family = families(nodes, labels, sketch, similarity)
    if not family.isEmpty():
        labels = components(family_links(family, text_of, k, similarity), labels)
    discard(nodes)
    found = records.select(*key, F.col("rep")).join(labels.withColumnRenamed("id", "rep"), "rep").select(*key, "c")
    each = sigs.select("id", *key).join(found, key, "left")
    return each.select("id", "n", F.coalesce("c", "id").alias("component"))


def keyed(docs: DataFrame, key: str, *, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """docs with a column key that near_duplicates takes as id; and whether it is the id throughout.

    Where ids are null or repeat, the row of an id with the least text keeps it; other texts of that id, and texts without id, get a
    negative number from id and text, so that different texts are never one document. Null texts come first."""
    n, ids = docs.agg(F.count("*"), F.count_distinct(ident)).first()
    own = F.col(ident).cast("long")
    if n == ids:
        return docs.withColumn(key, own), True
    least = fresh("least", [*docs.columns, key])
    made = -1 - F.pmod(F.xxhash64(own, F.lit("id"), F.col(text)), F.lit(1 << 62))
    first = docs.where(own.isNotNull()).groupBy(own.alias(key)).agg(F.min(F.struct(F.col(text).isNotNull().alias("some"), F.col(text).alias("text"))).alias(least))
    both = docs.join(first, own.eqNullSafe(F.col(key)), "left")
    mine = F.col(f"{least}.text").eqNullSafe(F.col(text)) & F.col(key).isNotNull()
    return both.withColumn(key, F.when(mine, own).otherwise(made)).drop(least), False


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: over two-word shingles; one row for every document, also where ids are null or repeat.

    component_id is the least doc_id of the component, null if none of its documents has one."""
    docs, plain = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"), "key")
    if not plain:
        docs = written(docs, "keyed")
    out = near_duplicates(docs, k=2, ident="key")
    if plain:
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    # rows of one key are equal: each key has one size and one component
    out = written(out.distinct(), "keyed-components")
    rows = docs.select("doc_id", F.col("key").alias("id")).join(out, "id")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * i >= 80 * (na + nb - i) UNION ALL SELECT b, a FROM i WHERE 100 * i >= 80 * (na + nb - i)),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM s JOIN c ON c.id = s.doc_id
"""

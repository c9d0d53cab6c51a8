"""Packing token sequences by a configuration linear program over the length histogram.

Documents become token pieces of at most the capacity; only the histogram of their lengths comes to
the driver. A configuration is a multiset of lengths that fits one sequence. The covering program
(fewest sequences so that every length is covered as often as it occurs) is solved by multiplicative
weights: lengths still short of their share weigh more, and a knapsack dynamic program over the
capacity prices configurations by those weights, giving for every length the best configuration that
holds it. The fractional solution is rounded, the program solved again for what that leaves, and the last few
pieces filled by best fit, the longest first. The plan is a list of runs (configuration, how many sequences), and every piece finds
its sequence and offset from its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, table, written

CAPACITY = 2048
END = 0
#: Parts in which the pieces of one length are ranked, at least; and pieces in a part, about.
SALTS, PART = 256, 1 << 16
ROUNDS, STEP, RATE = 160, 0.02, 12.0
#: Tokens that a configuration may leave free at first; how often the program is solved for what rounding left.
SPARE, SOLVES = 1, 4
#: Words whose ids a worker remembers.
CACHE = 300_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer cuts a text into words first and encodes each on its own, so words are encoded once and
    remembered. Texts that hold the string of a special token, whose id the tokenizer gives, are encoded whole by it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)").search
    # the byte-level cut, with white space as Unicode defines it
    space = r"\p{White_Space}"
    cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|{space}+(?!\P{{White_Space}})|{space}+").findall
    # the same cut for texts of ASCII and Latin letters only, by the faster module
    latin = "A-Za-zÀ-ÖØ-öø-ʯ"
    plain = re.compile(rf"[\x00-\x1b!-~ {latin}]*\Z").match
    cut_plain = re.compile(rf" ?[{latin}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\t-\r {latin}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
    own = tok.encode

    class Words(dict):
        """The ids of words; a new word is encoded when it is first looked up, and kept while there is room."""

        def __missing__(self, word: str) -> bytes:
            ids = own(word, add_special_tokens=False).ids
            found = pack_ids(f"<{len(ids)}I", *ids)
            if len(self) < CACHE:
                self[word] = found
            return found

    find = Words().__getitem__

    def encode(text: str) -> bytes:
        if special(text):
            ids = own(text, add_special_tokens=False).ids
            return pack_ids(f"<{len(ids)}I", *ids)
        return b"".join(map(find, cut_plain(text) if plain(text) else cut(text)))

    return encode


def tokenized(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids end with END; null and empty texts are END alone. Documents longer than capacity are cut into
    full pieces, the first taking what is left over. Whole texts are read; repeated rows give repeated pieces."""
    path = path or tokenizer_path()
    more = [("ids", pa.list_(pa.int32()))] if ids else []
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out: list[list] = [[] for _ in fields]
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (encode(t) if t else b"") + end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    start, length, piece = 0, first, 0
                    while start < n:
                        own = raw[4 * start : 4 * (start + length)]
                        row = [doc, piece, start, length, zlib.crc32(own)]
                        if ids:
                            row.append(np.frombuffer(own, "<u4").astype(np.int32))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                        start, length, piece = start + length, capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return mapped(docs.select(F.col(ident).cast("long"), F.col(text)), run, schema)


# the plan, on the driver: everything here is bounded by the capacity, not by the number of pieces


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most value of lengths that fit c; last[c]: the index of one such length, or -1 to leave a token free."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    # best shifted: at c, adding lengths[i] continues from c - lengths[i]
    for c in range(int(lengths[0]) if len(lengths) else capacity + 1, capacity + 1):
        m = int(np.searchsorted(lengths, c, side="right"))
        gain = value[:m] + best[c - lengths[:m]]
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], last[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    return best, last


def trace(last: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        i = int(last[room])
        if i < 0:
            room -= 1
        else:
            out.append(i)
            room -= int(lengths[i])
    return out


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """A fractional covering: configuration (indices of lengths, sorted) to how many sequences use it.

    Each round prices by the weights exp(-RATE * covered share) / length count, and adds a small step of every
    configuration near the best price; the sum is scaled so that every length is covered."""
    k = len(lengths)
    covered, x = np.zeros(k), {}
    need = counts.astype(float)
    for _ in range(ROUNDS):
        share = covered / need
        if share.min() >= 1:
            break
        weight = np.exp(-RATE * np.minimum(share - share.min(), 50.0)) * lengths / capacity
        best, last = knapsack(weight, lengths, capacity)
        price = weight + best[capacity - lengths]
        top = best[capacity]
        for i in np.flatnonzero((price >= 0.97 * top) & (share < share.min() + 0.25)).tolist():
            found = tuple(sorted([i, *trace(last, lengths, capacity - int(lengths[i]))]))
            used: dict[int, int] = {}
            for j in found:
                used[j] = used.get(j, 0) + 1
            amount = STEP * 2 * min(need[j] / n for j, n in used.items())
            x[found] = x.get(found, 0.0) + amount
            for j, n in used.items():
                covered[j] += amount * n
    return x


def plan(lengths: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, how many sequences) so that every length is used exactly as often as it occurs.

    The program is solved, rounded up, and solved again for what that left, as long as it places pieces: first by configurations
    that leave at most SPARE tokens free, then by all. The last few pieces go by best fit, as counts of lengths. Where few pieces
    make rounding up costly, by more than one sequence in a thousand, the first solution is rounded down and best fit takes
    what is left."""
    size = np.array(sorted(lengths), np.int64)
    count = np.array([c for _, c in sorted(zip(lengths, counts, strict=True))], np.int64)
    out: list[tuple[list[int], int]] = []
    full = size == capacity
    if full.any() and count[full][0]:
        out.append(([capacity], int(count[full][0])))
    size, left = size[~full], count[~full].copy()
    solution = configurations(size[left > 0], left[left > 0], capacity) if left.any() else {}
    whole: list[tuple[list[int], int]] = []
    rest = _solved(size, left, capacity, SPARE, SOLVES, math.ceil, whole, solution)
    _fill(size, _solved(size, rest, capacity, capacity, SOLVES, math.ceil, whole), capacity, whole)
    part: list[tuple[list[int], int]] = []
    _fill(size, _solved(size, left, capacity, SPARE, 1, math.floor, part, solution), capacity, part)
    by = [sum(n for _, n in x) for x in (whole, part)]
    return out + (whole if by[0] <= 1.001 * by[1] else part)


def _solved(size: np.ndarray, left: np.ndarray, capacity: int, spare: int, solves: int, whole: Callable[[float], int], out: list, first: dict[tuple[int, ...], float] | None = None) -> np.ndarray:
    """What is left after configurations with at most `spare` free tokens, each as often as the program says, made whole.

    first: the program's solution for `left`, if it is known."""
    left = left.copy()
    for k in range(solves):
        some = np.flatnonzero(left)
        before = int(left.sum())
        if not before:
            break
        own, rest = size[some], left[some]
        solution = first if k == 0 and first is not None else configurations(own, rest, capacity)
        waste = lambda c: capacity - int(own[list(c)].sum())  # noqa: B023, E731
        for c, amount in sorted(solution.items(), key=lambda z: (waste(z[0]), -z[1], z[0])):
            if waste(c) <= spare:
                _use(c, whole(amount), own, rest, out)
        left[some] = rest
        if rest.sum() > 0.8 * before:
            break
    return left


def _use(config: tuple[int, ...], most: int, size: np.ndarray, left: np.ndarray, out: list) -> None:
    used: dict[int, int] = {}
    for j in config:
        used[j] = used.get(j, 0) + 1
    n = min([most, *(int(left[j]) // c for j, c in used.items())])
    if n > 0:
        for j, c in used.items():
            left[j] -= n * c
        out.append(([int(size[j]) for j in config], n))


def _fill(size: np.ndarray, left: np.ndarray, capacity: int, out: list) -> None:
    """Best fit for counts of lengths, the longest first: each goes to the open sequences with the least room that holds it.

    Sequences filled alike are one group with a count, so the work grows with the number of lengths, not of pieces."""
    rooms: list[int] = []  # of groups of open sequences, ascending
    groups: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if room not in groups:
            groups[room] = {}
            insort(rooms, room)
        groups[room][pattern] = groups[room].get(pattern, 0) + n

    for length, n in zip(size[::-1].tolist(), left[::-1].tolist(), strict=True):
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, had = groups[room].popitem()
                if not groups[room]:
                    del groups[room], rooms[at]
                used = min(n, had)
                if had > used:
                    put(pattern, had - used, room)
                put((*pattern, length), used, room - length)
                n -= used
            else:
                each = min(n, capacity // length)
                put((length,) * each, n // each, capacity - each * length)
                n -= n // each * each
    out += [(list(p), n) for by in groups.values() for p, n in by.items()]


def runs(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, first offset), ordered by length and rank."""
    rows, rank, base = [], {}, 0
    for pattern, n in patterns:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            c = pattern.count(length)
            rows.append((length, rank.get(length, 0), base, c, at))
            rank[length] = rank.get(length, 0) + n * c
            at += c * length
        base += n
    return np.array(sorted(rows), np.int64).reshape(len(rows), 5)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; pieces needs doc_id, piece, start, length (1 to capacity), ids_crc32, and is read twice.

    Equal lengths may change places; repeated rows take places of their own. No pieces: no rows. The ranks of one
    length, however common, are counted in parts of about PART pieces, SALTS at least."""
    spark = pieces.sparkSession
    hist = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    table_ = runs(plan([r["length"] for r in hist], [r["n"] for r in hist], capacity)) if hist else np.zeros((0, 5), np.int64)
    shared = spark.sparkContext.broadcast(table_)
    salts = max([SALTS, *(-(-r["n"] // PART) for r in hist)])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(w) - 1).join(counts, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("salt", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0] * (1 << 50) + t[:, 1] if len(t) else np.zeros(0, np.int64)
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            own = t[np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1]
            nth, slot = np.divmod(rank - own[:, 1], own[:, 3])
            rest = [i for i, n in enumerate(b.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(own[:, 2] + nth), pa.array(own[:, 4] + slot * length)], names=[*(b.schema.names[i] for i in rest), "sequence_id", "offset"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return mapped(ranked, run, f"{rest}, sequence_id long, offset long").select(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, *, ids: bool = False, **how) -> DataFrame:
    """Pieces of docs with their places; tokenized once, into the shared folder."""
    return pack(written(tokenized(docs, ids=ids, **how), "pieces"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed_documents(table(spark, sf_dir, "documents"))

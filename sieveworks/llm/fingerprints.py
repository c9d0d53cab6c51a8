"""Document fingerprints by invertible Bloom lookup sketches, all in DataFrame and SQL functions.

A text is the set of its paragraphs' digests: its lines, and the runs of words that content cuts it into, a run ending at every
word whose hash is divisible by RUN; so an edit of one long line, or a word put in, leaves all other runs in common. All texts are
cut alike, whatever their length. Each digest goes to one cell in each of three parts of the sketch; a cell holds a count, the xor
of its digests and the xor of their check values. Subtracting the sketches of two versions cancels what they share; peeling cells
that hold a single digest recovers the digests only one version has. If peeling gets stuck, both sketches are made anew with so
many more cells that peeling is all but sure to end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table

PARTS = 3
#: Cells of the fingerprint itself; larger sketches have a power of RETRY times as many, up to the power RETRIES.
CELLS = 24
RETRY = 9
RETRIES = 6
ROUNDS = 24
#: Words of a run, on average.
RUN = 16
#: Documents in each ordered range, about.
RANGE_ROWS = 4096


def let(name: str, value: str, body: str) -> str:
    """SQL: body with value, computed once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def units(text: str) -> str:
    """SQL: the distinct paragraph digests of a text; none for an empty text."""
    ends = f"filter(sequence(0, size(h) - 1), i -> pmod(h[i], {RUN}) = 0 or i = size(h) - 1)"
    runs = let("h", f"transform(split({text}, ' '), x -> xxhash64(x))", let("c", ends, "transform(c, (e, k) -> xxhash64('w', slice(h, if(k = 0, -1, c[k - 1]) + 2, e - if(k = 0, -1, c[k - 1]))))"))
    lines = f"transform(filter(split({text}, '\n'), l -> l <> ''), l -> xxhash64('l', l))"
    return f"if({text} = '', cast(array() as array<bigint>), array_distinct(concat({lines}, {runs})))"


def checked(digests: str) -> str:
    """SQL: digests as structs of digest d and check value x, each counted once (n)."""
    return f"transform({digests}, d -> named_struct('n', 1, 'd', d, 'x', xxhash64(d, 'check')))"


def entries(u: str, sign: int, cells: str) -> str:
    """SQL: for every unit its cell in each part (j), with a count of sign, its digest and its check value."""
    each = ", ".join(f"named_struct('j', {i} * ({cells} div {PARTS}) + pmod(xxhash64(e.d, {i}), {cells} div {PARTS}), 'n', {sign} * e.n, 'd', e.d, 'x', e.x)" for i in range(PARTS))
    return f"flatten(transform({u}, e -> array({each})))"


def merged(e: str) -> str:
    """SQL: entries summed by cell, ordered by cell, empty cells left out: sorted, cut where the cell changes, folded run by run."""
    fold = "aggregate(slice(v, q + 1, coalesce(get(w, k + 1), size(v)) - q), named_struct('j', v[q].j, 'n', 0, 'd', 0L, 'x', 0L), (a, y) -> named_struct('j', a.j, 'n', a.n + y.n, 'd', a.d ^ y.d, 'x', a.x ^ y.x))"
    starts = "filter(sequence(0, size(v) - 1), i -> i = 0 or v[i].j <> v[i - 1].j)"
    own = f"if(coalesce(get(w, k + 1), size(v)) - q = 1, v[q], {fold})"
    cells = let("w", starts, f"filter(transform(w, (q, k) -> {own}), y -> y.n <> 0 or y.d <> 0 or y.x <> 0)")
    return let("v", f"sort_array({e})", f"if(size(v) = 0, v, {cells})")


def sketch(u: str, cells: str) -> str:
    """SQL: the cells of a set of units that are not empty, in order."""
    return merged(entries(u, 1, cells))


def peel(start: str, cells: str) -> str:
    """SQL: of the difference of two sketches, how many digests only the first (la) and the second (lb) holds, and whether all came out."""
    # distinct by the digest alone, a number: arrays of structs would be compared pair by pair
    pure = lambda n: f"array_distinct(transform(filter(s.c, y -> y.n = {n} and xxhash64(y.d, 'check') = y.x), y -> y.d))"
    rest = merged(f"concat(s.c, {entries(checked('p'), -1, cells)}, {entries(checked('q'), 1, cells)})")
    step = f"named_struct('c', if(size(p) + size(q) = 0, s.c, {rest}), 'la', s.la + size(p), 'lb', s.lb + size(q), 'stuck', size(p) + size(q) = 0)"
    step = let("p", pure(1), let("q", pure(-1), step))
    first = f"named_struct('c', {start}, 'la', 0, 'lb', 0, 'stuck', false)"
    return f"aggregate(sequence(1, {ROUNDS}), {first}, (s, i) -> if(s.stuck or size(s.c) = 0, s, {step}), s -> named_struct('la', s.la, 'lb', s.lb, 'done', size(s.c) = 0))"


def minus(a: str, b: str) -> str:
    """SQL: the difference of two sketches."""
    return merged(f"concat({a}, transform({b}, e -> named_struct('j', e.j, 'n', -e.n, 'd', e.d, 'x', e.x)))")


def difference(ua: str, ub: str, sa: str, sb: str) -> str:
    """SQL: sizes of the two one-sided differences (la, lb).

    Where the fingerprints' own sketches can't be peeled, both sets are sketched again, with the least number of cells that
    is half as large again as both sets together; should a larger one fail too, the next, and after the last the sets themselves
    are compared."""
    cells = f"({CELLS} * cast(power({RETRY}, r) as int))"
    # the difference of the larger sketches, summed in one go: the second version's entries count negative
    again = let("z", cells, peel(merged(f"concat({entries(ua, 1, 'z')}, {entries(ub, -1, 'z')})"), "z"))
    first = peel(minus(sa, sb), str(CELLS))
    enough = f"r < {RETRIES} and 2 * {cells} < 3 * (size({ua}) + size({ub}))"
    tries = f"aggregate(sequence(1, {RETRIES}), {first}, (t, r) -> if(t.done or ({enough}), t, {again}))"
    da, db = (f"transform({u}, e -> e.d)" for u in (ua, ub))
    exact = f"named_struct('la', size(array_except({da}, {db})), 'lb', size(array_except({db}, {da})), 'done', true)"
    return let("o", tries, f"if(o.done, o, {exact})")


def likeness(ua: str, ub: str, sa: str, sb: str) -> str:
    """SQL: shared digests by all digests, from the recovered differences; 1 for two sets without digests."""
    return let("f", difference(ua, ub, sa, sb), f"if(size({ua}) + f.lb = 0, 1D, cast(size({ua}) - f.la as double) / (size({ua}) + f.lb))")


def as_text(text: str, u: str, cells: str) -> str:
    """SQL: the fingerprint: number of digests, hash of the text, then every cell that is not empty, in hexadecimal."""
    return (
        f"concat(hex(size({u})), '-', lpad(hex(xxhash64({text})), 16, '0'), '-', "
        f"array_join(transform({cells}, y -> concat(hex(y.j), '.', hex(y.n), '.', lpad(hex(y.d), 16, '0'), lpad(hex(y.x), 16, '0'))), ';'))"
    )


def followed(docs: DataFrame, carry: list[str], *, order: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct of the columns `carry` of the next row in descending order, the first row following the last; and that
    column's name.

    Rows are dealt into ranges of about RANGE_ROWS rows by percentiles of the order column, as many as the table needs, each sorted
    on its own; copies of the first rows of a range go along to the end of the range before it. Null ids come last, equal ids by
    text, null texts first. Only percentiles and one maximum for each range reach the driver: 16 bytes for RANGE_ROWS rows."""
    taken = [*docs.columns]
    names = []
    for x in ("range", "copy", "next"):
        names.append(fresh(x, taken))
        taken.append(names[-1])
    rng, copy, nxt = names
    ids = docs.select(F.col(order).alias("k"))
    ranges = max(1, -(-ids.count() // RANGE_ROWS))
    cuts = sorted(set(ids.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("p")).first()["p"] or [])) if ranges > 1 else []
    # found in two steps, among every width-th cut and then among the cuts between two of these
    width = max(1, math.isqrt(len(cuts)))
    longs = lambda x: F.array(*[F.lit(int(c)).cast("long") for c in x]) if x else F.array().cast("array<long>")
    coarse, fine = longs(cuts[width - 1 :: width]), F.array(*[longs(cuts[i : i + width - 1]) for i in range(0, len(cuts) + 1, width)])
    reached = lambda x, c: F.size(F.filter(x, lambda y: y <= c))

    def number(c: Column) -> Column:
        # range 0 holds the largest ids; null ids go to a range of their own, the last
        steps = reached(coarse, c)
        return F.when(c.isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - steps * width - reached(F.get(fine, steps), c))

    tops = sorted((r["b"], r["top"]) for r in ids.groupBy(number(F.col("k")).alias("b")).agg(F.max("k").alias("top")).collect())
    # a range's largest id goes along to the end of the nonempty range before it, the first range's to the last
    top, prior = [None] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, (b, t) in enumerate(tops):
        top[b], prior[b] = t, tops[i - 1][0]
    of = lambda x, kind: F.array(*[F.lit(y).cast(kind) for y in x])
    out = docs.withColumn(rng, number(F.col(order)))
    here, first = F.col(rng), F.col(order).eqNullSafe(F.get(of(top, "long"), F.col(rng)))
    once = F.struct(here.alias("r"), F.lit(0).alias("c"))
    out = out.withColumn(copy, F.explode(F.when(first, F.array(once, F.struct(F.get(of(prior, "int"), here).alias("r"), F.lit(1).alias("c")))).otherwise(F.array(once))))
    out = out.withColumn(rng, F.col(f"{copy}.r")).withColumn(copy, F.col(f"{copy}.c"))
    w = Window.partitionBy(rng).orderBy(copy, F.col(order).desc_nulls_last(), F.col(text).asc_nulls_first())
    out = out.withColumn(nxt, F.lead(F.struct(*carry)).over(w))
    return out.where(F.col(copy) == 0).drop(copy, rng), nxt


def fingerprint(docs: DataFrame, *, text: str = "text", other: str, likeness_as: str, fingerprint_as: str) -> DataFrame:
    """docs with the fingerprint of one text column and its likeness to another; null texts are empty."""
    a, b = f"coalesce({text}, '')", f"coalesce({other}, '')"
    n = {x: fresh(x, docs.columns) for x in ("ua", "ub", "sa", "sb")}
    out = docs.withColumn(n["ua"], F.expr(checked(units(a)))).withColumn(n["ub"], F.expr(checked(units(b))))
    out = out.withColumn(n["sa"], F.expr(sketch(n["ua"], str(CELLS)))).withColumn(n["sb"], F.expr(sketch(n["ub"], str(CELLS))))
    out = out.withColumn(likeness_as, F.expr(likeness(n["ua"], n["ub"], n["sa"], n["sb"]))).withColumn(fingerprint_as, F.expr(as_text(a, n["ua"], n["sa"])))
    return out.drop(*n.values())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third replaced by the start of the next document. A null text is empty;
    a table of one row follows itself; repeated rows follow each other. A text is cut into units once, before it meets its
    neighbour; its units go along."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, nxt = followed(docs.withColumn("u", F.expr(units("text"))), ["text", "u"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.col(f"{nxt}.text").substr(F.lit(1), third))
    rows = rows.select("doc_id", "text", "u", F.col(f"{nxt}.u").alias("u_n"), edited.alias("edited"))
    rows = rows.select("doc_id", "text", "edited", F.expr(checked("u")).alias("u_text"), F.expr(checked("u_n")).alias("u_next"), F.expr(checked(units("edited"))).alias("u_edited"))
    for x in ("text", "edited", "next"):
        rows = rows.withColumn(f"s_{x}", F.expr(sketch(f"u_{x}", str(CELLS))))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(as_text("text", "u_text", "s_text")).alias("fingerprint"),
        F.expr(as_text("edited", "u_edited", "s_edited")).alias("edited_fingerprint"),
        F.expr(likeness("u_text", "u_edited", "s_text", "s_edited")).alias("near_edited"),
        F.expr(likeness("u_text", "u_next", "s_text", "s_next")).alias("near_next"),
    )

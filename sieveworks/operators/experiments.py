"""Aggregation of measurement rows: summaries, medians, baselines, scaling, samples, harvests, splits.

Measurement rows come from the driver's tables: an order or line is a run, its flags the lane, its price the size.
"""

from __future__ import annotations

from sieveworks.functions.dialect import Dialect


def wildcard_summary(d: Dialect) -> str:
    """By class, lane and architecture, and over all architectures ("*"): files, bytes, and the lane's bytes beside the raw lane's."""
    rows = "SELECT l_returnflag AS class, l_linestatus AS arch, CASE WHEN l_linenumber % 2 = 0 THEN 'raw' ELSE 'filtered' END AS lane, l_orderkey AS file, cast(l_quantity AS bigint) AS n FROM lineitem"
    sums = f"SELECT class, CASE WHEN grouping(arch) = 1 THEN '*' ELSE arch END AS arch, lane, count(DISTINCT file) AS files, sum(n) AS total FROM ({rows}) r GROUP BY GROUPING SETS ((class, lane), (class, arch, lane))"
    return (
        f"SELECT s.class, s.arch, s.lane, cast(s.files AS bigint) AS files, cast(s.total AS bigint) AS total, cast(b.total AS bigint) AS raw_total, round(100.0e0 * (s.total - b.total) / nullif(b.total, 0), 6) AS delta_percent "
        f"FROM ({sums}) s LEFT JOIN ({sums}) b ON b.class = s.class AND b.arch = s.arch AND b.lane = 'raw'"
    )


def upper_median(d: Dialect) -> str:
    """Of event values in thousandths by type the upper median (the middle, or the upper of two)."""
    x = "SELECT event_type, cast(round(value * 1000) AS bigint) AS x FROM events WHERE value IS NOT NULL"
    return f"SELECT event_type, max(CASE WHEN r = {d.div('n', '2')} + 1 THEN x END) AS med, cast(max(n) AS bigint) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ({x}) a) b GROUP BY event_type"


def mid_median(d: Dialect) -> str:
    """Of lead times in days by ship flag the median, the mean of two middles rounded down; least and most."""
    return "SELECT l_returnflag, cast(floor(median(cast(l_quantity AS bigint) * 3 + l_linenumber)) AS bigint) AS med, min(cast(l_quantity AS bigint) * 3 + l_linenumber) AS lo, max(cast(l_quantity AS bigint) * 3 + l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag"


def mode_summary(d: Dialect) -> str:
    """By input and mode: largest raw size, sums, upper median of time, and whether every run succeeded."""
    x = "SELECT o_orderpriority AS input, o_orderstatus AS mode, cast(floor(o_totalprice) AS bigint) AS raw, o_custkey AS us, o_orderkey % 97 <> 0 AS ok FROM orders"
    r = "SELECT *, row_number() OVER (PARTITION BY input, mode ORDER BY us) AS r, count(*) OVER (PARTITION BY input, mode) AS n FROM ({x}) a".format(x=x)
    return f"SELECT input, mode, max(raw) AS raw, cast(sum(us) AS bigint) AS total_us, max(CASE WHEN r = {d.div('n', '2')} + 1 THEN us END) AS med_us, min(cast(ok AS int)) = 1 AS ok FROM ({r}) b GROUP BY input, mode"


def first_run_summary(d: Dialect) -> str:
    """By input and mode over first runs (the least key of each customer), with the difference to the baseline mode O."""
    first = "SELECT o_orderpriority AS input, o_orderstatus AS mode, cast(floor(o_totalprice) AS bigint) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders) t WHERE run = 1"
    return (
        f"SELECT s.input, s.mode, cast(s.total AS bigint) AS total, cast(s.total - b.total AS bigint) AS delta, round(100.0e0 * (s.total - b.total) / nullif(b.total, 0), 6) AS delta_percent "
        f"FROM (SELECT input, mode, sum(n) AS total FROM ({first}) a GROUP BY input, mode) s LEFT JOIN (SELECT input, sum(n) AS total FROM ({first}) c WHERE mode = 'O' GROUP BY input) b ON b.input = s.input"
    )


def speedup_matrix(d: Dialect) -> str:
    """Scaling by corpus (segment) and jobs: median time, speed-up over one job, efficiency, and whether all outputs agree."""
    runs = "SELECT c_mktsegment AS corpus, cast(CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS bigint) AS jobs, cast(floor(c_acctbal * 100) AS bigint) + 1000000 AS ms, c_nationkey % 2 AS digest FROM customer"
    med = f"SELECT corpus, jobs, cast(floor(median(ms)) AS bigint) AS med_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM ({runs}) r GROUP BY corpus, jobs"
    same = f"SELECT corpus, count(DISTINCT digest) = 1 AS deterministic FROM ({runs}) r GROUP BY corpus"
    return (
        f"SELECT m.corpus, m.jobs, m.med_ms, m.min_ms, m.max_ms, round(cast(b.med_ms AS double) / nullif(m.med_ms, 0), 6) AS speedup, round(cast(b.med_ms AS double) / nullif(m.med_ms, 0) / m.jobs, 6) AS efficiency, s.deterministic "
        f"FROM ({med}) m JOIN ({same}) s ON s.corpus = m.corpus LEFT JOIN ({med}) b ON b.corpus = m.corpus AND b.jobs = 1"
    )


def archive_ratio(d: Dialect) -> str:
    """Archive size by raw bytes of each source, whose archive keeps every distinct text once: frame, contents, closing table; 1 where there are no bytes."""
    n = d.n_bytes("text")
    once = f"SELECT source, count(*) AS k, sum({n}) AS raw, min({n}) AS kept FROM documents WHERE text IS NOT NULL GROUP BY source, text"
    size = "42 + 8 + sum(kept) + 36 + 8 * sum(k)"
    return f"SELECT source, cast(sum(raw) AS bigint) AS raw, cast({size} AS bigint) AS archive, round(CASE WHEN sum(raw) = 0 THEN 1.0e0 ELSE cast({size} AS double) / sum(raw) END, 6) AS ratio FROM ({once}) t GROUP BY source"


def class_harvest(d: Dialect, budget: int = 40000) -> str:
    """Files by the first class rule that fits, each name once, taken by name until a class's bytes before it reach the budget; 12 bytes or fewer are passed over."""
    ruled = f"SELECT doc_id, {d.n_bytes('text')} AS n, concat('f', cast(doc_id % 700 AS {d.text})) AS name, CASE WHEN text LIKE '%<%' THEN 'markup' WHEN lang = 'en' AND {d.n_bytes('text')} > 4000 THEN 'large' WHEN lang = 'en' THEN 'text' ELSE 'other' END AS class FROM documents WHERE {d.n_bytes('text')} > 12"
    once = f"SELECT *, row_number() OVER (PARTITION BY class, name ORDER BY doc_id) AS r FROM ({ruled}) a"
    run = f"SELECT class, name, doc_id, n, coalesce(sum(n) OVER (PARTITION BY class ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({once}) b WHERE r = 1"
    return f"SELECT class, name, doc_id, cast(n AS bigint) AS n_bytes, cast(before AS bigint) AS before FROM ({run}) c WHERE before < {budget}"


def extension_breakdown(d: Dialect) -> str:
    """Candidates and bytes by language class and source ending."""
    return f"SELECT lang AS class, regexp_extract(source, '([0-9]+)$', 1) AS ext, cast(count(*) AS bigint) AS candidates, cast(sum({d.n_bytes('text')}) AS bigint) AS cand_bytes FROM documents GROUP BY lang, regexp_extract(source, '([0-9]+)$', 1)"


def even_sample(d: Dialect, k: int = 8) -> str:
    """k parts of each brand at even distances: i * (n - 1) / (k - 1); all if there are no more than k."""
    n = "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part"
    pick = f"SELECT b.p_brand, {d.div('i.i * (b.n - 1)', str(k - 1))} AS pos FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) b CROSS JOIN (SELECT {d.series('0', str(k - 1), 'i')}) i"
    return f"SELECT p_brand, p_partkey, cast(pos AS bigint) AS pos FROM ({n}) a WHERE n <= {k} OR EXISTS (SELECT 1 FROM ({pick}) p WHERE p.p_brand = a.p_brand AND p.pos = a.pos)"


def holdout_split(d: Dialect, chunk: int = 4096) -> str:
    """Bytes of each file for training (three fifths, rounded down to whole chunks) and held out."""
    n = d.n_bytes("text")
    train = f"{d.div(d.div(f'{n} * 3', '5'), str(chunk))} * {chunk}"
    return f"SELECT doc_id, cast({train} AS bigint) AS train_bytes, cast({n} - {train} AS bigint) AS heldout_bytes FROM documents WHERE text IS NOT NULL"


def prefix_sizes(d: Dialect) -> str:
    """Bytes of each file within the first 1, 4, 16, 64 and 100 KiB."""
    sizes = " UNION ALL ".join(f"SELECT doc_id, cast({k * 1024} AS bigint) AS prefix, cast(least({d.n_bytes('text')}, {k * 1024}) AS bigint) AS n FROM documents WHERE text IS NOT NULL" for k in (1, 4, 16, 64, 100))
    return sizes


def largest_remainder(d: Dialect, total: int = 4096) -> str:
    """Counts of event types scaled to a power of two: whole parts (at least 1), then the largest remainders one more, ties to the smaller name; the growing case."""
    c = "SELECT event_type AS sym, count(*) AS n FROM events GROUP BY event_type"
    q = f"SELECT sym, n, n * {total} AS scaled, sum(n) OVER () AS t FROM ({c}) a"
    w = f"SELECT sym, n, greatest(1, {d.div('scaled', 't')}) AS base, scaled % t AS rest FROM ({q}) b"
    r = f"SELECT *, row_number() OVER (ORDER BY rest DESC, sym) AS r, {total} - sum(base) OVER () AS missing FROM ({w}) e"
    return f"SELECT sym, cast(n AS bigint) AS n, cast(base + CASE WHEN r <= missing THEN 1 ELSE 0 END AS bigint) AS freq FROM ({r}) f"


def canonical_order(d: Dialect) -> str:
    """Symbols in the order of their code lengths, then themselves; running offsets of their shares."""
    return "SELECT p_brand, p_size, cast(row_number() OVER (ORDER BY p_size, p_brand) AS bigint) AS place, cast(sum(n) OVER (ORDER BY p_size, p_brand ROWS UNBOUNDED PRECEDING) - n AS bigint) AS off FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size) t"


def symbol_frequencies(d: Dialect) -> str:
    """How often each word occurs in the corpus: the frequency table that coders start from."""
    return f"SELECT w, cast(count(*) AS bigint) AS n FROM (SELECT {d.explode(d.split('text', ' '), 'w')} FROM documents WHERE text IS NOT NULL) t WHERE w <> '' GROUP BY w"


def source_manifest(d: Dialect) -> str:
    """Manifest rows (class, path, bytes, digest) joined to the files again; rows whose size differs."""
    m = f"SELECT lang AS class, doc_id, {d.n_bytes('text')} + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS n, {d.sha256('text')} AS digest FROM documents WHERE text IS NOT NULL"
    return f"SELECT m.class, m.doc_id, cast(m.n AS bigint) AS listed, cast({d.n_bytes('f.text')} AS bigint) AS found, m.digest FROM ({m}) m JOIN documents f ON f.doc_id = m.doc_id WHERE m.n <> {d.n_bytes('f.text')}"


STATEMENTS = [wildcard_summary, upper_median, mid_median, mode_summary, first_run_summary, speedup_matrix, archive_ratio, class_harvest, extension_breakdown, even_sample, holdout_split, prefix_sizes, largest_remainder, canonical_order, symbol_frequencies, source_manifest]

"""Chunk catalogs: fixed-size chunking, deduplication, references, verification, reassembly, sizes.

A file is a row (doc_id, text); its bytes are the UTF-8 form. A chunk is known by its digest; the chunk's
ordinal is the rank of its first place (document, position). Every statement groups or joins on digests or
ordinals, so a chunk that is common in the corpus is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from sieveworks.functions.dialect import Dialect

COMMON_SIZES = (1024, 4096, 16384, 65536)


def pieces(d: Dialect, size: int, src: str = "documents") -> str:
    """One row per chunk: doc_id, pos, hx (hexadecimal bytes), n (bytes); empty files have none."""
    return (
        f"SELECT doc_id, pos, substr(hx, cast(pos * {2 * size} + 1 AS int), {2 * size}) AS hx FROM "
        f"(SELECT doc_id, hx, {d.series('0', d.div('length(hx) - 1', str(2 * size)), 'pos')} FROM "
        f"(SELECT doc_id, {d.hex_of('text')} AS hx FROM {src} WHERE text IS NOT NULL AND text <> '') a) b"
    )


def unique(d: Dialect, size: int, src: str = "documents") -> str:
    """CTEs p (pieces with digest) and u (unique chunks with ordinal), p's text in hexadecimal."""
    return (
        f"p AS (SELECT doc_id, pos, {d.sha256('hx')} AS h, hx, cast(length(hx) / 2 AS bigint) AS n FROM ({pieces(d, size, src)}) z), "
        f"g AS (SELECT h, min(doc_id) AS first_doc, count(*) AS copies, max(n) AS n FROM p GROUP BY h), "
        f"f AS (SELECT p.h, min(p.pos) AS first_pos FROM p JOIN g ON p.h = g.h AND p.doc_id = g.first_doc GROUP BY p.h), "
        f"u AS (SELECT g.h, first_doc, first_pos, copies, g.n FROM g JOIN f ON g.h = f.h)"
    )


def chunk_dedup(d: Dialect, size: int = 1024) -> str:
    """Unique chunks: digest, first document and position, copies, bytes."""
    return f"WITH {unique(d, size)} SELECT h AS chunk, first_doc, cast(first_pos AS bigint) AS first_pos, cast(copies AS bigint) AS copies, n AS n_bytes FROM u"


def chunk_totals(d: Dialect) -> str:
    """Raw bytes, chunks, unique chunks and their bytes, for each common size."""
    each = " UNION ALL ".join(
        f"SELECT cast({s} AS bigint) AS size, cast(sum(copies * n) AS bigint) AS raw_bytes, cast(sum(copies) AS bigint) AS chunks, cast(count(*) AS bigint) AS unique_chunks, "
        f"cast(sum(n) AS bigint) AS unique_bytes FROM (SELECT h, count(*) AS copies, max(n) AS n FROM (SELECT {d.sha256('hx')} AS h, length(hx) / 2 AS n FROM ({pieces(d, s)}) z) y GROUP BY h) x"
        for s in COMMON_SIZES
    )
    return f"SELECT *, round(cast(unique_bytes AS double) / raw_bytes, 6) AS kept_share FROM ({each}) t"


def file_refs(d: Dialect, size: int = 4096) -> str:
    """Each file's references in order: the first places of its chunks, and its length."""
    return (
        f"WITH {unique(d, size)} SELECT p.doc_id, cast(count(*) AS bigint) AS n_refs, cast(sum(p.n) AS bigint) AS file_len, "
        f"{d.list_of('concat(cast(u.first_doc AS ' + d.text + '), \':\', cast(u.first_pos AS ' + d.text + '))', 'p.pos')} AS refs FROM p JOIN u ON p.h = u.h GROUP BY p.doc_id"
    )


def reassemble_hash(d: Dialect, size: int = 4096) -> str:
    """Files put together from unique chunks: the digest of the result beside the digest of the source."""
    joined = f"concat_ws('', {d.list_of('u.hx', 'p.pos')})" if d.spark else f"array_to_string({d.list_of('u.hx', 'p.pos')}, '')"
    return (
        f"WITH p AS (SELECT doc_id, pos, hx, {d.sha256('hx')} AS h FROM ({pieces(d, size)}) z), u AS (SELECT h, max(hx) AS hx FROM p GROUP BY h), "
        f"r AS (SELECT p.doc_id, {joined} AS hx FROM p JOIN u ON p.h = u.h GROUP BY p.doc_id) "
        f"SELECT r.doc_id, {d.sha256(d.unhex_text('r.hx'))} AS rebuilt, {d.sha256('s.text')} AS source, {d.sha256(d.unhex_text('r.hx'))} = {d.sha256('s.text')} AS same FROM r JOIN documents s ON r.doc_id = s.doc_id"
    )


def verify_refs(d: Dialect, size: int = 4096) -> str:
    """Files whose references do not add up to their length, or point nowhere, over a catalog in which chunks whose digest starts with 0 are missing."""
    return (
        f"WITH {unique(d, size)}, c AS (SELECT * FROM u WHERE substr(h, 1, 1) <> '0') "
        f"SELECT p.doc_id, cast(sum(p.n) AS bigint) AS file_len, cast(coalesce(sum(c.n), 0) AS bigint) AS ref_sum, cast(sum(CASE WHEN c.h IS NULL THEN 1 ELSE 0 END) AS bigint) AS dangling, "
        f"sum(p.n) = coalesce(sum(c.n), 0) AS ok FROM p LEFT JOIN c ON p.h = c.h GROUP BY p.doc_id"
    )


def exact_duplicates(d: Dialect) -> str:
    """Files of equal content: digest, first file, copies."""
    return f"SELECT {d.sha256('text')} AS digest, min(doc_id) AS first_doc, cast(count(*) AS bigint) AS copies FROM documents WHERE text IS NOT NULL GROUP BY {d.sha256('text')} HAVING count(*) > 1"


def store_size(d: Dialect) -> str:
    """Uncompressed container sizes: frame, contents, table of paths."""
    path = f"{d.n_bytes('concat(source, chr(47), cast(doc_id AS ' + d.text + '))')}"
    return (
        f"SELECT source, cast(count(*) AS bigint) AS files, cast(sum({d.n_bytes('text')}) AS bigint) AS raw_bytes, cast(42 + 8 + sum({d.n_bytes('text')}) + 36 + sum(2 + {path} + 8) AS bigint) AS store_bytes "
        f"FROM documents WHERE text IS NOT NULL GROUP BY source"
    )


def multiset_equal(d: Dialect, size: int = 4096) -> str:
    """Rows (doc_id, digest) that only one of source and reassembly has, by multiset; none if all is well."""
    back = reassemble_hash(d, size)
    one, two = f"SELECT doc_id, {d.sha256('text')} AS digest FROM documents WHERE text <> ''", f"SELECT doc_id, rebuilt AS digest FROM ({back}) b"
    return f"SELECT 'lost' AS side, doc_id, digest FROM (({one}) EXCEPT ALL ({two})) l UNION ALL SELECT 'added' AS side, doc_id, digest FROM (({two}) EXCEPT ALL ({one})) r"


def list_catalog(d: Dialect, size: int = 4096) -> str:
    """One row for each file: path, length, chunks, and how many of them it shares with other files."""
    return (
        f"WITH {unique(d, size)}, n AS (SELECT h, count(DISTINCT doc_id) AS files FROM p GROUP BY h) "
        f"SELECT s.source || '/' || cast(s.doc_id AS {d.text}) AS path, cast(coalesce(sum(p.n), 0) AS bigint) AS file_len, cast(count(p.h) AS bigint) AS chunks, "
        f"cast(coalesce(sum(CASE WHEN n.files > 1 THEN 1 ELSE 0 END), 0) AS bigint) AS shared FROM documents s LEFT JOIN p ON p.doc_id = s.doc_id LEFT JOIN n ON n.h = p.h GROUP BY s.source, s.doc_id"
    )


def path_safety(d: Dialect) -> str:
    """Paths from page addresses and crafted ones, with the verdict: not empty, not rooted, no drive, no parent step."""
    crafted = " UNION ALL ".join(f"SELECT '{p}' AS path" for p in ("", "/etc/passwd", "../evil.txt", "a/../../evil.txt", "a/b.txt", "C:/x", "..", "a/..b/c", "a//b", "\\\\host"))
    crafted = crafted if d.spark else crafted.replace("\\\\", "\\")
    bad = f"path = '' OR {d.matches('path', '^[/]|^[a-zA-Z]:|(^|/)[.][.](/|$)')} OR substr(path, 1, 1) = chr(92)"
    address = "regexp_replace(url, '^https?:/', '')"
    return f"SELECT path, NOT ({bad}) AS safe FROM (SELECT {address} AS path FROM pages WHERE url IS NOT NULL UNION ALL SELECT substr({address}, 2) AS path FROM pages WHERE url IS NOT NULL UNION ALL {crafted}) t"


def archive_names(d: Dialect) -> str:
    """Paths with an archive ending, case aside, and their stems."""
    path = f"concat(source, '/', cast(doc_id AS {d.text}), CASE WHEN doc_id % 3 = 0 THEN '.FOLD' WHEN doc_id % 3 = 1 THEN '.fold' ELSE '.txt' END)"
    return f"SELECT path, lower(path) LIKE '%.fold' AS is_archive, regexp_extract(path, '([^/]+)[.][^./]*$', 1) AS stem FROM (SELECT {path} AS path FROM documents) t"

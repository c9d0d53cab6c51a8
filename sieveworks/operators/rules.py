"""Grammar rules as tables: validity, closure, expansion, renumbering, dictionaries; context and header arithmetic.

A rule (id, l, r) replaces the pair (l, r) by the symbol 256 + id; symbols below 256 are bytes. A rule is valid if both parts
are below its own symbol, so rules form an acyclic graph and expansion ends.
"""

from __future__ import annotations

from sieveworks.functions.dialect import Dialect

MOST_RULES = 3840


def rule_table(d: Dialect, n: int = 60) -> str:
    """A table of rules whose parts come from their ids, every third one building on earlier rules."""
    low = "CASE WHEN id = 0 OR id % 3 = 0 THEN 97 + id % 26 ELSE 256 + cast(floor(id / 2) AS bigint) END"
    high = "CASE WHEN id = 0 OR id % 3 <> 2 THEN 97 + (id * 7) % 26 ELSE 256 + id - 1 END"
    return f"SELECT id, cast({low} AS bigint) AS l, cast({high} AS bigint) AS r FROM (SELECT {d.series('0', str(n - 1), 'id')}) t"


def rule_validity(d: Dialect) -> str:
    """Rules with the verdict, some made invalid."""
    broken = f"SELECT id, CASE WHEN id % 17 = 5 THEN 256 + id ELSE l END AS l, CASE WHEN id % 23 = 7 THEN 300 + id ELSE r END AS r FROM ({rule_table(d)}) t"
    return f"SELECT id, l, r, l < 256 + id AND r < 256 + id AND id < {MOST_RULES} AS valid FROM ({broken}) b"


def live_rules(d: Dialect) -> str:
    """Rules reachable from the rules in use (every seventh): the closure over parts, each rule once per step."""
    union = "UNION ALL" if d.spark else "UNION"
    # a depth bounds the walk: parts of a rule have smaller ids
    return (
        f"WITH RECURSIVE rules AS (SELECT * FROM ({rule_table(d)}) t), parts AS (SELECT id, l - 256 AS p FROM rules WHERE l >= 256 UNION SELECT id, r - 256 AS p FROM rules WHERE r >= 256), "
        f"live(id) AS (SELECT id FROM rules WHERE id % 7 = 6 AND id < 30 {union} SELECT p.p FROM live JOIN parts p ON p.id = live.id) SELECT DISTINCT id FROM live"
    )


def rule_expansion(d: Dialect) -> str:
    """The bytes of each rule, up to 64 of them, by following parts left to right: paths order the bytes."""
    step = "concat(path, CASE side.k WHEN 0 THEN 'a' ELSE 'b' END)"
    part = "CASE side.k WHEN 0 THEN x.l ELSE x.r END"
    sides = "(SELECT 0 AS k UNION ALL SELECT 1 AS k)"
    text = f"concat_ws('', {d.list_of('chr(cast(sym AS int))', 'path')})" if d.spark else f"array_to_string({d.list_of('chr(cast(sym AS int))', 'path')}, '')"
    return (
        f"WITH RECURSIVE rules AS (SELECT * FROM ({rule_table(d, 16)}) t), walk(root, path, sym) AS (SELECT id, cast('' AS {d.text}), 256 + id FROM rules "
        f"UNION ALL SELECT w.root, {step}, cast({part} AS bigint) FROM walk w JOIN rules x ON w.sym = 256 + x.id CROSS JOIN {sides} side) "
        f"SELECT root AS id, {text} AS bytes, cast(count(*) AS bigint) AS n FROM walk WHERE sym < 256 GROUP BY root"
    )


def gc_remap(d: Dialect) -> str:
    """After a collection: surviving rules with new ids, their parts renumbered; the survivors are closed under parts."""
    return (
        f"WITH live AS ({live_rules(d)}), rules AS (SELECT * FROM ({rule_table(d)}) t), m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nid FROM live) "
        f"SELECT cast(m.nid AS bigint) AS id, cast(CASE WHEN r.l < 256 THEN r.l ELSE 256 + a.nid END AS bigint) AS l, cast(CASE WHEN r.r < 256 THEN r.r ELSE 256 + b.nid END AS bigint) AS r, "
        f"(r.l < 256 OR a.nid IS NOT NULL) AND (r.r < 256 OR b.nid IS NOT NULL) AS closed FROM rules r JOIN m ON m.id = r.id LEFT JOIN m a ON a.id = r.l - 256 LEFT JOIN m b ON b.id = r.r - 256"
    )


def gc_windows(d: Dialect, interval: int = 64, lag: int = 16) -> str:
    """Rules (here classes of users) at the end of every window of `interval` uses: whether the last use so far, or with a lag above 1
    the last use plus the lag, reaches the start of the window; over all rules used by then, also those the window does not use."""
    return (
        f"WITH u AS (SELECT user_id % 97 AS rule, event_id AS seq, {d.div('event_id', str(interval))} AS w FROM events), k AS (SELECT rule, w, max(seq) AS used FROM u GROUP BY rule, w), "
        f"g AS (SELECT r.rule, x.w FROM (SELECT DISTINCT rule FROM k) r CROSS JOIN (SELECT DISTINCT w FROM k) x), "
        f"l AS (SELECT g.rule, g.w, max(k.used) OVER (PARTITION BY g.rule ORDER BY g.w) AS last_use FROM g LEFT JOIN k ON k.rule = g.rule AND k.w = g.w) "
        f"SELECT rule, cast(w AS bigint) AS w, last_use, last_use >= w * {interval} OR {lag} > 1 AND last_use + {lag} >= w * {interval} AS survives, last_use >= w * {interval} AS survives_lag_1 FROM l WHERE last_use IS NOT NULL"
    )


def dictionary_trim(d: Dialect, least: int = 1) -> str:
    """Of ranked candidate rules those before the first with too little benefit, at most MOST_RULES: benefit is uses * (length - 1) - 4."""
    ranked = f"SELECT p_partkey AS id, (p_size % 5) * (length(p_name) % 9 - 1) - 4 + CASE WHEN p_partkey < 60 THEN 40 ELSE 0 END AS benefit FROM part"
    return f"SELECT id, cast(benefit AS bigint) AS benefit FROM ({ranked}) t WHERE id < coalesce((SELECT min(id) FROM ({ranked}) u WHERE benefit < {least}), {MOST_RULES}) AND id < {MOST_RULES}"


def rule_digest(d: Dialect) -> str:
    """Digest of a rule table: its parts as little-endian 16-bit words in order."""
    word = (lambda c: f"concat(lpad(hex({c} % 256), 2, '0'), lpad(hex({d.rshift(c, 8)}), 2, '0'))") if d.spark else (lambda c: f"printf('%02X%02X', {c} % 256, {d.rshift(c, 8)})")
    joined = f"concat_ws('', {d.list_of('w', 'id')})" if d.spark else f"array_to_string({d.list_of('w', 'id')}, '')"
    return f"SELECT {d.sha256(joined)} AS digest, cast(count(*) AS bigint) AS rules FROM (SELECT id, concat({word('l')}, {word('r')}) AS w FROM ({rule_table(d)}) t) u"


def dictionary_marker(d: Dialect) -> str:
    """Archives and the dictionaries given for them: ok, missing, unexpected, mismatch, none."""
    need = "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN concat('d', cast(c_custkey % 5 AS {t})) END AS want FROM customer".format(t=d.text)
    have = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN concat('d', cast(c_custkey % 4 AS {t})) END AS got FROM customer WHERE c_custkey % 11 <> 0".format(t=d.text)
    return (
        f"SELECT coalesce(n.id, h.id) AS id, CASE WHEN want IS NULL AND got IS NULL THEN 'none' WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' WHEN want = got THEN 'ok' ELSE 'mismatch' END AS verdict "
        f"FROM ({need}) n FULL OUTER JOIN ({have}) h ON n.id = h.id"
    )


def parameter_word(d: Dialect) -> str:
    """Parameters packed into one word (chunk size, lag in 8 bits, interval in 16) and taken apart again; lag 256 comes back as 0."""
    base = "SELECT cast(4096 * (1 + o_orderkey % 256) AS bigint) AS chunk, cast(1 + o_orderkey % 1024 AS bigint) AS lag, cast(1 + o_orderkey % 4096 AS bigint) AS gc FROM orders"
    word = f"SELECT *, chunk + {d.lshift('(lag % 256)', 32)} + {d.lshift('(gc % 65536)', 40)} AS word FROM ({base}) t"
    return f"SELECT chunk, lag, gc, word, word % {1 << 32} AS chunk_back, {d.rshift('word', 32)} % 256 AS lag_back, {d.rshift('word', 40)} % 65536 AS gc_back, lag = {d.rshift('word', 32)} % 256 AS lag_same FROM ({word}) u"


def context_map(d: Dialect) -> str:
    """Context of each symbol: its own below 256; in the small map eight cold classes, in the large one 192 hot rules first; then the sentinel's."""
    cold = lambda first: f"{first} + (sym - {first}) * 2654435769 % 8"
    return (
        f"SELECT sym, cast(CASE WHEN sym < 256 THEN sym ELSE {cold(256)} END AS bigint) AS small, cast(CASE WHEN sym < 448 THEN sym ELSE {cold(448)} END AS bigint) AS large, "
        f"cast(264 AS bigint) AS small_sentinel, cast(456 AS bigint) AS large_sentinel FROM (SELECT {d.series('0', '4095', 'sym')}) t"
    )


def order2_bucket(d: Dialect) -> str:
    """Order-2 bucket of a symbol of 16 bits and the one before it, among 1024: two products, combined by exclusive or."""
    xor = "({} ^ {})" if d.spark else "xor({}, {})"
    bucket = xor.format("prev * 2654435769", "prev2 * 3210233709")
    return f"SELECT prev, prev2, cast({bucket} % 1024 AS bigint) AS bucket, cast(count(*) AS bigint) AS n FROM (SELECT l_partkey % 65536 AS prev, l_suppkey % 65536 AS prev2 FROM lineitem) t GROUP BY prev, prev2"


def fnv1a(d: Dialect) -> str:
    """32-bit FNV-1a checksums of customer names."""
    if d.spark:
        return "SELECT c_custkey, aggregate(transform(regexp_extract_all(hex(encode(c_name, 'UTF-8')), '..', 0), x -> cast(conv(x, 16, 10) AS bigint)), 2166136261L, (a, b) -> ((a ^ b) * 16777619L) & 4294967295L) AS checksum FROM customer"
    return "SELECT c_custkey, list_reduce([2166136261::BIGINT] || list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS checksum FROM customer"


def ceil_log2(d: Dialect) -> str:
    """The least k with 2**k not below n; 0 for n up to 1."""
    return f"SELECT n, cast(CASE WHEN n <= 1 THEN 0 ELSE ceil(log2(n)) END AS bigint) AS k FROM (SELECT {d.series('0', '5000', 'n')}) t"


def frame_overhead(d: Dialect) -> str:
    """Bytes of frames by number of rules: fold 274 + 5R, token 14 + 4R, byte 10, context 18 + 4R; the smallest one."""
    return f"SELECT n, 274 + 5 * n AS fold, 14 + 4 * n AS token, cast(10 AS bigint) AS byte, 18 + 4 * n AS context, least(274 + 5 * n, 14 + 4 * n, 10, 18 + 4 * n) AS least_frame FROM (SELECT {d.series('0', '1024', 'n')}) t"


def plausible_footer(d: Dialect) -> str:
    """Catalog counts against bytes: at most a chunk for 5 bytes, a file for 18, a stored file for 42."""
    return "SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS n_bytes, o_custkey AS chunks, o_custkey * 5 <= cast(floor(o_totalprice) AS bigint) AS chunks_ok, o_custkey * 18 <= cast(floor(o_totalprice) AS bigint) AS files_ok, o_custkey * 42 <= cast(floor(o_totalprice) AS bigint) AS stored_ok FROM orders"


STATEMENTS = [rule_validity, live_rules, rule_expansion, gc_remap, gc_windows, dictionary_trim, rule_digest, dictionary_marker, parameter_word, context_map, order2_bucket, fnv1a, ceil_log2, frame_overhead, plausible_footer]

"""All queries over the driver's tables by name, and their DuckDB SQL.

Statements are written once for both dialects; where Spark counts inside Arrow batches, the oracle spells out bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.dialect import DUCK, SPARK, Dialect
from sieveworks.operators import bytestats, chunks, codecs, experiments, grammar, grid, layout, rules
from sieveworks.sources.tables import register, table

Query = Callable[[SparkSession, str], DataFrame]


def of_sql(statement: Callable[[Dialect], str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(statement(SPARK))

    run.__doc__ = statement.__doc__
    return run


def of_files(operator: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir, "documents"))

    run.__doc__ = operator.__doc__
    return run


def characterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return grid.characterize(spark)


def of_chunks(operator: Callable[[DataFrame], DataFrame], size: int = 4096) -> Query:
    """An operator over the unique chunks of documents: digest and bytes in hexadecimal."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        pieces = spark.sql(chunks.pieces(SPARK, size)).groupBy(F.sha2("hx", 256).alias("chunk")).agg(F.first("hx").alias("hx"))
        return operator(pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk"))

    run.__doc__ = operator.__doc__
    return run


def store_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether storing a source's files uncompressed is smaller than its compressed container: the best sizes of its unique chunks,
    frame and table, 8 bytes for each reference."""
    register(spark, sf_dir)
    pieces = spark.sql(chunks.pieces(SPARK, 16384)).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    each = pieces.groupBy("source", F.sha2("hx", 256).alias("chunk")).agg(F.count("*").alias("refs"))
    unique = pieces.groupBy(F.sha2("hx", 256).alias("chunk")).agg(F.first("hx").alias("hx"))
    sizes = codecs.mode_sizes(unique.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")).select("chunk", "best")
    packed = each.join(sizes, "chunk").groupBy("source").agg((42 + 8 + F.sum("best") + 36 + 8 * F.sum("refs")).cast("long").alias("packed_bytes"))
    sizes = spark.sql(chunks.store_size(SPARK)).join(packed.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")), "left").drop("own")
    return sizes.withColumn("store_wins", F.col("store_bytes") < F.col("packed_bytes"))


def train_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.train_dictionary(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


def measured_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over orders rendered as text, the lines of 500 keys to a chunk."""
    register(spark, sf_dir)
    line = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice AS decimal(18, 2)), cast(o_orderdate AS date), o_orderpriority)"
    text = f"SELECT o_orderkey div 500 AS k, concat(array_join(transform(array_sort(collect_list(struct(o_orderkey AS o, {line} AS v))), p -> p.v), chr(10)), chr(10)) AS text FROM orders GROUP BY o_orderkey div 500"
    return layout.measured_gate(spark.sql(f"SELECT cast(k AS string) AS chunk, hex(encode(text, 'UTF-8')) AS hx FROM ({text}) t"))


def persistent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source is an archive of its unique chunks, in the order of their first places."""
    register(spark, sf_dir)
    pieces = spark.sql(chunks.pieces(SPARK, 4096)).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    unique = pieces.groupBy(F.coalesce("source", F.lit("")).alias("archive"), F.sha2("hx", 256).alias("h")).agg(F.min(F.col("doc_id") * (1 << 20) + F.col("pos")).alias("seq"), F.first("hx").alias("hx"))
    return grammar.persistent_fold(unique)


def dictionary_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(r["l"], r["r"]) for r in train_dictionary(spark, sf_dir).orderBy("rule_id").collect()]
    return codecs.dictionary_cover(table(spark, sf_dir, "documents"), rules)


STATEMENTS: dict[str, Callable[[Dialect], str]] = {
    f.__name__: f
    for f in (
        chunks.chunk_dedup, chunks.chunk_totals, chunks.file_refs, chunks.reassemble_hash, chunks.verify_refs, chunks.exact_duplicates, chunks.store_size, chunks.multiset_equal, chunks.list_catalog, chunks.path_safety, chunks.archive_names,
        grid.delimiter_counts, grid.delimiter_pick, grid.jsonish_lines, grid.uniform_grid, grid.edge_parts, grid.column_profile, grid.column_decision, grid.wrapper_sizes, grid.delta_roundtrip, grid.inverse_rows, grid.canonical_int, grid.canonical_date, grid.varint_lengths, grid.strided_sample,
        *rules.STATEMENTS, *experiments.STATEMENTS,
    )
}

_BYTES = "b AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x, generate_subscripts(regexp_extract_all(h, '..'), 1) AS pos FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL) t), v AS (SELECT doc_id, pos, ('0x' || x)::BIGINT AS v FROM b)"
_PAIRS = f"{_BYTES}, p AS (SELECT doc_id, pos, v AS l, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM v)"
_ENTROPY = f"WITH {_BYTES}, c AS (SELECT doc_id, v, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM c), e AS (SELECT doc_id, sum(n)::BIGINT AS n_bytes, count(*)::BIGINT AS distinct_bytes, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS entropy FROM s GROUP BY doc_id) SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(distinct_bytes, 0)::BIGINT AS distinct_bytes, coalesce(entropy, 0)::DOUBLE AS entropy FROM documents d LEFT JOIN e USING (doc_id) WHERE d.text IS NOT NULL"
_SIG = f"WITH {_BYTES}, c AS (SELECT doc_id, v // 16 AS k, count(*) AS n FROM v GROUP BY ALL), g AS (SELECT doc_id, k, coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY doc_id))::DOUBLE AS x FROM (SELECT DISTINCT doc_id FROM c) a CROSS JOIN range(16) r(k) LEFT JOIN c USING (doc_id, k))"

OWN: dict[str, tuple[Query, str | None]] = {
    "mode_sizes": (of_chunks(codecs.mode_sizes, 16384), None),
    "block_modes": (of_chunks(lambda c: codecs.mode_sizes(c).groupBy("mode").agg(F.count("*").alias("chunks"), F.sum("raw").alias("raw"), F.sum("best").alias("best")), 16384), None),
    "store_decision": (store_decision, None),
    "fold_sweep": (of_chunks(codecs.fold_sweep, 16384), None),
    "train_dictionary": (train_dictionary, None),
    "dictionary_cover": (dictionary_cover, None),
    "persistent_fold": (persistent_fold, None),
    "measured_gate": (measured_gate, None),
    "characterize": (characterize, grid.characterize_sql(DUCK)),
    "byte_histogram": (of_files(bytestats.histogram), f"WITH {_BYTES} SELECT doc_id, v AS byte, count(*) AS n FROM v GROUP BY ALL"),
    "byte_entropy": (of_files(bytestats.entropy), _ENTROPY),
    "near_random": (of_files(lambda f: bytestats.near_random(f, 4.5)), f"SELECT * FROM ({_ENTROPY}) t WHERE entropy >= 4.5"),
    "nibble_signature": (of_files(lambda f: bytestats.signature(f).select("doc_id", F.posexplode("sig").alias("k", "x")).select("doc_id", F.col("k").cast("long").alias("k"), F.round("x", 9).alias("x"))), f"{_SIG} SELECT doc_id, k::BIGINT AS k, round(x, 9) AS x FROM g"),
    "signature_distance": (of_files(bytestats.signature_distance), f"{_SIG}, m AS (SELECT k, avg(x) AS m FROM g GROUP BY k) SELECT doc_id, round(sum(abs(x - m)), 6) AS distance FROM g JOIN m USING (k) GROUP BY doc_id"),
    "pair_counts": (of_files(bytestats.pairs), f"WITH {_PAIRS} SELECT l, r, count(*) AS n FROM p WHERE r IS NOT NULL GROUP BY ALL"),
    "pair_topk": (of_files(bytestats.pair_topk), f"WITH {_PAIRS} SELECT l, r, count(*) AS n FROM p WHERE r IS NOT NULL GROUP BY ALL ORDER BY n DESC, l DESC, r DESC LIMIT 50"),
    "pair_nonoverlap": (
        of_files(lambda f: bytestats.pairs(f, overlapping=False)),
        f"WITH {_PAIRS}, i AS (SELECT doc_id, v, pos - row_number() OVER (PARTITION BY doc_id, v ORDER BY pos) AS grp FROM v), runs AS (SELECT doc_id, v, count(*) AS k FROM i GROUP BY doc_id, v, grp) SELECT l, r, n::BIGINT AS n FROM (SELECT l, r, count(*) AS n FROM p WHERE r <> l GROUP BY ALL UNION ALL SELECT v AS l, v AS r, sum(k // 2) AS n FROM runs GROUP BY v HAVING sum(k // 2) > 0) t",
    ),
    "order1_cost": (
        of_files(bytestats.order1_cost),
        f"WITH {_BYTES}, c AS (SELECT doc_id, pos, v, coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY pos), 256) AS ctx FROM v), k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, ctx ORDER BY pos) - 1 AS n, row_number() OVER (PARTITION BY doc_id, ctx, v ORDER BY pos) - 1 AS k FROM c), s AS (SELECT doc_id, sum(-log2((k + 1) / (n + 256)::DOUBLE)) AS bits FROM k GROUP BY doc_id) SELECT d.doc_id, round(coalesce(bits, 0), 3) AS bits FROM documents d LEFT JOIN s USING (doc_id) WHERE d.text IS NOT NULL",
    ),
}

FLAGSHIP = "characterize"
QUERIES: dict[str, Query] = {n: of_sql(f) for n, f in STATEMENTS.items()} | {n: q for n, (q, _) in OWN.items()}
ORACLE_SQL: dict[str, str] = {n: f(DUCK) for n, f in STATEMENTS.items()} | {n: s for n, (_, s) in OWN.items() if s}

"""Every query with an oracle against DuckDB, and the others against their own invariants."""

import pytest
from compare import same

from sieveworks.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, data, duck, name):
    same(catalogue.QUERIES[name](spark, data), duck, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_partitions_do_not_matter(spark, data):
    from sieveworks.operators import bytestats
    from sieveworks.sources.tables import table

    docs = table(spark, data, "documents")
    want = sorted(map(tuple, bytestats.pairs(docs).collect()))
    for n in (1, 7):
        assert sorted(map(tuple, bytestats.pairs(docs.repartition(n)).collect())) == want


def test_empty_tables(spark):
    from sieveworks.functions.dialect import SPARK
    from sieveworks.operators import bytestats, chunks, grid

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.createOrReplaceTempView("documents")
    assert spark.sql(chunks.chunk_dedup(SPARK)).count() == 0
    assert grid.characterize(spark).count() == 0
    assert bytestats.entropy(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id long, text string")
    odd.createOrReplaceTempView("documents")
    assert [tuple(r) for r in spark.sql(chunks.chunk_dedup(SPARK)).select("first_doc", "copies", "n_bytes").collect()] == [(3, 2, 1)]
    assert sorted(map(tuple, bytestats.entropy(odd).collect())) == [(2, 0, 0, 0.0), (3, 1, 1, 0.0), (3, 1, 1, 0.0)]


def test_context_arithmetic_by_hand(spark):
    """Low ten bits of 0x9E3779B9 and 0xBF58476D are 0x1B9 and 0x36D, so (1, 1) falls in 0x2D4; both multipliers' low bits by hand."""
    from sieveworks.functions.dialect import SPARK
    from sieveworks.operators import rules

    spark.createDataFrame([(1, 1), (0, 0), (65537, 65536)], "l_partkey long, l_suppkey long").createOrReplaceTempView("lineitem")
    assert {(r["prev"], r["prev2"]): r["bucket"] for r in spark.sql(rules.order2_bucket(SPARK)).collect()} == {(1, 1): 0x2D4, (0, 0): 0, (1, 0): 0x1B9}
    contexts = {r["sym"]: (r["small"], r["large"]) for r in spark.sql(rules.context_map(SPARK)).collect()}
    assert [contexts[x] for x in (97, 256, 257, 265, 447, 448, 451)] == [(97, 97), (256, 256), (257, 257), (257, 265), (263, 447), (256, 448), (259, 451)]


def test_collection_windows_by_hand(spark):
    """Windows of 64 uses: rule 1 is used at 0, rule 2 at 60 and 130; a lag of 16 carries rule 2 over the second window, not rule 1."""
    from sieveworks.functions.dialect import SPARK
    from sieveworks.operators import rules

    spark.createDataFrame([(0, 1), (60, 2), (70, 3), (130, 2)], "event_id long, user_id long").createOrReplaceTempView("events")
    got = {(r["rule"], r["w"]): (r["survives"], r["survives_lag_1"]) for r in spark.sql(rules.gc_windows(SPARK)).collect()}
    assert got == {(1, 0): (True, True), (1, 1): (False, False), (1, 2): (False, False), (2, 0): (True, True), (2, 1): (True, False), (2, 2): (True, True), (3, 1): (True, True), (3, 2): (False, False)}


def test_store_decision(spark, data):
    rows = catalogue.QUERIES["store_decision"](spark, data).collect()
    assert rows and all(r["store_wins"] == (r["store_bytes"] < r["packed_bytes"]) and not r["store_wins"] for r in rows)

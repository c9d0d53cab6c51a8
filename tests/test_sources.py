"""File trees, manifests, catalogs and streams."""

import pytest
from pyspark.sql import functions as F

from sieveworks.functions.dialect import SPARK
from sieveworks.operators import chunks
from sieveworks.sources import files
from sieveworks.streaming import dedup


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a/x.txt": b"one", "a/b/y.txt": b"two\nlines", "c/x.txt": b"other", "c/empty": b"", "target/z.txt": b"skip", "top.txt": b"t"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return root


def test_scan(spark, tree):
    found = files.scan(spark, str(tree))
    assert sorted((r["name"], r["class"]) for r in found.collect()) == [("a/b/y.txt", "a"), ("a/x.txt", "a"), ("c/x.txt", "c"), ("top.txt", "")]
    assert files.scan(spark, str(tree), tolerant=True).count() == 4
    assert sorted(r["name"] for r in files.first_by_name(found).collect()) == ["a/b/y.txt", "a/x.txt", "top.txt"]
    docs = files.as_documents(found).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in docs] == list(range(4)) and docs[0]["text"] == "t"


def test_manifest(spark, tree, tmp_path):
    found = files.scan(spark, str(tree), tolerant=True)
    files.write_tsv(files.manifest(found), str(tmp_path / "m"))
    listed = files.read_manifest(spark, str(tmp_path / "m"))
    assert files.check_manifest(listed, found).count() == 0
    (tree / "a/x.txt").write_bytes(b"ONE")
    (tree / "top.txt").unlink()
    (tree / "new.txt").write_bytes(b"n")
    again = files.scan(spark, str(tree), tolerant=True)
    assert sorted(map(tuple, files.check_manifest(listed, again).collect())) == [("a/x.txt", "digest"), ("new.txt", "unlisted"), ("top.txt", "missing")]
    assert files.as_json(files.manifest(again)).first()["value"].startswith("{")


def test_catalog(spark, tmp_path):
    spark.createDataFrame([(1, "abcdef" * 10), (2, "abcdef" * 5)], "doc_id long, text string").createOrReplaceTempView("documents")
    p = spark.sql(chunks.pieces(SPARK, 6)).withColumn("h", F.sha2("hx", 256))
    unique = p.groupBy("h").agg(F.first("hx").alias("hx"))
    files.write_catalog(unique, p.select("doc_id", "pos", "h"), str(tmp_path / "good"))
    assert unique.count() == 1 and files.verify_catalog(spark, str(tmp_path / "good")).count() == 0
    files.write_catalog(unique.withColumn("hx", F.lit("00")), p.select("doc_id", "pos", "h"), str(tmp_path / "bad"))
    assert {r["error"] for r in files.verify_catalog(spark, str(tmp_path / "bad")).collect()} == {"damaged chunk"}
    files.write_catalog(unique.limit(0), p.select("doc_id", "pos", "h"), str(tmp_path / "gone"))
    assert {r["error"] for r in files.verify_catalog(spark, str(tmp_path / "gone")).collect()} == {"missing chunk"}


def test_stream(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    for i in range(3):
        spark.createDataFrame([(i, "same text", None), (10 + i, f"own {i}", None)], schema).withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = dedup.new_chunks(stream).writeStream.format("memory").queryName("fresh_chunks").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh_chunks").count() == 4
    q = dedup.windowed_volume(stream).writeStream.format("memory").queryName("volume").option("checkpointLocation", f"{tmp_path}/ck2").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["files"] for r in spark.table("volume").collect()) == 6

"""File trees as DataFrames, manifests, and report sinks.

Listings come from Spark's binary file source, so any store that Spark reads will do; they carry a full order by name, never the
order in which a folder happens to be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("work", ".git", "target")


def scan(spark: SparkSession, folder: str, *, skip: tuple[str, ...] = SKIPPED, tolerant: bool = False, glob: str | None = None) -> DataFrame:
    """name (relative, with /), class (first folder), length, content of every file below a folder, whatever its depth.

    Files under a folder of a skipped name are left out. Spark's source
    lists no empty files. A tolerant scan passes over unreadable and missing files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    root = "/" + folder.split("://")[-1].strip("/") + "/"
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    name = F.expr(f"substr(regexp_replace(path, '^[a-z]+:/*', '/'), {len(root) + 1})") if root != "//" else plain
    files = reader.load(folder).select(name.alias("name"), "length", "content")
    for s in skip:
        files = files.where(~F.concat(F.lit("/"), "name").contains(f"/{s}/"))
    return files.withColumn("class", F.when(F.col("name").contains("/"), F.split_part("name", F.lit("/"), F.lit(1))).otherwise(""))


def first_by_name(files: DataFrame) -> DataFrame:
    """One file for each base name: the first by full name. Pre-aggregated, then joined on the full name."""
    base = F.regexp_extract("name", "[^/]+$", 0)
    first = files.groupBy(base.alias("base")).agg(F.min("name").alias("name"))
    return files.join(first.select("name"), "name")


def as_documents(files: DataFrame) -> DataFrame:
    """doc_id by name order, text: the form that the operators take; bytes that are no UTF-8 are replaced."""
    from pyspark.sql import Window

    w = Window.partitionBy("class").orderBy("name")
    ranked = files.withColumn("rank", F.row_number().over(w))
    sizes = files.groupBy("class").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(sizes, "class").select((F.col("before") + F.col("rank") - 1).alias("doc_id"), F.expr("decode(content, 'UTF-8')").alias("text"), F.col("class").alias("source"), "name")


def manifest(files: DataFrame) -> DataFrame:
    """class, rel, bytes, sha256."""
    return files.select("class", F.col("name").alias("rel"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated manifest with a header; a row of other than four fields, or a size that is no number, is an error."""
    return spark.read.schema("class string, rel string, bytes long, sha256 string").option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)


def check_manifest(listed: DataFrame, files: DataFrame) -> DataFrame:
    """rel and what is wrong: missing, unlisted, size, digest; no rows if all is well."""
    found = manifest(files)
    both = listed.alias("l").join(found.alias("f"), "rel", "full_outer")
    wrong = F.when(F.col("f.bytes").isNull(), "missing").when(F.col("l.bytes").isNull(), "unlisted").when(F.col("l.bytes") != F.col("f.bytes"), "size").when(F.col("l.sha256") != F.col("f.sha256"), "digest")
    return both.select("rel", wrong.alias("wrong")).where("wrong IS NOT NULL")


def write_tsv(df: DataFrame, path: str) -> None:
    """A report of few rows as one tab-separated file with a header."""
    df.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_catalog(chunks: DataFrame, refs: DataFrame, path: str) -> None:
    """A catalog of unique chunks (h, hx) and references (doc_id, pos, h) as Parquet."""
    chunks.write.parquet(f"{path}/chunks")
    refs.write.parquet(f"{path}/refs")


def verify_catalog(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, error: files with a reference to a missing chunk, or to one whose bytes have another digest."""
    chunks = spark.read.parquet(f"{path}/chunks").withColumn("good", F.sha2("hx", 256) == F.col("h"))
    refs = spark.read.parquet(f"{path}/refs").join(chunks.select("h", "good"), "h", "left")
    error = F.when(F.sum(F.col("good").isNull().cast("int")) > 0, "missing chunk").when(F.sum((~F.col("good")).cast("int")) > 0, "damaged chunk")
    return refs.groupBy("doc_id").agg(error.alias("error")).where("error IS NOT NULL")

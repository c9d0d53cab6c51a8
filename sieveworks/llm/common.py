"""What the operators of this subpackage share: tables, shared folder, column names."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sieveworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, *, few: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once.

    few: the table is far smaller than the corpus, so its last stage takes at most four tasks for each core."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing reads any more."""
    for df in tables:
        if folder := df.__dict__.get("_folder"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def give_back() -> None:
    """Memory that the allocators hold and nothing uses goes back to the system: idle workers stand beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


#: Rows of a batch of texts that stands in memory at once, in the executor and in its Python worker.
BATCH_ROWS = 1000


def mapped(df: DataFrame, run: Callable, schema, *, texts: bool = True) -> DataFrame:
    """df.mapInArrow(run, schema), with this package sent to the executors once, wherever they run.

    texts: rows may be long, so batches are of BATCH_ROWS rows, unless the session says how many."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if texts and df.sparkSession.conf.get(rows, None) is None:
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp(prefix='sieveworks-code-')}/{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidied, schema)


def fresh(name: str, taken: list[str]) -> str:
    """name, lengthened until no column of that name exists (names compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; no other letter changes; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def split_words(text: Column, delimiters: str) -> Column:
    """The pieces of text between runs of the delimiter class; never an empty piece."""
    return F.filter(F.split(text, delimiters), lambda w: w != "")

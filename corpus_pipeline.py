"""The corpus pipeline: stages over documents, each an operator of the training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveworks.llm import language, mixing, neardup, packing, toxicity
from sieveworks.llm.common import fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic score stays below the limit; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out, score, _ = toxicity.score(docs, model)
    return out.where(F.col(score) < toxicity.REJECT).select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents most of whose words are of one known language; texts without words go."""
    out, lang, score, _ = language.label(docs, language.train(docs))
    return out.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= language.REJECT)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one of the least id.

    Different texts are different documents also where ids are null or repeat; such rows come before those of plain ids. Of
    equal rows with words one stays; texts without words (null, empty, white space) have no duplicates, and all stay."""
    key, nth = fresh("key", docs.columns), fresh("nth", docs.columns)
    rows, plain = neardup.keyed(docs, key)
    if not plain:
        rows = written(rows, "keyed")
    groups = neardup.near_duplicates(rows, k=5, similarity=0.8, ident=key)
    gone = written(groups.where("id <> component").select(F.col("id").alias(key)).distinct(), "gone", few=True)
    if not plain:
        words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        w = Window.partitionBy(key).orderBy(*[F.col(c).cast("string") for c in docs.columns])
        once = rows.where(words).withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)
        rows = once.unionByName(rows.where(~words))
    few = gone.count() <= neardup.BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources; some twice, some not at all."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with sequence and offset."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: Trained fields and the choice of draws are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None

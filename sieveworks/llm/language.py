"""Language of every word, and of documents, from a linear-chain conditional random field.

Labels are the languages of the training documents. A word's features are its affixes, its
character n-grams and the word itself (the lexicon); the learned transitions favour staying in
a language, so code-switched text is labelled run by run by forward-backward.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, fresh, mapped, table
from .crf import BIAS, Crf, Scorer, Vocabulary, fit, numbered

WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Fixed bounds of the training sample: documents of each language, least hash of the id first, and their code points.
TRAIN_DOCUMENTS, TRAIN_CHARS = 300, 4_000_000
UNKNOWN = "und"
#: A document whose best language covers less of its words than this has no language.
REJECT = 0.5


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    words = WORD.findall(low := text.lower()) if text else []
    # number forms that are neither digits nor letters, such as ½ and ², are rare: only then the slower cut
    return words if not words or "".join(words).isalpha() else LETTERS.findall(low)


def forms(word: str) -> Iterable[str]:
    """Features: the word, affixes of one to three letters, character trigrams of the marked word."""
    yield BIAS
    yield word
    w = f"<{word}>"
    for n in (2, 3, 4):
        yield f"{w[:n]}~"
        yield f"~{w[-n:]}"
    for i in range(1, len(word) - 1):
        yield w[i : i + 3]


def learn(rows: list[tuple[str, str]]) -> Crf:
    """A field from (text, lang) rows; no rows: a model without labels."""
    labels = sorted({lang for _, lang in rows})
    number = {x: i for i, x in enumerate(labels)}
    vocab = Vocabulary()
    texts = [numbered(words_of(t), vocab) for t, _ in rows]
    tags = [np.full(len(w), number[lang], np.int64) for w, (_, lang) in zip(texts, rows, strict=True)]
    return fit(vocab, texts, tags, labels, forms, rounds=20, least=3)


def train(docs: DataFrame, *, most: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS) -> Crf:
    """A model from documents with text and language outside the held-out fold (crc32 of the id modulo 3 is 1).

    Of each language at most `most` documents, by least hash of the id, and those that end within the first `chars` code points of
    these; whole texts. Of rows that repeat an id the least text of a language counts."""
    own = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return learn([])
    # the share of the hash range that holds `most` documents of a language, and some more
    scale = 1 << 30
    bound = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(scale, int(scale * (most + 4 * most**0.5 + 4) / n) + 1))])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    some = own.where(h < bound[F.col("lang")]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy(h, "doc_id")  # over the sample only
    some = some.select("lang", "text", "doc_id", h.alias("place"), F.row_number().over(w).alias("nth"), F.sum(F.length("text")).over(w).alias("end"))
    rows = some.where((F.col("nth") <= most) & (F.col("end") <= chars)).collect()
    rows.sort(key=lambda r: (r["lang"], r["place"], r["doc_id"]))
    return learn([(r["text"], r["lang"]) for r in rows])


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("lang", T.StringType())]))
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))


def label_texts(texts: list[str | None], crf: Crf, scorer: Scorer) -> tuple[list[str], list[float], list[list[dict]]]:
    """Per text the language, the mean probability of that language over the words, and the runs of
    neighbouring words of one language (first word, number of words)."""
    words = [words_of(t) for t in texts]
    ends = np.cumsum([0, *map(len, words)])
    langs, scores, runs = [], [], []
    q = scorer(words) if crf.labels else None
    best = q.argmax(axis=1) if q is not None and len(q) else np.zeros(0, np.int64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if a == b or q is None:
            langs.append(UNKNOWN)
            scores.append(0.0)
            runs.append([])
            continue
        mean = q[a:b].mean(axis=0)
        top = int(mean.argmax())
        langs.append(crf.labels[top])
        scores.append(min(1.0, float(mean[top])))
        own = best[a:b]
        cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [b - a]])
        runs.append([{"start": int(x), "words": int(y - x), "lang": crf.labels[int(own[x])]} for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
    return langs, scores, runs


def label(docs: DataFrame, crf: Crf, *, text: str = "text") -> tuple[DataFrame, str, str, str]:
    """docs with three columns more, and their names: language, score (0 to 1), runs of words of one language.

    Null texts, texts without a letter, and all texts if the model knows no language get `und`, 0 and no
    run. Equal probabilities: the language first in code point order. Every row is kept; columns of docs
    keep their names, ours give way."""
    n = [fresh(x, docs.columns) for x in ("lang_pred", "lang_score", "lang_runs")]
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = Scorer(own)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                langs, scores, runs = label_texts(part.column(text).to_pylist(), own, scorer)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, RUNS_ARROW)], names=[*part.schema.names, *n])

    more = [T.StructField(n[0], T.StringType()), T.StructField(n[1], T.DoubleType()), T.StructField(n[2], RUNS)]
    return mapped(docs, run, T.StructType([*docs.schema.fields, *more])), *n


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the number of runs of one language; a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    out, lang, s, runs = label(docs.select("doc_id", "text"), train(docs))
    return out.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col(lang).alias("lang_pred"),
        F.col(s).alias("score"),
        F.size(runs).cast("long").alias("n_runs"),
    )

"""Toxic spans and document scores from a linear-chain conditional random field.

Labels come by document, so training first makes labelled tokens: within documents labelled
toxic, the words that explain the label. Word forms (whole words and their beginnings) are
picked greedily by how many unexplained toxic documents they cover and how few clean ones they
touch; their occurrences in toxic documents are the tokens labelled toxic, all other words are
labelled clean. The field learns from those tokens; forward-backward marginals of a text's
words give the offending spans and, through a calibrated noisy-or, the document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, fresh, mapped, table
from .crf import BIAS, Crf, Scorer, Vocabulary, fit, in_parts, marginals, numbered

WORD = re.compile(r"[^\W\d_]+")
#: Fixed bounds of the training sample: documents with a label, least hash of the id first, and their code points.
TRAIN_DOCUMENTS, TRAIN_CHARS = 3000, 16_000_000
SPAN = 0.5
REJECT = 0.3


def lowered(text: str) -> str:
    """text in lower case, code point by code point: a letter whose lower case is longer stays, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


def forms(word: str) -> Iterable[str]:
    """A word's features: itself, its beginnings, its endings, its length class."""
    yield BIAS
    yield word
    for n in (4, 5, 6, 7, 8):
        if len(word) > n:
            yield f"{word[:n]}~"
    for n in (4, 5):
        if len(word) > n:
            yield f"~{word[-n:]}"


def evidence(word: str) -> Iterable[str]:
    """What can explain a label: the word, and beginnings that leave at least one letter."""
    yield word
    for n in (4, 5, 6, 7, 8):
        if len(word) > n:
            yield f"{word[:n]}~"


def explain(vocab: Vocabulary, texts: list[np.ndarray], toxic: list[int], *, least: int = 2, purity: float = 0.9) -> set[str]:
    """The word forms that explain the toxic documents; texts are numbers of words of vocab.

    A form qualifies if at least `purity` of the documents that hold it are toxic. The one that
    explains most toxic documents still unexplained is taken (ties: fewer clean documents, then the
    longer form, then the smaller), until none explains `least` more; what then is left unexplained
    stays without labelled tokens. Equal texts count once."""
    names: dict[str, int] = {}
    of = [np.array([names.setdefault(e, len(names)) for e in evidence(w)], np.int32) for w in vocab]
    clean = np.zeros(len(names), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    seen: set[bytes] = set()
    for i, (words, t) in enumerate(zip(texts, toxic, strict=True)):
        if (key := words.tobytes()) in seen:
            continue
        seen.add(key)
        own = np.unique(np.concatenate([of[w] for w in np.unique(words)])) if len(words) else np.zeros(0, np.int32)
        if t:
            held.append((i, own))
        else:
            clean[own] += 1
    count = np.zeros(len(names), np.int64)
    for _, own in held:
        count[own] += 1
    form = list(names)
    able = (count >= least) & (count >= purity * (count + clean))
    pool: dict[str, set[int]] = {}
    for i, own in held:
        for e in own[able[own]].tolist():
            pool.setdefault(form[e], set()).add(i)
    # a word as pure as those, in many toxic documents and in no clean one, is offending too
    taken = {form[e] for e in np.flatnonzero((clean == 0) & (count >= max(3, 0.02 * sum(toxic)))).tolist()}
    while pool:
        best = min(pool, key=lambda e: (clean[names[e]] - len(pool[e]), clean[names[e]], -len(e), e))
        covered = set(pool[best])
        taken.add(best)
        pool = {e: rest for e, d in pool.items() if len(rest := d - covered) >= least}
    return taken


@dataclass
class Model:
    crf: Crf
    slope: float
    offset: float


def odds(q: np.ndarray) -> float:
    """Log odds of the noisy-or of toxic marginals; the least value for no words."""
    if not len(q):
        return -12.0
    none = float(np.log1p(-np.minimum(q, 1 - 1e-9)).sum())
    return min(12.0, max(-12.0, math.log(max(-math.expm1(none), 1e-9)) - none))


def learn(rows: list[tuple[str | None, int]]) -> Model:
    """A model from (text, toxic) rows. No rows of one of the labels: every score is the share of toxic rows."""
    vocab = Vocabulary()
    texts, y = [numbered(words_of(t), vocab) for t, _ in rows], [int(v) for _, v in rows]
    share = (sum(y) + 0.5) / (len(y) + 1) if y else 0.0
    if not any(y) or all(y):
        crf = fit(Vocabulary(), [], [], ["clean", "toxic"], forms)
        return Model(crf, 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    marks = explain(vocab, texts, y)
    bad = np.array([any(e in marks for e in evidence(w)) for w in vocab], np.int64)
    # the field learns from every toxic document and as many clean ones, spread evenly over the clean rows
    bads, goods = [i for i, t in enumerate(y) if t], [i for i, t in enumerate(y) if not t]
    use = bads + goods[:: max(1, len(goods) // len(bads))]
    tags = [bad[texts[i]] * y[i] for i in use]
    crf = fit(vocab, [texts[i] for i in use], tags, ["clean", "toxic"], forms, rounds=20)
    emit = crf.emissions(list(vocab))
    x = np.full(len(texts), odds(np.zeros(0)))
    for part in filter(None, in_parts(texts, 100_000)):
        lens = [len(texts[i]) for i in part]
        q = marginals(emit[np.concatenate([texts[i] for i in part])], lens, crf.trans, crf.start)[:, 1]
        x[part] = [odds(own) for own in np.split(q, np.cumsum(lens)[:-1])]
    slope, offset = _logistic(x, np.array(y, float))
    return Model(crf, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset by damped Newton steps, with a normal prior of variance 1 about (1, 0)."""
    w = np.array([1.0, 0.0])
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + (w - [1.0, 0.0])
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, float(np.abs(step).max()) / 0.5)
    return max(float(w[0]), 1e-3), float(w[1])


def train(docs: DataFrame, labels: DataFrame, *, most: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS) -> Model:
    """A model from labelled documents outside the held-out fold (crc32 of the id modulo 4 is 2).

    At most `most` of them, by least hash of the id, and those that end within the first `chars` code points of these; whole texts.
    Of rows that repeat an id the least text counts. Rows without a label or an id teach nothing."""
    marked = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), 4) != 2))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over the sample only
    some = some.withColumn("end", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(order)).where(F.col("end") <= chars)
    rows = sorted(some.select("doc_id", "text", "toxic").collect(), key=lambda r: r["doc_id"])
    return learn([(r["text"], int(r["toxic"] > 0)) for r in rows])


def score_texts(texts: list[str | None], model: Model, scorer: Scorer) -> tuple[list[float], list[list[dict]]]:
    words = [words_of(t) for t in texts]
    q = scorer(words)[:, 1]
    ends = np.cumsum([0, *map(len, words)])
    scores, spans = [], []
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        own = q[a:b]
        scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * odds(own) + model.offset)))))
        hits = np.flatnonzero(own >= SPAN)
        spans.append(_spans(text, own, set(hits.tolist())) if len(hits) else [])
    return scores, spans


def _spans(text: str, q: np.ndarray, hits: set[int]) -> list[dict]:
    """Offsets in code points of the text; neighbouring toxic words make one span."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(WORD.finditer(lowered(text))):
        if i in hits:
            if i == last + 1:
                out[-1] |= {"end": m.end(), "score": max(out[-1]["score"], float(q[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(q[i])})
            last = i
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model, *, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two columns more, and their names: the toxic score (0 to 1) and the offending spans.

    Null and empty texts, and texts without a letter, get the score of a text without toxic words
    and no span. Every row is kept, repeated rows too; columns of docs keep their names, ours give way."""
    s, p = fresh("toxic_score", docs.columns), fresh("toxic_spans", docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.crf)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                scores, spans = score_texts(part.column(text).to_pylist(), m, scorer)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(spans, SPANS_ARROW)], names=[*part.schema.names, s, p])

    schema = T.StructType([*docs.schema.fields, T.StructField(s, T.DoubleType()), T.StructField(p, SPANS)])
    return mapped(docs, run, schema), s, p


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.3 or more), spans; a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out, s, p = score(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col(s).alias("score"),
        (F.col(s) >= REJECT).cast("int").alias("predicted"),
        F.col(p).alias("spans"),
    )

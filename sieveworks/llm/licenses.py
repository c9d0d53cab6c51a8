"""License scans by diagonal voting, all in DataFrame and SQL functions.

Every rolling word k-gram of a text meets the same k-gram of a template in a join on its hash.
A hit at word `pos` of the text and word `tpos` of the template votes for the diagonal
pos - tpos. Votes are summed by diagonal; diagonals with enough votes that lie close together
are merged (an inserted or dropped word shifts the diagonal by one); a merged span is verified by
comparing words, not hashes, and by the share of the template's k-grams it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, ascii_lower, split_words, table

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: A span holds its template if it has this share of its k-grams.
COVER = 0.8
#: Diagonals at most so many words apart are one span.
GAP = 3

# fixed values: phrases of the base, with their labels; each place counts where all words stand in a row
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: notices that the method knows, with their labels
NOTICES = {
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under the creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work has been dedicated to the public domain": "public-domain",
}
LIMIT_TEMPLATES = 100_000


def gram_rows(base: dict[str, str], notices: dict[str, str]) -> list[tuple[int, bool, str, int, int, str, str]]:
    """(template, of the base, label, number of k-grams, position, first word, second word) of every template k-gram."""
    out = []
    for t, (text, label) in enumerate([*base.items(), *notices.items()]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        out += [(t, t < len(base), label, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    if len(out) > LIMIT_TEMPLATES:
        raise ValueError("more template k-grams than are broadcast")
    return out


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), DELIMITERS)


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each row of docs: the kept columns, n_words, and spans.

    spans: array of (template, base, label, start, cover), sorted; start counts words from 0. Of the base only
    full matches count, each place once; of the notices every merged span that covers enough. Null and empty
    texts have no words and no spans; repeated rows give repeated results; ties are all kept. The templates'
    k-grams are a fixed table below LIMIT_TEMPLATES rows, so they are broadcast."""
    spark = docs.sparkSession
    schema = "t int, is_base boolean, label string, grams int, tpos int, ta string, tb string"
    grams = spark.createDataFrame(gram_rows(base, notices), schema).withColumn("h", F.xxhash64("ta", "tb"))
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    words = docs.select(kept, F.monotonically_increasing_id().alias("rid"), words_of(F.col(text)).alias("words"))
    # a first element without hash stands for the row itself, so that rows without hits stay
    pairs = F.expr(
        "transform(sequence(0, greatest(size(words) - 1, 0)), i -> named_struct("
        "'pos', i - 1, 'a', if(i = 0, null, words[i - 1]), 'b', if(i = 0, null, words[i]), 'n', size(words)))"
    )
    rows = words.select("kept", "rid", F.explode(pairs).alias("g"))
    rows = rows.select("kept", "rid", "g.*").withColumn("h", F.when(F.col("pos") >= 0, F.xxhash64("a", "b")))
    hits = rows.join(F.broadcast(grams), "h", "left").where((F.col("pos") < 0) | (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
    # rows of a text meet once; what follows needs no other exchange
    hits = hits.select("kept", "rid", "n", "t", "is_base", "label", "grams", "tpos", "pos").repartition("rid")
    votes = hits.groupBy("rid", "t", "is_base", "label", "grams", F.when(F.col("pos") >= 0, F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("low"), F.collect_set("tpos").alias("at"), F.max("kept").alias("kept"), F.max("n").alias("n")
    )
    spans = votes.groupBy("rid").agg(
        F.max("kept").alias("kept"),
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("t").isNotNull() & (F.col("is_base") & (F.col("votes") == F.col("grams")) | ~F.col("is_base") & (F.col("votes") >= F.least(F.lit(2), F.col("grams")))), F.struct("t", "diagonal", "is_base", "label", "grams", "low", "at")))).alias("d"),
    )
    merged = F.expr(
        f"""aggregate(d, cast(array() as array<struct<t:int,diagonal:int,is_base:boolean,label:string,grams:int,low:int,at:array<int>>>),
        (acc, x) -> if(size(acc) > 0 and not x.is_base and acc[size(acc) - 1].t = x.t and x.diagonal - acc[size(acc) - 1].diagonal <= {GAP},
          concat(slice(acc, 1, size(acc) - 1), array(named_struct('t', x.t, 'diagonal', x.diagonal, 'is_base', x.is_base, 'label', x.label, 'grams', x.grams,
            'low', least(acc[size(acc) - 1].low, x.low), 'at', array_union(acc[size(acc) - 1].at, x.at)))),
          concat(acc, array(x))))"""
    )
    checked = F.expr(
        f"""transform(filter(m, x -> size(x.at) >= {COVER} * x.grams),
        x -> named_struct('template', x.t, 'base', x.is_base, 'label', x.label, 'start', cast(x.low as bigint), 'cover', cast(size(x.at) as double) / x.grams))"""
    )
    return spans.select("kept.*", F.col("n").cast("long").alias("n_words"), merged.alias("m")).select(*keep, "n_words", checked.alias("spans"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the best cover of any span, else 0."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.expr("transform(filter(spans, x -> x.base), x -> x.start)")
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(F.expr("transform(filter(spans, x -> x.base), x -> x.label)")).alias("base_labels"),
        names(F.expr("transform(spans, x -> x.label)")).alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(spans, x -> x.cover)")), F.lit(0.0)).cast(T.DoubleType()).alias("score"),
    )


def oracle_sql(base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> str:
    """The same rows in DuckDB SQL."""
    rows = ", ".join(f"({t}, {str(b).lower()}, '{label}', {n}, {i}, '{x}', '{y}')" for t, b, label, n, i, x, y in gram_rows(base, notices))
    return f"""
WITH g(t, is_base, label, grams, tpos, ta, tb) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{DELIMITERS}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, unnest(list_zip(w[:-2], w[2:], range(len(w) - 1))) AS z FROM d WHERE len(w) > 1),
hit AS (SELECT rid, t, is_base, label, grams, tpos, z[3] AS pos, z[3] - tpos AS diagonal FROM p JOIN g ON z[1] = ta AND z[2] = tb),
votes AS (SELECT rid, t, is_base, label, grams, diagonal, count(*) AS n, min(pos) AS low, list(DISTINCT tpos) AS ats FROM hit GROUP BY ALL),
good AS (SELECT * FROM votes WHERE CASE WHEN is_base THEN n = grams ELSE n >= least(2, grams) END),
step AS (SELECT *, CASE WHEN NOT is_base AND diagonal - lag(diagonal) OVER (PARTITION BY rid, t ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM good),
part AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, t ORDER BY diagonal) AS grp FROM step),
span AS (SELECT rid, t, is_base, label, grams, min(low) AS low, len(list_distinct(flatten(list(ats)))) AS covered FROM part GROUP BY rid, t, is_base, label, grams, grp),
ok AS (SELECT * FROM span WHERE covered >= {COVER} * grams),
a AS (SELECT rid, count(*) FILTER (is_base) AS n_base, min(low) FILTER (is_base) AS first_word, max(low) FILTER (is_base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
  max(covered::DOUBLE / grams) AS score FROM ok GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (rid)
"""

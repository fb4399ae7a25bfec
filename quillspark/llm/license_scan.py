"""License scan by diagonal voting.

Every rolling word k-gram of every document is joined by hash, in Spark, to the k-grams of
the license templates.  A hit at word p of a document and word t of a template votes for the
diagonal p - t; hits are aggregated by document, template and diagonal.  Neighbouring
diagonals, at most SLACK apart and close in the document, are one span with words inserted
or left out.  A span is verified by the template's words that its hits cover: at least
LEAST_COVERED of them, in not much more room than the template takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .tables import corpus, load

GRAM, SLACK, LEAST_COVERED = 3, 3, 0.75
BROADCAST_ROWS = 200_000
#: (license, notice or opening words of its text)
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_GRAMS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())])


def template_grams(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int, str, int]]:
    """(hash, word, template, license, words of the template) of every template k-gram."""
    w = K.words(pa.array([t for _, t in templates], pa.string()))
    g, off = K.grams(w, k)
    return [(int(h), p, t, templates[t][0], int(w.counts[t])) for t in range(len(templates)) for p, h in enumerate(g[off[t] : off[t + 1]].view(np.int64))]


def _roll(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch):
                g, off = K.grams(K.words(c.column("text")), k)
                n = np.diff(off)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c.column("doc_id").to_numpy(zero_copy_only=False), n)), pa.array(K.ranges(np.zeros(len(n), np.int64), n), pa.int32()), pa.array(g.view(np.int64))], schema=_GRAMS)

    return run


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = GRAM, slack: int = SLACK, least: float = LEAST_COVERED) -> DataFrame:
    """A row for each place where a document has a license template.

    doc_id, license, template (its number), start_word and end_word (exclusive) in the document,
    covered: the share of the template's words found.  docs has doc_id and text; other columns
    are ignored.  Null and empty texts and those of fewer than k words have no spans, nor have
    templates of fewer than k words.  Rows without a doc_id are left out; rows that repeat a
    doc_id and its text give the spans once.  Templates that share words may give overlapping
    spans.  An empty table gives none.
    """
    spark, docs = docs.sparkSession, corpus(docs)
    rows = template_grams(TEMPLATES if templates is None else templates, k)
    known = spark.createDataFrame(rows, "h long, at int, template int, license string, size int")
    hits = docs.mapInArrow(_roll(k), "doc_id long, pos int, h long").join(F.broadcast(known) if len(rows) <= BROADCAST_ROWS else known, "h")
    lines = hits.groupBy("doc_id", "template", "license", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("at"))
    by = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    before = lambda c: F.lag(c).over(by)
    apart = (F.col("diagonal") - before("diagonal") > slack) | (F.col("lo") > before("hi") + k + slack) | (F.col("hi") < before("lo") - k - slack)
    spans = lines.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("at")), lambda t: F.sequence(t, t + k - 1))))
    return (
        spans.groupBy("doc_id", "template", "license", "size", "span")
        .agg(F.min("lo").cast("long").alias("start_word"), (F.max("hi") + k).cast("long").alias("end_word"), F.size(words).alias("n"))
        .filter((F.col("n") >= least * F.col("size")) & (F.col("end_word") - F.col("start_word") <= 1.5 * F.col("size") + slack))
        .select("doc_id", "license", F.col("template").cast("long").alias("template"), "start_word", "end_word", (F.col("n") / F.col("size")).alias("covered"))
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(load(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
SQL = rf"""
WITH t AS (SELECT template, license, regexp_extract_all(lower(text), '{K.WORD_SQL}') AS w FROM (VALUES {_VALUES}) AS v(template, license, text)),
tg AS (SELECT template, license, len(w) AS size, i - 1 AS a, array_to_string(w[i:i + 2], ' ') AS g FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_SQL}') AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
l AS (SELECT doc_id, template, license, size, p - a AS diagonal, min(p) AS lo, max(p) AS hi, list(a) AS a FROM dg JOIN tg USING (g) GROUP BY ALL),
b AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > 3 OR lo > lag(hi) OVER w + 6 OR hi < lag(lo) OVER w - 6, true) AS fresh FROM l WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM b),
c AS (SELECT doc_id, template, license, size, min(lo) AS start_word, max(hi) + 3 AS end_word,
             len(list_distinct(flatten(list_transform(flatten(list(a)), lambda x: [x, x + 1, x + 2])))) AS n FROM s GROUP BY doc_id, template, license, size, span)
SELECT doc_id, license, template::BIGINT AS template, start_word::BIGINT AS start_word, end_word::BIGINT AS end_word, n / size::DOUBLE AS covered
FROM c WHERE n >= 0.75 * size AND end_word - start_word <= 1.5 * size + 3
"""
QUERIES = {"op2_license_scan": (op2_license_scan, SQL)}

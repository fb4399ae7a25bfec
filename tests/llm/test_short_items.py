"""Benchmark items of fewer than k words, and items without an id."""

import corpus_pipeline
from quillspark.llm import decontamination

DOCS = [(1, "well, The Answer: is 42 of course"), (2, "the answer was given"), (3, "Paris"), (4, "in paris and Paris again"), (5, None), (6, "one two three four five six seven"), (7, "")]
ITEMS = [(10, "the answer is 42"), (11, "paris"), (12, "Paris!"), (13, "four five six"), (14, ""), (15, None), (16, "six five"), (17, "one two three four five")]


def test_short_items_are_found(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {tuple(r) for r in decontamination.contained_items(docs, items).collect()}
    assert got == {(d, i, 1, 1, 1.0) for d, i in [(1, 10), (3, 11), (3, 12), (4, 11), (4, 12), (6, 13), (6, 17)]}
    left = decontamination.drop_contaminated(docs, items, short=True)
    assert sorted(r[0] for r in left.collect()) == [2, 5, 7]


def test_items_without_an_id(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(None, "one two three four five")], "item_id long, text string")
    assert sorted(r[0] for r in decontamination.drop_contaminated(docs, items).collect()) == [1, 2, 3, 4, 5, 7]


def test_the_pipeline_searches_short_items(spark, tmp_path):
    spark.createDataFrame([(None, "the answer is 42"), (1, "paris")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.benchmark_leaks(spark, spark.createDataFrame(DOCS, "doc_id long, text string"), str(tmp_path))
    assert sorted(r[0] for r in left.collect()) == [2, 5, 6, 7]

"""The pipeline against plain versions of its stages, on a small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, language_id

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).checkpoint())
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "benchmark_leaks", "tokens"]


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert df.filter("n_chars <> length(text)").isEmpty()


def test_language(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    said = {r["doc_id"] for r in language_id.identify(stages[0], language_id.train(stages[0])).filter("kept").collect()}
    assert kept == said and len(kept) > 0.9 * stages[0].count()


def test_near_duplicates(stages):
    assert pairs(stages[2]) == sorted(brute.keep_one(pairs(stages[1])))


def test_repeated_passages(stages):
    docs = pairs(stages[2])
    gone = brute.copied_words(docs)
    want = []
    for d, x in docs:
        text, left = brute.cut(x, gone[d]) if d in gone else (x, True)
        if left:
            want.append((d, text))
    assert pairs(stages[3]) == sorted(want)


def test_benchmark_leaks(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert pairs(stages[4]) == [(d, x) for d, x in pairs(stages[3]) if not any(brute.holds(x, i) for i in items)]


def test_tokens(stages):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    docs = pairs(stages[4])
    got = {r["doc_id"]: r["ids"] for r in stages[5].collect()}
    assert got == {d: t.encode(x, add_special_tokens=False).ids for d, x in docs}


def test_run_gives_the_last_stages_rows(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0)]])
def test_odd_tables(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, bpe, chat_format, decontamination, language_id, license_scan, ngram_join, quality, substring_dedup, url_filter

LONG = " ".join(f"w{i * 7919 % 65537}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [(1, None), (2, ""), (3, "   \n"), (4, LONG), (5, LONG + " end"), (6, "Released under the MIT License."), (6, "Released under the MIT License."), (None, "a b c d e f g"), (7, "one"), (8, "one"), (9, PASSAGE + " x"), (10, "y " + PASSAGE), (11, "\x00é🙂 日本語")]
EXTRA = ["h", "token", "unit", "bucket", "pos", "gid", "lang", "n", "__gone", "quality", "rows"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(i).cast("string").alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def model():
    return language_id.fit(["the cat and the dog are in the house"] * 9 + ["der hund und die katze sind in dem haus"] * 9, ["en"] * 9 + ["de"] * 9, epochs=1)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, PASSAGE), (4, "a b")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontamination.contained_items(docs, items)
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in got.collect()) == [(9, 1, 56), (10, 1, 56)]
    assert decontamination.contained_items(empty, items).count() == decontamination.contained_items(docs, items.limit(0)).count() == 0
    left = decontamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 2


def test_license(docs, empty):
    got = license_scan.license_spans(docs).collect()
    assert [(r["doc_id"], r["license"], r["start_word"], r["end_word"]) for r in got] == [(6, "MIT", 0, 5)]
    assert license_scan.license_spans(empty).count() == 0
    assert license_scan.license_spans(docs, templates=[("x", "a b")]).count() == 0


def test_language(docs, empty, model):
    got = {(r["doc_id"], r["language"], r["kept"]) for r in language_id.identify(docs, model).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False)} <= got and len(got) == 11
    assert language_id.identify(empty, model).count() == 0
    left = language_id.drop_unknown(docs, model)
    assert left.columns == docs.columns and not {1, 2, 3} & set(r[0] for r in left.collect())
    assert language_id.drop_unknown(empty, model).count() == 0


def test_language_without_labels(empty):
    nothing = language_id.train(empty)
    assert nothing.labels == [language_id.OTHER]


def test_bpe(docs, empty):
    got = bpe.encode(docs).collect()
    assert len(got) == len(ROWS) - 1 and all(r["exact"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["ids"] is None and by[2]["ids"] == [] and by[1]["n_tokens"] == 0
    assert bpe.encode(empty).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[4] == LONG and back[1] is None and back[11] == ROWS[-1][1]


def test_ngram_join(docs, empty):
    got = {(r["doc_id"], r["class_id"]) for r in ngram_join.linked(docs).collect()}
    assert got == {(4, 4), (5, 4), (7, 7), (8, 7), (9, 9), (10, 9)}
    assert ngram_join.linked(empty).count() == 0
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r[0] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 6, 7, 9, 11]
    assert ngram_join.keep_one(empty).count() == 0


def test_substring(docs, empty):
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["is_copy"]) for r in substring_dedup.repeated_spans(docs).collect()}
    assert {(9, 0, 60, False), (10, 1, 61, True), (4, 0, 60_000, False), (5, 0, 60_000, True)} <= got
    assert substring_dedup.repeated_spans(empty).count() == 0
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_copies(docs).collect()}
    assert left[10] == "y " and left[5] == "end" and left[9] == PASSAGE + " x" and left[1] is None
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(docs, 7)


def test_one_word_over_and_over(spark):
    df = spark.createDataFrame([(1, "ha " * 200)], "doc_id long, text string")
    assert substring_dedup.remove_copies(df).first()["text"].split() == ["ha"]


def test_url_filter(spark):
    rows = [(1, "http://casino.example.com/win", "<p>win big</p>"), (1, "http://casino.example.com/win", None), (2, None, None), (3, "", ""), (4, "not a url", "x"), (5, "HTTP://u:p@Good.Example.com:80/" + "a" * 5000, "<b>good</b>" * 9), (None, "http://x.y", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("run", F.lit(1)).withColumn("words", F.lit(1))
    got = url_filter.score_urls(df).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4, 5]
    by = {r["page_id"]: r for r in got}
    assert not by[1]["kept"] and by[5]["host"] == "good.example.com" and by[2]["words"] == []
    assert url_filter.score_urls(df.limit(0)).count() == 0
    clean = url_filter.score_urls(df.filter("page_id > 1")).collect()
    assert all(r["kept"] and r["log_odds"] is None for r in clean)


def test_chat(spark):
    rows = [(1, 0, "user", "hi?"), (1, 1, None, "yes"), (1, 1, None, "yes"), (2, None, None, None), (3, 0, "assistant", ""), (4, 0, None, "User: a?\nb\n\nAssistant: c\r\nd<|im_end|>"), (None, 0, "user", "x"), (5, 0, "user", "line\n" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    by = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert by[1]["n_turns"] == 3 and by[1]["roles"][0] == "user"
    assert by[2]["n_turns"] == 0 == by[3]["n_turns"] and by[2]["text"] == ""
    assert by[4]["text"] == "<|user|>\na?\nb\n<|end|>\n<|assistant|>\nc\nd\n<|end|>"
    assert set(by) == {1, 2, 3, 4, 5} and by[5]["text"].count("line") == 5000
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (6, 0, 1), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    vectors = quality.word_vectors(docs)
    net = quality.train(docs, labels, vectors)
    by = {r["doc_id"]: r for r in quality.classify(docs, net, vectors).collect()}
    assert len(by) == 11 and not by[1]["kept"] and by[3]["p_quality"] == 0
    assert quality.classify(empty, net, vectors).count() == 0
    for none in (quality.train(empty, labels, quality.word_vectors(empty)), quality.train(docs, labels.limit(0), vectors)):
        assert quality.classify(empty, none, vectors).count() == 0
        by = {r["doc_id"]: r for r in quality.classify(docs, none, vectors).collect()}
        assert by[4]["kept"] and by[4]["p_quality"] is None and not by[2]["kept"] and by[2]["p_quality"] == 0


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (11, [2.0, 0.0, 1.0]), (12, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("floor", F.lit("x"))
    got = {(r["vec_id"], r["rank"]): (r["neighbour_id"], r["score"]) for r in ann.neighbours(df).collect()}
    assert got == {(1, 1): (2, 1.0), (1, 2): (3, 0.0), (2, 1): (1, 1.0), (2, 2): (3, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0), (11, 1): (12, 3.0), (12, 1): (11, 3.0)}
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id = 1")).count() == 0

"""A corpus pipeline of five operators: language, near duplicates, copied passages, benchmark leaks, tokens.

Every stage takes an empty table and gives an empty one, ignores further columns, whatever
their names, and, but for the last, returns all columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, decontamination, language_id, ngram_join, substring_dedup
from quillspark.llm.exchange import cut
from quillspark.llm.tables import load


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no identified language go, among them null, empty and blank texts; repeated rows all stay or all go."""
    return language_id.drop_unknown(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the lowest doc_id stays, with all rows that repeat it; rows without a doc_id and null or empty texts stay."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay at their first place only, by (doc_id, word); rows that repeat a doc_id and its text are one document, and null, empty and shorter texts stay as they are."""
    return substring_dedup.remove_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, judged row by row; null and empty texts hold none, and null or empty items are in none."""
    return decontamination.drop_contaminated(docs, load(spark, sf_dir, "benchmark"), short=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left: doc_id, ids, n_tokens, exact; null text has null ids, repeated rows give repeated results, and rows without a doc_id are left out."""
    return bpe.encode(docs)


STAGES = [("language_id", identify), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]
#: The conditional random field and the byte-pair encoding can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each leaves is written to the shared checkpoint folder for the next."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

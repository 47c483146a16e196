"""A corpus pipeline: quality, toxicity, exact and near duplicates, packing.

Each stage takes all that its predecessor kept, as a Parquet table, and all but the last
return the columns of documents, whatever other columns there are and whatever they are
called. In every stage a null text counts as empty, texts are read whole however long they
are, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import exact_dedup, near_copies, packing, rule_quality, toxicity
from tamis.llm._shared import discard, table, text_or_empty, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject.

    A score depends on the text alone: a row with nulls in other columns is judged like any
    other, rows alike in their texts stay or go together, an empty text has the score of
    statistics that are all 0. Without labels of both classes all scores are the same.
    """
    model = rule_quality.fit(docs, table(spark, sf_dir, "labels"))
    return rule_quality.scored(docs, model).where("score >= 0.3").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    As in the stage before, only the text counts. An empty text has the score of the
    intercept, which is low where most labelled documents are clean; with no label that was
    learned from toxic, every document stays.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.score(text_or_empty()) < 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are equal without white space.

    The longest original stays, of ties the one with the smallest id; a null id ranks last.
    All empty and null texts are one class. Of rows alike in id and text one stays.
    """
    return exact_dedup.distinct_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity of 0.8 or more.

    Candidates are sets that the SimHash operator's index puts in one component, and, since most
    near copies differ in more bits than its radius, those that share a band of min-hashes;
    all are compared exactly.

    The smallest id of a group stays; a null id only where there is no other, and of rows
    alike in id and text one. Texts without words are one group, apart from all others.
    """
    return near_copies.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens.

    A null or empty text still has its end id. Repeated rows are packed as often as they
    occur, rows with a null id too.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: Its stages are learned models, components and a packing order, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

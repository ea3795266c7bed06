"""A training corpus in five stages, each a whole-table operator of colpattern.llm.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame;
the next one reads it back from Parquet. All but the last return the columns of documents.

Defined results, for every stage: columns beyond those of documents are carried through, whatever
their names; rows with a null doc_id and further texts under one id are never dropped as copies;
an empty table gives an empty result of the same columns. What else a stage does with null, empty
and very long texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colpattern.llm import curriculum, langid, omh, packing, substring
from colpattern.llm.common import fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go, and so do texts that are null, empty or
    without letters. Long texts are read whole; of tied languages the first in order wins; repeated
    rows are decided alike; where no row has a lang, there is nothing to tell by and all go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Null and empty texts
    are no one's copies and stay; rows that share doc_id and text are one; long texts are aligned whole."""
    return omh.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in a document with a smaller doc_id; the first copy stays.
    A document of which nothing is left goes; null and short texts stay as they are; rows that share
    doc_id and text are one; repeats within one document stay."""
    return substring.drop_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; sources that are asked for more than they have stand again. A null
    source is a source; null and empty texts have no words and stand where the next one does; ties in
    position are ordered by (doc_id, epoch); repeated rows are all placed."""
    return curriculum.in_order(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packs, which follow the order of docs. A long
    text is as many pieces as it takes, a null or empty one an end mark; repeated rows are all packed."""
    return packing.pack(docs, order=packing.stored_order(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packs", packs)]

#: None: n-gram filters, sketches with alignment and least squares are beyond SQL; the stages
#: are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)

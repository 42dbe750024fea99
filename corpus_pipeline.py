"""From raw documents to pieces for training: five stages, each on what the one before has kept.

A stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents``; ``run`` writes what a stage returns to the shared folder and reads
it again, so a lost executor costs a stage at most.

Every stage takes nulls in any column, repeated rows and an empty table, which
gives an empty one; columns beside those that it reads are passed on as they are.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from chartfold.llm import jaccard, linecrf, mixing, piece_nbest, qda
from chartfold.llm.queries import PIECE_MODEL, table
from chartfold.sources.scratch import stored


#: bytes of text that go to a Python worker at once; a number of rows says little about their size
BATCH_BYTES = 4 << 20


def in_small_batches(stage):
    """Sets the size of the session's Arrow batches, so that a worker's memory does not depend on how long texts are."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and are mostly content, line by line.

    Null and empty texts have no words and go; copies stay or go together.
    """
    return linecrf.keep_good(docs, linecrf.train(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good ones.

    The stage before has rejected most bad examples, so the classifier learns
    from all labelled documents of the input and judges those that are left.  A
    score of exactly 0.5 stays; equal texts score alike.
    """
    model = qda.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return qda.keep_good(docs, model)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more.

    The smallest id stays, of rows that share it the one with the least hash.
    Texts without words, and rows without an id, are linked with nothing and stay.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


@in_small_batches
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a document that is taken more than once is repeated.

    A null source is a source.  Texts without words are never taken; rows of equal
    id, text and source are taken together.
    """
    return mixing.take(docs, mixing.mix(docs))


@in_small_batches
def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text, the best three segmentations, and whether they decode to the text.

    A null or empty text has no pieces.
    """
    return piece_nbest.encode(docs, PIECE_MODEL, n=3)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", source_mixing),
    ("piece encoding", piece_encoding),
]

#: trained models and segmentation are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

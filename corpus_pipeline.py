"""Corpus pipeline over ``documents``: five stages, each on all rows that the one before kept.

1. language ID rejects texts without letters and those of no clear language;
2. line dedup deletes later copies of repeated line runs, and documents of which nothing is left;
3. the n-gram Jaccard join keeps one document of each near-duplicate component, the one of least id;
4. mixing takes each document as often as its fitted rate says (0, 1 or more rows);
5. packing cuts and packs the rest into sequences of at most 1024 tokens, and returns its pieces.

Each stage's output is written as Parquet and read again by the next; tables that a stage made for itself
are removed when the next one of the same run begins. A run begins with its first stage, in a thread of its own or not, and
leaves other runs' tables alone; those of the last stage stay, since its result reads them.
"""

from __future__ import annotations

import functools
import gc
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscope.llm import common, jaccard, langid, line_dedup, mixing, packing
from hopscope.llm.queries import SHARES, domain_labels, vocabulary

#: Documents whose best language is less likely than this are rejected.
LEAST_SCORE = 0.5
#: What the thread's run has made for itself so far.
_RUN = threading.local()


def _stage(f, first: bool = False):
    """Remove what the run's last stage made for itself, or begin a run; note what this stage makes."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if first or not hasattr(_RUN, "made"):
            _RUN.made = []
        common.drop_all(_RUN.made)
        try:
            with common.noting(_RUN.made):
                return f(spark, docs, sf_dir)
        finally:  # what fitting a model took on the driver, and shuffles and broadcasts that no plan refers to
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            common.give_back()

    return run_stage


@functools.partial(_stage, first=True)
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a clear language: null texts, texts without letters and those below ``LEAST_SCORE`` go.

    Learns from all rows with a lang. Repeated rows are judged alike, null ids like others, rows as they are.
    """
    return langid.keep_clear(docs, F.lit(True), LEAST_SCORE)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs, and documents that they made up.

    The first copy in order of doc_id (null ids last, rows of one id in order of reading) stays; of repeated rows
    the first stays whole. n_chars, if there, follows the text. Null and empty texts stay as they are.
    """
    return line_dedup.keep_first_lines(docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near-duplicates, the one of least id; of repeated rows one.

    Rows without words (null, empty) are like no other and stay; a null id counts as greater than others.
    """
    return jaccard.keep_first(docs)


@_stage
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its rate says: 0, 1 or more equal rows.

    Null and empty texts have no tokens and the prior's rate. Without labelled documents all rates are 1.
    """
    out = mixing.mix(docs.select("doc_id", "text", F.struct("*").alias("row")), domain_labels(spark, sf_dir), SHARES, ["row"])
    times = mixing.copies(F.col("rate"), F.col("row.doc_id"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


@_stage
def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their places in sequences of 1024 tokens; null texts are an end alone, each row is packed."""
    return packing.best_two_fit(docs, vocabulary())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_domains),
    ("best-fit packing", pack_documents),
]
#: The trained classifiers can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.cut(docs)
    return docs

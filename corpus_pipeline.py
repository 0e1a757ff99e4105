"""The corpus pipeline: documents through language ID, exact dedup, SimHash near-dedup and best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Language ID drops what its
distance rule rejects, the two dedup stages keep one row of each group, and packing returns a row for each piece
with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from willowfold.llm import exact_dedup, langid, packing, simhash
from willowfold.llm.shared import stash
from willowfold.sources.shared_dir import discard, new_dir, scratch
from willowfold.sources.tables import spread


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(spread(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(spread(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(spread(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("best_fit_packing", pack)]

#: SQL cannot express the classifier, the fingerprints' components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage kept on its way is deleted once its result is written, and a stage's result once the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, name)
        with scratch(spark):
            docs = stash(stage(spark, docs, sf_dir), name, path=path)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

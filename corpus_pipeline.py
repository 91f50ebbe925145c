"""From raw documents to packed training sequences, one operator per stage.

Every stage takes the rows that the one before it kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from assentlake.llm import minhash, packing, quality, toxicity
from assentlake.llm.common import table, vocabulary_path
from assentlake.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity stays below the threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8."""
    judged = staged(minhash.near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct(), "removed")
    # Few ids are sent to the texts; many meet them in a join.
    few = judged.count() <= minhash.SENT_IDS
    return docs.join(F.broadcast(judged) if few else judged, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in sequences of 4096: where each piece lies."""
    return packing.pack(packing.tokenized_pieces(docs, vocabulary_path("word_bpe_49k.json"), with_ids=False))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("packing", packed),
]

#: Learnt models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

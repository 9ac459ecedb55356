"""From raw documents to packed training sequences: five stages over whole tables.

Toxic documents go; of equal texts and of near copies one document stays; sources are mixed to their
target weights, so a document may be dropped or repeated; and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import exact, mixing, near, packing, toxicity
from sievework.llm.common import discard, read, written
from sievework.llm.queries import WORD_BPE


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.without_copies(docs, keep="largest")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five words at 0.8 finds copies with a block replaced; op7's rule, three words at 0.85, finds scattered edits
    return near.without_near_copies(docs, near.SHARE, near.SHINGLE, (80, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors' memory still holds what earlier stages left, so less is kept here
    return packing.pack(docs, WORD_BPE, kept=500_000, step=2 << 20)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("near dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained model and a tokenizer decide; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus; each stage's documents are written to the shared folder and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = written(docs)
            if before:
                discard(spark, before)
            before = path
    return docs

"""A corpus pipeline of five stages over ``documents``: filter, identify, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import langid, minhash, mixing, packing, toxicity
from foliant.llm.common import documents, fold, remove, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't predict toxic; it learns from labels outside the held-out fold."""
    labels = documents(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: with a letter, and near enough to a language's prototype, by that language's texts."""
    learned = docs.where(fold("doc_id", 5) != 0)
    return langid.keep_identified(docs, langid.with_least(learned, langid.learn(learned)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (shingles of five words, similarity 0.8)."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its place in a sequence of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, draw at random and cut bytes; SQL can't express them. tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written to the shared folder and read again, and deleted when
    the next one's is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            remove(spark, before)
        docs = before = out
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""Corpus pipeline: documents to packed training rows.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; run()
writes every stage's result as Parquet in the shared checkpoint folder and reads it back as the
next one's input. All but the last stage return the columns of documents.

Nulls, empty texts, repeated rows, empty tables and extra columns follow the operators'
docstrings: texts without words pass the filters, are in no group of near duplicates, and leave
in the mix, which takes no words of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from livepricing.llm import decontaminate, jaccard, mixing, packing, toxicity
from livepricing.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8."""
    return jaccard.first_of_groups(docs, n=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mix_sources),
    ("token_packing", pack_tokens),
]

#: The nearest-example scores, the seeded mix over their survivors and token ids are beyond SQL;
#: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return scratch.stage(result, f"pipeline_{name}")
        docs = scratch.stage(result, f"pipeline_{name}")

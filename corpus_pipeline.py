"""From raw documents to packed training sequences, in five stages over the operators of ``rooftally.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rooftally.llm import line_dedup, mixing, near_copies, packing, toxicity
from rooftally.llm.common import table
from rooftally.llm.queries import tokenizer_path
from rooftally.workspace import fresh_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the classifier chain rejects."""
    ship_package(spark)
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.drop_toxic(docs, chain)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out of the texts."""
    ship_package(spark)
    return line_dedup.strip_boilerplate(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship_package(spark)
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Even out the sources; every document is taken at least once."""
    ship_package(spark)
    return mixing.mix_documents(docs, most_repeats=mixing.MOST_REPEATS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash", dedup_documents),
                                   ("mixing", mix_sources), ("packing", pack_sequences)]

#: The stages learn a classifier, compare fingerprints and tokenise, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

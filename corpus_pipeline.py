"""A training corpus from `documents`: quality rules, near-duplicates, source mixture, token ids.

Each stage takes the documents that the stage before it kept and returns the columns of documents; the
last returns a digest of each document's token ids. Between stages the rows are written as Parquet to
the shared folder and read again.

Defined results, of every stage: a null text is the empty text (too short, so the first stage rejects it; the
others take it as it comes); a null source is a source of its own for the line rules and belongs to the rest in
the mixture; a null doc_id is kept by all stages, for near duplicates need a name to refer to; rows that are
equal in all get the same verdict, and of rows with one doc_id one stays after near duplicates; texts of any
length are taken whole; an empty table gives no rows; other columns are left out, and a column of COLUMNS that
docs does not have is left out as well, if it is lang or n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import covering_simhash, line_frequency, poisson_mix, prefix_bpe
from rowloom.llm._store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their order."""
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line rules keep, without their boilerplate lines."""
    return own(line_frequency.filtered(own(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents whose sets of five-word shingles are similar to 0.8 or more, directly or through others."""
    return own(covering_simhash.without_similar(own(docs)))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the production weights and dealt over all partitions; a repeated document is a repeated row."""
    return own(poisson_mix.mixed(own(docs)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return prefix_bpe.digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("token_ids", token_ids),
]

#: The second stage's hashes and components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

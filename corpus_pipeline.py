"""Raw documents to training text: quality, near-duplicates, repeated passages, mix, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written before the next one
reads it, so each stage begins by dropping the tables that earlier ones left between their steps.
All but the last keep the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bag_minhash, doubling_windows, host_rules, piece_lattice, source_mix
from riskweave.llm.common import free_name, release, scratch_tables, table
from riskweave.llm.queries import public_tokenizer
from riskweave.session import checkpoint_root


#: Tables that the stage before left between its steps.
LEFT: set[str] = set()


def after_the_last(stage: Callable) -> Callable:
    """A stage that first drops what the stage before, whose result is written, has left."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, LEFT)
        LEFT.clear()
        before = scratch_tables(spark)
        kept = stage(spark, docs, sf_dir)
        LEFT.update(scratch_tables(spark) - before)
        return kept

    return run_stage


@after_the_last
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the rules and whose host passes."""
    return host_rules.quality_rules(docs).where(F.col(free_name("kept", docs.columns))).select(*docs.columns)


@after_the_last
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class."""
    return bag_minhash.drop_near_duplicates(docs)


@after_the_last
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows out of the texts. A document that loses nothing keeps its text as it
    is; others have their kept words joined by one space."""
    kept = doubling_windows.remove_repeated_windows(docs, rewrite=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@after_the_last
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled inside its shards."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, "doc_id", "source", source_mix.sizes(F.col("text")).alias("size"))
    return source_mix.shuffled(source_mix.mix(sized)).select("row.*")


@after_the_last
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, and whether they decode to the text."""
    model = public_tokenizer("piece_bpe_32k.model")
    decoded = free_name("decoded", docs.columns)
    coded = piece_lattice.encode(docs, model, decoded=decoded)
    same = F.col(decoded) == F.coalesce("text", F.lit(""))
    return coded.withColumn(free_name("same", docs.columns), same).drop(decoded)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixed),
    ("SentencePiece", token_ids),
]

#: Weighted MinHash classes and permuted blocks have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    root = f"{checkpoint_root(spark)}/pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{number}")
        docs = spark.read.parquet(f"{root}/{number}")
    return docs

"""The registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import (
    bag_minhash,
    centroids,
    collocations,
    doubling_windows,
    exact_copies,
    host_rules,
    piece_lattice,
    prefix_free,
    pruned_graph,
    source_mix,
    sql,
    token_store,
    toxicity_neighbours,
    url_trees,
)
from riskweave.llm.common import table

Plan = Callable[[SparkSession, str], DataFrame]


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = token_store.store(docs, public_tokenizer("byte_bpe_50k.json"))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its class, named by the smallest id in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found = bag_minhash.near_duplicates(docs)
    return found.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"))


def op3_doubling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = doubling_windows.remove_repeated_windows(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_neighbours.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    judged = url_trees.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = source_mix.mix(docs.select("doc_id", "source", source_mix.sizes(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = host_rules.quality_rules(docs, carry_text=False)
    return judged.select("doc_id", *host_rules.RULES, "kept", F.round("host_rate", 9).alias("host_rate"))


def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return pruned_graph.nearest(rows, rows.where("vec_id % 20 = 0"))


def op9_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = prefix_free.remove_repeated_strings(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole text (as a checksum of little-endian 32-bit words) and their text again."""
    model = public_tokenizer("piece_bpe_32k.model")
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(text, 256).alias("sha256"))
    coded = piece_lattice.encode(docs, model, keep_text=False, decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("sha256")).alias("same"),
    )


def op11_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_copies.exact_copies(docs, carry_text=False)
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return found.select("doc_id", F.col("keep_key").alias("keep_id"), "group_size", "kept", digest)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, final = centroids.cluster(rows)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    mark = centroids.by_cluster(F.col("cluster"), marks or [""], "string").alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", mark)


def plans() -> dict[str, Plan]:
    own = (
        op1_token_store,
        op2_bag_minhash,
        op3_doubling_windows,
        op4_toxicity_neighbours,
        op5_url_trees,
        op6_source_mix,
        op7_host_rules,
        op8_pruned_graph,
        op9_prefix_free,
        op10_piece_lattice,
        op11_exact_copies,
        op12_collocations,
        op13_centroids,
    )
    return {f.__name__: f for f in own}


def oracles() -> dict[str, str]:
    return dict(sql.TWINS)

"""The dealt operators applied to their whole tables, one query each, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import (
    chat,
    hard_negatives,
    langid,
    lattice,
    line_dedup,
    mixing,
    ngram_lm,
    repair,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
    wu_manber,
)
from caselight.llm.common import table
from caselight.llm.oracles import ORACLE_SQL  # noqa: F401  (read by the entry point)
from caselight.session import shared_dir


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = ("n_lines", "n_removed", "bytes_removed", "kept_sha256")
    return line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), digests)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), columns=digests)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link(table(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages as WARC files and audits the table, as a replica with damage, against what was written.

    The damage follows from the id: one page in 97 has a changed byte, one in 89 is missing.
    """
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(pages, folder)
    replica = warc.digests_of_pages(pages, damaged=F.col("page_id") % 97 == 0)
    replica = replica.where(F.coalesce(F.col("page_id") % 89, F.lit(1)) != 0)
    return warc.audit(warc.digests_of_files(spark, folder), replica)


def op8_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.first_uses(mixing.assign(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = wu_manber.benchmark_hits(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        wu_manber.items_digest().alias("items_sha256"),
        wu_manber.contaminated().alias("contaminated"),
    )


def op11_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op12_bidirectional_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = repair.damage(conversations)
    found = repair.repair(rows, conversations.select("conv_id"))
    digests = repair.turn_digests(repair.repaired_turns(rows, found)).withColumnRenamed("conv_id", "own")
    digest = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return found.join(digests, found["conv_id"].eqNullSafe(digests["own"]), "left").select(*found.columns, digest)


def op13_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_suffix_array_dedup,
        op3_lm_scoring,
        op4_language_id,
        op5_lattice_near_dedup,
        op6_simhash_near_dedup,
        op7_merkle_fixity,
        op8_chat_collapse,
        op9_source_mixing,
        op10_wu_manber_decontamination,
        op11_counterfactual_toxicity,
        op12_bidirectional_repair,
        op13_four_russians_negatives,
        pipeline,
    )
}

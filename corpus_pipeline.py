"""A training corpus from raw documents: five stages, each of the operators in ``caselight.llm``.

Every stage takes (spark, docs, sf_dir) and returns what the next one gets.  All but the last return the
columns they were given; the last adds position, copy and words, in training order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import langid, mixing, simhash, suffix_dedup, wu_manber
from caselight.llm.common import table
from caselight.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, no letter) go; ``lang`` becomes the language found."""
    found = docs.withColumn("__found", langid.language(docs, langid.train(docs)))
    kept = found.where(F.col("__found.lang_pred") != langid.UNKNOWN)
    return kept.select(*[F.col("__found.lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document has are cut out; a character that was cut through goes whole."""
    inner = {c: f"__in_{c}" for c in docs.columns if c not in ("doc_id", "text", "n_chars")}
    cut = suffix_dedup.remove_repeats(
        docs.withColumnsRenamed(inner), columns=("kept",), keep=("doc_id", *inner.values())
    ).withColumn("kept", F.col("kept").cast("string"))
    text = F.when(F.is_valid_utf8("kept"), F.col("kept")).otherwise(_without_stumps(F.col("kept")))
    cut = cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*[F.col(inner[c]).alias(c) if c in inner else F.col(c) for c in docs.columns])


def _without_stumps(text: Column) -> Column:
    """Text without the bytes that are no character; U+FFFD of the text's own, told apart by an escape, stay."""
    for old, new in (("\ufdd0", "\ufdd0\ufdd2"), ("\ufffd", "\ufdd0\ufdd1")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.make_valid_utf8(text)
    for old, new in (("\ufffd", ""), ("\ufdd0\ufdd1", "\ufffd"), ("\ufdd0\ufdd2", "\ufdd0")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark windows go."""
    found = wu_manber.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), name="__hits")
    return found.where(~wu_manber.contaminated("__hits")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; the last use of a source may be cut."""
    made = ("position", "copy", "words")
    rest = [c for c in docs.columns if c not in ("doc_id", "source", *made)]
    inner = {c: f"__in_{c}" for c in rest}
    wide = docs.select("doc_id", "source", "text", *[F.col(c).alias(n) for c, n in inner.items()])
    uses = mixing.training_order(mixing.assign(wide, keep=tuple(inner.values())), ("source", "size", *inner.values()))
    text = mixing.cut_words(F.col(inner["text"]), F.col("words"), F.col("size"))
    out = uses.withColumn(inner["text"], text).withColumn(inner["n_chars"], F.length(inner["text"]).cast("long"))
    back = [F.col(inner[c]).alias(c) if c in inner else F.col(c) for c in docs.columns if c not in made]
    return out.select(*back, *made)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

# Neither fingerprints nor the language model can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

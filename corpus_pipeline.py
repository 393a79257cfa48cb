"""The corpus pipeline: stages from raw documents to token ids.

Each stage works on all rows that the one before it kept and returns the columns of documents; the last returns one row
of digests per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import byte_bpe, decontaminate, language, lines, simhash
from codequarry.sources.scratch import release
from codequarry.sources.scratch import stage as staged


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or without a letter) go; the others get the language that is found. Repeated rows are kept."""
    model = language.train(docs.filter(~language.held_out()))
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)} | {"text": "text"}
    rows = docs.select(*(F.col(f"`{c}`").alias(plain[c]) for c in docs.columns))
    kept = language.predict(rows, model, tuple(rows.columns)).filter(F.col("lang_pred") != language.UNKNOWN)
    return kept.select(*(F.col("lang_pred" if c == "lang" else plain[c]).alias(c) for c in docs.columns))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are on many sites go, and ``n_chars`` follows the text. Null and empty texts stay as they are; repeated rows are treated alike."""
    cleaned = lines.remove_boilerplate(docs).select(*_columns(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of five-word shingles, similarity 0.8 or more.

    Null and empty texts are copies of each other, as are texts with equal words; repeated rows stay once. Columns of any name are returned unchanged.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go. Null and empty texts have none; repeated rows go or stay together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of what is left, as digests; a row each for repeated rows, and no ids for null and empty texts."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_tokens),
]
#: Stages fit models and search by bits, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
            if before is not None:
                release(before)
            before = docs
    return docs

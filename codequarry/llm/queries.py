"""The queries of this subpackage, by the driver's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import byte_bpe, decontaminate, language, lines, media, phrases, pii, quality, resample, sharding, token_counts
from codequarry.llm.simhash import near_duplicates
from codequarry.llm.token_ids import token_output
from codequarry.sources.scratch import new_path


#: What op7's edits mask.
MAIL, NUMBER = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "[0-9]{4,}"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~language.held_out())
    network = quality.train(docs, labels)
    score = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return quality.score(docs, network).select("doc_id", language.held_out().alias("held_out"), "score", score.alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "last_word")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    found = language.predict(docs, language.train(docs.filter("not held_out")))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are kept; a first batch of edits masks mail addresses, a second one long numbers in the texts that the first has left."""
    import public_tokenizers

    trees = token_counts.TreeTable(spark, new_path(spark, "trees"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    trees.build(table(spark, sf_dir, "documents"))
    trees.edit(token_counts.masked(MAIL, "<mail>"), F.contains("text", F.lit("@")))
    trees.edit(token_counts.masked(NUMBER, "<number>"), F.col("text").rlike("[0-9]{4}"))
    return token_counts.counts_over_versions(trees)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.places(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_token_ids": op1_token_ids, "op2_byte_bpe": op2_byte_bpe, "op3_quality": op3_quality, "op4_pii": op4_pii, "op5_decontaminate": op5_decontaminate, "op6_language_id": op6_language_id, "op7_token_counts": op7_token_counts, "op8_simhash": op8_simhash, "op9_line_dedup": op9_line_dedup, "op10_media": op10_media, "op11_phrases": op11_phrases, "op12_resample": op12_resample, "op13_shards": op13_shards}
ORACLE_SQL = {"op9_line_dedup": lines.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL}

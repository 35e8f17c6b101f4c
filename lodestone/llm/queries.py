"""The queries of these operators and their SQL, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, exact, html_template, jaccard, lines, mixing, pii, quality, repair, rpforest, rules
from .common import table


def vocabulary() -> str:
    """The public tokenizer file that the box provides."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", F.sha2("text", 256).alias("text_sha256"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_columns(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judged(docs, rules.learn(docs, table(spark, sf_dir, "labels")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = repair.repair(repair.damage(table(spark, sf_dir, "conversations")), lost_col="lost")
    return x.withColumn("repaired_sha256", F.sha2("text", 256)).drop("text")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_pii, op3_mixing, op4_exact_dedup, op5_ngram_jaccard, op6_chat, op7_html, op8_bpe, op9_embedding_dedup, op10_line_dedup, op11_rules, op12_repair, op13_filter_audit)
}
ORACLES = {"op2_pii": pii.ORACLE, "op3_mixing": mixing.ORACLE, "op4_exact_dedup": exact.ORACLE, "op6_chat": chat.ORACLE, "op10_line_dedup": lines.ORACLE, "op12_repair": repair.ORACLE, "op13_filter_audit": audit.ORACLE}

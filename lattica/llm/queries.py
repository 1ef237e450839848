"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import JACCARD_JOIN, QUALITY_RULES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: its source put in the middle, its first tenth cut, a stamp at the end."""
    from pyspark.sql import functions as F

    from .token_trees import counted

    n = F.char_length(F.coalesce("text", F.lit(""))).cast("int")
    step = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), new.alias("new"))
    edits = F.array(step(n / 2, n / 2, F.concat(F.lit(" "), F.coalesce("source", F.lit("")))), step(F.lit(0), n / 10, F.lit("")), step(n * 2, n * 2, F.lit("\nEdited.")))
    return counted(_table(spark, sf_dir, "documents").withColumn("edits", edits), "edits", vocabulary("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import assess

    return assess(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .tiling import SHARE, overlaps

    found = overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("coverage") >= SHARE).alias("contaminated"), F.when(F.col("coverage") >= SHARE, F.col("best_item")).alias("item_id"), "coverage", "n_tiles", "n_items")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeat_spans import report

    return report(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_model": op8_language_model,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": JACCARD_JOIN, "op4_quality_rules": QUALITY_RULES}

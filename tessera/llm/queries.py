"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session


#: Tokenizer vocabulary of op2 and of the pipeline; None stands for the installed public one.
VOCABULARY: str | None = None


def vocabulary() -> str:
    if VOCABULARY is not None:
        return VOCABULARY
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def held_out(parts: int) -> Column:
    """Whether crc32 of doc_id as text is 0 modulo ``parts``; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 0, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, train

    docs = session.table(spark, sf_dir, "documents")
    out = apply_rules(docs, train(docs, session.table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digest

    return bpe_digest(session.table(spark, sf_dir, "documents"), vocabulary())


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(session.table(spark, sf_dir, "documents"), num=85, den=100, size=5)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_quality import score, train

    docs = session.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, session.table(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(session.table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(session.table(spark, sf_dir, "documents"), size=50)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(session.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_seen").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(session.table(spark, sf_dir, "documents"), size=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_matches

    out = benchmark_matches(session.table(spark, sf_dir, "documents"), session.table(spark, sf_dir, "benchmark"), size=8)
    return out.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(session.table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)

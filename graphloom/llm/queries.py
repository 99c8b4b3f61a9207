"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .decontaminate import find_contamination
from .html_extract import extract_html
from .license_scan import scan_licenses
from .line_dedup import RECURRING, dedup_lines
from .lm_score import score_documents
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality_rules import quality_rules
from .substring_dedup import dedup_substrings
from .url_filter import Rule, host_rule, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the contract fixes: a host and the beginning of a path.
BASE_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]

#: The method's own rules, for URLs that no base rule fits.
OWN_RULES = [
    Rule("||cheap-pills.", "||cheap-pills.", "block"),
    Rule("-pills.", "-pills.", "block"),
    Rule("||ads.", "||ads.", "block"),
    Rule("||adserver.", "||adserver.", "block"),
    Rule("||tracker.", "||tracker.", "block"),
    Rule("/casino/", "/casino/", "block"),
    Rule("/poker/", "/poker/", "block"),
    Rule("/xxx/", "/xxx/", "block"),
    Rule("/wp-login.php", "/wp-login.php", "block"),
    Rule("||docs.", "||docs.", "allow", 1),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule (the deciding base rule or null), verdict, own_rule."""
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), BASE_RULES + OWN_RULES)
    is_base = F.col("rule_tier") == 2
    return out.select("page_id", "host", "path", F.when(is_base, F.col("rule_name")).alias("rule"), "verdict", F.when(~is_base, F.col("rule_name")).alias("own_rule"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id: the least doc_id of the document's class of near copies."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(table(spark, sf_dir, "documents"), texts=False).drop("kept_text", "repeats")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, start, end, places: one row for each benchmark item a document holds."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    return score_documents(table(spark, sf_dir, "documents"))


def op8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract_html(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the two probabilities."""
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: what stays of each document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), **RECURRING).select("doc_id", "n_lines", "n_dropped", "text")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()

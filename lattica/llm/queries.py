"""The queries over the text tables, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, mixing, norm_topk, periodic_runs, ranked_search
from .decontamination import contaminated
from .html_text import main_text
from .mixing import mixed
from .near_dedup import near_groups
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .resharding import resharded
from .suffix_dedup import repeated_strings
from .tables import table
from .token_counts import section_tokens


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards by source, badly balanced, to 16 of equal bytes; the affected files are written."""
    return resharded(table(spark, sf_dir, "documents"), F.crc32(F.coalesce("source", F.lit(""))) % 12, 12)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("row")


def op11_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_products(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, every tenth of them made periodic."""
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.looped(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_suffix_dedup, op4_html_text, op5_decontamination, op6_token_counts, op7_resharding, op8_minhash_near_dedup, op9_quality_rules, op10_source_mixing, op11_norm_topk, op12_ranked_search, op13_periodic_runs)}
ORACLE: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op5_decontamination": decontamination.ORACLE, "op10_source_mixing": mixing.ORACLE, "op11_norm_topk": norm_topk.ORACLE, "op12_ranked_search": ranked_search.ORACLE}

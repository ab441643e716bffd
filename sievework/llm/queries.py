"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.web_pages import boilerplate_lines

    return boilerplate_lines(table(spark, sf_dir, "fetch_results"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.web_pages import repeated_lines

    return repeated_lines(table(spark, sf_dir, "fetch_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs(table(spark, sf_dir, "fetch_results"), table(spark, sf_dir, "search_hits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.names import variant_pairs

    return variant_pairs(table(spark, sf_dir, "profiles"), table(spark, sf_dir, "institution_names"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.transcripts import speaker_turns

    return speaker_turns(table(spark, sf_dir, "transcribe_results"), table(spark, sf_dir, "speakers")).select("result_id", "turn_no", "speaker_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.splitting import oversized_items

    return oversized_items(table(spark, sf_dir, "fetch_results"), table(spark, sf_dir, "chunk_results"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.web_pages import leftovers

    return leftovers(table(spark, sf_dir, "fetch_results"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.packing import containers

    return containers(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.leakage import leaked_items

    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.reading_level import reading_bands

    return reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


P6_SQL = r"""
SELECT 'fetch' AS item_kind, fetch_id AS item_id,
  CAST(len(list_filter(regexp_split_to_array(markdown, '[\s\x0b\x1c-\x1f\x{85}\p{Z}.!?。！？]'), lambda x: length(x) > 4000)) > 0 AS BIGINT) AS forced
FROM fetch_results WHERE length(markdown) > 4000
UNION
SELECT 'claims', chunk_id,
  CAST(len(list_filter(claims, lambda c: len(list_filter(regexp_split_to_array(c.quote, '[\s\x0b\x1c-\x1f\x{85}\p{Z}.!?。！？]'), lambda x: length(x) > 1500)) > 0)) > 0 AS BIGINT)
FROM chunk_results WHERE list_sum(list_transform(claims, lambda c: coalesce(length(c.quote), 0))) > 1500
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL}

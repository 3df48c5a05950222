"""Queries of the training-data operators; each is a function of the session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from collatrix.llm import components, lookalikes, markup, matching, mixing, names, repeats, sentences, survivor, tokens
from collatrix.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_links(table(spark, d, "creator_names"), table(spark, d, "authority_records"))


def p1_owners(spark: SparkSession, d: str) -> DataFrame:
    return names.owners(table(spark, d, "creator_names"), table(spark, d, "authority_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "candidates"), table(spark, d, "cluster_jobs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_sources(table(spark, d, "item_snaps"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_records(table(spark, d, "item_snaps"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched_records(table(spark, d, "items"), table(spark, d, "authority_records"))


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched_with_confidence(table(spark, d, "items"), table(spark, d, "authority_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.marked_up(table(spark, d, "items"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_fields(table(spark, d, "items")).drop("value")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeat_pairs(table(spark, d, "authority_records"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return repeats.work_groups(table(spark, d, "authority_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.disguised(table(spark, d, "authority_records"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_forms(table(spark, d, "authority_records"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.skeleton_groups(table(spark, d, "authority_records"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p9_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this package by its name."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    """Equivalent SQL for those queries that SQL can express over whole tables."""
    return {"p2_found": P2_FOUND}


P2_FOUND = """
WITH RECURSIVE rows_ AS (
  SELECT list_distinct(list_filter(item_keys, lambda x: x IS NOT NULL)) AS k FROM candidates
  UNION ALL SELECT list_distinct(list_filter(member_keys, lambda x: x IS NOT NULL)) FROM cluster_jobs
), stars AS (SELECT list_min(k) AS a, unnest(k) AS b FROM rows_ WHERE len(k) > 0),
edges AS (SELECT DISTINCT a, b FROM stars UNION SELECT DISTINCT b, a FROM stars),
reach(id, root) AS (SELECT DISTINCT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id WHERE r.root < e.b)
SELECT id AS item_key, min(root) AS group_key FROM reach GROUP BY id
"""

"""Citation keys: collisions, keyless items, and whether the keys of merged-away records survive as aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.functions import text
from collatrix.operators.dedup import latest
from collatrix.operators.merge import REPLACES


def keys_of(items: DataFrame) -> DataFrame:
    """item_key, citekey (pinned, else computed, else null)."""
    return latest(items).select("item_key", text.citation_key(F.col("extra"), F.col("citation_key")).alias("citekey"))


def collisions(items: DataFrame) -> DataFrame:
    """citekey, n, first_item of the keys that several items share. The items themselves aren't gathered: a key may be shared by any number."""
    return keys_of(items).filter("citekey is not null").groupBy("citekey").agg(F.count("*").alias("n"), F.min("item_key").alias("first_item")).filter("n > 1")


def colliding_items(items: DataFrame) -> DataFrame:
    """item_key, citekey of every item whose key another has too."""
    return keys_of(items).join(collisions(items).select("citekey"), "citekey", "left_semi").select("item_key", "citekey")


def report(items: DataFrame) -> DataFrame:
    """One row: items scanned, without a key, distinct keys, keys that collide."""
    per = keys_of(items).groupBy("citekey").agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("scanned"), F.coalesce(F.sum(F.when(F.col("citekey").isNull(), F.col("n"))), F.lit(0)).alias("keyless"),
        F.count("citekey").alias("unique_keys"), F.count_if(F.col("citekey").isNotNull() & (F.col("n") > 1)).alias("collisions"))


def alias_survival(items: DataFrame) -> DataFrame:
    """item_key, replaced, old_key, outcome for every merged-away record a survivor names: kept, lost, no key, or gone."""
    one = latest(items)
    links = one.select("item_key", "extra", F.explode(F.coalesce(F.try_element_at("relations", F.lit(REPLACES)), F.array().cast("array<string>"))).alias("uri"))
    links = links.select("item_key", text.alias_keys(F.col("extra")).alias("aliases"), text.target_key(F.col("uri")).alias("replaced"))
    old = one.select(F.col("item_key").alias("replaced"), text.citation_key(F.col("extra"), F.col("citation_key")).alias("old_key"), F.lit(True).alias("known"))
    x = links.join(old, "replaced", "left")
    outcome = F.when(F.col("known").isNull(), "gone").when(F.col("old_key").isNull(), "no key").when(F.array_contains("aliases", F.col("old_key")), "kept").otherwise("lost")
    return x.select("item_key", "replaced", "old_key", outcome.alias("outcome"))

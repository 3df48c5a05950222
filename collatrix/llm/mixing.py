"""Problem 9: mixing sources to target weights by systematic sampling.

A unit is one text of one source: exact copies inside a source are one unit, so that no text is used more often than
``max_repeats``, however many documents hold it. Every unit of source s gets the expected number of copies
min(max_repeats, target tokens / tokens of s). Along the units of a source the expected copies are summed up, one random
offset is added, and a unit is emitted once for each integer its stretch of the sum crosses. Units are ordered by size,
which makes the sample stratified by length and keeps the tokens really drawn close to the target.

The running sum needs no source in one task: units are summed by small buckets, the buckets of a source (at most
SIZE_CLASSES x SLICES rows) get their starting points, and the rest of the sum runs inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatrix.llm.tokens import BYTE_BPE_50K, TOKENIZER_DIR, count_tokens
from collatrix.session import stage

SLICES = 64


def units(docs: DataFrame, name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """source, digest, tokens, doc_id (the least of the copies), n_docs: the distinct texts of each source.

    Null and empty texts hold no tokens and are no units; a null source is a source of its own (and never a target).
    """
    sized = count_tokens(docs.select("doc_id", "source", F.sha2("text", 256).alias("digest"), "text"), "text", name, folder)
    return sized.filter("tokens > 0").groupBy("source", "digest").agg(F.max("tokens").alias("tokens"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))


def _chance(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def plan_shares(per_source: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """For each source of ``targets``: available tokens and units, budget, expected copies per unit.

    ``total_tokens``: size of the mix; by default all tokens of the targets' sources. Target weights are scaled to sum 1.
    A null or negative weight is 0, a null max_repeats is 1. A source named twice counts once, by its highest weight.
    """
    want = targets.filter("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    whole = Window.partitionBy(F.lit(0))  # rows: the sources named in the targets, a handful
    t = want.join(per_source, "source", "left").fillna(0, ["available_tokens", "available_units"])
    t = t.withColumn("target_weight", F.when(F.sum("w").over(whole) > 0, F.col("w") / F.sum("w").over(whole)).otherwise(0.0))
    total = F.lit(total_tokens) if total_tokens is not None else F.sum("available_tokens").over(whole)
    t = t.withColumn("target_tokens", F.col("target_weight") * total)
    e = F.when(F.col("available_tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_tokens") / F.col("available_tokens"))).otherwise(0.0)
    return t.withColumn("copies_expected", e).drop("w")


def draw(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """(drawn, plan): drawn has doc_id, source, copy_no (from 1), tokens, one row per emission."""
    u = stage(units(docs, name, folder), "p9-units")
    per_source = u.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("available_units"))
    plan = stage(plan_shares(per_source, targets, total_tokens), "p9-plan")  # a row per target source
    x = u.join(plan.select("source", "copies_expected").filter("copies_expected > 0"), "source")
    x = x.withColumn("order", F.xxhash64(F.lit(seed), "digest")).withColumn("size_class", F.floor(F.log2(F.col("tokens") + 1.0) * 8).cast("int"))
    x = x.withColumn("slice", F.pmod(F.col("order"), F.lit(SLICES)).cast("int"))
    bucket = ["source", "size_class", "slice"]
    sums = x.groupBy(bucket).agg(F.sum("copies_expected").alias("here"))
    before = Window.partitionBy("source").orderBy("size_class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*bucket, F.coalesce(F.sum("here").over(before), F.lit(0.0)).alias("start"))
    x = x.join(starts, bucket)
    inside = Window.partitionBy(bucket).orderBy("order", "digest").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("upto", F.sum("copies_expected").over(inside))
    low = F.col("start") + F.col("upto") - F.col("copies_expected") + _chance(seed, F.col("source"))
    # Sums of fractions are rounded, so that a whole number of expected copies can't become one more.
    n = (F.floor(F.round(low + F.col("copies_expected"), 6)) - F.floor(F.round(low, 6))).cast("int")
    x = x.withColumn("n", n).filter("n > 0")
    return x.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "tokens"), plan


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, name: str = BYTE_BPE_50K, folder: str = TOKENIZER_DIR) -> DataFrame:
    """A row per target source with the share really reached, also for those without texts or short of their target.

    ``short``: even with every text repeated as often as allowed, the source can't reach its target tokens.
    """
    drawn, plan = draw(docs, targets, total_tokens, seed, name, folder)
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"), F.max("copy_no").alias("m"))
    r = plan.join(got, "source", "left")
    whole = Window.partitionBy(F.lit(0))
    total = F.sum(F.coalesce("t", F.lit(0))).over(whole)
    return r.select(
        "source", "target_weight", "max_repeats", "available_units", "available_tokens", "target_tokens",
        F.coalesce("c", F.lit(0)).alias("drawn_copies"), F.coalesce("t", F.lit(0)).alias("drawn_tokens"), F.coalesce("m", F.lit(0)).alias("most_copies"),
        F.when(total > 0, F.coalesce("t", F.lit(0)) / total).otherwise(0.0).alias("actual_share"),
        (F.col("available_tokens") * F.col("max_repeats") < F.col("target_tokens")).alias("short"),
    )

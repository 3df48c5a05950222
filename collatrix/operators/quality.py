"""Completeness of records by rule, in the full and the short rule set, and small edits of sets and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.functions import text
from collatrix.operators.dedup import latest

#: Fields an edit may set; everything else is identity, structure or state.
EDITABLE = ["title", "pub_date", "doi", "volume", "issue", "edition", "university", "abstract_note", "publisher", "publication_title", "extra"]


def _missing(c: str) -> Column:
    return text.is_empty(F.col(c))


def _no_creators() -> Column:
    return F.coalesce(F.size("creators"), F.lit(0)) <= 0


def full_rules() -> tuple[Column, Column]:
    """(issues, warnings) of one record as arrays of texts; creators are named by their position from 0."""
    kind = F.coalesce("item_type", F.lit(""))
    upper = (F.upper("title") == F.col("title")) & (F.lower("title") != F.col("title"))
    issues = F.array_compact(F.array(
        F.when(_missing("title"), "Missing title"), F.when(_no_creators(), "No creators/authors"), F.when(_missing("pub_date"), "Missing date"),
        F.when((kind == "journalArticle") & _missing("publication_title"), "Missing journal name"), F.when((kind == "book") & _missing("publisher"), "Missing publisher"),
        F.when((kind == "bookSection") & _missing("publication_title"), "Missing book title"), F.when((kind == "bookSection") & _missing("publisher"), "Missing publisher")))
    who = F.coalesce(F.transform("creators", lambda c, i: F.when(text.is_empty(c["lastName"]), F.concat(F.lit("Creator "), i.cast("string"), F.lit(": missing lastName")))), F.array().cast("array<string>"))
    warnings = F.array_compact(F.array(
        F.when((kind == "journalArticle") & _missing("volume"), "Missing volume"), F.when((kind == "journalArticle") & _missing("doi"), "Missing DOI"), F.when(upper, "Title is ALL CAPS")))
    first = F.coalesce(F.transform("creators", lambda c, i: F.when(text.is_empty(c["firstName"]) & (c["creatorType"] == "author"), F.concat(F.lit("Creator "), i.cast("string"), F.lit(": missing firstName")))), F.array().cast("array<string>"))
    return F.concat(issues, F.array_compact(who)), F.concat(warnings, F.array_compact(first))


def short_rules() -> tuple[Column, Column]:
    """(issues, warnings) by the smaller rule set of batch runs."""
    kind = F.coalesce("item_type", F.lit(""))
    issues = F.array_compact(F.array(
        F.when(_missing("title"), "no title"), F.when(_no_creators(), "no creators"), F.when(_missing("pub_date"), "no date"), F.when((kind == "journalArticle") & _missing("publication_title"), "no journal"),
        F.when((kind == "book") & _missing("publisher"), "no publisher"), F.when((kind == "bookSection") & _missing("publication_title"), "no book title")))
    return issues, F.array_compact(F.array(F.when((kind == "journalArticle") & _missing("doi"), "no DOI")))


def validated(items: DataFrame, rules=full_rules) -> DataFrame:
    """item_key, bucket (issues, warnings, clean), issues, warnings of every item."""
    issues, warnings = rules()
    bucket = F.when(F.size("issues") > 0, "issues").when(F.size("warnings") > 0, "warnings").otherwise("clean")
    return latest(items).select("item_key", issues.alias("issues"), warnings.alias("warnings")).withColumn("bucket", bucket)


def bucket_counts(items: DataFrame, rules=short_rules) -> DataFrame:
    """bucket, n."""
    return validated(items, rules).groupBy("bucket").agg(F.count("*").alias("n"))


def edit_tags(tags: Column, add: list[str], remove: list[str]) -> Column:
    """Tag names after adding and removing, each once, in their order; null tags are empty."""
    have = F.coalesce(F.transform(tags, lambda t: t["tag"]), F.array().cast("array<string>"))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.array_except(F.array_union(have, lit(add)), lit(remove))


def proposed_changes(changes: DataFrame, items: DataFrame) -> DataFrame:
    """item_key, field, value, old, outcome of proposed edits (item_key, version, field, value): applied, unchanged, stale, forbidden or unknown."""
    long = latest(items).select("item_key", F.col("version").alias("now"), F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("old")) for c in EDITABLE])).alias("x"))
    known = latest(items).select("item_key", F.lit(True).alias("known"))
    y = changes.join(long.select("item_key", "now", F.col("x.f").alias("field"), "x.old"), ["item_key", "field"], "left").join(known, "item_key", "left")
    outcome = F.when(F.col("known").isNull(), "unknown").when(~F.col("field").isin(EDITABLE), "forbidden").when(~F.col("version").eqNullSafe(F.col("now")), "stale").when(F.col("value").eqNullSafe(F.col("old")), "unchanged").otherwise("applied")
    return y.select("item_key", "field", "value", "old", outcome.alias("outcome"))

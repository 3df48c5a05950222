"""Duplicate clusters by identifier and by normalised key, with the guards that send a cluster to review.

No operator here compares the members of a cluster pairwise in one task unless they differ in what is compared: guards
are distinct counts, which combine before the shuffle; only the distinct titles and subtitles of a cluster are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatrix.functions import text
from collatrix.session import stage

TITLE_FLOOR = 0.5
#: Fields that tell volumes, deposits and editions apart; those a table lacks are skipped.
TELLING = {"volume": "volume", "numberOfVolumes": "number_of_volumes", "issue": "issue", "seriesNumber": "series_number", "number": "number", "university": "university", "institution": "institution"}
#: What counts for completeness: everything but structure and state.
SCALARS = ["item_key", "item_type", "title", "pub_date", "doi", "volume", "issue", "edition", "university", "abstract_note", "publisher", "publication_title", "extra", "citation_key"]


def latest(items: DataFrame, key: str = "item_key") -> DataFrame:
    """One row per key: the last delivered (highest version, then modification; then a digest of the row, so ties are stable). Null keys are dropped."""
    order = F.struct(F.coalesce("version", F.lit(-1)), F.coalesce("date_modified", F.timestamp_micros(F.lit(0))), F.xxhash64(*[c for c in items.columns if c != "relations"]))
    rest = [c for c in items.columns if c != key]
    return items.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def completeness(items: DataFrame) -> Column:
    """How many bibliographic fields are filled; creators count as one."""
    filled = [(~text.is_empty(F.col(c))).cast("int") for c in SCALARS if c in items.columns and c != "item_key"]
    total = F.coalesce((F.size("creators") > 0).cast("int"), F.lit(0)) if "creators" in items.columns else F.lit(0)
    for f in filled:
        total = total + f
    return total


def keyed(items: DataFrame) -> DataFrame:
    """The normal forms the clusters and their guards need, one row per item."""
    t = F.col("title")
    full = text.full_title(t)
    has = set(items.columns)
    return items.select(
        "item_key",
        text.doi_key(F.col("doi")).alias("doi"),
        text.title_key(t).alias("title_key"),
        text.year_of(F.col("pub_date")).alias("year"),
        text.first_author(F.col("creators")).alias("author"),
        text.surnames(F.col("creators")).alias("surnames"),
        F.coalesce("item_type", F.lit("\0")).alias("item_type"),
        F.array_join(text.content_tokens(full), " ").alias("tokens"),
        text.subtitle(t).alias("subtitle"),
        text.part_signature(full).alias("parts"),
        text.edition_key(F.col("edition")).alias("edition"),
        *[text.field_key(F.col(c)).alias(f"tell_{n}") for n, c in TELLING.items() if c in has],
        completeness(items).alias("completeness"),
    )


def memberships(keys: DataFrame) -> DataFrame:
    """path, cluster, and the columns of ``keys`` of every item in a cluster of two or more.

    An item whose DOI others share belongs to the DOI's cluster only; the rest are grouped by title, year and first author
    (a missing author is a value, a missing title or year is not).
    """
    doi = keys.filter("doi is not null").groupBy("doi").agg(F.count("*").alias("n")).filter("n > 1").select("doi")
    by_doi = keys.join(doi, "doi", "left_semi").withColumn("path", F.lit("doi")).withColumn("cluster", F.col("doi"))
    rest = keys.join(doi, "doi", "left_anti")
    cluster = F.concat_ws("|", "title_key", "year", "author")
    rest = rest.filter((F.col("title_key") != "") & (F.col("year") != "")).withColumn("path", F.lit("key")).withColumn("cluster", cluster)
    several = rest.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    return by_doi.unionByName(rest.join(several, "cluster", "left_semi"))


def _disagreeing(distinct: DataFrame, value: str, apart: Column) -> DataFrame:
    """(path, cluster) in which two distinct values are ``apart`` (columns a.value, b.value).

    Most clusters that disagree do so with their least value; only the others compare all their distinct values.
    """
    least = distinct.groupBy("path", "cluster").agg(F.min(value).alias(value))
    a, b = least.alias("a"), distinct.alias("b")
    same = (F.col("a.path") == F.col("b.path")) & (F.col("a.cluster") == F.col("b.cluster"))
    found = a.join(b, same & (F.col(f"a.{value}") != F.col(f"b.{value}"))).filter(apart).select(F.col("a.path").alias("path"), F.col("a.cluster").alias("cluster")).distinct()
    rest = distinct.join(found, ["path", "cluster"], "left_anti")
    a, b = rest.alias("a"), rest.alias("b")
    more = a.join(b, same & (F.col(f"a.{value}") < F.col(f"b.{value}"))).filter(apart).select(F.col("a.path").alias("path"), F.col("a.cluster").alias("cluster")).distinct()
    return found.unionByName(more)


def _title_disagreement(members: DataFrame) -> DataFrame:
    """(path, cluster) in which two distinct titles share less than half of their content words."""
    distinct = members.filter("tokens <> ''").select("path", "cluster", "tokens").distinct()
    x, y = F.split("a.tokens", " "), F.split("b.tokens", " ")
    return _disagreeing(distinct, "tokens", F.size(F.array_intersect(x, y)) < TITLE_FLOOR * F.size(F.array_union(x, y)))


def clipped(a: Column, b: Column) -> Column:
    """Whether ``a`` is ``b`` clipped; a numeral that goes on in ``b`` is another number, not a clipped one."""
    goes_on = F.substr(b, F.length(a) + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    numeral = F.regexp_extract(a, r"(\S+)$", 1).rlike(r"^([0-9]+|[ivxlcdm]+)$")
    return b.startswith(a) & ~(goes_on & numeral)


def _subtitle_disagreement(members: DataFrame) -> DataFrame:
    """(path, cluster) with two subtitles of which neither is the other clipped."""
    distinct = members.filter("subtitle <> ''").select("path", "cluster", "subtitle").distinct()
    return _disagreeing(distinct, "subtitle", ~(clipped(F.col("a.subtitle"), F.col("b.subtitle")) | clipped(F.col("b.subtitle"), F.col("a.subtitle"))))


def _creator_disagreement(members: DataFrame) -> DataFrame:
    """Clusters by key in which two or more surnames stand in some members but not in all."""
    size = members.filter("path = 'key'").groupBy("path", "cluster").agg(F.count("*").alias("size"))
    each = members.filter("path = 'key'").select("path", "cluster", F.explode("surnames").alias("s")).groupBy("path", "cluster", "s").agg(F.count("*").alias("n"))
    return each.join(size, ["path", "cluster"]).filter("n < size").groupBy("path", "cluster").agg(F.count("*").alias("k")).filter("k >= 2").select("path", "cluster")


def clusters(items: DataFrame) -> DataFrame:
    """path, item_keys (sorted), auto_accept, conflicts (in the order of the guards), master_key of every duplicate cluster.

    Of repeated deliveries of an item the last counts; null keys are dropped; empty tables give no cluster. The master is the
    most complete member, then the least key.
    """
    m = stage(memberships(keyed(latest(items))), "dedup-members")  # read by each guard
    told = [c for c in m.columns if c.startswith("tell_")]
    # more than one distinct value: the least isn't the greatest; unlike distinct counts, this combines before the shuffle
    several = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    filled = lambda c: several(F.nullif(F.col(c), F.lit("")))
    g = m.groupBy("path", "cluster").agg(
        F.array_sort(F.collect_list("item_key")).alias("item_keys"),
        several("item_type").alias("types"),
        several("parts").alias("n_parts"),
        several("edition").alias("editions"),
        filled("year").alias("years"),
        several("doi").alias("dois"),
        F.min_by("item_key", F.struct(-F.col("completeness"), F.col("item_key"))).alias("master_key"),
        *[filled(c).alias(c) for c in told],
    )
    for name, found in (("title_off", _title_disagreement(m)), ("subtitle_off", _subtitle_disagreement(m)), ("creators_off", _creator_disagreement(m))):
        g = g.join(found.withColumn(name, F.lit(True)), ["path", "cluster"], "left")
    guards = [
        (F.col("types"), "item-type conflict"),
        (F.col("title_off"), "title disagreement"),
        (F.col("subtitle_off"), "subtitle disagreement"),
        (F.col("n_parts"), "volume/part disagreement"),
        *[(F.col(c), f"{c.removeprefix('tell_')} disagreement") for c in told],
        (F.col("editions"), "edition disagreement"),
        ((F.col("path") == "doi") & (F.col("years")), "year disagreement"),
        ((F.col("path") == "key") & (F.col("dois")), "DOI disagreement"),
        ((F.col("path") == "key") & F.col("creators_off"), "creator disagreement"),
    ]
    conflicts = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in guards]))
    return g.select("path", "item_keys", (F.size(conflicts) == 0).alias("auto_accept"), conflicts.alias("conflicts"), "master_key")


def with_reason(found: DataFrame) -> DataFrame:
    """Adds the reason of each cluster, and what demoted it."""
    base = F.when(F.col("path") == "doi", "exact DOI").otherwise("exact normalized title+year+author")
    return found.withColumn("reason", F.when(F.col("auto_accept"), base).otherwise(F.concat(base, F.lit(" (demoted: "), F.array_join("conflicts", ", "), F.lit(")"))))


def cluster_counts(found: DataFrame) -> DataFrame:
    """One row: clusters, those accepted and those for review."""
    return found.agg(F.count("*").alias("clusters"), F.count_if("auto_accept").alias("auto_accept"), F.count_if(~F.col("auto_accept")).alias("review"))


def ranked_master(items: DataFrame, group: str) -> DataFrame:
    """``group`` and its master among any grouped items: the most complete, then the least key."""
    w = Window.partitionBy(group).orderBy(F.desc("completeness"), "item_key")
    return items.withColumn("completeness", completeness(items)).withColumn("r", F.row_number().over(w)).filter("r = 1").select(group, F.col("item_key").alias("master_key"))

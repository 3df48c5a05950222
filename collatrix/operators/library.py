"""Reading a library: pages, single items, children, storage, and the identities by which records are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatrix.functions import text
from collatrix.operators.dedup import latest

#: Fields of an item as a detail view lists them.
FIELDS = ["item_type", "title", "pub_date", "doi", "volume", "issue", "edition", "university", "abstract_note", "publisher", "publication_title", "extra", "citation_key"]


def scan(items: DataFrame, kinds: list[str] | None = None, trashed: bool = False) -> DataFrame:
    """The latest delivery of each item of some types (all for none); those in the trash only if asked for."""
    one = latest(items)
    one = one if trashed else one.filter(~F.coalesce("deleted", F.lit(False)))
    return one.filter(F.col("item_type").isin(kinds)) if kinds else one


def page(items: DataFrame, offset: int, size: int) -> DataFrame:
    """position (from 0), item_key, title of one page of a scan ordered by key; past the end there are no rows. Only the rows up to the page's end are sorted to the driver's side."""
    head = items.select("item_key", "title").orderBy("item_key").offset(offset).limit(size)
    return head.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item_key")) + offset - 1)


def point(items: DataFrame, key: str) -> DataFrame:
    """The one item of a key, or no row; the key reaches the file scan as a filter."""
    return latest(items.filter(F.col("item_key") == key))


def details(items: DataFrame) -> DataFrame:
    """item_key, field, value of every filled field of each item."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FIELDS])
    return items.select("item_key", F.explode(each).alias("x")).select("item_key", "x.field", "x.value").filter(~text.is_empty(F.col("value")))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """item_key, field (creators or tags), only_a, only_b: creators in their order and tag names as sets that differ between two tables of items."""
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform("creators", lambda c: F.concat_ws("/", F.coalesce(c["creatorType"], F.lit("")), F.coalesce(c["lastName"], F.lit("")), F.coalesce(c["firstName"], F.lit("")), F.coalesce(c["name"], F.lit("")))), none)
    tags = F.coalesce(F.array_sort(F.array_distinct(F.transform("tags", lambda t: F.coalesce(t["tag"], F.lit(""))))), none)
    long = lambda df, v: df.select("item_key", F.explode(F.array(F.struct(F.lit("creators").alias("field"), names.alias("v")), F.struct(F.lit("tags").alias("field"), tags.alias("v")))).alias("x")).select("item_key", "x.field", F.col("x.v").alias(v))
    both = long(a, "a").join(long(b, "b"), ["item_key", "field"], "full").filter(~F.coalesce("a", none).eqNullSafe(F.coalesce("b", none)))
    minus = lambda x, y: F.array_join(F.array_sort(F.array_except(F.coalesce(x, none), F.coalesce(y, none))), ";")
    return both.select("item_key", "field", minus("a", "b").alias("only_a"), minus("b", "a").alias("only_b"))


def children(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_key, kind, n, chars: what hangs on each item by kind; one item may hold any share of all children."""
    kids = documents.filter("item_key is not null").groupBy("item_key", "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    return kids.join(latest(items).select("item_key"), "item_key", "left_semi")


def orphans(documents: DataFrame, items: DataFrame, sample: int = 10) -> DataFrame:
    """item_key, n, orphans: the first keys that children name and no item has, with the number of all such keys (a report with a sample)."""
    lost = documents.filter("item_key is not null").groupBy("item_key").agg(F.count("*").alias("n")).join(latest(items).select("item_key"), "item_key", "left_anti")
    total = lost.agg(F.count("*").alias("orphans"))
    return lost.orderBy("item_key").limit(sample).crossJoin(F.broadcast(total))  # one row


def childless(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_key of the items nothing hangs on."""
    return latest(items).select("item_key").join(documents.select("item_key").filter("item_key is not null").distinct(), "item_key", "left_anti")


def identities(keyed: DataFrame) -> DataFrame:
    """item_key, identity: a digest of type, title, year, first author and DOI in their normal forms; equal ones are one record to any observer."""
    return keyed.select("item_key", F.sha2(F.concat_ws("|", "item_type", "title_key", "year", "author", F.coalesce("doi", F.lit(""))), 256).alias("identity"))


def observation_id(key: Column, version: Column) -> Column:
    """An id of one state of one item."""
    return F.concat(F.lit("META-"), F.left(F.md5(F.concat_ws("|", key, F.coalesce(version.cast("string"), F.lit("")))), F.lit(12)))


def names_of(full: Column) -> tuple[Column, Column]:
    """(first, last) of a name typed as one string: "Last, First" or "First Last"; a single word is a last name."""
    t = text.squeeze(F.coalesce(full, F.lit("")))
    comma = F.instr(t, ",") > 0
    last = F.when(comma, F.trim(F.substring_index(t, ",", 1))).otherwise(F.substring_index(t, " ", -1))
    first = F.when(comma, F.trim(F.regexp_replace(t, "^[^,]*,", ""))).otherwise(F.regexp_replace(t, r"\s*\S+$", ""))
    return first, last


def search_text(keyed: DataFrame) -> DataFrame:
    """item_key, query: what a bibliographic search is asked for a record without an identifier: title, first author, year."""
    return keyed.filter("doi is null and title_key <> ''").select("item_key", F.concat_ws(" ", "title_key", F.nullif("author", F.lit("")), F.nullif("year", F.lit(""))).alias("query"))


def listing(found: DataFrame, group: str, order: list[Column], cap: int = 20) -> DataFrame:
    """The first ``cap`` rows of each group with their place and the number of all rows of the group: a capped report."""
    sizes = found.groupBy(group).agg(F.count("*").alias("total"))
    top = found.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= cap)
    return top.join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def same_members(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """job_id, cand_id: match results with exactly the members of a job, in whatever order and however often named."""
    members = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda k: k.isNotNull())))
    j = jobs.select("job_id", members("member_keys").alias("m")).filter(F.size("m") > 0)
    return j.join(candidates.select("cand_id", members("item_keys").alias("m")), "m").select("job_id", "cand_id")

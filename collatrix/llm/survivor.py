"""Problem 3: the best representative of each duplicate group, put together field by field.

Values are ranked by whether they count (completeness), then by the trust in their source (where a table of it is given),
then by recency, with the item key as the last tie-break. The
only comparison between members, "is this a shortened copy of another member's value", needs no pairs: among the
distinct values of a field in binary order, the value that follows v begins with v if any does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatrix.session import stage

# Words that stand in for a missing value, without case, brackets and punctuation.
STAND_INS = [
    "unknown", "n a", "na", "not given", "missing", "null", "none", "nil", "xxx", "tbd", "tba", "nan", "undefined", "not available",
    "not specified", "unspecified", "not known", "no value", "empty", "blank", "untitled", "untitled document", "no title", "title missing",
    "o t", "ohne titel", "sin titulo", "sans titre", "o o", "s l", "sine loco", "no place", "o j", "s d", "s a", "n d", "no date",
    "undated", "s n", "sine nomine", "publisher not identified", "place not identified", "date not identified", "no publisher",
    "abstract missing", "no abstract available", "no abstract", "abstract not available", "anon", "anonymous", "unbekannt", "desconocido", "inconnu",
]
#: Names that programs give to files, without a word of their own.
FILE_NAME = r"^((microsoft|ms) (word|excel|powerpoint) )?(scan|scanned|doc|document|untitled|img|image|page|file) ?\d*$"
# Labels that stand alone where the number after them is missing, by field.
LABELS = {"pages": ["p", "pp", "s"], "volume": ["vol", "v", "bd"], "issue": ["no", "nr", "issue"]}
#: Fields that hold short codes or numbers: there "4" is no shortened "42".
CODE_FIELDS = ["volume", "issue", "pages", "number", "numberOfVolumes", "seriesNumber", "edition", "language", "ISBN", "ISSN"]
#: What cutting leaves at the end of a shortened value.
CUT = r"(?U)(\s*(\[\s*(\.{2,}|…)\s*\]|\(\s*(\.{2,}|…)\s*\)|\.{3,}|…)|-+|–|—)\s*$"
SPACE = r"(?U)[\s ​﻿]+"


def _core(value: Column) -> Column:
    """The value as compared: one case, single spaces, without the mark that cutting leaves."""
    plain = F.lower(F.trim(F.regexp_replace(value, SPACE, " ")))
    return F.trim(F.regexp_replace(plain, CUT, ""))


def says_something(field: Column, value: Column, stand_ins: list[str] = STAND_INS) -> Column:
    """False for null, blank and mere stand-ins: no letter or digit, a word of ``stand_ins``, a program's name for a file, all zeros in a date or page range, a DOI without prefix and number."""
    words = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
    doi = F.lower(field) == "doi"
    label = F.lit(False)
    for f, ws in LABELS.items():
        label = label | ((field == f) & words.isin(ws))
    return F.coalesce(
        (words != "") & ~words.isin(stand_ins) & ~label & ~((F.lower(field) == "title") & words.rlike(FILE_NAME))
        & ~(F.lower(field).isin("date", "pages", "year") & words.rlike(r"^[0 ]+$"))
        & ~(doi & ~value.rlike(r"10[.]\d+")),
        F.lit(False),
    )


def _trusted(rows: DataFrame, trust: DataFrame | None) -> DataFrame:
    if trust is None:
        return rows.withColumn("trust", F.lit(0.0))
    known = trust.filter("item_key is not null").groupBy("item_key").agg(F.max("trust").alias("trust"))
    return rows.join(known, "item_key", "left").withColumn("trust", F.coalesce(F.col("trust").cast("double"), F.lit(0.0)))


def judged_values(snaps: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """snapshot_id, item_key, modified_at, trust, field, value, counts: one row per field of each member.

    ``trust``: item_key, trust (double, higher is better; 0 for items it lacks); without it all are trusted alike.

    A repeated (snapshot_id, item_key) stands once, by the latest modified_at, then the highest version. Null maps give no
    rows; a null snapshot_id is a group of its own; a null item_key is a member like any other.
    """
    newest = Window.partitionBy("snapshot_id", "item_key").orderBy(F.desc_nulls_last("modified_at"), F.desc_nulls_last("version"), F.desc(F.to_json("fields")))
    one = snaps.select("snapshot_id", "item_key", "version", "modified_at", "fields").withColumn("nth", F.row_number().over(newest)).filter("nth = 1")
    one = _trusted(one, trust)
    long = one.select("snapshot_id", "item_key", "modified_at", "trust", F.explode("fields").alias("field", "value"))
    long = long.withColumn("says", says_something(F.col("field"), F.col("value"))).withColumn("core", F.when(F.col("says"), _core(F.col("value"))))
    long = long.withColumn("cut", F.coalesce(F.rtrim("value").rlike(CUT), F.lit(False)))
    # Distinct cores first (combined before the shuffle), then each core against the one after it. A core begins with
    # the character of any longer one, which splits groups of any size without losing a comparison.
    cores = long.filter("says").groupBy("snapshot_id", "field", "core").agg(F.bool_or(~F.col("cut")).alias("whole"))
    after = Window.partitionBy("snapshot_id", "field", F.substring("core", 1, 1)).orderBy("core")
    cores = cores.withColumn("next", F.lead("core").over(after)).withColumn("longer", F.coalesce(F.col("next").startswith(F.col("core")), F.lit(False)))
    shortened = cores.select(
        F.col("snapshot_id").alias("s"), F.col("field").alias("f"), F.col("core").alias("c"), "longer", "whole"
    )
    met = long.join(shortened, long.snapshot_id.eqNullSafe(F.col("s")) & (long.field == F.col("f")) & (long.core == F.col("c")), "left")
    is_short = F.when(F.col("cut"), F.col("longer") | F.col("whole")).otherwise(F.col("longer") & ~F.col("field").isin(CODE_FIELDS))
    return met.select("snapshot_id", "item_key", "modified_at", "trust", "field", "value", (F.col("says") & ~F.coalesce(is_short, F.lit(False))).alias("counts"))


#: Of the counting values of a field: trust first, then recency, then the key.
def _rank(*by: str) -> object:
    return Window.partitionBy(*by).orderBy(F.desc("trust"), F.desc_nulls_last("modified_at"), F.asc_nulls_last("item_key"))


def surviving_sources(snaps: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """p3_found: snapshot_id, field, source_key; the row with field 'master' names the member with most counting values, then the most trusted, then the latest.

    Empty input gives no rows; a snapshot in which nothing counts still has its master row, by recency.
    """
    members = _trusted(snaps.groupBy("snapshot_id", "item_key").agg(F.max("modified_at").alias("modified_at")), trust)
    judged = stage(judged_values(snaps, trust), "p3-judged")
    w = _rank("snapshot_id", "field")
    fields = judged.filter("counts").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("snapshot_id", "field", F.col("item_key").alias("source_key"))
    tally = judged.groupBy("snapshot_id", "item_key").agg(F.count_if("counts").alias("n")).select(F.col("snapshot_id").alias("s"), F.col("item_key").alias("k"), "n")
    counted = members.join(tally, members.snapshot_id.eqNullSafe(F.col("s")) & members.item_key.eqNullSafe(F.col("k")), "left").select(
        "snapshot_id", "item_key", "modified_at", "trust", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("snapshot_id").orderBy(F.desc("n"), F.desc("trust"), F.desc_nulls_last("modified_at"), F.asc_nulls_last("item_key"))
    master = counted.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("snapshot_id", F.lit("master").alias("field"), F.col("item_key").alias("source_key"))
    return fields.unionByName(master)


def surviving_records(snaps: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """snapshot_id, master_key, fields: the record put together from the surviving values."""
    judged = judged_values(snaps, trust).filter("counts")
    w = _rank("snapshot_id", "field")
    best = judged.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    built = best.groupBy("snapshot_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    master = surviving_sources(snaps, trust).filter("field = 'master'").select(F.col("snapshot_id").alias("s"), F.col("source_key").alias("master_key"))
    return master.join(built, F.col("s").eqNullSafe(built.snapshot_id), "left").select(F.col("s").alias("snapshot_id"), "master_key", "fields")

"""Agreement of a record with what independent authorities say, and fields composed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatrix.functions import similarity, text
from collatrix.operators.dedup import latest

TITLE_MATCH = 0.85
COMPOSED = ["title", "creators", "date", "DOI", "publicationTitle", "itemType"]


def candidates_of(items: DataFrame) -> DataFrame:
    """Items as candidates: cand, title, author, year, venue, doi, family, orcid-free."""
    one = latest(items)
    return one.select(
        F.col("item_key").alias("cand"), "title", text.first_author(F.col("creators")).alias("author"), text.year_of(F.col("pub_date")).alias("year"),
        F.coalesce("publication_title", F.lit("")).alias("venue"), text.doi_key(F.col("doi")).alias("doi"), text.type_family(F.col("item_type")).alias("family"), F.col("item_type").alias("type"))


def authorities_of(records: DataFrame) -> DataFrame:
    """Authority records in the same terms; rec_id gives the order in which they answered."""
    return records.select(
        "rec_id", "source", F.col("title").alias("a_title"), text.first_author(F.col("creators")).alias("a_author"), text.year_of(F.col("year")).alias("a_year"),
        F.coalesce("container_title", F.lit("")).alias("a_venue"), text.doi_key(F.col("doi")).alias("a_doi"), text.type_family(F.col("item_type")).alias("a_family"))


def lookup_by_doi(candidates: DataFrame, authorities: DataFrame) -> DataFrame:
    """Every candidate with each authority record of its DOI; candidates without any keep a row of nulls."""
    return candidates.join(authorities, candidates.doi == authorities.a_doi, "left")


def facts(met: DataFrame) -> DataFrame:
    """Per candidate: author, year and id agreement, consensus of authorities, distinct DOIs. No similarity is needed.

    ``met``: a candidate's columns beside one authority record each (nulls for none).
    """
    year = F.when((F.col("year") == "") | (F.coalesce("a_year", F.lit("")) == ""), 0.0).when(F.col("year") == F.col("a_year"), 1.0).when(F.abs(F.col("year").try_cast("int") - F.col("a_year").try_cast("int")) == 1, 0.5).otherwise(0.0)
    per = met.groupBy("cand").agg(
        F.count("rec_id").alias("n_authorities"),
        F.max(F.when((F.col("author") != "") & (F.col("author") == F.col("a_author")), 1.0).otherwise(0.0)).alias("author"),
        F.max(year).alias("year"),
        F.max(F.when(F.col("doi") == F.col("a_doi"), 1.0).otherwise(0.0)).alias("id"),
        F.first("doi", ignorenulls=True).alias("cand_doi"),
    )
    counts = met.filter("a_doi is not null").groupBy("cand", "a_doi").agg(F.count("*").alias("n"), F.min("rec_id").alias("seen"))
    w = Window.partitionBy("cand").orderBy(F.desc("n"), "seen")
    best = counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("cand", F.col("a_doi").alias("top_doi"), F.col("n").alias("top_n"))
    spread = counts.join(per.select("cand", "cand_doi"), "cand").groupBy("cand").agg(F.count("*").alias("dois"), F.bool_or(F.col("a_doi") == F.col("cand_doi")).alias("own"))
    out = per.join(best, "cand", "left").join(spread, "cand", "left")
    distinct = F.coalesce("dois", F.lit(0)) + F.when(F.col("cand_doi").isNotNull() & ~F.coalesce("own", F.lit(False)), 1).otherwise(0)
    return out.select(
        "cand", "n_authorities", "author", "year", "id", (F.col("id") == 1.0).alias("id_agreement"), (F.coalesce("top_n", F.lit(0)) >= 2).alias("consensus"),
        F.coalesce("top_n", F.lit(0)).alias("consensus_count"), F.when(F.col("top_n") >= 2, F.col("top_doi")).alias("consensus_doi"), (distinct >= 2).alias("id_disagreement"),
        (F.col("cand_doi").isNotNull() & (F.col("n_authorities") == 0)).alias("doi_unresolved"))


def scores(met: DataFrame) -> DataFrame:
    """``facts`` with the title and venue similarities, p_raw, p, the type mismatch and the decision."""
    sim = met.filter("rec_id is not null").select("cand", "family", "type", "a_family", "title",
        F.when(text.is_empty(F.col("title")), 0.0).otherwise(similarity.title_similarity(F.col("title"), F.coalesce("a_title", F.lit("")))).alias("t"),
        F.when(F.col("venue") == "", 0.0).otherwise(similarity.title_similarity(F.col("venue"), F.col("a_venue"))).alias("v"))
    mismatch = (F.coalesce("type", F.lit("")) != "") & (F.coalesce("a_family", F.lit("")) != "") & (F.col("family") != F.col("a_family")) & (F.col("t") >= TITLE_MATCH)
    best = sim.groupBy("cand").agg(F.max("t").alias("title"), F.max("v").alias("venue"), F.bool_or(mismatch).alias("type_mismatch"))
    out = facts(met).join(best, "cand", "left").fillna({"title": 0.0, "venue": 0.0, "type_mismatch": False})
    w = similarity.AGREEMENT_WEIGHTS
    p_raw = sum((F.col(c) * v for c, v in w.items()), F.lit(0.0))
    out = out.withColumn("p_raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p_raw)))
    out = out.withColumn("p", similarity.calibrated(F.col("p_raw"), F.col("consensus")))
    return out.withColumn("decision", decision())


def decision(p="p"):
    """flag, accept or reject; an identifier disagreement always flags."""
    conflict = F.col("id_disagreement") | F.col("doi_unresolved") | F.col("type_mismatch")
    return (
        F.when(F.col("id_disagreement"), "flag")
        .when((F.col(p) >= 0.90) & ~conflict & (F.col("id_agreement") | F.col("consensus")), "accept")
        .when((F.col(p) < 0.55) & ~F.col("id_agreement") & ~conflict & (F.col("n_authorities") > 0), "reject")
        .otherwise("flag")
    )


def library_view(records: DataFrame) -> DataFrame:
    """work (the DOI), rec_id, source, field, value, norm: each authority value in the library's terms, one row per filled field."""
    first = text.first_author(F.col("creators"))
    shown = F.array_join(F.transform(F.coalesce("creators", F.array().cast(records.schema["creators"].dataType)), lambda c: F.coalesce(F.nullif(c["lastName"], F.lit("")), c["name"], F.lit(""))), "; ")
    rows = [
        ("title", F.col("title"), text.title_key(F.col("title"))), ("creators", shown, first), ("date", F.col("year"), text.year_of(F.col("year"))),
        ("DOI", F.col("doi"), F.coalesce(text.doi_key(F.col("doi")), F.lit(""))), ("publicationTitle", F.col("container_title"), text.title_key(F.col("container_title"))),
        ("itemType", text.library_type(F.col("item_type")), F.lower(text.library_type(F.col("item_type")))),
    ]
    each = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), n.alias("norm")) for f, v, n in rows])
    return records.select(text.doi_key(F.col("doi")).alias("work"), "rec_id", F.coalesce("source", F.lit("authority")).alias("source"), F.explode(each).alias("x")).select(
        "work", "rec_id", "source", "x.field", "x.value", "x.norm").filter("work is not null and value is not null and value <> '' and norm <> ''")


def consensus_fields(records: DataFrame) -> DataFrame:
    """work, field, value, sources: the value on whose normal form at least two distinct sources agree.

    Of several such forms the one whose first record answered first; its value is that of this record.
    """
    v = library_view(records)
    g = v.groupBy("work", "field", "norm").agg(F.countDistinct("source").alias("n"), F.min("rec_id").alias("first"), F.min_by("value", "rec_id").alias("value"), F.array_sort(F.collect_set("source")).alias("sources"))
    w = Window.partitionBy("work", "field").orderBy("first", "norm")
    return g.filter("n >= 2").withColumn("r", F.row_number().over(w)).filter("r = 1").select("work", "field", "value", F.array_join("sources", ",").alias("sources"))


def composed(items: DataFrame, records: DataFrame, accepted: DataFrame) -> DataFrame:
    """cand, field, value, origin: for accepted candidates consensus, then the agreeing authority, then the candidate; for
    others the candidate's own values, authorities only filling gaps.

    ``accepted``: cand, accept (boolean).
    """
    one = latest(items)
    first = text.first_author(F.col("creators"))
    shown = F.array_join(F.transform("creators", lambda c: F.coalesce(F.nullif(c["lastName"], F.lit("")), c["name"], F.lit(""))), "; ")
    rows = [
        ("title", F.col("title"), text.title_key(F.col("title"))), ("creators", shown, first), ("date", F.col("pub_date"), text.year_of(F.col("pub_date"))), ("DOI", F.col("doi"), F.coalesce(text.doi_key(F.col("doi")), F.lit(""))),
        ("publicationTitle", F.col("publication_title"), text.title_key(F.col("publication_title"))), ("itemType", text.library_type(F.col("item_type")), F.lower(text.library_type(F.col("item_type")))),
    ]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(v, F.lit("")).alias("own"), F.coalesce(n, F.lit("")).alias("own_norm")) for f, v, n in rows])
    own = one.select(F.col("item_key").alias("cand"), text.doi_key(F.col("doi")).alias("work"), F.explode(each).alias("x")).select("cand", "work", "x.field", "x.own", "x.own_norm")
    v = library_view(records)
    agreed = consensus_fields(records).select("work", "field", F.col("value").alias("c_value"), "sources")
    own = own.join(accepted, "cand", "left").join(agreed, ["work", "field"], "left")
    one_source = v.groupBy("work", "field", "norm").agg(F.min_by(F.struct("source", "value"), "rec_id").alias("m"))
    own = own.join(one_source.select("work", "field", F.col("norm").alias("own_norm"), "m"), ["work", "field", "own_norm"], "left")
    gap = v.groupBy("work", "field").agg(F.min_by(F.struct("source", "value"), "rec_id").alias("g"))
    own = own.join(gap, ["work", "field"], "left")
    ok = F.coalesce("accept", F.lit(False))
    label = F.concat(F.lit("consensus:"), F.col("sources"))
    value = F.when(ok, F.coalesce("c_value", "m.value", "own")).otherwise(F.coalesce("own", "c_value", "g.value"))
    origin = F.when(ok, F.when(F.col("c_value").isNotNull(), label).when(F.col("m.value").isNotNull(), F.col("m.source")).otherwise("candidate")).otherwise(
        F.when(F.col("own").isNotNull(), "candidate").otherwise(F.concat(F.coalesce(label, F.col("g.source")), F.lit(" (gap-fill; unverified)"))))
    return own.select("cand", "field", value.alias("value"), origin.alias("origin")).filter("value is not null")

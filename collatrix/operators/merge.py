"""Merging records as set-wise table differences: projection of a merge, the checks on its result, undoing it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.functions import text
from collatrix.operators.dedup import latest

#: Fields that are identity, structure or state and never come from another record.
KEPT = ["citation_key", "item_key", "item_type", "version", "deleted", "collections", "tags", "relations", "creators", "date_added", "date_modified"]
SCALARS = ["title", "pub_date", "doi", "volume", "issue", "edition", "university", "abstract_note", "publisher", "publication_title", "extra"]
REPLACES = "dc:replaces"
_TAG = "array<struct<tag: string, type: int>>"


def plan(jobs: DataFrame) -> DataFrame:
    """job_id, master, member, pos, fields (chosen source per field): one row per member of a merge, masters first.

    The master is the job's pick, or else the least member key. Jobs without two distinct non-null members give nothing.
    """
    members = F.array_distinct(F.filter("member_keys", lambda k: k.isNotNull()))
    j = jobs.select("job_id", members.alias("m"), "master", F.coalesce("field_sources", F.create_map().cast("map<string,string>")).alias("fields")).filter(F.size("m") > 1)
    master = F.when(F.array_contains("m", F.col("master")), F.col("master")).otherwise(F.array_min("m"))
    j = j.withColumn("master", master)
    return j.select("job_id", "master", F.posexplode(F.concat(F.array("master"), F.filter("m", lambda k: k != F.col("master")))).alias("pos", "member"), "fields")


def snapshot(members: DataFrame, items: DataFrame) -> DataFrame:
    """The before-image: each member beside its item (nulls where the item is gone)."""
    return members.join(latest(items), members.member == F.col("item_key"), "left")


def _long(df: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in SCALARS])
    return df.select("job_id", "master", "member", "pos", "fields", F.explode(each).alias("x")).select("job_id", "master", "member", "pos", "fields", "x.field", "x.value")


def projected_fields(snap: DataFrame, smart_fill: bool = False) -> DataFrame:
    """job_id, master, field, value: the survivor's scalar fields after the merge.

    A field's chosen source supplies it if it isn't empty there; with ``smart_fill`` an empty field takes the first filled
    value of the other members in their order. ``extra`` keeps the survivor's citation key and gains the keys and aliases of
    the others as aliases.
    """
    long = _long(snap)
    own = long.filter("pos = 0").select("job_id", "master", "field", "fields", F.col("value").alias("own"))
    chosen = long.filter("pos >= 0").select("job_id", "field", "member", "value").filter(~text.is_empty(F.col("value")))
    pick = own.withColumn("source", F.try_element_at("fields", "field")).join(chosen.withColumnRenamed("member", "source"), ["job_id", "field", "source"], "left")
    if smart_fill:
        fill = long.filter("pos > 0 and value is not null and value <> ''").groupBy("job_id", "field").agg(F.min_by("value", "pos").alias("fill"))
        pick = pick.join(fill, ["job_id", "field"], "left")
    else:
        pick = pick.withColumn("fill", F.lit(None).cast("string"))
    value = F.when((F.col("field") == "extra") & F.col("value").isNotNull() & (F.col("source") != F.col("master")), text.extra_keeping_identity(F.col("own"), F.col("value"))).otherwise(
        F.coalesce("value", F.nullif(F.col("own"), F.lit("")), "fill", "own"))
    keys = F.array_compact(F.concat(F.array(F.nullif(F.col("citation_key"), F.lit("")), text.pinned_key(F.col("extra"))), text.alias_keys(F.col("extra"))))
    others = snap.filter("pos > 0").select("job_id", F.struct("pos", keys.alias("k")).alias("p")).groupBy("job_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["k"])).alias("aliases"))
    out = pick.select("job_id", "master", "field", value.alias("value")).join(others, "job_id", "left")
    gained = (F.col("field") == "extra") & (F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0)
    return out.select("job_id", "master", "field", F.when(gained, text.with_aliases(F.col("value"), F.col("aliases"))).otherwise(F.col("value")).alias("value"))


def projected_sets(snap: DataFrame) -> DataFrame:
    """job_id, master, collections, tags (names and types), relations: unions over the members in their order.

    Relations gain one ``dc:replaces`` entry for each merged-away member. All arrays are sorted and distinct.
    """
    empty = F.array().cast("array<string>")
    cols = snap.select("job_id", "master", F.explode(F.coalesce("collections", empty)).alias("c")).groupBy("job_id", "master").agg(F.array_sort(F.collect_set("c")).alias("collections"))
    tags = snap.select("job_id", F.explode(F.coalesce(F.col("tags").cast(_TAG), F.array().cast(_TAG))).alias("t")).filter("t is not null")
    tags = tags.select("job_id", F.concat_ws("#", "t.tag", F.coalesce("t.type", F.lit(0)).cast("string")).alias("t")).groupBy("job_id").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    rel = snap.select("job_id", F.explode("relations").alias("p", "targets")).select("job_id", "p", F.explode("targets").alias("t")).filter("t is not null")
    gone = snap.filter("pos > 0").select("job_id", F.lit(REPLACES).alias("p"), F.col("member").alias("t"))
    rel = rel.unionByName(gone).groupBy("job_id").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "p", "t"))).alias("relations"))
    base = snap.filter("pos = 0").select("job_id", "master")
    out = base.join(cols.drop("master"), "job_id", "left").join(tags, "job_id", "left").join(rel, "job_id", "left")
    return out.select("job_id", "master", *[F.coalesce(c, empty).alias(c) for c in ("collections", "tags", "relations")])


def observed_sets(items: DataFrame, masters: DataFrame) -> DataFrame:
    """The same three sets as they stand in ``items`` for each (job_id, master)."""
    empty = F.array().cast("array<string>")
    one = masters.select("job_id", "master").distinct().join(latest(items), F.col("master") == F.col("item_key"), "left")
    tags = F.transform(F.coalesce(F.col("tags").cast(_TAG), F.array().cast(_TAG)), lambda t: F.concat_ws("#", t["tag"], F.coalesce(t["type"], F.lit(0)).cast("string")))
    rel = F.flatten(F.transform(F.map_entries(F.coalesce("relations", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(F.coalesce(e["value"], empty), lambda t: F.concat_ws(" ", e["key"], t))))
    return one.select("job_id", "master", F.array_sort(F.array_distinct(F.coalesce("collections", empty))).alias("collections"), F.array_sort(F.array_distinct(tags)).alias("tags"), F.array_sort(F.array_distinct(rel)).alias("relations"))


def checks(members: DataFrame, before: DataFrame, after: DataFrame, children_before: DataFrame | None = None, children_after: DataFrame | None = None, smart_fill: bool = False) -> DataFrame:
    """job_id, number, name, passed: the integrity checks of each merge, ``before`` and ``after`` as items tables.

    ``children``: child_key, parent_key, kind (note, attachment, annotation), md5, filename; without them checks 7 to 10 pass.
    A missing master fails check 0 and has no other row.
    """
    snap = snapshot(members, before)
    base = members.filter("pos = 0").select("job_id", "master")
    now = latest(after)
    present = base.join(now.select(F.col("item_key").alias("master"), F.col("item_type").alias("now_type"), F.col("citation_key").alias("now_ck"), F.col("extra").alias("now_extra")), "master", "left").withColumn("there", F.lit(True))
    exists = base.join(now.select(F.col("item_key").alias("master")), "master", "left_semi").select("job_id")
    rows = [base.join(exists.withColumn("ok", F.lit(True)), "job_id", "left").select("job_id", F.lit(0).alias("number"), F.lit("master-present").alias("name"), F.coalesce("ok", F.lit(False)).alias("passed"))]

    def row(df: DataFrame, number: int, name: str, passed) -> None:
        rows.append(df.select("job_id", F.lit(number).alias("number"), F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed")))

    kinds = snap.groupBy("job_id").agg(F.countDistinct(F.coalesce("item_type", F.lit("\0"))).alias("n"), F.max(F.when(F.col("pos") == 0, F.col("item_type"))).alias("was"))
    row(present.join(kinds, "job_id"), 1, "item-type-equality", (F.col("n") == 1) & F.col("was").eqNullSafe(F.col("now_type")))
    drift = snap.filter("pos > 0").select("job_id", "member", "version").join(now.select(F.col("item_key").alias("member"), F.col("version").alias("v")), "member", "left")
    row(base.join(drift.groupBy("job_id").agg(F.bool_and(F.col("version").eqNullSafe(F.col("v"))).alias("same")), "job_id", "left"), 2, "version-drift", F.coalesce("same", F.lit(True)))
    want = projected_fields(snap, smart_fill).filter("field is not null")
    have = now.select(F.col("item_key").alias("master"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("have")) for c in SCALARS])).alias("x")).select("master", "x.field", "x.have")
    scal = want.join(have, ["master", "field"], "left").groupBy("job_id").agg(F.bool_and(F.coalesce("value", F.lit("")) == F.coalesce("have", F.lit(""))).alias("same"))
    row(base.join(scal, "job_id", "left"), 3, "master-scalar-preservation", F.col("same"))
    sets = projected_sets(snap).join(observed_sets(after, base).select("job_id", *[F.col(c).alias(f"now_{c}") for c in ("collections", "tags", "relations")]), "job_id")
    row(sets, 4, "collections-equality", F.col("collections") == F.col("now_collections"))
    row(sets, 5, "tags-superset", F.size(F.array_except("tags", "now_tags")) == 0)
    row(sets, 6, "relations-bounds", F.col("relations") == F.col("now_relations"))
    if children_before is not None and children_after is not None:
        kids = members.join(children_before, members.member == F.col("parent_key")).select("job_id", "master", "child_key", "kind", "md5", "filename")
        seen = kids.join(children_after.select("child_key", F.col("parent_key").alias("now_parent"), F.col("md5").alias("now_md5"), F.col("filename").alias("now_file")), "child_key", "left")
        g = seen.groupBy("job_id").agg(
            F.bool_and(F.coalesce(F.col("now_parent") == F.col("master"), F.lit(False)) | (F.col("kind") == "annotation")).alias("home"),
            F.bool_and((F.col("kind") != "attachment") | (F.col("md5").eqNullSafe(F.col("now_md5")) & F.col("filename").eqNullSafe(F.col("now_file")))).alias("stored"),
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("note", "attachment", "annotation")],
        )
        there = base.join(children_after, F.col("master") == F.col("parent_key")).groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(f"m_{k}") for k in ("note", "attachment")])
        marks = kids.filter("kind = 'attachment'").select("job_id", F.col("child_key").alias("att"))
        was = marks.join(children_before.filter("kind = 'annotation'"), F.col("att") == F.col("parent_key")).groupBy("job_id", "att").agg(F.count("*").alias("was"))
        is_ = marks.join(children_after.filter("kind = 'annotation'"), F.col("att") == F.col("parent_key")).groupBy("job_id", "att").agg(F.count("*").alias("is"))
        ann = was.join(is_, ["job_id", "att"], "full").groupBy("job_id").agg(F.bool_and(F.coalesce("was", F.lit(0)) == F.coalesce("is", F.lit(0))).alias("marks"))
        g = base.join(g, "job_id", "left").join(there, "job_id", "left").join(ann, "job_id", "left")
        row(g, 7, "child-completeness", F.coalesce("home", F.lit(True)))
        row(g, 8, "note-parity", F.coalesce("n_note", F.lit(0)) == F.coalesce("m_note", F.lit(0)))
        row(g, 8, "attachment-parity", F.coalesce("n_attachment", F.lit(0)) == F.coalesce("m_attachment", F.lit(0)))
        row(g, 9, "annotation-parity", F.coalesce("marks", F.lit(True)))
        row(g, 10, "storage-integrity", F.coalesce("stored", F.lit(True)))
    own = snap.filter("pos = 0").select("job_id", text.citation_key(F.col("extra"), F.col("citation_key")).alias("was_key"))
    row(present.join(own, "job_id"), 11, "citekey-preservation", F.col("was_key").eqNullSafe(text.citation_key(F.col("now_extra"), F.col("now_ck"))))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r.join(exists, "job_id", "left_semi"))
    return out


def by_job(members: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` and their items with keys led by the job, so that each job has its own copy of an item that several share."""
    own = lambda c: F.concat_ws("/", F.col("job_id").cast("string"), c)
    one = members.select("job_id", "member").distinct().join(latest(items), F.col("member") == F.col("item_key"))
    copies = one.select(*[own(F.col(c)).alias(c) if c == "item_key" else F.col(c) for c in items.columns])
    keyed = members.withColumn("fields", F.transform_values("fields", lambda _, v: F.when(v.isNotNull(), own(v))))
    return keyed.withColumn("master", own(F.col("master"))).withColumn("member", own(F.col("member"))), copies


def applied(items: DataFrame, members: DataFrame, smart_fill: bool = False) -> DataFrame:
    """The items table after all merges: survivors with their projected fields and sets, the others in the trash.

    Only columns of the items table; items in no merge stay as they are.
    """
    one = latest(items)
    snap = snapshot(members, items)
    wide = projected_fields(snap, smart_fill).groupBy("master").pivot("field", SCALARS).agg(F.first("value"))
    wide = wide.select("master", *[F.col(c).alias(f"new_{c}") for c in SCALARS])
    sets = projected_sets(snap).select("master", F.col("collections").alias("new_collections"), F.col("tags").alias("new_tags"), F.col("relations").alias("new_relations"))
    trash = members.filter("pos > 0").select(F.col("member").alias("item_key")).distinct().withColumn("trash", F.lit(True))
    x = one.join(wide, one.item_key == wide.master, "left").join(sets.withColumnRenamed("master", "set_master"), one.item_key == F.col("set_master"), "left").join(trash, "item_key", "left")
    merged = F.col("set_master").isNotNull()
    tags = F.transform("new_tags", lambda t: F.struct(F.regexp_replace(t, "#-?[0-9]+$", "").alias("tag"), F.regexp_extract(t, "#(-?[0-9]+)$", 1).cast("int").alias("type")))
    pairs = F.transform("new_relations", lambda r: F.struct(F.substring_index(r, " ", 1).alias("p"), F.regexp_replace(r, r"^\S+ ", "").alias("t")))
    relations = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["p"])), lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p["p"] == k), lambda p: p["t"]))))
    out = []
    for c in one.columns:
        if c in SCALARS:
            out.append(F.when(merged, F.col(f"new_{c}")).otherwise(one[c]).alias(c))
        elif c == "collections":
            out.append(F.when(merged, F.col("new_collections")).otherwise(one[c]).alias(c))
        elif c == "tags":
            out.append(F.when(merged, tags.cast(one.schema[c].dataType)).otherwise(one[c]).alias(c))
        elif c == "relations":
            out.append(F.when(merged, relations.cast(one.schema[c].dataType)).otherwise(one[c]).alias(c))
        elif c == "deleted":
            out.append(F.coalesce("trash", one[c]).alias(c))
        else:
            out.append(one[c])
    return x.select(*out)


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, value_a, value_b of every field in which two tables differ for a key, null-safe; keys of either side count."""
    long = lambda df, v: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in fields])).alias("x")).select(key, "x.field", F.col("x.v").alias(v))
    both = long(a, "value_a").join(long(b, "value_b"), [key, "field"], "full")
    return both.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def undo(members: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """job_id, item_key, step: what undoing each merge takes: revert a changed survivor, restore what is in the trash, recreate what is gone."""
    snap = snapshot(members, before)
    now = latest(after).select(F.col("item_key").alias("k"), F.coalesce("deleted", F.lit(False)).alias("trashed"), *[F.col(c).alias(f"now_{c}") for c in SCALARS])
    x = snap.join(now, snap.member == F.col("k"), "left")
    changed = F.lit(False)
    for c in SCALARS:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    step = F.when(F.col("k").isNull(), "recreate").when((F.col("pos") > 0) & F.col("trashed"), "restore").when((F.col("pos") == 0) & changed, "revert").otherwise("none")
    return x.select("job_id", F.col("member").alias("item_key"), step.alias("step"))

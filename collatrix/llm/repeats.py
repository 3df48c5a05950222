"""Problem 6: near-duplicate records with small edits, by adaptive multi-match prefixes.

A record is its creators' names and a weighted set of title words, misspelt ones replaced by a more frequent spelling
within one error; rare words weigh more. Two records can only be of one work if they share a creator (where both name
any), so each candidate key holds one name. Of the title words, ordered by rarity, two sets of weighted Jaccard
similarity J or more share at least l words of their prefixes, if a prefix ends where the weight after it and the l - 1
heaviest words together stay under J times the whole. A longer prefix with more required matches costs more look-ups but
meets fewer strangers; each record takes, for each of its names, the l whose estimated candidates (from the rarity of the
name and of the words in the prefix) plus look-ups are least, and the l words form one join key with the name, so that
frequent words never meet alone. The index of a name holds only the levels that some record of this name asks for. A name
by which few records ask needs no keys: its records meet as they are, and the pairs whose prefixes share l words stay.
Candidates whose years, parts or DOIs contradict leave in the join; the others are verified record by record, and a record
without a DOI goes to the best-scoring DOI only, before the links are closed into groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatrix.llm import works
from collatrix.llm.components import components
from collatrix.llm.names import misspelt, similar_tokens
from collatrix.session import release, stage

#: Least weighted Jaccard similarity of title words for which no pair is missed, of main titles and of whole ones.
JACCARD = {"m": 0.4, "w": 0.5}
#: Longest multi-match considered.
MOST = 3
#: What one verification costs in look-ups.
VERIFY_COST = 30.0
#: An organisation enters by so many of its rarest words: forms of one organisation differ in one word at most, or in all
#: but the place, which is rare.
ORG_PREFIX = 3
#: Names by which so many records ask at most are met directly; each record of such a name is compared with these only.
FEW = 128


def elements(prepared: DataFrame) -> DataFrame:
    """id (one row each), family, el, distinct: names of persons (n), words of each organisation (o0, o1, ...), words of the main title (m) and, where it is longer, of the whole title (w)."""
    name = lambda n: F.concat(F.lit("n:"), n)
    short = F.when((F.size("mains") <= 2) & F.col("year").isNotNull(), F.array(F.concat(F.lit("y:"), F.col("year").cast("string")))).otherwise(F.array().cast("array<string>"))
    each = F.concat(
        F.array(
            F.struct(F.lit("n").alias("family"), F.transform("names", name).alias("els")),
            F.struct(F.lit("m").alias("family"), F.concat("mains", short).alias("els")),
            F.struct(F.lit("w").alias("family"), F.when(F.size("words") > F.size("mains"), F.col("words")).alias("els")),
        ),
        F.transform("orgs", lambda ws, i: F.struct(F.concat(F.lit("o"), i.cast("string")).alias("family"), F.transform(ws, name).alias("els"))),
    )
    return prepared.select("id", F.explode(each).alias("x")).select("id", "x.family", F.explode(F.array_distinct("x.els")).alias("el"))


def spellings(long: DataFrame) -> DataFrame:
    """a, right: misspelt elements of ``long`` (id, family, el) and the most frequent spelling within one error of each, which is no misspelling of another."""
    df = stage(long.filter("family <> 'w'").groupBy("el").agg(F.count("*").alias("df")), "p6-df")
    plain = df.filter(~F.col("el").rlike(r"\d|^y:"))
    near = similar_tokens(plain.select(F.col("el").alias("t")))
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # names only stand for names, words for words
    near = near.filter(F.col("a").startswith("n:") == F.col("b").startswith("n:"))
    near = near.join(df.select(F.col("el").alias("a"), F.col("df").alias("da")), "a").join(df.select(F.col("el").alias("b"), F.col("df").alias("db")), "b")
    better = near.filter(misspelt(F.col("da"), F.col("db")) & (F.struct("db", "b") > F.struct("da", "a")))
    right = stage(better.groupBy("a").agg(F.max_by("b", F.struct("db", "b")).alias("right")), "p6-right")
    while True:  # a spelling may be a misspelling of a third one; frequencies rise along the way, so it ends
        ahead = right.select(F.col("a").alias("right"), F.col("right").alias("beyond"))
        further = stage(right.join(ahead, "right", "left").select("a", F.coalesce("beyond", "right").alias("right"), F.col("beyond").isNotNull().alias("moved")), "p6-right")
        moved = not further.filter("moved").isEmpty()
        release(right)
        right = further
        if not moved:
            release(df)
            return right


def respelled(long: DataFrame, right: DataFrame) -> DataFrame:
    """``long`` with misspelt elements in their right spelling."""
    return long.join(right.select(F.col("a").alias("el"), "right"), "el", "left").select("id", "family", F.coalesce("right", "el").alias("el")).distinct()


def _tuples(xs: Column, l: int, of) -> Column:
    """``of(list of l columns)`` for every l elements of an array, in order."""
    n = F.size(xs)
    if l == 1:
        return F.transform(xs, lambda x: of([x]))
    if l == 2:
        return F.flatten(F.transform(xs, lambda x, i: F.transform(F.slice(xs, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: of([x, y]))))
    return F.flatten(F.flatten(F.transform(xs, lambda x, i: F.transform(
        F.slice(xs, i + 2, F.greatest(n - i - 1, F.lit(0))),
        lambda y, j: F.transform(F.slice(xs, i + j + 3, F.greatest(n - i - j - 2, F.lit(0))), lambda z: of([x, y, z]))))))


def _met(shares: Column, l: int) -> Column:
    """Sum over all l of the shares of their products, by power sums."""
    power = lambda k: F.aggregate(shares, F.lit(0.0), lambda t, x: t + F.pow(x, F.lit(k)))
    p = [power(k) for k in (1, 2, 3)]
    return (p[0], (p[0] * p[0] - p[1]) / 2, (p[0] * p[0] * p[0] - 3 * p[0] * p[1] + 2 * p[2]) / 6)[l - 1]


def _choose(n: Column, l: int) -> Column:
    return (n, n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6)[l - 1].cast("double")


def _reaching(top: Column) -> Column:
    return F.size(F.filter("from", lambda x: x + top >= F.col("need") - 1e-9))


def _prefixes(weighed: DataFrame, total: float, jaccard: dict[str, float], most: int) -> DataFrame:
    """family, id, els (rarest first, hashed), k1 ... (length of the prefix of each level; 0 where the level can't be used), t1 ... (share of records one meets)."""
    w = -F.log(F.col("df") / total) + 0.5
    s = weighed.groupBy("family", "id").agg(F.array_sort(F.collect_list(F.struct((-w).alias("w"), "el", "df"))).alias("e"))
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t - x["w"])
    s = s.select("family", "id", F.transform("e", lambda x: F.xxhash64(x["el"])).alias("els"), F.transform("e", lambda x: x["df"] / total).alias("shares"),
                 F.transform("e", lambda _, i: weight(F.slice("e", i + 1, F.size("e")))).alias("from"))
    whole = F.element_at("from", 1)
    need = F.when(F.col("family") == "m", F.lit(jaccard["m"])).otherwise(F.lit(jaccard["w"])) * whole
    s = s.withColumn("need", need)
    for l in range(1, most + 1):
        # an element is in the prefix while the weight from it on, with the l - 1 heaviest, still reaches what is needed
        top = whole - F.coalesce(F.get("from", F.lit(l - 1)), F.lit(0.0)) if l > 1 else F.lit(0.0)
        k = _reaching(top)
        k = F.when((k >= l) & (top < F.col("need") - 1e-9), k).otherwise(0)
        s = s.withColumn(f"k{l}", k).withColumn(f"t{l}", _met(F.slice("shares", 1, F.col(f"k{l}")), l))
    return s.drop("shares", "from", "need")


def candidates(sets: DataFrame, facts: DataFrame, jaccard: dict[str, float] = JACCARD, most: int = MOST) -> DataFrame:
    """(a, b), a < b: pairs of ids whose words may reach the similarity, that share a name or, if one has none, the year, and whose facts don't contradict.

    A record without title words meets those with the same names, year and first letter of the venue.
    ``sets``: id, family, el, one row per element, as ``elements`` gives them; ``facts``: id, year, about, doi, part, cut, venue, and
    side if records of several tables stand in one (see ``grouped``), which never meet.
    """
    facts = facts if "side" in facts.columns else facts.withColumn("side", F.lit(0))
    words, people = sets.filter("family in ('m', 'w')"), sets.filter("family not in ('m', 'w')")
    total = float(max(facts.count(), 1))
    df = words.groupBy("family", "el").agg(F.count("*").alias("df"))
    s = stage(_prefixes(words.join(df, ["family", "el"]), total, jaccard, most), "p6-prefixes")

    # names: of an organisation the rarest words; of records without any the year, under which all dated records stand
    people = people.join(facts.select("id", "side"), "id").select("id", "family", F.concat_ws("/", "side", "el").alias("el"))
    n_df = people.groupBy("el").agg(F.countDistinct("id").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id", "family").orderBy("df", "el"))
    people = people.join(n_df, "el").withColumn("r", rank).filter((F.col("family") == "n") | (F.col("r") <= ORG_PREFIX)).select("id", F.col("el").alias("name"), "df").distinct()
    people = stage(people, "p6-people")
    dated = facts.filter("year is not null").select("id", F.concat_ws("/", "side", F.lit("y"), "year").alias("name"))
    in_year = dated.groupBy("name").agg(F.count("*").alias("df"))
    lone = dated.join(people.select("id").distinct(), "id", "left_anti").withColumn("asks", F.lit(True))
    years = dated.join(lone, ["id", "name"], "left").join(in_year, "name").select("id", "name", "df", F.coalesce("asks", F.lit(False)).alias("asks"))
    names = people.withColumn("asks", F.lit(True)).unionByName(years.join(lone.select("name").distinct(), "name", "left_semi"))

    # the level each record takes for each name, and the levels its name is looked up by
    cost = []
    for l in range(1, most + 1):
        cost.append(F.when(F.col(f"k{l}") > 0, VERIFY_COST * F.col("df") * F.col(f"t{l}") + _choose(F.col(f"k{l}"), l)).otherwise(F.lit(1e18)))
    least = F.least(*cost) if most > 1 else cost[0]
    pick = F.lit(1)
    for l in range(most, 0, -1):
        pick = F.when(cost[l - 1] <= least, F.lit(l)).otherwise(pick)
    # what must not contradict travels with the keys: the mark of texts about works in the key itself, the rest as numbers
    told = facts.select("id", "year", F.coalesce("about", F.lit("")).alias("about"), F.xxhash64(F.left("doi", F.lit(14))).alias("doi"), F.col("doi").isNotNull().alias("known"),
                        F.when(F.coalesce("part", F.lit("")) == "", 0).otherwise(F.xxhash64("part")).alias("part"), F.coalesce("cut", F.lit(False)).alias("cut"), "side")
    told = told.withColumn("doi", F.when(F.col("known"), F.col("doi"))).drop("known")
    kept = ["id", "year", "doi", "part", "cut", "side"]
    lengths = [f"k{l}" for l in range(1, most + 1)]
    rows = stage(s.join(names, "id").join(told, "id").select(*kept, "about", "family", "name", "asks", pick.alias("pick"), "els", *lengths), "p6-rows")
    levels = rows.filter("asks").groupBy("family", "name").agg(F.collect_set("pick").alias("levels"), F.count("*").alias("askers"))
    rows = stage(rows.join(levels, ["family", "name"]).select(*kept, F.xxhash64("family", "name", "about").alias("f"), "asks", "pick", "els", *lengths, "levels", "askers"), "p6-asked")
    close, many = rows.filter(F.col("askers") <= FEW), rows.filter(F.col("askers") > FEW)

    def keys(of: DataFrame, level: Column) -> DataFrame:
        x = of.select(*kept, level.alias("l"), "f", "els", *lengths)
        hashed = F.array().cast("array<bigint>")
        for l in range(1, most + 1):
            hashed = F.when(F.col("l") == l, _tuples(F.slice("els", 1, F.col(f"k{l}")), l, lambda xs: F.xxhash64(*xs))).otherwise(hashed)
        return x.select(*kept, "l", "f", F.explode(hashed).alias("h")).select(*kept, F.xxhash64("l", "f", "h").alias("key"))

    untitled = facts.join(words.select("id").distinct(), "id", "left_anti").select("id").withColumn("bare", F.lit(True))
    crew = people.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("crew"))
    whole = facts.filter("year is not null and venue is not null and size(venue) > 0").select("id", F.left(F.get("venue", F.lit(0)), F.lit(1)).alias("v")).join(crew, "id").join(told, "id")
    whole = whole.select(*kept, F.xxhash64(F.lit("u"), "crew", "year", "v", "about").alias("key")).join(untitled, "id", "left")
    bare, full = whole.filter("bare").select(*kept, "key"), whole.select(*kept, "key")
    probes = keys(many.filter("asks"), F.col("pick")).unionByName(bare).alias("a")
    index = keys(many.withColumn("level", F.explode("levels")), F.col("level")).unionByName(full).alias("b")
    met = probes.join(index, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & works.may_match("a", "b"))
    met = met.select("a.id", F.col("b.id").alias("other")).unionByName(_met_directly(close.drop("levels", "askers"), most))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _met_directly(rows: DataFrame, most: int) -> DataFrame:
    """id, other: what keys of l words would find for the records that ask, without keys: pairs of one name (f) whose facts don't contradict and whose prefixes share l words."""
    prefixes = F.array(*(F.slice("els", F.lit(1), F.col(f"k{l}")) for l in range(1, most + 1)))
    rows = rows.withColumn("prefixes", prefixes).drop(*(f"k{l}" for l in range(1, most + 1)))
    a, b = rows.filter("asks").alias("a"), rows.alias("b")

    def share(asking: str) -> Column:
        # both prefixes have the length of the level that one of them asks for
        l = F.col(f"{asking}.pick")
        return F.size(F.array_intersect(F.get("a.prefixes", l - 1), F.get("b.prefixes", l - 1))) >= l

    # of two records that both ask, each pair comes once
    once = F.when(F.col("b.asks"), F.col("a.id") < F.col("b.id")).otherwise(F.col("a.id") != F.col("b.id"))
    # in this order, the cheapest first; a filter after the join would be asked before its conditions
    met = a.join(b, (F.col("a.f") == F.col("b.f")) & once & works.may_match("a", "b") & F.arrays_overlap("a.els", "b.els") & (share("a") | (F.col("b.asks") & share("b"))))
    return met.select("a.id", F.col("b.id").alias("other"))


def grouped(prepared: DataFrame, given, right: DataFrame | None = None) -> DataFrame:
    """id, work of prepared records (staged, id long): equal ``work`` (the least id) is one work.

    ``right``: ``spellings`` of a larger table. A column ``side`` tells tables apart that are grouped at once, each for itself: DOIs of
    side 0 (the default) were assigned by authorities, those of others may be of other works and neither link nor part.
    """
    prepared = prepared if "side" in prepared.columns else prepared.withColumn("side", F.lit(0))
    copies = stage(prepared.join(prepared.groupBy("side", "data").agg(F.min("id").alias("rep")), ["side", "data"]).select("id", "rep"), "p6-copies")
    one = prepared.join(copies.filter("id = rep").select("id"), "id")
    # what says nothing isn't equal to what says nothing
    blank = (F.size("words") == 0) & (F.size("names") == 0) & (F.size("orgs") == 0) & F.col("doi").isNull()
    one = stage(one.withColumn("blank", blank), "p6-one")
    lone = one.filter("blank").select(F.col("id").alias("rep"))
    long = elements(one.filter("not blank"))
    sets = stage(respelled(long, spellings(long) if right is None else right), "p6-elements")
    pairs = stage(candidates(sets, one.select("id", "year", "about", "doi", "part", "cut", "venue", "side")), "p6-pairs")
    data = one.select("id", "data", "doi", "side")
    a, b = data.select(F.col("id").alias("a"), F.col("data").alias("data_a"), (F.col("side") == 0).alias("trusted")), data.select(F.col("id").alias("b"), F.col("data").alias("data_b"))
    links = stage(works.scored(pairs.join(a, "a").join(b, "b"), given), "p6-links")
    release(pairs, sets)
    assigned = data.filter("side = 0 and doi is not null").select("id", "doi")
    heads = assigned.groupBy("doi").agg(F.min("id").alias("head"))
    same_doi = assigned.join(heads, "doi").filter("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst"))
    # a record without a DOI belongs to one DOI at most: that of its best link
    da, db = assigned.select(F.col("id").alias("a"), F.col("doi").alias("doi_a")), assigned.select(F.col("id").alias("b"), F.col("doi").alias("doi_b"))
    l = stage(links.join(da, "a", "left").join(db, "b", "left"), "p6-dois")
    toward = l.filter("doi_a is null and doi_b is not null").select(F.col("a").alias("id"), F.col("doi_b").alias("doi"), "score").unionByName(
        l.filter("doi_b is null and doi_a is not null").select(F.col("b").alias("id"), F.col("doi_a").alias("doi"), "score"))
    best = stage(toward.groupBy("id").agg(F.max_by("doi", F.struct("score", "doi")).alias("best")), "p6-best")
    ba, bb = best.select(F.col("id").alias("a"), F.col("best").alias("best_a")), best.select(F.col("id").alias("b"), F.col("best").alias("best_b"))
    l = l.join(ba, "a", "left").join(bb, "b", "left").withColumn("x", F.coalesce("doi_a", "best_a")).withColumn("y", F.coalesce("doi_b", "best_b"))
    kept = l.filter("x is null or y is null or x = y").select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(same_doi)
    text = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    groups = components(one.select(text("id").alias("id")), kept.select(text("src").alias("src"), text("dst").alias("dst")))
    groups = stage(groups.select(F.col("id").cast("long").alias("rep"), F.col("group").cast("long").alias("work")), "p6-groups")
    release(links, l, best)
    out = copies.join(groups, "rep").join(lone.withColumn("alone", F.lit(True)), "rep", "left")
    return out.select("id", F.when(F.col("alone"), F.col("id")).otherwise(F.col("work")).alias("work"))


def prepared_records(records: DataFrame, given) -> DataFrame:
    """The staged prepared form of authority_records, one row per distinct non-null rec_id; records alike in all that is read are parsed once."""
    raw = works.authority(records.filter("rec_id is not null").dropDuplicates(["rec_id"]))
    rest = [c for c in raw.columns if c != "id"]
    raw = raw.withColumn("content", F.xxhash64(*rest)).withColumn("content", F.concat_ws("/", F.col("content").cast("string"), F.md5(F.to_json(F.struct(*rest)))))
    raw = stage(raw, "p6-raw")
    heads = raw.groupBy("content").agg(F.min("id").alias("id"))
    distinct = works.prepared(raw.join(heads.select("id"), "id").drop("content"), given)
    whole = raw.select("id", "content").join(heads.withColumnRenamed("id", "head"), "content").select("id", "head")
    return stage(whole.join(distinct.withColumnRenamed("id", "head"), "head").drop("head"), "p6-prepared")


def work_groups(records: DataFrame) -> DataFrame:
    """rec_id, work: one row per distinct non-null rec_id of authority_records; equal ``work`` (the least rec_id) is one work.

    Records alike in all that is compared are one before candidates are sought, so copies cost nothing. A record with neither
    title nor creators nor DOI stays alone. Nulls in any column are a missing value.
    """
    given = records.sparkSession.sparkContext.broadcast(works.given_names_of(records))
    return grouped(prepared_records(records, given), given).withColumnRenamed("id", "rec_id")


def repeat_pairs(records: DataFrame) -> DataFrame:
    """p6_found: rec_id_a, rec_id_b, every pair inside a group, a < b."""
    g = stage(work_groups(records), "p6-works")
    l, r = g.alias("l"), g.alias("r")
    pairs = l.join(r, (F.col("l.work") == F.col("r.work")) & (F.col("l.rec_id") < F.col("r.rec_id")))
    return pairs.select(F.col("l.rec_id").alias("rec_id_a"), F.col("r.rec_id").alias("rec_id_b"))

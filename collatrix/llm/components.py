"""Problem 2: consolidating pairwise match results into groups.

The graph is kept as one directed pair of rows per link. First the component that holds the vertex of highest degree is
peeled off by breadth-first joins from that vertex, as long as the frontier keeps growing like that of a giant
component; what was reached gets one label and leaves the graph by an anti-join. The many small components that remain
are labelled by minimum propagation with contraction (every vertex hooks to its least neighbour, hooks are followed to
their ends, links are rewritten to those ends), which needs a logarithmic number of rounds even for long chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.session import release, stage

#: A vertex with more links than this has them spread over SPLITS salted keys in the frontier joins.
HOT_DEGREE = 10_000
SPLITS = 32
#: The frontier of a giant component grows for a few rounds; once it falls under this share of what was reached, a
#: component that isn't exhausted is a long chain, and contraction finishes it in fewer rounds.
FRONTIER_SHARE = 0.02
PEEL_ROUNDS = 12


def links_of_rows(keys: DataFrame, column: str = "keys") -> tuple[DataFrame, DataFrame]:
    """Vertices (``id``) and links (``src``, ``dst``) of rows that each hold an array of keys.

    Each row becomes a star around its least key, so a row of n keys gives n - 1 links and not n². Null arrays, empty
    arrays and null elements give nothing; repeated elements count once; a single key gives a vertex without link.
    """
    clean = keys.select(F.array_distinct(F.filter(column, lambda x: x.isNotNull())).alias("k")).filter(F.size("k") > 0)
    stars = clean.select(F.array_min("k").alias("src"), F.explode("k").alias("dst"))
    return stars.select(F.col("dst").alias("id")).distinct(), stars.filter("src <> dst").distinct()


def _peel(both: DataFrame) -> tuple[DataFrame, DataFrame, bool] | None:
    """Breadth-first joins from the vertex of highest degree: (reached, links left, exhausted)."""
    degrees = both.groupBy("src").agg(F.count("*").alias("degree"))
    top = degrees.orderBy(F.desc("degree"), "src").limit(1).collect()
    if not top:
        return None
    spark = both.sparkSession
    hot = degrees.filter(F.col("degree") > HOT_DEGREE).select(F.col("src").alias("id"))
    any_hot = top[0]["degree"] > HOT_DEGREE
    if any_hot:
        salted = both.join(hot.withColumnRenamed("id", "src").withColumn("hot", F.lit(True)), "src", "left").select(
            "src", "dst", F.when(F.col("hot"), F.pmod(F.xxhash64("dst"), F.lit(SPLITS))).otherwise(F.lit(0)).cast("int").alias("salt"))
        both = stage(salted, "p2-salted")
    reached = frontier = stage(spark.createDataFrame([(top[0]["src"],)], "id string"), "p2-frontier")
    seen = 1
    for _ in range(PEEL_ROUNDS):
        if any_hot:
            keys = frontier.join(hot.withColumn("hot", F.lit(True)), "id", "left").select(
                "id", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
            step = both.join(keys, (both.src == keys.id) & (both.salt == keys.salt)).select("dst")
        else:
            step = both.join(frontier, both.src == frontier.id).select("dst")
        frontier = stage(step.select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti"), "p2-frontier")
        found = frontier.count()
        if not found:
            return reached, both.select("src", "dst").join(reached, both.src == reached.id, "left_anti"), True
        grown = stage(reached.unionByName(frontier), "p2-reached")
        release(reached)
        reached = grown
        seen += found
        if found < FRONTIER_SHARE * seen:
            break
    return reached, both.select("src", "dst"), False


def _salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``left`` joined with the one row per ``key`` of ``right``; rows of a hub (``hot``: id) are spread over SPLITS tasks."""
    hot = hot.select(F.col("id").alias(key), F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SPLITS))).otherwise(F.lit(0)).cast("int")
    spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    l = left.join(hot, key, "left").withColumn("salt", salt).drop("hot")
    r = right.join(hot, key, "left").withColumn("salt", F.explode(spread)).drop("hot")
    return l.join(r, [key, "salt"]).drop("salt")


def _contract(both: DataFrame) -> DataFrame:
    """(id, root) of every vertex that has a link, by rounds of minimum propagation and contraction."""
    labels = None
    while True:
        hooks = both.groupBy("src").agg(F.min("dst").alias("to"), F.count("*").alias("n")).select(F.col("src").alias("id"), F.least("src", "to").alias("to"), F.lit(True).alias("moved"), "n")
        hooks = stage(hooks, "p2-hooks")
        hubs = hooks.filter(F.col("n") > HOT_DEGREE).select("id")
        any_hub = not hubs.isEmpty()
        meet = (lambda l, r, k, h=stage(hubs, "p2-hubs"): _salted_join(l, r, k, h)) if any_hub else (lambda l, r, k: l.join(r, k))
        while True:  # follow hooks to their ends; each pass doubles the distance
            ahead = hooks.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
            longer = stage(meet(hooks.select("id", "to"), ahead, "to").select("id", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")), "p2-hooks")
            moved = longer.agg(F.bool_or("moved")).first()[0]
            release(hooks)
            hooks = longer
            if not moved:
                break
        ends = hooks.select(F.col("id").alias("root"), F.col("to").alias("end"))
        newer = ends.select(F.col("root").alias("id"), F.col("end").alias("root")) if labels is None else labels.join(ends, "root", "left").select("id", F.coalesce("end", "root").alias("root"))
        newer = stage(newer, "p2-labels")
        a, b = hooks.select(F.col("id").alias("src"), F.col("to").alias("s")), hooks.select(F.col("id").alias("dst"), F.col("to").alias("d"))
        fewer = stage(meet(meet(both.select("src", "dst"), a, "src"), b, "dst").filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct(), "p2-links")
        release(hooks, both, *([] if labels is None else [labels]))
        labels, both = newer, fewer
        if both.isEmpty():
            return labels


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group) of every vertex; the group is the least id (string order) among all vertices linked to it.

    ``vertices``: distinct non-null ``id``. ``links``: ``src``, ``dst`` among them, in any direction, repeats and loops
    allowed. A vertex without links is its own group; empty input gives no rows. Other columns are ignored.
    """
    both = links.filter("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()
    both = stage(both, "p2-links")
    giant = None
    peeled = _peel(both)
    if peeled is not None:
        reached, rest, exhausted = peeled
        giant = stage(reached.withColumn("group", F.lit(reached.agg(F.min("id")).first()[0])), "p2-giant")
        if not exhausted:
            # The part reached so far becomes one vertex, and contraction goes on from there.
            name = giant.select("id", "group")
            s, d = name.select(F.col("id").alias("src"), F.col("group").alias("s")), name.select(F.col("id").alias("dst"), F.col("group").alias("d"))
            rest = rest.join(s, "src", "left").join(d, "dst", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).filter("src <> dst").distinct()
        both = stage(rest, "p2-links")
    labels = vertices.select("id", F.col("id").alias("group"))
    if giant is not None:
        labels = vertices.join(giant, "id", "left").select("id", F.coalesce("group", "id").alias("group"))
        if not both.isEmpty():
            roots = _contract(both)
            found = labels.join(roots.select(F.col("id").alias("group"), "root"), "group", "left").select("id", F.coalesce("root", "group").alias("group"))
            labels = found
    return labels


def match_groups(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """p2_found: item_key, group_key for every distinct non-null key in candidates.item_keys or cluster_jobs.member_keys."""
    rows = candidates.select(F.col("item_keys").alias("keys")).unionByName(jobs.select(F.col("member_keys").alias("keys")))
    vertices, links = links_of_rows(rows)
    return components(vertices, links).select(F.col("id").alias("item_key"), F.col("group").alias("group_key"))

"""Health, coverage and recovery reports over an append-only log (prov_log), and over the library.

The log may hold a line twice (same ``prov_id``): a line counts once, by its first append. Order is ``append_seq``; late
timestamps change nothing. ``params`` that are no JSON object read as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Item types that have a DOI; activities that carry a verdict; the mark of a reviewed failure.
DOI_TYPES = ["journalArticle", "conferencePaper", "preprint", "thesis", "report", "bookSection", "book", "dataset", "manuscript"]
VERIFY_ACTIVITIES = ["shadow_merge", "commit_merge", "commit_merge_shadow", "commit_merge_verify"]
ACKNOWLEDGED = "verify_failure_acknowledged"


def entries(log: DataFrame) -> DataFrame:
    """Each log line once, by its first append, in one pass; lines without ``prov_id`` can't be told apart and all stay."""
    rest = [c for c in log.columns if c != "prov_id"]
    first = log.filter("prov_id is not null").groupBy("prov_id").agg(F.min_by(F.struct(*rest), "append_seq").alias("r"))
    return first.select("prov_id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*log.columns).unionByName(log.filter("prov_id is null"))


def param(name: str) -> Column:
    """A value of ``params``; null where params are broken or lack it."""
    return F.get_json_object("params", f"$.{name}")


def activity_counts(log: DataFrame) -> DataFrame:
    """activity, n, n_items: lines and distinct items per activity."""
    return entries(log).groupBy("activity").agg(F.count("*").alias("n"), F.countDistinct("item_key").alias("n_items"))


def verdicts(log: DataFrame) -> DataFrame:
    """Lines of the activities that carry a verdict, with ``acknowledged``: a failure whose snapshot a later review names."""
    e = entries(log)
    marks = e.filter((F.col("activity") == ACKNOWLEDGED) & F.col("snapshot_id").isNotNull()).select("snapshot_id").distinct().withColumn("marked", F.lit(True))
    v = e.filter(F.col("activity").isin(VERIFY_ACTIVITIES) & F.col("passed").isNotNull()).join(marks, "snapshot_id", "left")
    return v.withColumn("acknowledged", F.coalesce("marked", F.lit(False)) & ~F.col("passed")).drop("marked")


def verify_rates(log: DataFrame) -> DataFrame:
    """activity, verifies, passed, rate of the lines that carry a verdict, without acknowledged failures."""
    v = verdicts(log).filter("not acknowledged")
    return v.groupBy("activity").agg(F.count("*").alias("verifies"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("rate"))


def health(log: DataFrame, floor: float = 1.0) -> DataFrame:
    """One row: verifies, passed, acknowledged, rate, commits, lines, status (degraded under the floor; no verdict at all is ok)."""
    v = verdicts(log).agg(F.count_if(~F.col("acknowledged")).alias("verifies"), F.count_if("passed").alias("passed"), F.count_if("acknowledged").alias("acknowledged"))
    e = entries(log).agg(F.count_if(F.col("activity") == "commit_merge").alias("commits"), F.count("*").alias("lines"))
    rate = F.col("passed") / F.nullif(F.col("verifies"), F.lit(0))
    return v.crossJoin(e).withColumn("rate", rate).withColumn("status", F.when(F.coalesce(rate, F.lit(1.0)) < floor, "degraded").otherwise("ok"))  # one row each


def freshness(log: DataFrame, report: str, window_seconds: int) -> DataFrame:
    """report, ts, age_seconds, fresh: the last report by append order against the latest timestamp of the log; no report is not fresh."""
    e = entries(log)
    now = e.agg(F.max("ts").alias("now"))
    last = e.filter(F.col("activity") == report).agg(F.max_by("ts", "append_seq").alias("ts"))
    age = F.timestamp_diff("SECOND", F.col("ts"), F.col("now"))
    return last.crossJoin(now).select(F.lit(report).alias("report"), "ts", age.alias("age_seconds"), F.coalesce((age >= 0) & (age <= window_seconds), F.lit(False)).alias("fresh"))  # one row each


def unresolved(log: DataFrame) -> DataFrame:
    """snapshot_id, reason: transactions that need a look: an intent without an end, writes without an intent, an end without an intent."""
    e = entries(log).filter("snapshot_id is not null")
    of = lambda *a: e.filter(F.col("activity").isin(*a)).select("snapshot_id").distinct()
    intents, writes, ends = of("merge_txn_intent"), of("merge_txn_write"), of("merge_txn_result", "merge_txn_rolled_back")
    parts = [(intents.join(ends, "snapshot_id", "left_anti"), "intent without an end"), (writes.join(intents, "snapshot_id", "left_anti"), "writes without an intent"), (ends.join(intents, "snapshot_id", "left_anti"), "end without an intent")]
    out = [x.withColumn("reason", F.lit(r)) for x, r in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def transaction_states(log: DataFrame) -> DataFrame:
    """snapshot_id, writes, state: planned, intended, written, committed, rolled back, or torn (both ends), by which lines a transaction has."""
    has = lambda a: F.count_if(F.col("activity") == a)
    x = entries(log).filter("snapshot_id is not null").groupBy("snapshot_id").agg(has("merge_txn_intent").alias("i"), has("merge_txn_write").alias("writes"), has("merge_txn_result").alias("c"), has("merge_txn_rolled_back").alias("r"))
    state = F.when((F.col("c") > 0) & (F.col("r") > 0), "torn").when(F.col("c") > 0, "committed").when(F.col("r") > 0, "rolled back").when(F.col("writes") > 0, "written").when(F.col("i") > 0, "intended").otherwise("planned")
    return x.select("snapshot_id", "writes", state.alias("state"))


def open_writes(log: DataFrame) -> DataFrame:
    """snapshot_id, item_key, writes: writes of transactions that have no receipt, by snapshot and item (null-safe)."""
    e = entries(log).filter("snapshot_id is not null")
    w = e.filter(F.col("activity") == "merge_txn_write").groupBy("snapshot_id", "item_key").agg(F.count("*").alias("writes"))
    done = e.filter(F.col("activity").isin("merge_txn_result", "merge_txn_rolled_back")).select("snapshot_id").distinct()
    return w.join(done, "snapshot_id", "left_anti")


def inversion(log: DataFrame) -> DataFrame:
    """snapshot_id, step (from 1), append_seq, item_key: the writes of every unfinished transaction, newest first, as undoing takes them."""
    e = entries(log).filter("snapshot_id is not null")
    w = e.filter(F.col("activity") == "merge_txn_write").select("snapshot_id", "append_seq", "item_key")
    done = e.filter(F.col("activity").isin("merge_txn_result", "merge_txn_rolled_back")).select("snapshot_id").distinct()
    step = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("append_seq")))
    return w.join(done, "snapshot_id", "left_anti").withColumn("step", step)


def lost_snapshots(log: DataFrame, snaps: DataFrame) -> DataFrame:
    """snapshot_id, lines: snapshots the log names and no snapshot table has."""
    named = entries(log).filter("snapshot_id is not null").groupBy("snapshot_id").agg(F.count("*").alias("lines"))
    return named.join(snaps.select("snapshot_id").distinct(), "snapshot_id", "left_anti")


def pending_jobs(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """job_id, snapshot_id of the jobs a run has still to do: those whose snapshot has no result line."""
    done = entries(log).filter((F.col("activity") == "merge_txn_result") & F.col("snapshot_id").isNotNull()).select("snapshot_id").distinct()
    return jobs.select("job_id", "snapshot_id").join(done, "snapshot_id", "left_anti").select("job_id", "snapshot_id")


def run_counters(log: DataFrame) -> DataFrame:
    """agent, activity, lines, items, first_seq, last_seq of each agent's runs; lines without an agent are counted under null."""
    return entries(log).groupBy("agent", "activity").agg(F.count("*").alias("lines"), F.count("item_key").alias("items"), F.min("append_seq").alias("first_seq"), F.max("append_seq").alias("last_seq"))


def readiness(log: DataFrame, report: str = "merge_health_report", window_seconds: int = 86_400) -> DataFrame:
    """gate, status of four gates: freshness, log integrity, open transactions, verify rate; each fails closed."""
    gate = lambda df, name, ok: df.select(F.lit(name).alias("gate"), F.when(ok, "pass").otherwise("fail").alias("status"))
    broken = log.agg(F.count_if(F.col("params").isNotNull() & F.expr("try_parse_json(params) is null")).alias("n"))
    rows = [gate(freshness(log, report, window_seconds), "freshness", F.col("fresh")), gate(broken, "log integrity", F.col("n") == 0), gate(unresolved(log).agg(F.count("*").alias("n")), "open transactions", F.col("n") == 0), gate(health(log), "verify rate", F.col("status") == "ok")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def daily_report(log: DataFrame) -> DataFrame:
    """day, lines, items, verifies, passed, rate per day of the timestamp; lines without one form a day of their own (null)."""
    e = entries(log).withColumn("day", F.to_date("ts"))
    return e.groupBy("day").agg(
        F.count("*").alias("lines"), F.countDistinct("item_key").alias("items"), F.count("passed").alias("verifies"),
        F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("rate"))


def latest_per_item(log: DataFrame) -> DataFrame:
    """item_key, append_seq, activity: the last line of each item, by append order. One item may hold any share of the log."""
    e = entries(log).filter("item_key is not null")
    return e.groupBy("item_key").agg(F.max_by(F.struct("append_seq", "activity"), "append_seq").alias("m")).select("item_key", "m.append_seq", "m.activity")


def recent(log: DataFrame, activity: str, n: int = 20) -> DataFrame:
    """The last n lines of an activity: a top-k report."""
    return entries(log).filter(F.col("activity") == activity).orderBy(F.desc("append_seq")).limit(n)


def history(log: DataFrame, item_key: str) -> DataFrame:
    """All lines of an item in append order."""
    return entries(log).filter(F.col("item_key") == item_key).orderBy("append_seq")


def unanswered(log: DataFrame, intent: str, answers: list[str], keys: list[str]) -> DataFrame:
    """The last line of an intent per key that no line of ``answers`` answers, null-safe on the keys."""
    e = entries(log)
    asked = e.filter(F.col("activity") == intent).groupBy(*keys).agg(F.max("append_seq").alias("append_seq"), F.count("*").alias("intents"))
    told = e.filter(F.col("activity").isin(answers)).select(*[F.col(k).alias(f"t_{k}") for k in keys]).distinct()
    cond = [asked[k].eqNullSafe(told[f"t_{k}"]) for k in keys]
    return asked.join(told, cond, "left_anti")


def answered_failures(log: DataFrame, mark: str = ACKNOWLEDGED) -> DataFrame:
    """snapshot_id, failures, acknowledged: failed verdicts per snapshot and whether a line of ``mark`` names the snapshot."""
    e = entries(log)
    failed = e.filter("passed = false and snapshot_id is not null").groupBy("snapshot_id").agg(F.count("*").alias("failures"))
    marks = e.filter(F.col("activity") == mark).select("snapshot_id").filter("snapshot_id is not null").distinct().withColumn("acknowledged", F.lit(True))
    return failed.join(marks, "snapshot_id", "left").fillna({"acknowledged": False})


def coverage(log: DataFrame) -> DataFrame:
    """One row: lines, distinct ids, repeated lines, lines without item or agent, broken params, first and last append."""
    return log.agg(
        F.count("*").alias("lines"), F.countDistinct("prov_id").alias("ids"), (F.count("prov_id") - F.countDistinct("prov_id")).alias("repeated"),
        F.count_if(F.col("item_key").isNull()).alias("no_item"), F.count_if(F.col("agent").isNull()).alias("no_agent"),
        F.count_if(F.col("params").isNotNull() & F.expr("try_parse_json(params) is null")).alias("broken_params"),
        F.min("append_seq").alias("first_seq"), F.max("append_seq").alias("last_seq"))


def late_lines(log: DataFrame) -> DataFrame:
    """activity, late: lines whose timestamp lies before one appended earlier to the same activity, by running maximum.

    The running maximum needs no single task per activity: maxima of blocks of the append order are combined first.
    """
    e = entries(log).filter("ts is not null").withColumn("block", F.floor(F.col("append_seq") / 65536))
    tops = e.groupBy("activity", "block").agg(F.max("ts").alias("top"))
    before = Window.partitionBy("activity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("before", F.max("top").over(before)).select(F.col("activity").alias("a"), F.col("block").alias("b"), "before")
    inside = Window.partitionBy("activity", "block").orderBy("append_seq").rowsBetween(Window.unboundedPreceding, -1)
    x = e.withColumn("here", F.max("ts").over(inside)).join(tops, F.col("activity").eqNullSafe(F.col("a")) & (F.col("block") == F.col("b")))
    late = F.coalesce(F.col("ts") < F.greatest(F.coalesce("here", "before"), F.coalesce("before", "here")), F.lit(False))
    return x.groupBy("activity").agg(F.count_if(late).alias("late"), F.count("*").alias("lines"))


def damage(lines: DataFrame, accepted: DataFrame) -> DataFrame:
    """line_no, sha, reason, status of damaged raw lines; those with an accepted mark for the same line and digest are settled.

    ``lines``: line_no, value. ``accepted``: line_no, sha.
    """
    bad = F.when(F.length("value") > 10_000_000, "too long").when(F.expr("try_parse_json(value) is null"), "not json").when(~F.trim("value").startswith("{"), "not an object")
    x = lines.filter("value is not null and trim(value) <> ''").withColumn("reason", bad).filter("reason is not null").withColumn("sha", F.sha2("value", 256))
    settled = accepted.select("line_no", "sha").distinct().withColumn("ok", F.lit(True))
    return x.join(settled, ["line_no", "sha"], "left").select("line_no", "sha", "reason", F.when(F.col("ok"), "accepted").otherwise("blocking").alias("status"))


def library_health(items: DataFrame) -> DataFrame:
    """One row: items, trashed, share without DOI among the types that have one, without creators, without date, without key."""
    from collatrix.operators.dedup import latest

    one = latest(items)
    live = ~F.coalesce("deleted", F.lit(False))
    typed = live & F.col("item_type").isin(DOI_TYPES)
    none = F.coalesce(F.trim("doi"), F.lit("")) == ""
    return one.agg(
        F.count("*").alias("items"), F.count_if(~live).alias("trashed"), F.count_if(typed).alias("doi_types"),
        F.round(100.0 * F.count_if(typed & none) / F.nullif(F.count_if(typed), F.lit(0)), 2).alias("pct_missing_doi"),
        F.count_if(live & (F.coalesce(F.size("creators"), F.lit(0)) <= 0)).alias("no_creators"), F.count_if(live & (F.coalesce("pub_date", F.lit("")) == "")).alias("no_date"),
        F.count_if(live & (F.coalesce("citation_key", F.lit("")) == "")).alias("no_key"))

"""All queries of the core operators by name, and the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.functions import text
from collatrix.operators import agreement, audit, citekeys, dedup, ingest, library, merge, pairs, quality
from collatrix.plans.oracle import SQL
from collatrix.session import stage, table
from collatrix.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    for c in arrays:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


def dedup_scan(spark: SparkSession, d: str) -> DataFrame:
    return _joined(dedup.with_reason(dedup.clusters(table(spark, d, "items"))), "item_keys", "conflicts")


def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cluster_counts(dedup.clusters(table(spark, d, "items")))


def item_keys_normalised(spark: SparkSession, d: str) -> DataFrame:
    k = dedup.keyed(dedup.latest(table(spark, d, "items")))
    return k.select("item_key", "doi", "title_key", "year", "author", F.array_join("surnames", ",").alias("surnames"), "subtitle", "parts", "edition")


def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    return pairs.candidates(table(spark, d, "items"))


def pair_scores_top(spark: SparkSession, d: str) -> DataFrame:
    return pairs.top(pairs.candidates(table(spark, d, "items")))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return pairs.keyword_search(table(spark, d, "items"), "survey harvest")


def agreement_facts(spark: SparkSession, d: str) -> DataFrame:
    c, a = agreement.candidates_of(table(spark, d, "items")), agreement.authorities_of(table(spark, d, "authority_records"))
    return agreement.facts(agreement.lookup_by_doi(c, a))


def agreement_scores(spark: SparkSession, d: str) -> DataFrame:
    c, a = agreement.candidates_of(table(spark, d, "items")), agreement.authorities_of(table(spark, d, "authority_records"))
    return agreement.scores(agreement.lookup_by_doi(c, a))


def consensus_fields(spark: SparkSession, d: str) -> DataFrame:
    return agreement.consensus_fields(table(spark, d, "authority_records"))


def composed_fields(spark: SparkSession, d: str) -> DataFrame:
    items, records = table(spark, d, "items"), table(spark, d, "authority_records")
    c, a = agreement.candidates_of(items), agreement.authorities_of(records)
    accepted = agreement.scores(agreement.lookup_by_doi(c, a)).select("cand", (F.col("decision") == "accept").alias("accept"))
    return agreement.composed(items, records, accepted)


def merge_sets(spark: SparkSession, d: str) -> DataFrame:
    snap = merge.snapshot(merge.plan(table(spark, d, "cluster_jobs")), table(spark, d, "items"))
    return _joined(merge.projected_sets(snap), "collections", "tags", "relations")


def merge_fields(spark: SparkSession, d: str) -> DataFrame:
    return merge.projected_fields(merge.snapshot(merge.plan(table(spark, d, "cluster_jobs")), table(spark, d, "items")), smart_fill=True)


def merge_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of every job, each against its items as they stand after that merge alone."""
    members, items = merge.by_job(merge.plan(table(spark, d, "cluster_jobs")), table(spark, d, "items"))
    members, items = stage(members, "merge-members"), stage(items, "merge-items")  # read many times
    return merge.checks(members, items, stage(merge.applied(items, members), "merge-applied"))


def merge_undo(spark: SparkSession, d: str) -> DataFrame:
    """What undoing each merge takes, each against its items as they stand after that merge alone."""
    members, items = merge.by_job(merge.plan(table(spark, d, "cluster_jobs")), table(spark, d, "items"))
    members, items = stage(members, "merge-members"), stage(items, "merge-items")
    steps = merge.undo(members, items, stage(merge.applied(items, members), "merge-applied"))
    return steps.select("job_id", F.substring_index("item_key", "/", -1).alias("item_key"), "step")


def version_differences(spark: SparkSession, d: str) -> DataFrame:
    """Fields in which the earliest delivery of an item differs from the latest."""
    items = table(spark, d, "items").filter("item_key is not null")
    cols = ["title", "pub_date", "doi", "volume", "citation_key", "extra"]
    old = items.groupBy("item_key").agg(F.min_by(F.struct(*cols), F.struct("version", "date_modified", *cols)).alias("r")).select("item_key", "r.*")
    new = items.groupBy("item_key").agg(F.max_by(F.struct(*cols), F.struct("version", "date_modified", *cols)).alias("r")).select("item_key", "r.*")
    return merge.field_differences(old, new, "item_key", cols)


def citekey_collisions(spark: SparkSession, d: str) -> DataFrame:
    return citekeys.collisions(table(spark, d, "items"))


def citekey_items(spark: SparkSession, d: str) -> DataFrame:
    return citekeys.colliding_items(table(spark, d, "items"))


def citekey_report(spark: SparkSession, d: str) -> DataFrame:
    return citekeys.report(table(spark, d, "items"))


def alias_survival(spark: SparkSession, d: str) -> DataFrame:
    return citekeys.alias_survival(table(spark, d, "items"))


def log_activity_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.activity_counts(table(spark, d, "prov_log"))


def log_verify_rates(spark: SparkSession, d: str) -> DataFrame:
    return audit.verify_rates(table(spark, d, "prov_log"))


def log_daily_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.daily_report(table(spark, d, "prov_log"))


def log_latest_per_item(spark: SparkSession, d: str) -> DataFrame:
    return audit.latest_per_item(table(spark, d, "prov_log"))


def log_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(table(spark, d, "prov_log"))


def log_late_lines(spark: SparkSession, d: str) -> DataFrame:
    return audit.late_lines(table(spark, d, "prov_log"))


def log_unanswered(spark: SparkSession, d: str) -> DataFrame:
    return audit.unanswered(table(spark, d, "prov_log"), "merge_txn_intent", ["merge_txn_result", "merge_txn_rolled_back"], ["snapshot_id"])


def log_failures(spark: SparkSession, d: str) -> DataFrame:
    return audit.answered_failures(table(spark, d, "prov_log"))


def log_recent_merges(spark: SparkSession, d: str) -> DataFrame:
    return audit.recent(table(spark, d, "prov_log"), "merge_txn_result").select("append_seq", "prov_id", "item_key", "snapshot_id")


def library_health(spark: SparkSession, d: str) -> DataFrame:
    return audit.library_health(table(spark, d, "items"))


def validate_items(spark: SparkSession, d: str) -> DataFrame:
    return _joined(quality.validated(table(spark, d, "items")), "issues", "warnings")


def validate_buckets(spark: SparkSession, d: str) -> DataFrame:
    return quality.bucket_counts(table(spark, d, "items"))


def edited_tags(spark: SparkSession, d: str) -> DataFrame:
    one = dedup.latest(table(spark, d, "items"))
    return one.select("item_key", F.array_join(F.array_sort(quality.edit_tags(F.col("tags"), ["to check"], ["folklore"])), ",").alias("tags"))


def document_facts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.facts(table(spark, d, "documents"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    f = ingest.front_matter(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in f.items()]).filter("title is not null or author is not null or year is not null")


def item_summaries(spark: SparkSession, d: str) -> DataFrame:
    one = dedup.latest(table(spark, d, "items"))
    return one.select("item_key", text.summary(F.col("item_key"), F.col("creators"), F.col("pub_date"), F.col("title"), F.col("item_type")).alias("summary"))


def write_batches(spark: SparkSession, d: str) -> DataFrame:
    """Size of each batch of 50 items."""
    b = sinks.batches(dedup.latest(table(spark, d, "items")).select("item_key"), "item_key")
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.max("index").alias("last_index"))


def blob_digests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("text").alias("body"))
    return sinks.new_blobs(docs, spark.createDataFrame([], "digest string")).select("digest", F.length("body").alias("n_chars"))


def transaction_ids(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "cluster_jobs")
    return jobs.select("job_id", sinks.content_id("TXN-", F.col("master"), F.array_join(F.array_sort(F.coalesce("secondaries", F.array().cast("array<string>"))), ",")).alias("txn_id"))


def log_health(spark: SparkSession, d: str) -> DataFrame:
    return audit.health(table(spark, d, "prov_log"))


def log_freshness(spark: SparkSession, d: str) -> DataFrame:
    return audit.freshness(table(spark, d, "prov_log"), "merge_health_report", 86_400)


def log_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return audit.unresolved(table(spark, d, "prov_log"))


def log_transaction_states(spark: SparkSession, d: str) -> DataFrame:
    return audit.transaction_states(table(spark, d, "prov_log"))


def log_open_writes(spark: SparkSession, d: str) -> DataFrame:
    return audit.open_writes(table(spark, d, "prov_log"))


def log_inversion(spark: SparkSession, d: str) -> DataFrame:
    return audit.inversion(table(spark, d, "prov_log"))


def log_lost_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return audit.lost_snapshots(table(spark, d, "prov_log"), table(spark, d, "item_snaps"))


def log_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return audit.run_counters(table(spark, d, "prov_log"))


def log_readiness(spark: SparkSession, d: str) -> DataFrame:
    return audit.readiness(table(spark, d, "prov_log"))


def jobs_pending(spark: SparkSession, d: str) -> DataFrame:
    return audit.pending_jobs(table(spark, d, "cluster_jobs"), table(spark, d, "prov_log"))


def job_candidates(spark: SparkSession, d: str) -> DataFrame:
    return library.same_members(table(spark, d, "cluster_jobs"), table(spark, d, "candidates"))


def library_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25 journal articles that aren't in the trash; paging is the feature."""
    return library.page(library.scan(table(spark, d, "items"), ["journalArticle"]), 50, 25)


def item_details(spark: SparkSession, d: str) -> DataFrame:
    return library.details(dedup.latest(table(spark, d, "items")))


def version_set_differences(spark: SparkSession, d: str) -> DataFrame:
    """Creators and tags in which the earliest delivery of an item differs from the latest."""
    items = table(spark, d, "items").filter("item_key is not null").select("item_key", "creators", "tags", F.struct("version", "date_modified", F.to_json("creators"), F.to_json("tags")).alias("o"))
    ends = items.groupBy("item_key").agg(F.min_by(F.struct("creators", "tags"), "o").alias("a"), F.max_by(F.struct("creators", "tags"), "o").alias("b"))
    return library.set_differences(ends.select("item_key", "a.*"), ends.select("item_key", "b.*"))


def item_children(spark: SparkSession, d: str) -> DataFrame:
    return library.children(table(spark, d, "documents"), table(spark, d, "items"))


def orphan_documents(spark: SparkSession, d: str) -> DataFrame:
    return library.orphans(table(spark, d, "documents"), table(spark, d, "items"))


def items_without_documents(spark: SparkSession, d: str) -> DataFrame:
    return library.childless(table(spark, d, "documents"), table(spark, d, "items"))


def item_identities(spark: SparkSession, d: str) -> DataFrame:
    return library.identities(dedup.keyed(dedup.latest(table(spark, d, "items"))))


def observation_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "item_snaps").select("snapshot_id", "item_key", library.observation_id(F.col("item_key"), F.col("version")).alias("meta_id")).distinct()


def creators_of_strings(spark: SparkSession, d: str) -> DataFrame:
    first, last = library.names_of(F.col("full_name"))
    return table(spark, d, "creator_names").filter("full_name is not null and trim(full_name) <> ''").select("name_id", first.alias("first_name"), last.alias("last_name"))


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    return library.search_text(dedup.keyed(dedup.latest(table(spark, d, "items"))))


def review_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 match results of each reason, with the number of all; a capped report."""
    found = table(spark, d, "candidates").select("cand_id", "reason", "auto_accept")
    return library.listing(found, "reason", [F.col("cand_id")])


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """What the titles of items say when they are taken for names of files."""
    one = dedup.latest(table(spark, d, "items")).filter("title is not null")
    return one.select("item_key", *[c.alias(k) for k, c in ingest.file_name_facts(F.concat_ws(" - ", F.nullif(text.year_of(F.col("pub_date")), F.lit("")), "title")).items()])


def queries() -> dict[str, Query]:
    skip = {"queries", "oracle_sql", "stage", "table"}
    return {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and k not in skip and getattr(v, "__module__", "") == __name__}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""SQL for DuckDB, equivalent to the queries of the catalogue.

The normal forms are written out here once more, in SQL, so that the two sides share only their fixed values.
"""

from __future__ import annotations

from collatrix.functions.text import FIRST_EDITIONS, FOLD_FROM, FOLD_TO, LIBRARY_TYPES, MARKS, PART, SEVERAL, STOP_WORDS

# Fixed values, written out once more so that a wrong one in the engine shows.
ENGLISH_SHARE = 0.18
FUNCTION_WORDS = (
    "about all an and are as at be but by can could each for from had have her his if in into is it its more no not of on or out "
    "said so some than that the them then there these they this to up was were what when which who will with you"
).split()
DOI_TYPES = ["book", "bookSection", "conferencePaper", "dataset", "journalArticle", "manuscript", "preprint", "report", "thesis"]
VERIFY = "('commit_merge', 'commit_merge_shadow', 'commit_merge_verify', 'shadow_merge')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "(" + ", ".join(_q(x) for x in xs) + ")"


def _fold(c: str) -> str:
    for k, v in SEVERAL.items():
        c = f"replace({c}, {_q(k)}, {_q(v)})"
    return f"translate({c}, {_q(FOLD_FROM + MARKS)}, {_q(FOLD_TO)})"


_SP = r"[\s\p{Z}]+"


def _squeeze(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '{_SP}', ' ', 'g'), '^ | $', '', 'g')"


def _words(c: str) -> str:
    return _squeeze(rf"regexp_replace(lower({_fold(f'coalesce({c}, {_q('')})')}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g')")


_DOI = f"nullif(regexp_replace(lower({_squeeze('coalesce(doi, {})'.format(_q('')))}), '^https?://(dx\\.)?doi\\.org/', ''), '')"
_YEAR = lambda c: rf"regexp_extract(coalesce({c}, ''), '\b(1[0-9]{{3}}|2[0-9]{{3}})\b', 1)"
_SURNAME = lambda x: _squeeze(f"lower({_fold(f'coalesce(nullif({x}.lastName, {_q('')}), nullif({x}.name, {_q('')}), {_q('')})')})")
_AUTHOR = f"""coalesce((list_transform(list_filter(creators, lambda c: (c.creatorType IS NULL OR c.creatorType = 'author') AND coalesce(nullif(c.lastName, ''), nullif(c.name, '')) IS NOT NULL), lambda c: {_SURNAME('c')}))[1], '')"""
_SURNAMES = f"""coalesce(list_sort(list_distinct(list_filter(list_transform(creators, lambda c: {_SURNAME('c')}), lambda s: s <> ''))), [])"""
_FILLED = " + ".join(f"(CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END)" for c in ["item_type", "title", "pub_date", "doi", "volume", "issue", "edition", "university", "abstract_note", "publisher", "publication_title", "extra", "citation_key"])
_PINNED = r"nullif(" + _squeeze(r"regexp_extract(coalesce(extra, ''), '(?im)^[ \t]*citation key:[ \t]*(\S[^\n]*)$', 1)") + ", '')"
_ALIASES = r"list_filter(list_transform(flatten(list_transform(regexp_extract_all(coalesce(extra, ''), '(?im)^[ \t]*tex\.ids:([^\n]*)$', 1), lambda x: string_split(x, ','))), lambda x: " + _squeeze("x") + "), lambda k: k <> '')"
_CITEKEY = f"coalesce({_PINNED}, nullif(citation_key, ''))"

# Deliveries of an item that agree in version and time are alike in all the queries read.
_ONE = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY coalesce(version, -1) DESC, coalesce(date_modified, TIMESTAMP '1970-01-01') DESC) AS rn_ FROM items WHERE item_key IS NOT NULL) WHERE rn_ = 1)"""
_E = """e AS (SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY prov_id ORDER BY append_seq) AS rn_ FROM prov_log) WHERE rn_ = 1 OR prov_id IS NULL)"""

_V = f"""v AS (SELECT *, NOT passed AND snapshot_id IS NOT NULL AND snapshot_id IN (SELECT snapshot_id FROM e WHERE activity = 'verify_failure_acknowledged' AND snapshot_id IS NOT NULL) AS acknowledged
 FROM e WHERE passed IS NOT NULL AND activity IN {VERIFY})"""
_TX = """has AS (SELECT snapshot_id, count(*) FILTER (activity = 'merge_txn_intent') AS i, count(*) FILTER (activity = 'merge_txn_write') AS w, count(*) FILTER (activity = 'merge_txn_result') AS c,
 count(*) FILTER (activity = 'merge_txn_rolled_back') AS r FROM e WHERE snapshot_id IS NOT NULL GROUP BY snapshot_id)"""
_UNRESOLVED = """SELECT snapshot_id, 'intent without an end' AS reason FROM has WHERE i > 0 AND c + r = 0 UNION ALL SELECT snapshot_id, 'writes without an intent' FROM has WHERE w > 0 AND i = 0
 UNION ALL SELECT snapshot_id, 'end without an intent' FROM has WHERE c + r > 0 AND i = 0"""
_HEALTH = """h AS (SELECT (SELECT count(*) FROM v WHERE NOT acknowledged) AS verifies, (SELECT count(*) FROM v WHERE passed) AS passed, (SELECT count(*) FROM v WHERE acknowledged) AS acknowledged,
 (SELECT count(*) FROM e WHERE activity = 'commit_merge') AS commits, (SELECT count(*) FROM e) AS lines),
hh AS (SELECT *, passed::DOUBLE / nullif(verifies, 0) AS rate, CASE WHEN coalesce(passed::DOUBLE / nullif(verifies, 0), 1.0) < 1.0 THEN 'degraded' ELSE 'ok' END AS status FROM h)"""
_FRESH = """f AS (SELECT 'merge_health_report' AS report, ts, date_sub('second', ts, now) AS age_seconds, coalesce(date_sub('second', ts, now) BETWEEN 0 AND 86400, FALSE) AS fresh
 FROM (SELECT (SELECT arg_max(ts, append_seq) FROM e WHERE activity = 'merge_health_report') AS ts, (SELECT max(ts) FROM e) AS now))"""

_FULL = _words("title")
_KEYED = f"""keyed AS (SELECT item_key, {_DOI} AS doi, {_words("split_part(title, ':', 1)")} AS title_key, {_YEAR('pub_date')} AS year, {_AUTHOR} AS author, {_SURNAMES} AS surnames,
 coalesce(item_type, chr(1)) AS item_type, {_FULL} AS full_title, CASE WHEN contains(title, ':') THEN {_words("regexp_replace(title, '(?s)^[^:]*:', '')")} ELSE '' END AS subtitle,
 CASE WHEN {_squeeze(f"lower({_fold('coalesce(edition, {})'.format(_q('')))})")} IN {_list(FIRST_EDITIONS)} THEN '' ELSE {_squeeze(f"lower({_fold('coalesce(edition, {})'.format(_q('')))})")} END AS edition,
 {", ".join(f"{_squeeze(f'lower({_fold(f'coalesce({c}, {_q('')})')})')} AS tell_{c}" for c in ("volume", "issue", "university"))},
 {_FILLED} + (CASE WHEN len(creators) > 0 THEN 1 ELSE 0 END) AS completeness FROM one),
k AS (SELECT *, list_sort(list_distinct(list_filter(string_split(full_title, ' '), lambda w: w <> '' AND w NOT IN {_list(STOP_WORDS)}))) AS tokens,
 array_to_string(list_sort(list_distinct(regexp_extract_all(full_title, {_q('(' + PART + ')')}, 1))), '|') AS parts FROM keyed)"""

_CLUSTERS = f"""WITH {_ONE}, {_KEYED},
shared AS (SELECT doi FROM k WHERE doi IS NOT NULL GROUP BY doi HAVING count(*) > 1),
m0 AS (SELECT 'doi' AS path, doi AS cluster, * FROM k WHERE doi IN (SELECT doi FROM shared)
 UNION ALL SELECT 'key', concat_ws('|', title_key, year, author), * FROM k WHERE (doi IS NULL OR doi NOT IN (SELECT doi FROM shared)) AND title_key <> '' AND year <> ''),
big AS (SELECT path, cluster, count(*) AS size FROM m0 GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT m0.*, big.size FROM m0 JOIN big USING (path, cluster)),
toff AS (SELECT DISTINCT a.path, a.cluster FROM (SELECT DISTINCT path, cluster, tokens FROM m WHERE len(tokens) > 0) a JOIN (SELECT DISTINCT path, cluster, tokens FROM m WHERE len(tokens) > 0) b
 ON a.path = b.path AND a.cluster = b.cluster AND a.tokens < b.tokens WHERE len(list_intersect(a.tokens, b.tokens)) < 0.5 * len(list_distinct(list_concat(a.tokens, b.tokens)))),
subs AS (SELECT DISTINCT path, cluster, subtitle AS s FROM m WHERE subtitle <> ''),
soff AS (SELECT DISTINCT a.path, a.cluster FROM subs a JOIN subs b ON a.path = b.path AND a.cluster = b.cluster AND a.s < b.s
 WHERE NOT (starts_with(b.s, a.s) AND NOT (regexp_matches(substr(b.s, len(a.s) + 1, 1), '[\\p{{L}}\\p{{N}}]') AND regexp_matches(regexp_extract(a.s, '(\\S+)$', 1), '^([0-9]+|[ivxlcdm]+)$')))),
coff AS (SELECT path, cluster FROM (SELECT path, cluster, s, count(*) AS n, any_value(size) AS size FROM (SELECT path, cluster, size, unnest(surnames) AS s FROM m WHERE path = 'key') GROUP BY ALL) WHERE n < size GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT path, cluster, list_sort(list(item_key)) AS keys, count(DISTINCT item_type) AS types, count(DISTINCT parts) AS n_parts, count(DISTINCT edition) AS editions, count(DISTINCT nullif(year, '')) AS years,
 count(DISTINCT doi) AS dois, count(DISTINCT nullif(tell_volume, '')) AS volume, count(DISTINCT nullif(tell_issue, '')) AS issue, count(DISTINCT nullif(tell_university, '')) AS university,
 arg_min(item_key, {{'a': -completeness, 'b': item_key}}) AS master_key FROM m GROUP BY path, cluster),
c AS (SELECT g.*, list_filter([CASE WHEN types > 1 THEN 'item-type conflict' END, CASE WHEN toff.path IS NOT NULL THEN 'title disagreement' END, CASE WHEN soff.path IS NOT NULL THEN 'subtitle disagreement' END,
 CASE WHEN n_parts > 1 THEN 'volume/part disagreement' END, CASE WHEN volume > 1 THEN 'volume disagreement' END, CASE WHEN issue > 1 THEN 'issue disagreement' END, CASE WHEN university > 1 THEN 'university disagreement' END,
 CASE WHEN editions > 1 THEN 'edition disagreement' END, CASE WHEN g.path = 'doi' AND years > 1 THEN 'year disagreement' END, CASE WHEN g.path = 'key' AND dois > 1 THEN 'DOI disagreement' END,
 CASE WHEN coff.path IS NOT NULL THEN 'creator disagreement' END], lambda x: x IS NOT NULL) AS conflicts
 FROM g LEFT JOIN toff USING (path, cluster) LEFT JOIN soff USING (path, cluster) LEFT JOIN coff USING (path, cluster))"""

_LIB = "CASE " + " ".join(f"WHEN replace(lower(t), ' ', '') = {_q(k)} THEN {_q(v)}" for k, v in LIBRARY_TYPES.items()) + " ELSE t END"
_CAND = f"""cand AS (SELECT item_key AS cand, {_AUTHOR} AS author, {_YEAR('pub_date')} AS year, {_DOI} AS doi FROM one),
auth AS (SELECT rec_id, {_AUTHOR} AS a_author, {_YEAR('year')} AS a_year, {_DOI} AS a_doi FROM authority_records),
met AS (SELECT * FROM cand LEFT JOIN auth ON doi = a_doi)"""

_MEMBERS = """ms AS (SELECT job_id, list_distinct(list_filter(member_keys, lambda x: x IS NOT NULL)) AS m, master FROM cluster_jobs),
pl AS (SELECT job_id, m, CASE WHEN list_contains(m, master) THEN master ELSE list_min(m) END AS master FROM ms WHERE len(m) > 1),
mem AS (SELECT job_id, master, unnest(m) AS member FROM pl)"""
_RULES = """list_filter([CASE WHEN coalesce(title, '') = '' THEN 'no title' END, CASE WHEN coalesce(len(creators), 0) = 0 THEN 'no creators' END, CASE WHEN coalesce(pub_date, '') = '' THEN 'no date' END,
 CASE WHEN item_type = 'journalArticle' AND coalesce(publication_title, '') = '' THEN 'x' END, CASE WHEN item_type = 'book' AND coalesce(publisher, '') = '' THEN 'x' END,
 CASE WHEN item_type = 'bookSection' AND coalesce(publication_title, '') = '' THEN 'x' END], lambda x: x IS NOT NULL)"""

_MISS = lambda c: f"coalesce({c}, '') = ''"
_ISSUES = f"""list_concat(list_filter([CASE WHEN {_MISS('title')} THEN 'Missing title' END, CASE WHEN coalesce(len(creators), 0) = 0 THEN 'No creators/authors' END, CASE WHEN {_MISS('pub_date')} THEN 'Missing date' END,
 CASE WHEN item_type = 'journalArticle' AND {_MISS('publication_title')} THEN 'Missing journal name' END, CASE WHEN item_type = 'book' AND {_MISS('publisher')} THEN 'Missing publisher' END,
 CASE WHEN item_type = 'bookSection' AND {_MISS('publication_title')} THEN 'Missing book title' END, CASE WHEN item_type = 'bookSection' AND {_MISS('publisher')} THEN 'Missing publisher' END], lambda x: x IS NOT NULL),
 list_filter(list_transform(coalesce(creators, []), lambda c, i: CASE WHEN {_MISS('c.lastName')} THEN 'Creator ' || (i - 1)::VARCHAR || ': missing lastName' END), lambda x: x IS NOT NULL))"""
_WARNINGS = f"""list_concat(list_filter([CASE WHEN item_type = 'journalArticle' AND {_MISS('volume')} THEN 'Missing volume' END, CASE WHEN item_type = 'journalArticle' AND {_MISS('doi')} THEN 'Missing DOI' END,
 CASE WHEN upper(title) = title AND lower(title) <> title THEN 'Title is ALL CAPS' END], lambda x: x IS NOT NULL),
 list_filter(list_transform(coalesce(creators, []), lambda c, i: CASE WHEN {_MISS('c.firstName')} AND c.creatorType = 'author' THEN 'Creator ' || (i - 1)::VARCHAR || ': missing firstName' END), lambda x: x IS NOT NULL))"""

SQL: dict[str, str] = {
    "dedup_scan": _CLUSTERS + """ SELECT path, array_to_string(keys, ',') AS item_keys, len(conflicts) = 0 AS auto_accept, array_to_string(conflicts, ',') AS conflicts, master_key,
 CASE WHEN path = 'doi' THEN 'exact DOI' ELSE 'exact normalized title+year+author' END || CASE WHEN len(conflicts) = 0 THEN '' ELSE ' (demoted: ' || array_to_string(conflicts, ', ') || ')' END AS reason FROM c""",
    "dedup_counts": _CLUSTERS + " SELECT count(*) AS clusters, count(*) FILTER (len(conflicts) = 0) AS auto_accept, count(*) FILTER (len(conflicts) > 0) AS review FROM c",
    "item_keys_normalised": f"WITH {_ONE}, {_KEYED} SELECT item_key, doi, title_key, year, author, array_to_string(surnames, ',') AS surnames, subtitle, parts, edition FROM k",
    "agreement_facts": f"""WITH {_ONE}, {_CAND},
per AS (SELECT cand, count(rec_id) AS n_authorities, max(CASE WHEN author <> '' AND author = a_author THEN 1.0::DOUBLE ELSE 0.0 END) AS author,
 max(CASE WHEN year = '' OR coalesce(a_year, '') = '' THEN 0.0::DOUBLE WHEN year = a_year THEN 1.0 WHEN abs(try_cast(year AS INT) - try_cast(a_year AS INT)) = 1 THEN 0.5 ELSE 0.0 END) AS year,
 max(CASE WHEN doi = a_doi THEN 1.0::DOUBLE ELSE 0.0 END) AS id, any_value(doi) AS cand_doi FROM met GROUP BY cand),
cnt AS (SELECT cand, a_doi, count(*) AS n, min(rec_id) AS seen FROM met WHERE a_doi IS NOT NULL GROUP BY ALL),
best AS (SELECT cand, a_doi, n FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY n DESC, seen) AS r FROM cnt) WHERE r = 1)
SELECT per.cand, n_authorities, author, year, id, id = 1.0 AS id_agreement, coalesce(best.n, 0) >= 2 AS consensus, coalesce(best.n, 0) AS consensus_count, CASE WHEN best.n >= 2 THEN best.a_doi END AS consensus_doi,
 (SELECT count(DISTINCT a_doi) FROM cnt WHERE cnt.cand = per.cand) + CASE WHEN cand_doi IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cnt WHERE cnt.cand = per.cand AND cnt.a_doi = cand_doi) THEN 1 ELSE 0 END >= 2 AS id_disagreement,
 cand_doi IS NOT NULL AND n_authorities = 0 AS doi_unresolved FROM per LEFT JOIN best ON per.cand = best.cand""",
    "consensus_fields": f"""WITH r AS (SELECT *, {_DOI} AS work, trim(coalesce(item_type, '')) AS t FROM authority_records),
v AS (SELECT work, rec_id, coalesce(source, 'authority') AS source, 'title' AS field, title AS value, {_words("split_part(title, ':', 1)")} AS norm FROM r
 UNION ALL SELECT work, rec_id, coalesce(source, 'authority'), 'creators', array_to_string(list_transform(coalesce(creators, []), lambda c: coalesce(nullif(c.lastName, ''), c.name, '')), '; '), {_AUTHOR} FROM r
 UNION ALL SELECT work, rec_id, coalesce(source, 'authority'), 'date', year, {_YEAR('year')} FROM r
 UNION ALL SELECT work, rec_id, coalesce(source, 'authority'), 'DOI', doi, coalesce(work, '') FROM r
 UNION ALL SELECT work, rec_id, coalesce(source, 'authority'), 'publicationTitle', container_title, {_words("split_part(container_title, ':', 1)")} FROM r
 UNION ALL SELECT work, rec_id, coalesce(source, 'authority'), 'itemType', {_LIB}, lower({_LIB}) FROM r),
g AS (SELECT work, field, norm, count(DISTINCT source) AS n, min(rec_id) AS first, arg_min(value, rec_id) AS value, list_sort(list(DISTINCT source)) AS sources FROM v
 WHERE work IS NOT NULL AND coalesce(value, '') <> '' AND norm <> '' GROUP BY ALL)
SELECT work, field, value, array_to_string(sources, ',') AS sources FROM (SELECT *, row_number() OVER (PARTITION BY work, field ORDER BY first, norm) AS r FROM g WHERE n >= 2) WHERE r = 1""",
    "merge_sets": f"""WITH {_ONE}, {_MEMBERS}, s AS (SELECT mem.*, one.collections, one.tags, one.relations FROM mem LEFT JOIN one ON item_key = member),
cs AS (SELECT job_id, array_to_string(list_sort(list(DISTINCT c)), ',') AS v FROM (SELECT job_id, unnest(collections) AS c FROM s) WHERE c IS NOT NULL GROUP BY job_id),
ts AS (SELECT job_id, array_to_string(list_sort(list(DISTINCT concat_ws('#', t.tag, coalesce(t.type, 0)))), ',') AS v FROM (SELECT job_id, unnest(tags) AS t FROM s) WHERE t IS NOT NULL GROUP BY job_id),
rs AS (SELECT job_id, array_to_string(list_sort(list(DISTINCT x)), ',') AS v FROM (
 SELECT job_id, concat_ws(' ', e.key, u) AS x FROM (SELECT job_id, e, unnest(e.value) AS u FROM (SELECT job_id, unnest(map_entries(relations)) AS e FROM s)) WHERE u IS NOT NULL
 UNION ALL SELECT job_id, 'dc:replaces ' || member FROM mem WHERE member <> master) GROUP BY job_id)
SELECT pl.job_id, pl.master, coalesce(cs.v, '') AS collections, coalesce(ts.v, '') AS tags, coalesce(rs.v, '') AS relations FROM pl LEFT JOIN cs USING (job_id) LEFT JOIN ts USING (job_id) LEFT JOIN rs USING (job_id)""",
    "citekey_collisions": f"WITH {_ONE} SELECT citekey, count(*) AS n, min(item_key) AS first_item FROM (SELECT item_key, {_CITEKEY} AS citekey FROM one) WHERE citekey IS NOT NULL GROUP BY citekey HAVING count(*) > 1",
    "citekey_items": f"WITH {_ONE}, k AS (SELECT item_key, {_CITEKEY} AS citekey FROM one) SELECT * FROM k WHERE citekey IN (SELECT citekey FROM k WHERE citekey IS NOT NULL GROUP BY citekey HAVING count(*) > 1)",
    "citekey_report": f"""WITH {_ONE}, k AS (SELECT item_key, {_CITEKEY} AS citekey FROM one) SELECT count(*) AS scanned, count(*) - count(citekey) AS keyless, count(DISTINCT citekey) AS unique_keys,
 (SELECT count(*) FROM (SELECT citekey FROM k WHERE citekey IS NOT NULL GROUP BY citekey HAVING count(*) > 1)) AS collisions FROM k""",
    "alias_survival": f"""WITH {_ONE}, l AS (SELECT item_key, {_ALIASES} AS aliases, unnest(relations['dc:replaces']) AS uri FROM one),
r AS (SELECT item_key, aliases, regexp_replace(regexp_replace(uri, '/+$', ''), '^.*/', '') AS replaced FROM l), o AS (SELECT item_key AS replaced, {_CITEKEY} AS old_key, TRUE AS known FROM one)
SELECT r.item_key, r.replaced, o.old_key, CASE WHEN o.known IS NULL THEN 'gone' WHEN o.old_key IS NULL THEN 'no key' WHEN list_contains(aliases, o.old_key) THEN 'kept' ELSE 'lost' END AS outcome FROM r LEFT JOIN o USING (replaced)""",
    "log_activity_counts": f"WITH {_E} SELECT activity, count(*) AS n, count(DISTINCT item_key) AS n_items FROM e GROUP BY activity",
    "log_verify_rates": f"WITH {_E}, {_V} SELECT activity, count(*) AS verifies, count(*) FILTER (passed) AS passed, avg(passed::INT::DOUBLE) AS rate FROM v WHERE NOT acknowledged GROUP BY activity",
    "log_daily_report": f"""WITH {_E} SELECT ts::DATE AS day, count(*) AS lines, count(DISTINCT item_key) AS items, count(passed) AS verifies, count(*) FILTER (passed) AS passed, avg(passed::INT::DOUBLE) AS rate FROM e GROUP BY ts::DATE""",
    "log_latest_per_item": f"WITH {_E} SELECT item_key, max(append_seq) AS append_seq, arg_max(activity, append_seq) AS activity FROM e WHERE item_key IS NOT NULL GROUP BY item_key",
    "log_coverage": """SELECT count(*) AS lines, count(DISTINCT prov_id) AS ids, count(prov_id) - count(DISTINCT prov_id) AS repeated, count(*) FILTER (item_key IS NULL) AS no_item, count(*) FILTER (agent IS NULL) AS no_agent,
 count(*) FILTER (params IS NOT NULL AND NOT json_valid(params)) AS broken_params, min(append_seq) AS first_seq, max(append_seq) AS last_seq FROM prov_log""",
    "log_late_lines": f"""WITH {_E} SELECT activity, count(*) FILTER (coalesce(ts < top, FALSE)) AS late, count(*) AS lines FROM (SELECT *, max(ts) OVER (PARTITION BY activity ORDER BY append_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e WHERE ts IS NOT NULL) GROUP BY activity""",
    "log_unanswered": f"""WITH {_E}, a AS (SELECT snapshot_id, max(append_seq) AS append_seq, count(*) AS intents FROM e WHERE activity = 'merge_txn_intent' GROUP BY snapshot_id)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE activity IN ('merge_txn_result', 'merge_txn_rolled_back') AND e.snapshot_id IS NOT DISTINCT FROM a.snapshot_id)""",
    "log_failures": f"""WITH {_E}, f AS (SELECT snapshot_id, count(*) AS failures FROM e WHERE passed = FALSE AND snapshot_id IS NOT NULL GROUP BY snapshot_id)
SELECT snapshot_id, failures, snapshot_id IN (SELECT snapshot_id FROM e WHERE activity = 'verify_failure_acknowledged' AND snapshot_id IS NOT NULL) AS acknowledged FROM f""",
    "log_recent_merges": f"WITH {_E} SELECT append_seq, prov_id, item_key, snapshot_id FROM e WHERE activity = 'merge_txn_result' ORDER BY append_seq DESC LIMIT 20",
    "library_health": f"""WITH {_ONE}, x AS (SELECT *, NOT coalesce(deleted, FALSE) AS live FROM one) SELECT count(*) AS items, count(*) FILTER (NOT live) AS trashed, count(*) FILTER (live AND item_type IN {_list(DOI_TYPES)}) AS doi_types,
 round(100.0 * count(*) FILTER (live AND item_type IN {_list(DOI_TYPES)} AND trim(coalesce(doi, '')) = '') / nullif(count(*) FILTER (live AND item_type IN {_list(DOI_TYPES)}), 0), 2) AS pct_missing_doi,
 count(*) FILTER (live AND coalesce(len(creators), 0) = 0) AS no_creators, count(*) FILTER (live AND coalesce(pub_date, '') = '') AS no_date, count(*) FILTER (live AND coalesce(citation_key, '') = '') AS no_key FROM x""",
    "validate_buckets": f"""WITH {_ONE} SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN len({_RULES}) > 0 THEN 'issues' WHEN item_type = 'journalArticle' AND coalesce(doi, '') = '' THEN 'warnings' ELSE 'clean' END AS bucket FROM one) GROUP BY bucket""",
    "edited_tags": f"""WITH {_ONE} SELECT item_key, array_to_string(list_sort(list_filter(list_distinct(list_concat(coalesce(list_transform(tags, lambda t: t.tag), []), ['to check'])), lambda x: x <> 'folklore')), ',') AS tags FROM one""",
    "front_matter": r"""WITH b AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---', 1) AS x FROM documents),
f AS (SELECT doc_id, """ + ", ".join("nullif(regexp_replace(" + _squeeze(rf"regexp_extract(x, '(?im)^{k}[ \t]*:[ \t]*(.+)$', 1)") + f""", '^["'']|["'']$', '', 'g'), '') AS {k}""" for k in ("title", "author", "date", "year", "doi")) + """ FROM b)
SELECT * FROM f WHERE title IS NOT NULL OR author IS NOT NULL OR year IS NOT NULL""",
    "write_batches": "WITH x AS (SELECT (row_number() OVER (ORDER BY item_key) - 1) AS i FROM (SELECT DISTINCT item_key FROM items WHERE item_key IS NOT NULL)) SELECT i // 50 AS batch, count(*) AS n, max(i % 50)::INT AS last_index FROM x GROUP BY i // 50",
    "blob_digests": "SELECT DISTINCT sha256(text) AS digest, length(text)::INT AS n_chars FROM documents WHERE text IS NOT NULL",
    "transaction_ids": """SELECT job_id, 'TXN-' || substr(sha256(concat_ws('|', coalesce(master, ''), array_to_string(list_sort(coalesce(secondaries, [])), ','))), 1, 16) AS txn_id FROM cluster_jobs""",
    "version_differences": """WITH i AS (SELECT item_key, title, pub_date, doi, volume, citation_key, extra, version, date_modified FROM items WHERE item_key IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY version, date_modified NULLS FIRST, title NULLS FIRST, pub_date NULLS FIRST, doi NULLS FIRST, volume NULLS FIRST, citation_key NULLS FIRST, extra NULLS FIRST) AS up,
 row_number() OVER (PARTITION BY item_key ORDER BY version DESC, date_modified DESC NULLS LAST, title DESC NULLS LAST, pub_date DESC NULLS LAST, doi DESC NULLS LAST, volume DESC NULLS LAST, citation_key DESC NULLS LAST, extra DESC NULLS LAST) AS down FROM i),
o AS (SELECT * FROM r WHERE up = 1), n AS (SELECT * FROM r WHERE down = 1)
""" + " UNION ALL ".join(f"SELECT o.item_key, '{c}' AS field, o.{c} AS value_a, n.{c} AS value_b FROM o JOIN n USING (item_key) WHERE o.{c} IS DISTINCT FROM n.{c}" for c in ("title", "pub_date", "doi", "volume", "citation_key", "extra")),
    "document_facts": rf"""WITH t AS (SELECT doc_id, contains(lower(source), 'ocr') AS ocr, CASE WHEN len(coalesce(text, '')) / (len(string_split(coalesce(text, ''), chr(12)))) >= 1000 THEN 'born_digital' WHEN len(coalesce(text, '')) / (len(string_split(coalesce(text, ''), chr(12)))) <= 200 THEN 'scanned' END AS vote, coalesce(text, '') AS x, regexp_extract_all(lower(coalesce(text, '')), '([a-zA-Z]+)', 1) AS w FROM documents)
SELECT doc_id, nullif(regexp_replace(regexp_replace(lower(regexp_extract(x, '\b(10\.\d{{4,9}}/\S+)', 1)), '[.,;:!?''"”’)\]}}]+$', ''), '^https?://(dx\.)?doi\.org/', ''), '') AS doi,
 lower(nullif(regexp_extract(x, '(?i)\barxiv:\s*(\d{{4}}\.\d{{4,5}}(?:v\d+)?)', 1), '')) AS arxiv, nullif(upper(regexp_replace(regexp_extract(x, '(?i)\bisbn(?:-1[03])?[:\s]\s*([0-9][0-9 -]{{8,20}}[0-9Xx])', 1), '[ -]', '', 'g')), '') AS isbn, CASE WHEN len(w) = 0 THEN 'unknown' WHEN len(list_filter(w, lambda q: q IN {_list(FUNCTION_WORDS)})) / len(w) >= {ENGLISH_SHARE} THEN 'en' ELSE 'other' END AS language,
 CASE WHEN ocr IS NOT NULL AND vote IS NOT NULL AND (ocr AND vote = 'scanned' OR NOT ocr AND vote = 'born_digital') THEN vote ELSE 'scanned' END AS source_kind FROM t""",
    "log_health": f"WITH {_E}, {_V}, {_HEALTH} SELECT * FROM hh",
    "log_freshness": f"WITH {_E}, {_FRESH} SELECT * FROM f",
    "log_unresolved": f"WITH {_E}, {_TX} {_UNRESOLVED}",
    "log_transaction_states": f"""WITH {_E}, {_TX} SELECT snapshot_id, w AS writes, CASE WHEN c > 0 AND r > 0 THEN 'torn' WHEN c > 0 THEN 'committed' WHEN r > 0 THEN 'rolled back' WHEN w > 0 THEN 'written' WHEN i > 0 THEN 'intended' ELSE 'planned' END AS state FROM has""",
    "log_open_writes": f"""WITH {_E}, {_TX} SELECT snapshot_id, item_key, count(*) AS writes FROM e WHERE activity = 'merge_txn_write' AND snapshot_id IN (SELECT snapshot_id FROM has WHERE c + r = 0) GROUP BY ALL""",
    "log_inversion": f"""WITH {_E}, {_TX} SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY append_seq DESC)::INT AS step, append_seq, item_key FROM e WHERE activity = 'merge_txn_write' AND snapshot_id IN (SELECT snapshot_id FROM has WHERE c + r = 0)""",
    "log_lost_snapshots": f"WITH {_E} SELECT snapshot_id, count(*) AS lines FROM e WHERE snapshot_id IS NOT NULL AND snapshot_id NOT IN (SELECT snapshot_id FROM item_snaps WHERE snapshot_id IS NOT NULL) GROUP BY snapshot_id",
    "log_run_counters": f"WITH {_E} SELECT agent, activity, count(*) AS lines, count(item_key) AS items, min(append_seq) AS first_seq, max(append_seq) AS last_seq FROM e GROUP BY agent, activity",
    "log_readiness": f"""WITH {_E}, {_V}, {_TX}, {_HEALTH}, {_FRESH}, u AS ({_UNRESOLVED}) SELECT 'freshness' AS gate, CASE WHEN fresh THEN 'pass' ELSE 'fail' END AS status FROM f
 UNION ALL SELECT 'log integrity', CASE WHEN (SELECT count(*) FROM prov_log WHERE params IS NOT NULL AND NOT json_valid(params)) = 0 THEN 'pass' ELSE 'fail' END
 UNION ALL SELECT 'open transactions', CASE WHEN (SELECT count(*) FROM u) = 0 THEN 'pass' ELSE 'fail' END UNION ALL SELECT 'verify rate', CASE WHEN status = 'ok' THEN 'pass' ELSE 'fail' END FROM hh""",
    "jobs_pending": f"WITH {_E} SELECT job_id, snapshot_id FROM cluster_jobs WHERE snapshot_id IS NULL OR snapshot_id NOT IN (SELECT snapshot_id FROM e WHERE activity = 'merge_txn_result' AND snapshot_id IS NOT NULL)",
    "job_candidates": """WITH j AS (SELECT job_id, list_sort(list_distinct(list_filter(member_keys, lambda x: x IS NOT NULL))) AS m FROM cluster_jobs),
c AS (SELECT cand_id, list_sort(list_distinct(list_filter(item_keys, lambda x: x IS NOT NULL))) AS m FROM candidates) SELECT job_id, cand_id FROM j JOIN c USING (m) WHERE len(m) > 0""",
    "library_page": f"WITH {_ONE} SELECT item_key, title, (row_number() OVER (ORDER BY item_key) - 1)::INT AS position FROM one WHERE item_type = 'journalArticle' AND NOT coalesce(deleted, FALSE) QUALIFY row_number() OVER (ORDER BY item_key) BETWEEN 51 AND 75",
    "item_details": f"WITH {_ONE} " + " UNION ALL ".join(f"SELECT item_key, '{c}' AS field, {c} AS value FROM one WHERE coalesce({c}, '') <> ''" for c in ("item_type", "title", "pub_date", "doi", "volume", "issue", "edition", "university", "abstract_note", "publisher", "publication_title", "extra", "citation_key")),
    "item_children": "SELECT item_key, kind, count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents WHERE item_key IN (SELECT item_key FROM items WHERE item_key IS NOT NULL) GROUP BY item_key, kind",
    "orphan_documents": """WITH x AS (SELECT item_key, count(*) AS n FROM documents WHERE item_key IS NOT NULL AND item_key NOT IN (SELECT item_key FROM items WHERE item_key IS NOT NULL) GROUP BY item_key)
SELECT item_key, n, (SELECT count(*) FROM x) AS orphans FROM x ORDER BY item_key LIMIT 10""",
    "items_without_documents": "SELECT DISTINCT item_key FROM items WHERE item_key IS NOT NULL AND item_key NOT IN (SELECT item_key FROM documents WHERE item_key IS NOT NULL)",
    "item_identities": f"WITH {_ONE}, {_KEYED} SELECT item_key, sha256(concat_ws('|', item_type, title_key, year, author, coalesce(doi, ''))) AS identity FROM k",
    "observation_ids": "SELECT DISTINCT snapshot_id, item_key, 'META-' || substr(md5(concat_ws('|', item_key, coalesce(version::VARCHAR, ''))), 1, 12) AS meta_id FROM item_snaps",
    "creators_of_strings": rf"""WITH t AS (SELECT name_id, {_squeeze("full_name")} AS t FROM creator_names WHERE trim(coalesce(full_name, '')) <> '')
SELECT name_id, CASE WHEN contains(t, ',') THEN trim(regexp_replace(t, '^[^,]*,', '')) ELSE regexp_replace(t, '\s*\S+$', '') END AS first_name, CASE WHEN contains(t, ',') THEN trim(split_part(t, ',', 1)) ELSE regexp_extract(t, '(\S*)$', 1) END AS last_name FROM t""",
    "search_queries": f"WITH {_ONE}, {_KEYED} SELECT item_key, concat_ws(' ', title_key, nullif(author, ''), nullif(year, '')) AS query FROM k WHERE doi IS NULL AND title_key <> ''",
    "review_listing": "SELECT cand_id, reason, auto_accept, (row_number() OVER w)::INT AS place, count(*) OVER (PARTITION BY reason) AS total FROM candidates WINDOW w AS (PARTITION BY reason ORDER BY cand_id) QUALIFY row_number() OVER w <= 20",
    "validate_items": f"""WITH {_ONE}, r AS (SELECT item_key, {_ISSUES} AS i, {_WARNINGS} AS w FROM one) SELECT item_key, array_to_string(i, ',') AS issues, array_to_string(w, ',') AS warnings,
 CASE WHEN len(i) > 0 THEN 'issues' WHEN len(w) > 0 THEN 'warnings' ELSE 'clean' END AS bucket FROM r""",
    "item_summaries": rf"""WITH {_ONE} SELECT item_key, '[' || item_key || '] ' || coalesce(array_to_string(list_transform(list_filter(creators[1:3], lambda c: c.creatorType = 'author'), lambda c: coalesce(c.lastName, '')), ', ') || CASE WHEN len(creators) > 3 THEN ' et al.' ELSE '' END, '')
 || ' (' || coalesce(nullif(regexp_extract(coalesce(pub_date, 'n.d.'), '(\d{{4}})', 1), ''), pub_date, 'n.d.') || ') "' || coalesce(title, 'Untitled') || '" [' || coalesce(item_type, '') || ']' AS summary FROM one""",
    "keyword_search": f"""WITH {_ONE}, t AS (SELECT item_key, string_split({_words("concat_ws(' ', title, array_to_string(list_transform(coalesce(creators, []), lambda c: concat_ws(' ', c.firstName, c.lastName, c.name)), ' '), " + _YEAR("pub_date") + ")")}, ' ') AS w FROM one WHERE coalesce(item_type, '') <> 'attachment' AND NOT coalesce(deleted, FALSE))
SELECT item_key, 2::BIGINT AS hits FROM t WHERE list_contains(w, 'survey') AND list_contains(w, 'harvest')""",
}

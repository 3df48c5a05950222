import json

import pytest
from pyspark.sql import functions as F

from collatrix.operators import agreement, audit, citekeys, dedup, merge, pairs, quality
from collatrix.session import table
from collatrix.sources import landed, sinks

ITEM = (
    "item_key string, version long, item_type string, title string, pub_date string, doi string, volume string, issue string, edition string, university string, abstract_note string, "
    "publisher string, publication_title string, extra string, citation_key string, creators array<struct<creatorType string, firstName string, lastName string, name string>>, "
    "collections array<string>, tags array<struct<tag string, type int>>, relations map<string, array<string>>, deleted boolean, date_added timestamp, date_modified timestamp"
)
COLUMNS = [c.strip().split(" ")[0] for c in ITEM.replace("array<struct<creatorType string, firstName string, lastName string, name string>>", "x").replace("array<struct<tag string, type int>>", "x").replace("map<string, array<string>>", "x").split(",")]


def items(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        names = r.pop("authors", ["Smith"])
        base = {"item_key": f"K{i}", "version": 1, "item_type": "book", "title": "A Study of Rivers", "pub_date": "2001", "creators": [("author", "A", n, None) for n in names]}
        full.append(tuple((base | r).get(c) for c in COLUMNS))
    return spark.createDataFrame(full, ITEM)


def scan(df):
    return [(sorted(r["item_keys"]), r["auto_accept"], list(r["conflicts"]), r["master_key"]) for r in dedup.clusters(df).collect()]


CASES = [
    ([{"doi": "10.1/a", "title": "Rivers of Peru"}, {"doi": "10.1/A", "title": "Clay pots"}], ["title disagreement"]),
    ([{"title": "Rivers: north"}, {"title": "Rivers: south"}], ["title disagreement", "subtitle disagreement"]),
    ([{"title": "Rivers of the valley: a descriptive study"}, {"title": "Rivers of the valley"}], []),
    ([{"title": "Rivers of the valley: a descriptive study in parts"}, {"title": "Rivers of the valley"}], ["title disagreement"]),
    ([{"title": "Rivers of the great valley in winter: notes"}, {"title": "Rivers of the great valley in winter"}], []),
    ([{"doi": "10.1/a"}, {"doi": "10.1/a"}], []),
    ([{"doi": "10.1/a", "item_type": "report"}, {"doi": "10.1/a"}], ["item-type conflict"]),
    ([{"doi": "10.1/a"}, {"doi": "10.1/b"}], ["DOI disagreement"]),
    ([{"title": "Historia Tomo I"}, {"title": "Historia Tomo II"}], None),
    ([{"volume": "1"}, {"volume": "2"}], ["volume disagreement"]),
    ([{"edition": "1"}, {"edition": None}], []),
    ([{"edition": "2"}, {"edition": None}], ["edition disagreement"]),
    ([{"authors": ["Smith", "Li", "Ray"]}, {"authors": ["Smith"]}], ["creator disagreement"]),
    ([{"authors": ["Smith", "Li"]}, {"authors": ["Smith"]}], []),
    ([{"authors": ["Smith", "Li"]}, {"authors": ["Smith", "Li"]}], []),
    ([{"title": "One"}, {"title": "Other"}], None),
]


@pytest.mark.parametrize(("rows", "conflicts"), CASES)
def test_guards(spark, rows, conflicts):
    got = scan(items(spark, *[dict(r) for r in rows]))
    if conflicts is None:
        assert got == []
    else:
        assert [g[2] for g in got] == [conflicts]
        assert got[0][1] == (not conflicts)


def test_numeral_is_no_clipped_subtitle(spark):
    got = scan(items(spark, {"title": "A long title of some work: tomo xvi"}, {"title": "A long title of some work: tomo xvii"}))
    assert "subtitle disagreement" in got[0][2]


def test_master_is_most_complete_then_least(spark):
    assert scan(items(spark, {"item_key": "Z", "publisher": "P"}, {"item_key": "A", "collections": ["x", "y"]}))[0][3] == "Z"
    assert scan(items(spark, {"item_key": "Z"}, {"item_key": "A"}))[0][3] == "A"


def test_last_delivery_wins_and_odd_input_is_no_error(spark):
    df = items(spark, {"item_key": "A", "version": 1, "title": "Old"}, {"item_key": "A", "version": 2, "title": "New"}, {"item_key": None}, {"item_key": "B", "title": None, "creators": None}, {"item_key": "C", "title": "x" * 50_000})
    assert dedup.latest(df).filter("item_key = 'A'").first()["title"] == "New"
    assert scan(df) == []
    assert scan(df.limit(0)) == []
    assert quality.validated(df.limit(0)).count() == 0


def test_pair_scores_match_brute_force(spark, sf):
    from difflib import SequenceMatcher

    df = items(spark, {"title": "River trade in Peru", "doi": "10.1/x"}, {"title": "Clay pots", "doi": "10.1/X"}, {"title": None}, {"title": "River trade in Peru", "pub_date": "2002"}, {"title": "River trade in Perú", "authors": ["Jones"]})
    rec = df.select("item_key", F.struct("title", "doi", "pub_date", "creators").alias("r"))
    got = {(r["x"], r["y"]): r["score"] for r in pairs.scored(rec.select(F.col("item_key").alias("x"), F.col("r").alias("a")).join(rec.select(F.col("item_key").alias("y"), F.col("r").alias("b")), F.col("x") < F.col("y"))).collect()}
    assert got["K0", "K1"] == 1.0
    assert got["K0", "K2"] == 0.0
    assert got["K0", "K3"] == pytest.approx(0.925, abs=0.01)
    ratio = SequenceMatcher(None, "river trade in peru", "river trade in perú").ratio()
    assert got["K0", "K4"] == pytest.approx(round(ratio * 0.55 + 0.15, 3), abs=1e-9)
    assert ("K0", "K3") in {(r["key_a"], r["key_b"]) for r in pairs.candidates(df).collect()}


def test_pair_candidates_miss_no_pair(spark, sf):
    df = items(
        spark, {"title": "Pots near Mozudeth", "doi": "10.1/x"}, {"title": "Quite other words", "doi": "10.1/X ", "authors": ["Jones"]}, {"title": "Rivertrade inn Perru"}, {"title": "River trade in Peru", "authors": ["Smyth"]},
        {"title": "River trades in Perus", "authors": ["Li"]}, {"title": "River tradez in Peruz", "authors": ["Wu"]}, {"title": "?!", "authors": []}, {"title": "..", "authors": [None]}, {"title": None}, {"title": "River trade", "pub_date": None, "authors": [None]})
    for lib in (df, table(spark, sf, "items").limit(150)):
        rec = dedup.latest(lib).select("item_key", F.struct("title", "doi", "pub_date", "creators").alias("r"))
        every = pairs.scored(rec.select(F.col("item_key").alias("key_a"), F.col("r").alias("a")).join(rec.select(F.col("item_key").alias("key_b"), F.col("r").alias("b")), F.col("key_a") < F.col("key_b")))
        for least in (0.65, 0.5):
            want = {(r["key_a"], r["key_b"], r["score"]) for r in every.filter(F.col("score") >= least).select("key_a", "key_b", "score").collect()}
            assert want
            assert {tuple(r) for r in pairs.candidates(lib, least).collect()} == want


def test_pairs_of_hot_blocks_meet_only_if_titles_are_near(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    from collatrix.operators import reach

    draw = random.Random(3)
    words = ["river", "trade", "pots", "kilns", "memory", "harvest", "coast", "песни", "水利工程", "a"]
    titles = [" ".join(draw.choices(words, k=draw.choice([1, 4, 7, 8, 14]))) for _ in range(40)]
    titles += [t[:3] + draw.choice("xyz") + t[5:] for t in titles[:20]] + ["", "", "e" * 300, "e" * 290, "e" * 150, "𝒳" * 40]
    rows = [(f"K{i:03}", 0, t, draw.choice([2000, 2001, 2005, None]), (n := draw.choice([1, 1, 2, 3])), draw.randint(1, n)) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "item_key string, block int, t string, year int, n int, hits int")

    def score(a, b):
        gap = None if a[3] is None or b[3] is None else abs(a[3] - b[3])
        date = 0 if gap is None or gap > 1 else 1 - gap / 2
        return 0.55 * SequenceMatcher(None, a[2], b[2]).ratio() + 0.3 * a[5] / max(a[4], b[4]) + 0.15 * date

    scores = {(a[0], b[0]): score(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]}
    monkeypatch.setattr(reach, "TASKS", 4)
    for least, tile in ((0.65, 2000), (0.65, 9), (0.4, 20)):
        monkeypatch.setattr(reach, "TILE", tile)
        found = [tuple(r) for r in reach.in_blocks(df, least, 1.0).collect()]
        assert len(found) == len(set(found))
        assert {p for p, s in scores.items() if s >= least} <= set(found)
    # other titles of a block without names don't get as far as the ratio
    plain = spark.createDataFrame([(f"K{i:03}", 0, "".join(draw.choices("abcdefghijklmnop ", k=60)), 2000 + 3 * i, 1, 1) for i in range(100)], df.schema)
    assert reach.in_blocks(plain, 0.65, 1.0).count() < 50  # of 4950


def test_top_pairs_of_a_block_without_names(spark):
    df = items(spark, *({"title": f"Pots of {'abcdefgh'[i % 8] * 9} {'klmnopqr'[i // 8] * 9}", "pub_date": str(1900 + i % 3), "authors": [None]} for i in range(40)))
    found = pairs.candidates(df)
    order = sorted((-r["score"], r["key_a"], r["key_b"]) for r in found.collect())
    assert len(order) > 20
    assert [(-r["score"], r["key_a"], r["key_b"]) for r in pairs.top(found).collect()] == order[:20]


def test_like_names_miss_none(spark):
    from difflib import SequenceMatcher

    base = ["li", "wu", "abc", "abcd", "smith", "smyth", "smithe", "garcia", "garzia", "garciaa", "aaaaaaaa", "aaaaaaa", "niskebrosic", "niskebrozic", "niskebrosi", "niskebrosik", "iskebrosic", "meyer lindenberg", "meyer lindenburg", "meyerlindenberg", "x" * 300, "x" * 290]
    base += [("konstantinopolitanischer dudelsackpfeifer" * 2)[:k] for k in (29, 30, 31, 33, 36, 40, 50)] + ["konstantinopolitanische dudelsackpfeifer von wu", ""]
    got = {tuple(r) for r in pairs._like_names(spark.createDataFrame([(x,) for x in base], "name string")).collect()}
    assert {(x, y) for x in base for y in base if SequenceMatcher(None, x, y).ratio() > 0.85} <= got


def test_agreement(spark):
    lib = items(spark, {"item_key": "A", "doi": "10.1/a", "publication_title": "J"}, {"item_key": "B", "doi": "10.1/b"}, {"item_key": "C", "doi": None})
    schema = "rec_id long, source string, title string, year string, doi string, container_title string, item_type string, creators array<struct<creatorType string, firstName string, lastName string, name string>>"
    rec = spark.createDataFrame([(1, "crossref", "A Study of Rivers", "2001", "10.1/A", "J", "book", [("author", "A", "Smith", None)]), (2, "openalex", "A study of rivers", "2002", "10.1/a", None, None, None)], schema)
    s = {r["cand"]: r for r in agreement.scores(agreement.lookup_by_doi(agreement.candidates_of(lib), agreement.authorities_of(rec))).collect()}
    assert (s["A"]["title"], s["A"]["author"], s["A"]["year"], s["A"]["venue"], s["A"]["id"]) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert s["A"]["p_raw"] == pytest.approx(1.0)
    assert s["A"]["consensus"]
    assert s["A"]["decision"] == "accept"
    assert s["B"]["doi_unresolved"]
    assert s["B"]["p_raw"] == 0.0
    assert s["C"]["decision"] == "flag"
    fields = {r["field"]: r["value"] for r in agreement.consensus_fields(rec).collect()}
    assert fields == {"title": "A Study of Rivers", "DOI": "10.1/A"}


def test_merge_and_its_checks(spark):
    lib = items(
        spark, {"item_key": "M", "extra": "Citation Key: m1", "collections": ["c1"], "tags": [("t", 0)], "publisher": ""},
        {"item_key": "S", "extra": "Citation Key: s1\ntex.ids: old", "collections": ["c2"], "tags": [("t", 1)], "relations": {"dc:relation": ["u"]}, "publisher": "P"})
    jobs = spark.createDataFrame([(1, ["M", "S", "M", None], "M", {}), (2, ["X"], None, None), (3, None, None, None)], "job_id long, member_keys array<string>, master string, field_sources map<string,string>")
    members = merge.plan(jobs)
    assert {r["member"] for r in members.collect()} == {"M", "S"}
    after = merge.applied(lib, members, smart_fill=True)
    m = after.filter("item_key = 'M'").first()
    assert m["extra"] == "Citation Key: m1\ntex.ids: s1, old"
    assert m["publisher"] == "P"
    assert sorted(m["collections"]) == ["c1", "c2"]
    assert {(t["tag"], t["type"]) for t in m["tags"]} == {("t", 0), ("t", 1)}
    assert m["relations"] == {"dc:relation": ["u"], "dc:replaces": ["S"]}
    assert after.filter("item_key = 'S'").first()["deleted"]
    kids = spark.createDataFrame([("n", "S", "note", None, None), ("a", "S", "attachment", "h", "f"), ("x", "a", "annotation", None, None)], "child_key string, parent_key string, kind string, md5 string, filename string")
    moved = kids.withColumn("parent_key", F.when(F.col("parent_key") == "S", "M").otherwise(F.col("parent_key")))
    good = {(r["number"], r["name"]): r["passed"] for r in merge.checks(members, lib, after, kids, moved, smart_fill=True).collect()}
    assert len(good) == 13
    assert all(good.values()), good
    # each corruption is reported by its check and by no other
    change = lambda **kw: after.select(*[(F.when(F.col("item_key") == "M", kw[c]).otherwise(F.col(c))).alias(c) if c in kw else F.col(c) for c in after.columns])
    for corrupt, number in ((change(item_type=F.lit("report")), 1), (change(publisher=F.lit("Q")), 3), (change(collections=F.array(F.lit("c1"))), 4), (change(tags=F.slice("tags", 1, 1)), 5), (change(relations=F.lit(None).cast("map<string,array<string>>")), 6)):
        bad = {r["number"] for r in merge.checks(members, lib, corrupt, kids, moved, smart_fill=True).collect() if not r["passed"]}
        assert bad == {number}
    assert {r["number"] for r in merge.checks(members, lib, after, kids, kids, smart_fill=True).collect() if not r["passed"]} == {7, 8}
    assert [r["number"] for r in merge.checks(members, lib, after.filter("item_key <> 'M'"), kids, moved).collect() if not r["passed"]] == [0]
    steps = {r["item_key"]: r["step"] for r in merge.undo(members, lib, after).collect()}
    assert steps == {"M": "revert", "S": "restore"}


def test_every_job_is_checked(spark, tmp_path):
    from collatrix.plans import catalogue

    items(spark, {"item_key": "A"}, {"item_key": "B", "title": "B", "relations": {"dc:replaces": ["A"]}}, {"item_key": "C", "title": "C"}).write.parquet(f"{tmp_path}/items.parquet")
    jobs = [(1, ["A", "B"], "A", {"title": "B"}), (2, ["B", "C"], "B", {"title": "C"}), (3, ["C", "A"], "A", None), (4, ["A", "gone"], "gone", None)]
    spark.createDataFrame(jobs, "job_id long, member_keys array<string>, master string, field_sources map<string,string>").write.parquet(f"{tmp_path}/cluster_jobs.parquet")
    got = catalogue.merge_checks(spark, str(tmp_path)).collect()
    assert {j: sum(r["job_id"] == j for r in got) for j in (1, 2, 3, 4)} == {1: 8, 2: 8, 3: 8, 4: 1}
    assert {(r["job_id"], r["number"]) for r in got if not r["passed"]} == {(4, 0)}


def test_citekeys(spark):
    lib = items(spark, {"item_key": "A", "citation_key": "k"}, {"item_key": "B", "extra": "citation key: k"}, {"item_key": "C", "citation_key": "z"}, {"item_key": "D", "relations": {"dc:replaces": ["http://x/items/A/", "http://x/items/Q"]}, "extra": "tex.ids: k"})
    r = citekeys.report(lib).first()
    assert (r["scanned"], r["keyless"], r["unique_keys"], r["collisions"]) == (4, 1, 2, 1)
    assert {(x["replaced"], x["outcome"]) for x in citekeys.alias_survival(lib).collect()} == {("A", "kept"), ("Q", "gone")}


def test_log_counts_a_repeated_line_once(spark):
    schema = "append_seq long, prov_id string, activity string, agent string, item_key string, snapshot_id string, params string, ts timestamp, passed boolean"
    v = "commit_merge_verify"
    rows = [(1, "p1", "snapshot", None, "A", "s", "{}", None, None), (2, "p2", v, None, "A", "s", "{bad", None, True), (3, "p2", v, None, "A", "s", "{bad", None, True), (4, "p3", v, None, None, "s", None, None, False), (5, None, "x", None, None, None, None, None, None), (6, None, "x", None, None, None, None, None, None)]
    log = spark.createDataFrame(rows, schema)
    r = audit.verify_rates(log).first()
    assert (r["verifies"], r["passed"], r["rate"]) == (2, 1, 0.5)
    # other activities don't count; a reviewed failure leaves the rate but is reported
    more = log.unionByName(spark.createDataFrame([(7, "p7", "other", None, None, "s", None, None, False), (8, "p8", "verify_failure_acknowledged", None, None, "s", None, None, None)], schema))
    assert audit.verify_rates(more).first()["rate"] == 1.0
    h = audit.health(more).first()
    assert (h["verifies"], h["passed"], h["acknowledged"], h["rate"], h["status"]) == (1, 1, 1, 1.0, "ok")
    assert audit.health(log).first()["status"] == "degraded"
    assert audit.health(log.limit(0)).first()["status"] == "ok"
    assert {r["activity"]: r["n"] for r in audit.activity_counts(log).collect()} == {"snapshot": 1, v: 2, "x": 2}
    c = audit.coverage(log).first()
    assert (c["repeated"], c["broken_params"], c["no_item"]) == (1, 2, 3)
    assert audit.unanswered(log, "snapshot", ["commit"], ["snapshot_id"]).count() == 1
    assert audit.unanswered(log, "snapshot", [v], ["snapshot_id"]).count() == 0
    assert audit.activity_counts(log.limit(0)).count() == 0


def test_damaged_lines(spark):
    import hashlib

    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, "{broken"), (3, "[1]"), (4, ""), (5, None)], "line_no long, value string")
    mark = spark.createDataFrame([(2, hashlib.sha256(b"{broken").hexdigest())], "line_no long, sha string")
    assert {(r["line_no"], r["reason"], r["status"]) for r in audit.damage(lines, mark).collect()} == {(2, "not json", "accepted"), (3, "not an object", "blocking")}


def test_batches_and_versions(spark):
    b = sinks.batches(spark.range(120).selectExpr("cast(id as string) as k"), "k")
    assert sorted((r["batch"], r["count"]) for r in b.groupBy("batch").count().collect()) == [(0, 50), (1, 50), (2, 20)]
    assert b.select("batch", "index").distinct().count() == 120
    t = spark.createDataFrame([("A", 1, "x"), ("B", 2, "y")], "k string, version long, v string")
    done, bad = sinks.versioned_patch(t, spark.createDataFrame([("A", 1, "new"), ("B", 1, "no"), ("Q", 1, "no")], "k string, version long, v string"), "k")
    assert {tuple(r) for r in done.collect()} == {("A", 2, "new"), ("B", 2, "y")}
    assert {r["k"] for r in bad.collect()} == {"B", "Q"}


def test_landed_payloads(spark):
    put = lambda *xs: spark.createDataFrame([(json.dumps(x),) for x in xs], "value string")
    cr = landed.normalise(put({"message": {"title": ["T"], "DOI": "10.1/X", "type": "journal-article", "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2001, 2]]}}}, {"message": {}}), "crossref")
    oa = landed.normalise(put({"id": "https://x/W1", "display_name": "T", "publication_year": 2001, "authorships": [{"author": {"display_name": "A B", "orcid": "https://o/0000-x"}}]}), "openalex")
    rows = landed.gather([cr, oa]).collect()
    assert [(r["source"], r["title"], r["year"], r["doi"]) for r in rows] == [("crossref", "T", "2001", "10.1/x"), ("openalex", "T", "2001", None)]
    assert rows[1]["creators"][0]["orcid"] == "0000-X"


def test_bibtex_and_files(spark, tmp_path):
    bib = spark.createDataFrame([("k1", "@article{smith00, title = {The {DNA} of\n rivers}, author = {Smith, A. and Bea Ray}, pages = {1--9}, year = 2000}"), ("k2", "none"), ("k3", None), ("k4", "@odd{x, title = {T~U}, editor = {Poe, E.}}")], "item_key string, value string")
    r = sorted(landed.parse_bibtex(bib).collect())
    assert [(x["item_key"], x["item_type"]) for x in r] == [("k1", "journalArticle"), ("k4", "journalArticle")]
    assert r[1]["fields"] == {"title": "T U"}
    assert [(c["creatorType"], c["lastName"]) for c in r[1]["creators"]] == [("editor", "Poe")]
    assert r[0]["fields"] == {"title": "The DNA of rivers", "pages": "1-9", "date": "2000"}
    assert [(c["firstName"], c["lastName"]) for c in r[0]["creators"]] == [("A.", "Smith"), ("Bea", "Ray")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Smith - 2001 - Rivers.PDF").write_bytes(b"%PDF doi:10.1234/abc rest")
    (tmp_path / "x.txt").write_text("t")
    got = landed.scan_files(spark, str(tmp_path), [".pdf"]).collect()
    assert [(g["stem"], g["suffix"]) for g in got] == [("Smith - 2001 - Rivers", ".pdf")]
    log = tmp_path / "log.jsonl"
    log.write_text('{"prov_id": "a", "activity": "x"}\n{broken\n[1]\n')
    assert [x["prov_id"] for x in landed.read_log(spark, str(log)).collect()] == ["a"]


def test_stream_counts_equal_batch(spark, sf, tmp_path):
    from collatrix.streaming import log_tail

    src = tmp_path / "in"
    log = table(spark, sf, "prov_log").select("append_seq", "prov_id", "activity", "agent", "item_key", "snapshot_id", "params", F.col("ts").cast("timestamp").alias("ts"), "passed")
    log.write.parquet(str(src))
    stream = log_tail.read(spark, str(src))
    # every line is delivered again in a later file, with a later append
    log.withColumn("append_seq", F.col("append_seq") + 1_000_000).filter("prov_id is not null").write.mode("append").parquet(str(src))
    want = {tuple(r) for r in audit.latest_per_item(log).collect()}
    for _ in range(2):  # the second run finds nothing new
        q = log_tail.read(spark, str(src), per_trigger=1).writeStream.foreachBatch(log_tail.upsert_latest(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {tuple(r) for r in log_tail.latest(spark, str(tmp_path / "out")).collect()} == want
    counts = log_tail.windowed_counts(stream, late="3650 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    got = {r["activity"]: r["n"] for r in spark.sql("select activity, sum(n) as n from counts group by activity").collect()}
    assert got == {r["activity"]: r["n"] for r in audit.entries(log).filter("ts is not null").groupBy("activity").agg(F.count("*").alias("n")).collect()}


def test_every_query_runs(spark, sf, tmp_path):
    from collatrix.plans import catalogue

    for name, q in catalogue.queries().items():
        q(spark, sf).write.parquet(str(tmp_path / name))
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_library_reads(spark):
    from collatrix.operators import library

    lib = items(spark, {"item_key": "A", "tags": [("x", 0)]}, {"item_key": "B", "deleted": True}, {"item_key": "C", "item_type": "report", "authors": ["Wu"]}, {"item_key": None})
    assert [r["item_key"] for r in library.scan(lib).orderBy("item_key").collect()] == ["A", "C"]
    assert [(r["position"], r["item_key"]) for r in library.page(library.scan(lib, trashed=True), 1, 5).collect()] == [(1, "B"), (2, "C")]
    assert library.page(lib, 50, 5).count() == 0
    assert library.point(lib, "C").first()["item_type"] == "report"
    assert {r["field"] for r in library.details(library.point(lib, "A")).collect()} == {"item_type", "title", "pub_date"}
    other = items(spark, {"item_key": "A", "tags": [("y", 1)]}, {"item_key": "C", "item_type": "report"})
    got = {(r["item_key"], r["field"]): (r["only_a"], r["only_b"]) for r in library.set_differences(lib, other).filter("item_key in ('A', 'C')").collect()}
    assert got == {("A", "tags"): ("x", "y"), ("C", "creators"): ("author/Wu/A/", "author/Smith/A/")}
    docs = spark.createDataFrame([("A", "note", 3), ("A", "note", None), ("Z", "page", 1), (None, "page", 1)], "item_key string, kind string, n_chars long")
    assert [tuple(r) for r in library.children(docs, lib).collect()] == [("A", "note", 2, 3)]
    assert [tuple(r) for r in library.orphans(docs, lib).collect()] == [("Z", 1, 1)]
    assert {r["item_key"] for r in library.childless(docs, lib).collect()} == {"B", "C"}
    jobs = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, [None]), (3, None)], "job_id long, member_keys array<string>")
    found = spark.createDataFrame([(7, ["a", "b"]), (8, ["a"]), (9, None)], "cand_id long, item_keys array<string>")
    assert [tuple(r) for r in library.same_members(jobs, found).collect()] == [(1, 7)]


def test_files_tell_their_records(spark, tmp_path):
    from collatrix.operators import ingest

    md = spark.createDataFrame([("---\ntitle: \"T\"\nauthor: A\n---\n# H\ndoi 10.1234/abc.",), ("# Head line\ntext 10.1234/x.y.",), (None,)], "t string")
    got = [(r["title"], r["author"], r["doi"]) for r in md.select(*[c.alias(k) for k, c in ingest.markdown_facts(F.col("t")).items()]).collect()]
    assert got == [("T", "A", "10.1234/abc"), ("Head line", None, "10.1234/x.y"), (None, None, None)]
    assert md.select(ingest.head_doi(F.lit("%PDF (10.1000/abc.)")).alias("d"), ingest.head_doi(F.lit("10.1000/a")).alias("e")).first()[:] == ("10.1000/abc.)", None)
    path = tmp_path / "log.jsonl"
    path.write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    rows = landed.read_lines(spark, str(path)).collect()
    assert len(rows) == 2000
    assert all(r["value"] == f"line {r['line_no']}" for r in rows)


def test_transactions_are_told_apart(spark):
    schema = "append_seq long, prov_id string, activity string, agent string, item_key string, snapshot_id string, params string, ts timestamp, passed boolean"
    line = lambda n, a, s, k=None: (n, f"p{n}", a, None, k, s, None, None, None)
    log = spark.createDataFrame([
        line(1, "merge_txn_intent", "a"), line(2, "merge_txn_write", "a", "X"), line(3, "merge_txn_result", "a"), line(4, "merge_txn_intent", "b"), line(5, "merge_txn_write", "b", "X"), line(6, "merge_txn_write", "b", "Y"),
        line(7, "merge_txn_write", "c", None), line(8, "merge_txn_result", "d"), line(9, "merge_txn_rolled_back", "d"), line(10, "snapshot_cluster", "e")], schema)
    assert {(r["snapshot_id"], r["reason"]) for r in audit.unresolved(log).collect()} == {("b", "intent without an end"), ("c", "writes without an intent"), ("d", "end without an intent")}
    assert {r["snapshot_id"]: r["state"] for r in audit.transaction_states(log).collect()} == {"a": "committed", "b": "written", "c": "written", "d": "torn", "e": "planned"}
    assert {(r["snapshot_id"], r["item_key"]) for r in audit.open_writes(log).collect()} == {("b", "X"), ("b", "Y"), ("c", None)}
    assert {(r["snapshot_id"], r["step"], r["item_key"]) for r in audit.inversion(log).collect()} == {("b", 1, "Y"), ("b", 2, "X"), ("c", 1, None)}
    assert {r["gate"]: r["status"] for r in audit.readiness(log).collect()} == {"freshness": "fail", "log integrity": "pass", "open transactions": "fail", "verify rate": "pass"}
    assert audit.unresolved(log.limit(0)).count() == 0

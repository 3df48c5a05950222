import random

import pytest
from pyspark.sql import functions as F

from collatrix.llm import lookalikes, markup, mixing, sentences, survivor, tokens


def test_encoder_is_exact_and_round_trips(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    t = tokens.tokenizer()
    with open(f"{tokens.TOKENIZER_DIR}/{tokens.BYTE_BPE_50K}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    ref = tiktoken.Encoding("ref", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    letters = "ab cdeABC \n\t中文ไทยéü0123<|endoftext|>'s're🙂​ "
    for s in ["", "hello world", "a" * 3000, "ไทย" * 500, "<|endoftext|>", *("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(500))]:
        assert t.encode(s) == ref.encode_ordinary(s)
        assert t.decode(t.encode(s)) == s
    df = spark.createDataFrame([(1, "hi there"), (2, ""), (3, None), (3, None)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode_texts(df).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in got) == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert tokens.encode_texts(df.limit(0)).count() == 0


SNAP = "snapshot_id string, item_key string, item_type string, citekey string, version long, modified_at timestamp, fields map<string,string>"


def test_survivors(spark):
    from datetime import datetime

    t = lambda d: datetime(2024, 1, d)
    rows = [
        ("s", "A", None, None, 1, t(1), {"title": "Harvest songs of the valley", "volume": "42", "date": "1985-05-05", "place": "o. O.", "DOI": "10.1/abc", "pages": None}),
        ("s", "B", None, None, 1, t(2), {"title": "Harvest songs (…)", "volume": "4", "date": "1985", "place": "?", "DOI": "10.", "pages": "0-0"}),
        ("s", "C", None, None, 1, None, {"title": "harvest songs of the valley", "publisher": "P", "issue": "\t"}),
        ("s", "A", None, None, 1, t(1), {"title": "Harvest songs of the valley", "volume": "42", "date": "1985-05-05", "place": "o. O.", "DOI": "10.1/abc", "pages": None}),
        ("n", "X", None, None, 1, t(1), None), ("n", "Y", None, None, 1, t(3), {"title": "[missing]"}),
    ]
    df = spark.createDataFrame(rows, SNAP)
    got = {(r["snapshot_id"], r["field"]): r["source_key"] for r in survivor.surviving_sources(df).collect()}
    assert got == {("s", "title"): "A", ("s", "volume"): "B", ("s", "date"): "A", ("s", "DOI"): "A", ("s", "publisher"): "C", ("s", "master"): "A", ("n", "master"): "Y"}
    rec = {r["snapshot_id"]: r for r in survivor.surviving_records(df).collect()}
    assert rec["s"]["fields"]["volume"] == "4"
    assert rec["n"]["fields"] is None
    assert survivor.surviving_sources(df.limit(0)).count() == 0
    # trust comes before recency, completeness before trust
    trust = spark.createDataFrame([("A", 2.0), ("Y", 1.0), (None, 9.0)], "item_key string, trust double")
    got = {(r["snapshot_id"], r["field"]): r["source_key"] for r in survivor.surviving_sources(df, trust).collect()}
    assert (got["s", "volume"], got["s", "title"], got["s", "publisher"], got["s", "master"], got["n", "master"]) == ("A", "A", "C", "A", "Y")


def test_mixing_reaches_targets_and_caps(spark):
    rnd = random.Random(1)
    docs = [(i, "big" if i % 3 else "mid", " ".join(rnd.choice(["river", "clay", "salt", "toll"]) + str(i) for _ in range(rnd.randint(3, 30)))) for i in range(600)]
    docs += [(1000, "tiny", "a rare note"), (1001, "tiny", "a rare note"), (1002, "mid", None), (1003, "mid", ""), (1004, None, "lost")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.05, 5), ("none", 0.05, 2)], "source string, target_weight double, max_repeats int")
    s = {r["source"]: r for r in mixing.shares(d, t, total_tokens=4000).collect()}
    assert set(s) == {"big", "mid", "tiny", "none"}
    assert abs(s["big"]["drawn_tokens"] - 2000) < 60
    assert abs(s["mid"]["drawn_tokens"] - 1600) < 60
    assert (s["tiny"]["drawn_copies"], s["tiny"]["most_copies"], s["tiny"]["short"]) == (5, 5, True)
    assert (s["none"]["drawn_tokens"], s["none"]["short"]) == (0, True)
    assert sum(r["actual_share"] for r in s.values()) == pytest.approx(1.0)
    drawn = mixing.draw(d, t, total_tokens=4000)[0]
    assert drawn.groupBy("doc_id").count().join(d.select("doc_id", "source"), "doc_id").join(t, "source").filter("count > max_repeats").count() == 0
    assert {tuple(r) for r in drawn.collect()} == {tuple(r) for r in mixing.draw(d, t, total_tokens=4000)[0].collect()}
    assert mixing.draw(d.limit(0), t)[0].count() == 0


@pytest.mark.parametrize(("given", "want"), [
    ("Fenvоmia", "Fenvomia"), ("A miсroscоpic survеy", "A microscopic survey"), ("Ｃａｌｋ", "Calk"), ("𝗈𝖿 x", "of x"), ("Do­lores", "Dolores"), ("a b", "a b"), ("1304‐1372", "1304-1372"),
    ("élevage", "élevage"), ("ﬆatutes", "statutes"), ("Остревa", "Острева"), ("Part Ι", "Part I"), ("Ꭺpple", "Apple"), ("օne", "one"), ("ɑbc", "abc"),
])
def test_disguised_characters(given, want):
    assert lookalikes.consistent_form(given) == want
    assert lookalikes.skeleton(given) == lookalikes.skeleton(want)


def test_the_whole_public_table_is_used():
    from collatrix.llm.confusables import prototypes

    assert len(prototypes()) > 6000
    for a, b in (("modern", "modem"), ("Ꭺpple", "Apple"), ("օne", "one"), ("paypal", "раураl"), ("l0ve", "IOve")):
        assert lookalikes.skeleton(a) == lookalikes.skeleton(b)
    assert lookalikes.skeleton("apple") != lookalikes.skeleton("angle")


@pytest.mark.parametrize("plain", ["Արմեն Սարգսյան", "ᏣᎳᎩ", "اه", "Ɛwe", "Élevage côtier “x” – y…", "Керамика близ Острева, XIX [sic]", "杜瓦林水利，1146", "هل كان", "भूमिका", "", "x" * 100_000, "नु‍क्ता"])
def test_genuine_text_is_no_case(plain):
    assert lookalikes.consistent_form(plain) == plain


def test_disguised_rows(spark):
    schema = "rec_id long, title string, creators array<struct<firstName: string, lastName: string, name: string>>, forms string"
    df = spark.createDataFrame([(1, "plain", [("A", "В​asov", None)], "x"), (2, "Ｔitle", None, "x"), (3, None, [None], "x"), (4, "", [], None)], schema)
    assert {tuple(r) for r in lookalikes.disguised(df).collect()} == {(1, "creators"), (2, "title")}
    assert lookalikes.consistent_forms(df).count() == 8
    assert {r["value"] for r in lookalikes.skeleton_groups(df.union(df.select(df.rec_id, F.lit("Title"), "creators", "forms"))).collect()} == {"Ｔitle", "Title"}


MARKED = ["<i>x</i>", "&lt;b&gt;y", "{C}alrteva", "\\textbf of", "of~Pilgrim", "$^{14}$C", "'''bold''' word", "an **x** y", "`code` x", "[[Ulp]] x", "{{cite}} a", "== S ==\ntext", "# H\n\ntext", "a <br/> b", "\\& x", "se{\\~n}ala", "| a | b |\n|---|---|\n| 1 | 2 |", "[t](https://r.example/x) y", "&#8217;s", "_of_ x", "x <!-- rev -->"]
PLAIN = ["p < 0.05 in 3 * 4 > 2", "title*", "[sic] and [...]", "R & D", "Ratios a/b and c\\d", "(*moa) and (*choa)", "$34 to $155", "north_42_x", "~45 graves", "{1, 2, 38}", "Trench #58", "see https://repo.example/a_b_c/~x?v=2", "the sign '='", "layer 25|252", "l'échange", "", "1) one"]


@pytest.mark.parametrize("v", MARKED)
def test_markup_is_found_and_removed(v):
    blocks, text, kinds = markup.clean(v)
    assert kinds
    assert not any(x in text for x in ("<i>", "**", "'''", "\\text", "{{", "[[", "&lt;", "]("))
    assert isinstance(blocks, list)


@pytest.mark.parametrize("v", PLAIN)
def test_plain_signs_are_no_markup(v):
    assert markup.clean(v)[1:] == (v, [])


def test_no_section_is_lost_for_being_short():
    long = "A long background, with commas, and with more words than any other part of it. " * 6
    value = f"<jats:abstract><jats:sec><jats:title>Background</jats:title><jats:p>{long}</jats:p></jats:sec><jats:sec><jats:title>Results</jats:title><jats:p>No effect was found.</jats:p></jats:sec></jats:abstract><p>Trial 7.</p><nav><a href='#'>home</a></nav>"
    blocks, text, _ = markup.clean(value)
    assert [b["text"] for b in blocks] == ["Background", long.strip(), "Results", "No effect was found.", "Trial 7."]
    assert "home" not in text


def test_share_of_words_kept(spark, sf):
    """Of the words of all marked-up values without tags, commands and entities, nearly all are in the clean text."""
    import re

    kept = total = 0
    for r in markup.clean_fields(spark.read.parquet(f"{sf}/items.parquet")).filter("size(kinds) > 0").collect():
        plain = re.sub(r"<[^>]*>|&[#\w]+;|\\\\[A-Za-z]+|https?://\S+|[{}$]", " ", r["value"])
        words, have = re.findall(r"[^\W\d_]{4,}", plain), r["text"].replace("\n", " ")
        total += len(words)
        kept += sum(w in have for w in words)
    assert kept / total > 0.98, kept / total


def test_structure_is_kept(spark):
    html = "<div><p>" + "A long paragraph, with commas, and words, that matter a lot. " * 4 + "</p><h2>Head</h2><ul><li>one</li><li>two</li></ul><pre>x = 1\n  y</pre></div><nav><a href='#'>home</a> <a href='#'>about</a></nav>"
    blocks, _, _ = markup.clean(html)
    assert [b["kind"] for b in blocks] == ["paragraph", "heading", "item", "item", "code"]
    assert blocks[-1]["text"] == "x = 1\n  y"
    blocks, _, _ = markup.clean("# T\n\ntext\n\n- a\n- b\n\n```\nrun *x*\n```\n")
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "T"), ("paragraph", "text"), ("item", "a"), ("item", "b"), ("code", "run *x*")]
    df = spark.createDataFrame([("A", "<i>t</i>", None), ("A", "<i>t</i>", None), ("B", "", "plain"), (None, "a **b** c", "x" * 200_000 + " <b>y</b>")], "item_key string, title string, abstract_note string")
    assert sorted((r["item_key"] or "", r["field"]) for r in markup.marked_up(df).collect()) == [("", "abstract_note"), ("", "title"), ("A", "title")]
    assert markup.marked_up(df.limit(0)).count() == 0


TEXTS = [
    "As Dr. Grob noted in vol. 5, pp. 1-9, the ledger lists it. The kiln at Farm was left in the 4th c. B.C. The map lists it, etc. The toll dates it.",
    "Prof. Smith saw Dr. Jones. The pit, etc. The ledger explains it. Dr. Hall and Dr. Webb left. See vol. 3 and pp. 4-7. The copy, etc. The map ends.",
] * 20


def units(spark, texts, *extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *extra])], "doc_id long, text string")
    out = {}
    for r in sentences.sentence_units(df).collect():
        out.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    return {k: sorted(v) for k, v in out.items()}


def test_sentences(spark):
    cases = [
        "“Who kept the ledger?” asked H. Jevon, and nobody replied. “We found nothing. The pit was empty,” wrote Prof. X.",
        "---\ntitle: x\n---\n\n# Head one\n\nThe first\nline goes on. The second.\n\n- an item. With two.\n- other\n\n```\ncode. Here.\n```\n",
        "村民说：“水退了！”这是第二句。“这是谁的印章？”他问。", "— Это печь? — спросила Кремолева. Какая находка!", "गड्ढा खाली था। औसत गहराई 67.5 मी. थी।", "", "   \n ", "The mean was 3.5 m. The end.",
    ]
    got = units(spark, TEXTS, *cases, None)
    text = lambda k: [cases[k][a:b] for a, b in got.get(len(TEXTS) + k, [])]
    assert text(0) == ["“Who kept the ledger?” asked H. Jevon, and nobody replied.", "“We found nothing. The pit was empty,” wrote Prof. X."]
    assert text(1) == ["---\ntitle: x\n---", "# Head one", "The first\nline goes on.", "The second.", "- an item. With two.", "- other", "```\ncode. Here.\n```"]
    assert text(2) == ["村民说：“水退了！”", "这是第二句。", "“这是谁的印章？”他问。"]
    assert text(3) == ["— Это печь? — спросила Кремолева.", "Какая находка!"]
    assert text(4) == ["गड्ढा खाली था।", "औसत गहराई 67.5 मी. थी।"]
    assert text(5) == text(6) == []
    assert text(7) == ["The mean was 3.5 m.", "The end."]
    assert len(got[0]) == 4
    for k, spans in got.items():
        src = [*TEXTS, *cases][k]
        assert all(a < b and not src[a].isspace() and not src[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert "".join(src.split()) == "".join("".join(src[a:b] for a, b in spans).split())

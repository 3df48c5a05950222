import unicodedata

import pytest
from pyspark.sql import functions as F

from collatrix.functions import similarity, text
from collatrix.operators import ingest


def one(spark, col, **values):
    types = {str: "string", int: "int", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()))
    return df.select(col.alias("x")).first()["x"]


def test_diacritics_are_stripped_by_compatibility(spark):
    for s in ["Crème Brûlée", "ﬁn ﬆ ²½ Ⅳ", "Straße Ørsted", "Ａｂｃ", "été", "…", "", "ĳsvogel ŉ"]:
        want = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        assert one(spark, text.strip_diacritics(F.col("c")), c=s) == want, s


@pytest.mark.parametrize(("title", "key", "full", "sub"), [
    ("The Azté́cs: A History", "the aztecs", "the aztecs a history", "a history"),
    ("No colon — here!", "no colon here", "no colon here", ""),
    ("A: b: c", "a", "a b c", "b c"),
    ("", "", "", ""),
    (None, "", "", ""),
])
def test_titles(spark, title, key, full, sub):
    c = F.col("c").cast("string")
    assert one(spark, text.title_key(c), c=title) == key
    assert one(spark, text.full_title(c), c=title) == full
    assert one(spark, text.subtitle(c), c=title) == sub


def test_part_signature_needs_marker_and_number(spark):
    assert one(spark, text.part_signature(F.col("c")), c="historia tomo ii part of it vol 3") == "tomo ii|vol 3"
    assert one(spark, text.part_signature(F.col("c")), c="part of the study") == ""


def test_years_and_dois(spark):
    assert one(spark, text.year_of(F.col("c")), c="c. 1998-2001") == "1998"
    assert one(spark, text.year_of(F.col("c")), c="12345") == ""
    assert one(spark, text.doi_key(F.col("c")), c=" https://doi.org/10.1/ABC ") == "10.1/abc"
    assert one(spark, text.doi_key(F.col("c")), c="  ") is None


def test_extra_lines(spark):
    extra = "note\nCitation Key: smith2000\ntex.ids: a, b"
    assert one(spark, text.pinned_key(F.col("c")), c=extra) == "smith2000"
    assert one(spark, text.alias_keys(F.col("c")), c=extra) == ["a", "b"]
    assert one(spark, text.with_aliases(F.col("c"), F.array(F.lit("b"), F.lit("z"))), c=extra) == "note\nCitation Key: smith2000\ntex.ids: a, b, z"
    kept = one(spark, text.extra_keeping_identity(F.col("a"), F.col("b")), a=extra, b="other\nCitation Key: dup\ntex.ids: q")
    assert kept == "Citation Key: smith2000\nother\ntex.ids: a, b"


def test_identifiers(spark):
    ids = ingest.identifiers(F.col("c"))
    t = "see 10.1234/abc(2).) and arXiv:2101.00001v2, ISBN 978-3-16-148410-0"
    assert one(spark, ids["doi"], c=t) == "10.1234/abc(2)"
    assert one(spark, ids["arxiv"], c=t) == "2101.00001v2"
    assert one(spark, ids["isbn"], c=t) == "9783161484100"
    assert one(spark, ids["doi"], c="nothing") is None


def test_language_and_votes(spark):
    assert one(spark, ingest.language(F.col("c")), c="the cat is on the mat and it was there") == "en"
    assert one(spark, ingest.language(F.col("c")), c="der Hund schläft heute lange im Garten") == "other"
    assert one(spark, ingest.language(F.col("c")), c="123") == "unknown"
    v = ingest.votes(F.lit("x" * 1500), F.lit(False), F.lit(0.1), F.lit(0.9))
    assert one(spark, ingest.source_kind(v), c="") == "born_digital"
    v = ingest.votes(F.lit("x" * 1500), F.lit(True), F.lit(None).cast("double"), F.lit(None).cast("double"))
    assert one(spark, ingest.source_kind(v), c="") == "scanned"


def test_ratio_is_not_symmetric(spark):
    assert one(spark, similarity.title_similarity(F.col("a"), F.col("b")), a="tide", b="diet") == pytest.approx(0.25)
    assert one(spark, similarity.title_similarity(F.col("a"), F.col("b")), a="diet", b="tide") == pytest.approx(0.5)


def test_calibration_floor(spark):
    assert one(spark, similarity.calibrated(F.lit(1.0), F.lit(False)), c="") < 0.01
    assert one(spark, similarity.calibrated(F.lit(0.6), F.lit(True)), c="") == pytest.approx(0.92)
    assert one(spark, similarity.sigmoid(F.lit(-1000.0)), c="") == 0.0

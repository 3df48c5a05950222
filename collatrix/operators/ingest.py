"""Facts drawn from texts before a record exists: identifiers, language, how a file should be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.functions import text

# Function words of English; thresholds of the votes on how a file was made.
FUNCTION_WORDS = (
    "the of and to in is that it for as was with be by on not are this but have from or had they which you were her his an at will each all can there when who "
    "more no if out so said what up its about into than them then these some could"
).split()
ENGLISH_SHARE = 0.18
BORN_DIGITAL_CHARS, SCANNED_CHARS = 1000.0, 200.0
IMAGE_SHARE, TEXT_SHARE = 0.5, 0.8
DISCARDED = ["header", "footer", "page_number", "page_footnote", "discarded"]
IMAGE_LIKE = ["image", "chart"]
TEXT_LIKE = ["text", "title", "table", "equation", "list", "code"]


def clean_doi(raw: Column) -> Column:
    """A DOI found in text without trailing punctuation and closing brackets that nothing opened."""
    def step(d: Column, _: Column) -> Column:
        cut = F.substr(d, F.lit(1), F.length(d) - 1)
        count = lambda c: F.length(d) - F.length(F.replace(d, F.lit(c), F.lit("")))
        out = F.when(d.rlike("[.,;:!?'\"”’]$"), cut)
        for o, c in (("(", ")"), ("[", "]"), ("{", "}")):
            out = out.when(d.endswith(c) & (count(c) > count(o)), cut)
        return out.otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1))), raw, step)


def identifiers(c: Column) -> dict[str, Column]:
    """doi, arxiv and isbn: the first of each in a text, null for none."""
    t = F.coalesce(c, F.lit(""))
    # The patterns of DOIs, arXiv numbers and ISBNs.
    doi = text.doi_key(clean_doi(F.regexp_extract(t, r"\b(10\.\d{4,9}/\S+)", 1)))
    new, old = F.regexp_extract(t, r"(?i)\barxiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)", 1), F.regexp_extract(t, r"(?i)\barxiv:\s*([a-z][a-z-]*(?:\.[A-Z]{2})?/\d{7})", 1)
    digits = F.upper(F.regexp_replace(F.regexp_extract(t, r"(?i)\bisbn(?:-1[03])?[:\s]\s*([0-9][0-9 -]{8,20}[0-9Xx])", 1), "[ -]", ""))
    return {"doi": doi, "arxiv": F.lower(F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))), "isbn": F.when(F.length(digits).isin(10, 13), digits)}


def language(c: Column) -> Column:
    """en, other, or unknown (no Latin letters), by the share of English function words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-zA-Z]+)"), 1)
    hits = F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS)))
    return F.when(F.size(words) == 0, "unknown").when(hits / F.size(words) >= ENGLISH_SHARE, "en").otherwise("other")


def block_mix(blocks: DataFrame) -> DataFrame:
    """doc, image_share, text_share over the blocks (doc, type) that aren't discarded; documents without any have none."""
    kept = blocks.filter(~F.coalesce("type", F.lit("")).isin(DISCARDED))
    share = lambda kinds: F.avg(F.coalesce(F.col("type").isin(kinds), F.lit(False)).cast("double"))
    return kept.groupBy("doc").agg(share(IMAGE_LIKE).alias("image_share"), share(TEXT_LIKE).alias("text_share"))


def votes(layer: Column, is_ocr: Column, image_share: Column, text_share: Column) -> Column:
    """The votes born_digital or scanned of three signals; a missing signal abstains."""
    pages = F.length(layer) - F.length(F.replace(layer, F.lit("\f"), F.lit(""))) + 1
    per = F.length(layer) / pages
    a = F.when(per >= BORN_DIGITAL_CHARS, "born_digital").when(per <= SCANNED_CHARS, "scanned")
    b = F.when(is_ocr, "scanned").when(~is_ocr, "born_digital")
    c = F.when(image_share >= IMAGE_SHARE, "scanned").when(text_share >= TEXT_SHARE, "born_digital")
    return F.array_compact(F.array(a, b, c))


def source_kind(v: Column) -> Column:
    """What the votes agree on; scanned for fewer than two votes or any disagreement."""
    return F.when((F.size(v) >= 2) & (F.size(F.array_distinct(v)) == 1), F.get(v, F.lit(0))).otherwise("scanned")


def parse_path(kind: Column, lang: Column, hint: Column, service_up: bool) -> Column:
    """path_a for born-digital English that isn't humanities if the header service is up, else path_b."""
    fit = (kind == "born_digital") & (lang == "en") & (F.lower(F.trim(F.coalesce(hint, F.lit("")))) != "humanities")
    return F.when(fit & F.lit(service_up), "path_a").otherwise("path_b")


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, doi, arxiv, isbn, language, source_kind of every document; null texts have no identifier and an unknown language.

    Whether a text was scanned is told by its length per page and by its source (one of character recognition); a null source abstains.
    """
    ids = identifiers(F.col("text"))
    v = votes(F.coalesce("text", F.lit("")), F.lower("source").contains("ocr"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return docs.select("doc_id", *[c.alias(n) for n, c in ids.items()], language(F.col("text")).alias("language"), source_kind(v).alias("source_kind"))


def without_confidence(m: Column) -> Column:
    """A map without keys that report a confidence of their own."""
    return F.map_filter(m, lambda k, _: ~(F.lower(k).isin("score", "p", "p_raw", "self_confidence") | F.lower(k).rlike("confidence|probability|certainty|likelihood")))


def front_matter(c: Column) -> dict[str, Column]:
    """title, author, date, year, doi of a leading block between two lines of dashes; null where missing."""
    block = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---", 1)
    take = lambda k: F.nullif(F.regexp_replace(text.squeeze(F.regexp_extract(block, rf"(?im)^{k}[ \t]*:[ \t]*(.+)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    return {k: take(k) for k in ("title", "author", "date", "year", "doi")}


def file_name_facts(name: Column) -> dict[str, Column]:
    """author, year, title of a file's stem: "Author - Year - Title", "Year - Title" or the stem with its separators as spaces."""
    three, two = r"^(.+?)\s*[-_]\s*((?:19|20)\d{2})\s*[-_]\s*(.+)$", r"^((?:19|20)\d{2})\s*[-_]\s*(.+)$"
    full, dated = name.rlike(three), name.rlike(two)
    spaced = lambda c: text.squeeze(F.regexp_replace(c, "[_]+", " "))
    return {
        "author": F.when(full & ~dated, spaced(F.regexp_extract(name, three, 1))),
        "year": F.when(dated, F.regexp_extract(name, two, 1)).when(full, F.regexp_extract(name, three, 2)),
        "title": F.when(dated, spaced(F.regexp_extract(name, two, 2))).when(full, spaced(F.regexp_extract(name, three, 3))).otherwise(spaced(F.regexp_replace(name, "-", " "))),
    }


# A DOI as it stands in the bytes of a file.
BODY_DOI = r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"


def head_doi(head: Column) -> Column:
    """The first DOI in the head of a file, without a final period; null if it is too short to be one."""
    d = F.regexp_replace(F.regexp_extract(F.coalesce(head, F.lit("")), BODY_DOI, 1), r"\.+$", "")
    return F.when(F.length(d) > 10, d)


def markdown_facts(c: Column) -> dict[str, Column]:
    """title, author, date, year, doi of a Markdown text: of its front matter, else of its first heading and the first DOI in the text."""
    f = front_matter(c)
    heading = F.nullif(text.squeeze(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    body = F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), BODY_DOI, 1), r"\.+$", ""), F.lit(""))
    return f | {"title": F.coalesce(f["title"], heading), "doi": F.coalesce(f["doi"], body)}

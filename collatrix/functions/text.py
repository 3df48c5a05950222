"""Column functions over the strings of a bibliographic record. All of them stay inside the JVM.

Missing and empty are the same for a record ("emptiness, not null"): the normalisers return an empty string for either,
unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content in a title; numbers and markers of parts; spellings of a first edition.
STOP_WORDS = "a an the of and or in on for to with by from as at into over under after before is are".split()
PART_MARKERS = "volume volumen vol tomo tome part parte band bd fascicle fasciculo fasc heft libro livre seccion section capitulo chapter cuaderno numero teil".split()
PART_NUMBERS = [r"\d{1,4}", "[ivxlcdm]+", "primer[oa]", "segund[oa]", "tercer[oa]", "cuart[oa]", "quint[oa]", "sext[oa]", "first", "second", "third", "fourth", "fifth", "sixth"]
FIRST_EDITIONS = ["", "1", "1.", "1st", "first", "first edition", "primera", "primera edicion"]
# Item types of sources and their coarse families; an unmapped type is its own family.
TYPE_FAMILIES = {
    "journalarticle": "article", "journal-article": "article", "article-journal": "article", "article": "article", "magazinearticle": "article",
    "newspaperarticle": "article", "book": "book", "monograph": "book", "booksection": "chapter", "chapter": "chapter", "book-chapter": "chapter",
    "conferencepaper": "conference", "proceedings-article": "conference", "paper-conference": "conference", "thesis": "thesis", "dissertation": "thesis",
    "report": "report", "report-document": "report", "dataset": "dataset",
}
LIBRARY_TYPES = {
    "journal-article": "journalArticle", "article-journal": "journalArticle", "journalarticle": "journalArticle", "article": "journalArticle", "book": "book",
    "monograph": "book", "book-chapter": "bookSection", "chapter": "bookSection", "booksection": "bookSection", "proceedings-article": "conferencePaper",
    "paper-conference": "conferencePaper", "conferencepaper": "conferencePaper", "thesis": "thesis", "dissertation": "thesis", "report": "report", "dataset": "dataset",
}

PART = rf"\b(?:{'|'.join(PART_MARKERS)})\s+(?:{'|'.join(PART_NUMBERS)})\b"
NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
SPACE = r"[\s\p{Z}]+"
YEAR = r"\b(1[0-9]{3}|2[0-9]{3})\b"


def _folding() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decomposition without marks, as tables by rule: one character for one, marks to drop, one for several."""
    one, to, marks, several = [], [], [], {}
    for c in (chr(i) for i in range(0x80, 0x10000) if not 0xAC00 <= i <= 0xD7A3 and not 0xD800 <= i <= 0xF8FF):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one.append(c)
            to.append(plain)
        elif len(plain) > 1 and (ord(c) < 0x250 or 0xFB00 <= ord(c) <= 0xFB06 or 0x2000 <= ord(c) <= 0x2188):
            several[c] = plain
    return "".join(one), "".join(to), "".join(marks), several


FOLD_FROM, FOLD_TO, MARKS, SEVERAL = _folding()


def strip_diacritics(c: Column) -> Column:
    """Compatibility decomposition without combining marks. Hangul and characters beyond the basic plane stay as they are."""
    pairs = F.split(F.lit("\2".join(f"{k}\1{v}" for k, v in SEVERAL.items())), "\2")
    long = F.aggregate(pairs, c, lambda s, x: F.replace(s, F.substring_index(x, "\1", 1), F.substring_index(x, "\1", -1)))
    return F.translate(F.when(c.rlike("[" + "".join(SEVERAL) + "]"), long).otherwise(c), FOLD_FROM + MARKS, FOLD_TO)


def squeeze(c: Column) -> Column:
    """Single spaces, none at the ends; any white space counts."""
    return F.regexp_replace(F.regexp_replace(c, SPACE, " "), "^ | $", "")


def plain_words(c: Column) -> Column:
    """Without diacritics, lower case, punctuation as spaces, single spaces."""
    return squeeze(F.regexp_replace(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))), NOT_WORD, " "))


def title_key(c: Column) -> Column:
    """The normalised title up to the first colon."""
    return plain_words(F.substring_index(c, ":", 1))


def full_title(c: Column) -> Column:
    """The normalised title with its subtitle."""
    return plain_words(c)


def subtitle(c: Column) -> Column:
    """The normalised text after the first colon; empty without a colon."""
    return plain_words(F.when(F.instr(c, ":") > 0, F.regexp_replace(c, r"(?s)^[^:]*:", "")).otherwise(F.lit("")))


def loose(c: Column) -> Column:
    """The other normaliser, of fuzzy comparison: lower case, punctuation removed (not spaced), accents kept."""
    s = squeeze(F.lower(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(s, NOT_WORD, ""), SPACE, " ")


def content_tokens(normalised: Column) -> Column:
    """Distinct words of a normalised title without stop words; an empty array for none."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalised, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS))))


def part_signature(normalised: Column) -> Column:
    """The "marker number" designations in a normalised title, sorted and joined; empty for none."""
    found = F.regexp_extract_all(normalised, F.lit(f"({PART})"), 1)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, SPACE, " ")))), "|")


def edition_key(c: Column) -> Column:
    """The edition, with every spelling of a first one as empty."""
    s = squeeze(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))))
    return F.when(s.isin(FIRST_EDITIONS), "").otherwise(s)


def field_key(c: Column) -> Column:
    """A field that tells volumes apart, as compared."""
    return squeeze(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))))


def year_of(*dates: Column) -> Column:
    """The first year (1000 to 2999) of the first date that has one; empty for none."""
    years = [F.nullif(F.regexp_extract(F.coalesce(d, F.lit("")), YEAR, 1), F.lit("")) for d in dates]
    return F.coalesce(*years, F.lit(""))


def loose_year(c: Column) -> Column:
    """The first four digits anywhere, as an integer; null for none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4})", 1).try_cast("int")


def doi_key(c: Column) -> Column:
    """A DOI without its resolver, lower case; null where nothing is left."""
    d = F.regexp_replace(F.lower(squeeze(F.coalesce(c, F.lit("")))), r"^https?://(dx\.)?doi\.org/", "")
    return F.nullif(d, F.lit(""))


def surname(creator: Column) -> Column:
    """The last name, or else the name, without diacritics, lower case; punctuation kept."""
    name = F.coalesce(F.nullif(creator["lastName"], F.lit("")), F.nullif(creator["name"], F.lit("")), F.lit(""))
    return squeeze(F.lower(strip_diacritics(name)))


def first_author(creators: Column) -> Column:
    """Surname of the first creator that is an author (or has no role) and has a name; empty for none."""
    who = F.filter(creators, lambda c: (c["creatorType"].isNull() | (c["creatorType"] == "author")) & (F.coalesce(F.nullif(c["lastName"], F.lit("")), F.nullif(c["name"], F.lit(""))).isNotNull()))
    return F.coalesce(F.get(F.transform(F.slice(who, 1, 1), surname), F.lit(0)), F.lit(""))


def surnames(creators: Column) -> Column:
    """Distinct surnames of all creators, sorted; an empty array for none."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(creators, surname), lambda s: s != ""))), F.array().cast("array<string>"))


def clean_latex(c: Column) -> Column:
    """Without braces and the commands textit, textbf and emph; ties as spaces."""
    s = F.regexp_replace(F.regexp_replace(c, r"[{}]", ""), r"\\(textit|textbf|emph)\s*", "")
    return F.trim(F.replace(s, F.lit("~"), F.lit(" ")))


def type_family(c: Column) -> Column:
    """Coarse family of an item type."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_FAMILIES.items() for x in kv])[t], t)


def library_type(c: Column) -> Column:
    """A source's item type in the library's spelling; unmapped types stay."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LIBRARY_TYPES.items() for x in kv])[F.replace(F.lower(t), F.lit(" "), F.lit(""))], t)


def pinned_key(extra: Column) -> Column:
    """The citation key pinned in a line of ``extra``; null for none."""
    return F.nullif(squeeze(F.regexp_extract(F.coalesce(extra, F.lit("")), r"(?im)^[ \t]*citation key:[ \t]*(\S[^\n]*)$", 1)), F.lit(""))


def alias_keys(extra: Column) -> Column:
    """The alias keys of the ``tex.ids`` lines of ``extra``, in order; an empty array for none."""
    lines = F.regexp_extract_all(F.coalesce(extra, F.lit("")), F.lit(r"(?im)^[ \t]*tex\.ids:([^\n]*)$"), 1)
    return F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), squeeze), lambda k: k != "")


def with_aliases(extra: Column, keys: Column) -> Column:
    """``extra`` with the keys added to its one ``tex.ids`` line, each once and in order; other lines as they were."""
    have = F.array_distinct(F.concat(alias_keys(extra), F.filter(keys, lambda k: k.isNotNull() & (k != ""))))
    other = F.filter(F.split(F.coalesce(extra, F.lit("")), "\n"), lambda x: (squeeze(x) != "") & ~F.lower(squeeze(x)).startswith("tex.ids:"))
    return F.when(F.size(have) == 0, F.coalesce(extra, F.lit(""))).otherwise(F.array_join(F.concat(other, F.array(F.concat(F.lit("tex.ids: "), F.array_join(have, ", ")))), "\n"))


def extra_keeping_identity(own: Column, other: Column) -> Column:
    """The content lines of ``other`` with the citation key and aliases of ``own``."""
    body = F.filter(F.split(F.coalesce(other, F.lit("")), "\n"), lambda x: (squeeze(x) != "") & ~F.lower(squeeze(x)).rlike(r"^(citation key:|tex\.ids:)"))
    key = pinned_key(own)
    text = F.array_join(F.concat(F.when(key.isNotNull(), F.array(F.concat(F.lit("Citation Key: "), key))).otherwise(F.array().cast("array<string>")), body), "\n")
    return F.when(F.size(alias_keys(own)) > 0, with_aliases(text, alias_keys(own))).otherwise(text)


def citation_key(extra: Column, key: Column) -> Column:
    """The pinned key, else the computed one, else null."""
    return F.coalesce(pinned_key(extra), F.nullif(key, F.lit("")))


def target_key(uri: Column) -> Column:
    """The last segment of a relation's URI."""
    return F.substring_index(F.regexp_replace(uri, "/+$", ""), "/", -1)


def orcid_key(c: Column) -> Column:
    """The last segment of an ORCID, upper case; null for none."""
    return F.nullif(F.upper(target_key(F.trim(c))), F.lit(""))


def is_empty(c: Column) -> Column:
    """Null or an empty string."""
    return c.isNull() | (c == "")


def first_filled(*cs: Column) -> Column:
    """The first that isn't empty, else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def summary(key: Column, creators: Column, date: Column, title: Column, kind: Column) -> Column:
    """One line of an item: authors among its first three creators, "et al." for more than three, year, title, type."""
    three = F.transform(F.filter(F.slice(creators, 1, 3), lambda c: c["creatorType"] == "author"), lambda c: F.coalesce(c["lastName"], F.lit("")))
    names = F.concat(F.array_join(three, ", "), F.when(F.size(creators) > 3, " et al.").otherwise(""))
    year = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(date, F.lit("n.d.")), r"(\d{4})", 1), F.lit("")), date, F.lit("n.d."))
    return F.concat(F.lit("["), key, F.lit("] "), F.coalesce(names, F.lit("")), F.lit(" ("), year, F.lit(') "'), F.coalesce(title, F.lit("Untitled")), F.lit('" ['), F.coalesce(kind, F.lit("")), F.lit("]"))

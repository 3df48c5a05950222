"""Problem 7: visually identical text with different characters.

Two forms of a text are made here. The *skeleton* serves comparison: the text is decomposed, every character is replaced
by the prototype of its look-alike class (the full public table, see ``confusables``), and the result is decomposed again;
originals that look alike have equal skeletons. The *consistent form* serves storage: the text with each disguised
character replaced by the plain one that belongs there, decided by the letters of the word and of the language around it;
genuine text in any script, plain quotes and composed accents stay as they are. A value is a case of the problem where it
differs from its consistent form and both have the same skeleton.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.llm.confusables import prototypes

# Letters of Cyrillic and Greek and the Latin letters (of the same case) that they stand for in mixed words; some
# are alike only in some fonts and so are no entries of the public table.
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХҮԌаеѕіјорсухһԁԛԝѵӏгпкм", "ABESIJKMHOPCTYXYGaesijopcyxhdqwvlrnkm", strict=True))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναικρτυχγ", "ABEZHIKMNOPTYXovaikptuxy", strict=True))
#: Only these stand for each other with the same shape; the rest of the table serves mixed words.
TRUE_TWINS = set("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧον")
HYPHENS = "‐‑‒⁃−˗﹘﹣－᠆"
LINE_ENDS = "  \x85"
FILLERS = "͏ᅟᅠㅤﾠ឴឵"
VISIBLE_FORMAT = set("؀؁؂؃؄؅۝܏࣢")
#: Kinds of compatibility character that are only another dress of the plain one.
DRESS = ("<font>", "<wide>", "<narrow>", "<circle>", "<square>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>")
LIGATURES = set("ĲĳǄǅǆǇǈǉǊǋǌǱǲǳŉſﬀﬁﬂﬃﬄﬅﬆﬓﬔﬕﬖﬗ")
#: Characters that need no look: with these alone a value is never a case.
PLAIN = r"^[\x20-\x7e\t\r\n¡-¬®-ſ‘’“”„–—…]*$"

LATIN_AS_CYRILLIC = {v: k for k, v in CYRILLIC_AS_LATIN.items() if k in "АВЕКМНОРСТУХаеорсухкмгп"}
LATIN_TWINS = set("ABEKMHOPCTYXaeopcyx")
ROMAN = re.compile(r"[IVXLCDM]+|[ivxlcdm]+")


@lru_cache(maxsize=20_000)
def _script(ch: str) -> str:
    """L, C, G for letters of Latin, Cyrillic, Greek; H for Han and Kana; X for another script; '' for no letter."""
    if not ch.isalpha():
        return ""
    if ch < "ɐ" or "Ḁ" <= ch <= "ỿ":
        return "L"
    if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
        return "G"
    if "Ѐ" <= ch <= "ԯ":
        return "C"
    return "H" if "぀" <= ch <= "鿿" or "\U00020000" <= ch <= "\U0003ffff" else "X"


@lru_cache(maxsize=50_000)
def _undressed(ch: str) -> str:
    """The plain characters under a full-width, styled or joined form; other characters as they are."""
    kind = unicodedata.decomposition(ch)
    if ch in LIGATURES or kind.startswith(DRESS):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _joins_natively(left: str, right: str) -> bool:
    """Zero-width joiners belong to Arabic, Indic and emoji text."""
    return bool(left and right) and all(("؀" <= c <= "ࣿ") or ("ऀ" <= c <= "෿") or ord(c) >= 0x1F000 or c == "️" for c in (left, right))


def _visible(text: str) -> str:
    out = []
    for i, ch in enumerate(text):
        cat = unicodedata.category(ch)
        if ch in "‌‍" and _joins_natively(text[i - 1 : i], text[i + 1 : i + 2]):
            out.append(ch)
        elif (cat == "Cf" and ch not in VISIBLE_FORMAT) or ch in FILLERS or (cat == "Cc" and ch not in "\t\n\r\x85"):
            continue
        elif "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
            if out and ord(out[-1][-1]) >= 0x2100:  # chooses the look of a symbol
                out.append(ch)
        elif cat == "Zs" or ch in LINE_ENDS:
            out.append(" ")
        elif ch in HYPHENS:
            out.append("-")
        else:
            out.append(ch)
    return "".join(out)


def _undress(text: str) -> str:
    east = any(_script(c) == "H" for c in text)
    out = []
    for ch in text:
        plain = _undressed(ch)
        # Full-width punctuation is the ordinary one in East Asian text.
        out.append(ch if plain != ch and east and not plain.isalnum() else plain)
    return "".join(out)


_CLUSTER = re.compile(r"\w[̀-ͯ҃-゙゚҇]+")


def _compose(text: str) -> str:
    return _CLUSTER.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)


_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=50_000)
def _as_latin(ch: str) -> str:
    """The Latin letter that a letter of another script shows, or ''."""
    known = CYRILLIC_AS_LATIN.get(ch) or GREEK_AS_LATIN.get(ch)
    if known or _script(ch) != "X":
        return known or ""
    shown = prototypes().get(ch, "")
    if len(shown) != 1 or not ("a" <= shown.lower() <= "z"):
        return ""
    return "I" if shown == "l" and ch.isupper() else shown


def _own(word: str, script: str) -> int:
    """Letters of a script that no other script imitates."""
    if script == "L":
        return sum(_script(c) == "L" and c not in LATIN_TWINS for c in word)
    if script == "X":
        return sum(_script(c) == "X" and not _as_latin(c) for c in word)
    return sum(_script(c) == script and c not in TRUE_TWINS for c in word)


def _respelled(word: str, around: str) -> str:
    """The word with the letters of one script only, where it holds letters of another posing as its own."""
    scripts = {_script(c) for c in word} & set("LCGX")
    if len(scripts) == 1:
        (only,) = scripts
        if not around or only == around or _own(word, only):
            return word
        if around == "L":
            # of scripts without case, too many letters are plain strokes to take a whole word for a disguise
            posing = only in "CG" or (len(word) > 1 and all(c.lower() != c.upper() for c in word))
            return "".join(_as_latin(c) or c for c in word) if posing else word
        if around == "C" and only == "L" and not ROMAN.fullmatch(word):
            return "".join(LATIN_AS_CYRILLIC.get(c, c) for c in word)
        return word
    if len(scripts) < 2:
        return word
    own = {s: _own(word, s) for s in scripts}
    target = max(sorted(scripts), key=lambda s: (own[s] > 0, own[s], s == around, sum(_script(c) == s for c in word)))
    if target == "X" and not own["X"]:
        target = max(sorted(scripts - {"X"}), key=lambda s: (s == around, sum(_script(c) == s for c in word)))
    if target == "L":
        return "".join(_as_latin(c) or c for c in word)
    if target == "C":
        return "".join(LATIN_AS_CYRILLIC.get(c, c) for c in word)
    return word


def language_around(text: str) -> str:
    """The script whose own letters (those no look-alike could be) prevail in a text, or ''."""
    own = {s: _own(text, s) for s in "LCG"}
    best = max("LCG", key=lambda s: own[s])
    return best if own[best] else ""


def consistent_form(text: str | None, around: str = "") -> str | None:
    """The text in plain characters; null stays null, empty stays empty. ``around``: script of what stands beside it."""
    if not text or re.match(PLAIN, text):
        return text
    t = _compose(_undress(_visible(text)))
    dominant = language_around(t) or around
    return _WORD.sub(lambda m: _respelled(m[0], dominant), t)


@lru_cache(maxsize=50_000)
def _prototype(ch: str) -> str:
    known = prototypes()
    return "".join(known.get(y, y) for x in _undressed(ch) for y in [CYRILLIC_AS_LATIN.get(x) or GREEK_AS_LATIN.get(x) or x])


def skeleton(text: str | None) -> str | None:
    """Equal for texts that look alike; null stays null. Spaces are single and not at the ends."""
    if text is None:
        return None
    shown = " ".join(_visible(unicodedata.normalize("NFD", text)).split())
    return unicodedata.normalize("NFD", "".join(_prototype(c) for c in shown))


def _names(creators: Column) -> Column:
    """firstName, lastName, name of every creator, as one array."""
    return F.coalesce(F.flatten(F.transform(creators, lambda c: F.array(c["firstName"], c["lastName"], c["name"]))), F.array().cast("array<string>"))


def long_values(records: DataFrame) -> DataFrame:
    """rec_id, field, values: title and creators of each record as arrays of strings."""
    both = F.array(
        F.struct(F.lit("title").alias("field"), F.array("title").alias("values")),
        F.struct(F.lit("creators").alias("field"), _names(F.col("creators")).alias("values")),
    )
    return records.select("rec_id", F.explode(both).alias("v")).select("rec_id", "v.field", "v.values")


def consistent_forms(records: DataFrame) -> DataFrame:
    """rec_id, field, values, forms, changed for the title and the creators of every record.

    Null and empty values are never changed; a null creators array counts as empty; repeated records are repeated. Values
    of plain characters only are settled without Python.
    """
    rows = long_values(records)
    odd = F.exists("values", lambda v: F.coalesce(~v.rlike(PLAIN), F.lit(False)))
    rows = rows.withColumn("odd", odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = []
            for values in b.column(2).to_pylist():
                around = language_around(" ".join(v for v in values if v))
                plain = [consistent_form(v, around) for v in values]
                # what is replaced must look the same
                forms.append([f if v == f or skeleton(v) == skeleton(f) else v for v, f in zip(values, plain, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(forms, pa.list_(pa.string()))], ["rec_id", "field", "values", "forms"])

    done = rows.filter("odd").drop("odd").mapInArrow(run, "rec_id long, field string, values array<string>, forms array<string>")
    done = done.withColumn("changed", ~F.col("values").eqNullSafe(F.col("forms")))
    plain = rows.filter(~F.col("odd")).select("rec_id", "field", "values", F.col("values").alias("forms"), F.lit(False).alias("changed"))
    return done.unionByName(plain)


def disguised(records: DataFrame) -> DataFrame:
    """p7_found: rec_id, field of the values whose consistent form differs from what they hold."""
    return consistent_forms(records).filter("changed").select("rec_id", "field")


def skeleton_groups(records: DataFrame) -> DataFrame:
    """skeleton, value, n_values, n_forms: each distinct title or name with the number of its rows and of the forms that look the same.

    Only skeletons with more than one form. Values are counted before they are grouped, so a value that a third of all
    rows hold is one row in its group.
    """
    values = long_values(records).select(F.explode("values").alias("value")).filter("value is not null and value <> ''")
    counted = values.groupBy("value").agg(F.count("*").alias("n_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([skeleton(v) for v in b.column(0).to_pylist()], pa.string()), *b.columns], ["skeleton", "value", "n_values"])

    marked = counted.mapInArrow(run, "skeleton string, value string, n_values long")
    sizes = marked.groupBy("skeleton").agg(F.count("*").alias("n_forms")).filter("n_forms > 1")
    return marked.join(sizes, "skeleton").select("skeleton", "value", "n_values", "n_forms")

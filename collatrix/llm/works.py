"""What problems 4 and 6 share: records of works made comparable, and the test whether two records are of one work.

A record is brought to words (title without markup, look-alikes, hyphenation and cataloguer's additions), the numbers of
its parts, whether it reviews or answers another work, its year, its DOI, its venue and its parsed creators. Two records
are of one work if nothing contradicts (DOI, part, review or reply, year, creators) and the words of one title are those
of the other, up to typing errors, order, a dropped word or a dropped subtitle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.llm.lookalikes import consistent_form, language_around
from collatrix.llm.markup import SUSPECT, clean
from collatrix.llm.names import ORG_WORDS, _given_names, compare, fold, near, parse

# Articles, prepositions and conjunctions of the languages of the tables. Only words of closed classes: a list by
# document frequency would take in words such as "early" or "new", by which titles differ.
STOP = {
    *"a an the of and in at on for to from with by".split(), *"el la los las de del en y e un una sobre desde al".split(),
    *"le les l d des du et dans sur un une".split(), *"der die das und in im bei zu zur von aus den dem eine ein u".split(), *"и в на о об из с близ".split(),
}
# Short spellings of words too frequent to be told by their rarity.
SPELLED = {"thru": "through", "tho": "though"}
# How titles name works about another work, by language.
ABOUT = re.compile(
    r"^(?:(review|rezension|rez|besprechung|resena|recension|compte rendu|recensione|рецензия|书评)|(reply|response|rejoinder|antwort|erwiderung|respuesta|replica|reponse|ответ)|"
    r"(erratum|corrigendum|correction|berichtigung|fe de erratas))\s*(?:of|to|on|zu|auf|de|del|a|al|du|sur|на|к|:)\s+"
)
_PART = re.compile(r"\b(?:part|pt|teil|partie|parte|часть|ч|vol|volume|band|bd|tome|tomo|tom|том|t|book|heft|no|nr|部|卷)\s*\.?\s*((?:[ivx]{1,5}|\d{1,3}))\b|第\s*(\d{1,3})\s*[部卷册]")
_ADDED = re.compile(r"\[(?:sic|online|ed\.?|reprint|electronic resource)\]|\((?:ed\.?|reprint|online)\)|/ with maps|, with (?:an )?index\b|with an? index$|\[title missing\]")
_CUT = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…)\s*$")
_SPLIT = re.compile(r"\s*(?::|\s[-–—]\s|\(|\.\s|\?:)\s*")
_TOKENS = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]+")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_MARKED = re.compile(SUSPECT)
_SPACES = re.compile(r"\s+")
_HYPHENS = (re.compile(r"(?<=[^\W\d_])- (?=[^\W\d_])"), re.compile(r"(?<=[^\W\d_])-(?=[^\W\d_])"))
_YEAR = re.compile(r"(?<!\d)(1[0-9]{3}|20[0-9]{2})(?!\d)")


def title_parts(title: str | None) -> dict:
    """main and all (words), about (what it says of another work), part (its numbers), cut (whether the end is missing)."""
    t = title or ""
    if _MARKED.search(t):
        t = clean(t)[1] or ""
    t = consistent_form(t) or ""
    t = _SPACES.sub(" ", t).strip(" “”\"'*«»")
    cut = bool(_CUT.search(t))
    t = _CUT.sub("", t)
    if "-" in t:
        for hyphen in _HYPHENS:
            t = hyphen.sub("", t)
    low = _ADDED.sub(" ", fold(t).replace("&", " and ")).strip(" *.“”\"'")
    about = ""
    first, _, rest_ = low.partition(" ")
    for word, mark in (("review", "of"), ("reply", "to")):
        if first != word and rest_.startswith(mark + " ") and near(first, word):
            low = f"{word} {rest_}"
    while m := ABOUT.match(low):
        about += "r" if m[1] else "p" if m[2] else "e"
        low = low[m.end() :].strip(" “\"'")
    numbers = sorted({_ROMAN.get(x, None) or (int(x) if x.isdigit() else 0) for m in _PART.finditer(low) for x in [m[1] or m[2]]} - {0})
    bare = _PART.sub(" ", low)
    main, *rest = _SPLIT.split(bare, maxsplit=1)
    words = _words(bare)
    first = _words(main) if rest else words
    if len([w for w in first if w not in STOP]) < 3:
        first = words
    return {"m": first, "w": words, "about": about, "part": numbers, "cut": cut}


def _words(text: str) -> list[str]:
    out: list[str] = []
    for w in _TOKENS.findall(text):
        han = _HAN.search(w)
        if han:
            for run in _HAN.findall(w):
                out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            out += re.findall(r"\d+", w)
        else:
            out.append(SPELLED.get(w, w))
    return out


def year_of(text: str | None) -> int | None:
    """The first year in a free-form date; null and dates without one give null."""
    m = _YEAR.search(text or "")
    return int(m[1]) if m else None


def doi_of(text: str | None) -> str | None:
    """A DOI without its decoration, in lower case; null if there is none."""
    m = re.search(r"10\.\d{2,9}/\S+", (text or "").lower())
    return m[0].rstrip(".,;)") if m else None


def comparable(title, year, doi, venue, kind, creators, given) -> dict:
    """A record as ``same_work`` takes it."""
    p = title_parts(title)
    people = [x for c in creators or [] if c for x in [parse(c.get("firstName"), c.get("lastName"), c.get("name"), given)] if x]
    v = [w for w in _TOKENS.findall(fold(venue or "").replace("&", " ")) if w not in ("the", "of", "and", "for", "in")]
    return p | {"y": year_of(year), "doi": doi_of(doi), "v": v, "c": people, "k": kind}


def venue_fits(a: list[str], b: list[str]) -> bool | None:
    """Whether two venues may be one, abbreviated words and initials included; null if either is missing."""
    if not a or not b:
        return None
    if len(a) == 1 and len(b) > 1:
        a, b = b, a
    if len(b) == 1 and len(a) > 1 and len(b[0]) <= len(a) + 2:
        letters = "".join(w[0] for w in a)
        return b[0] == letters or near(b[0], letters) or (len(letters) - len(b[0]) in (1, 2) and letters.startswith(b[0][:2]))
    left = list(b)
    hits = 0
    for x in a:
        y = next((y for y in left if x == y or near(x, y) or (min(len(x), len(y)) >= 1 and x[0] == y[0] and (x.startswith(y[: max(1, len(y) - 1)]) or y.startswith(x[: max(1, len(x) - 1)])))), None)
        if y is not None:
            left.remove(y)
            hits += 1
    return hits >= 0.7 * min(len(a), len(b)) and abs(len(a) - len(b)) <= 2


def creators_fit(a: list[dict], b: list[dict], given) -> float | None:
    """Share of the creators of the shorter list that the other list has too; null if either is empty."""
    if not a or not b:
        return None
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    left = list(long)
    hits = 0
    for x in short:
        for y in left:
            if compare(x, y, [1.0] * len(x["family"]), [1.0] * len(y["family"]), given)[1] or _same_family(x, y):
                left.remove(y)
                hits += 1
                break
    return hits / len(short)


def _same_family(x: dict, y: dict) -> bool:
    """Family names that agree where the given names are of no help (swapped, misspelt twice), for rare names only."""
    if x["kind"] != y["kind"]:
        return False
    if x["kind"] == "o":
        common = sum(any(p == q or near(p, q) for q in y["family"]) for p in x["family"])
        return common >= max(2, 0.7 * min(len(x["family"]), len(y["family"])))
    fx, fy = "".join(x["family"]), "".join(y["family"])
    words_x, words_y = {*x["family"], *x["given"], fx}, {*y["family"], *y["given"], fy}
    letters = not x["given"] or not y["given"] or x["given"][0][0] == y["given"][0][0]
    return (len(fx) > 4 and (fx == fy or near(fx, fy)) and letters) or (fx in y["given"] and fy in x["given"]) or len({w for w in words_x & words_y if len(w) > 3}) > 1


def match_words(a: list[str], b: list[str], cut_a: bool, cut_b: bool) -> tuple[int, list[str], list[str]]:
    """(matched content words, words left of a, words left of b), with typing errors, split words and cut ends."""
    from collections import Counter

    sa, sb = set(a), set(b)
    if len(sa) == len(a) and len(sb) == len(b):  # words are counted only where one comes twice
        ca = cb = {}
        hits = sum(w in sb and w not in STOP for w in a)
        la, lb = [w for w in a if w not in sb], [w for w in b if w not in sa]
    else:
        ca, cb = Counter(a), Counter(b)
        both = ca & cb
        hits = sum(n for w, n in both.items() if w not in STOP)
        la, lb = list((ca - both).elements()), list((cb - both).elements())
    if la and lb:
        # a word needs one with its first or second letter at the beginning to be alike, as it stands or as scanned text confuses it
        heads = {w[0] for w in lb} | {w[1] for w in lb if len(w) > 1} | {_confused(w)[0] for w in lb}
        for x in [x for x in la if x[0] in heads or x[1:2] in heads or _confused(x)[0] in heads]:
            y = next((y for y in lb if _alike(x, y)), None)
            if y is not None:
                la.remove(x)
                lb.remove(y)
                hits += x not in STOP
    # words torn apart by a stray space, or run together
    for l, r, full in ((la, lb, b), (lb, la, a)):
        for x in list(l):
            pieces = [y for y in r if len(y) >= 1 and y in x]
            joined = len(pieces) > 1 and next(((p, q) for p in pieces for q in pieces if p is not q and (p + q == x or near(p + q, x))), None)
            if joined and x in l:
                l.remove(x)
                for y in joined:
                    r.remove(y)
                hits += 1
    for cut, words, left, other in ((cut_a, a, la, lb), (cut_b, b, lb, la)):
        if cut and words and words[-1] in left and any(y.startswith(words[-1]) for y in other):
            left.remove(words[-1])
    # a word typed twice is no other word
    drop = lambda ws, mine, other: [w for w in ws if w not in STOP and len(w) > 1 and not (mine.get(w, 0) > 1 and w in other)]
    return hits, drop(la, ca, cb), drop(lb, cb, ca)


def _alike(x: str, y: str) -> bool:
    apart = abs(len(x) - len(y))
    if apart > 3 or x.isdigit() or y.isdigit():
        return False
    if apart <= 1 and near(x, y):
        return True
    s, l = (x, y) if len(x) < len(y) else (y, x)
    if len(s) >= 3 and l.startswith(s):
        return True
    if x.endswith("ies") and x[:-3] + "y" == y or y.endswith("ies") and y[:-3] + "y" == x:
        return True
    if len(s) >= 5 and apart <= 2:
        return _confused(x) == _confused(y)
    return False


@lru_cache(maxsize=100_000)
def _confused(w: str) -> str:
    """Letters that scanned text confuses, as one."""
    return w.replace("rn", "m").replace("in", "m").replace("ri", "n").replace("li", "h").replace("1", "l").replace("0", "o").replace("vv", "w").replace("cl", "d").replace("i", "l").replace("5", "s")


def same_work(a: dict, b: dict, given, trusted: bool = True) -> float:
    """Score in 0..1 that two records are of one work; 0 where something contradicts. From 0.5 on they are taken as one.

    ``trusted``: whether the DOIs of both were assigned by authorities; if not, one may belong to another work by mistake.
    """
    if a["about"] != b["about"]:
        return 0.0
    doi = None
    if a["doi"] and b["doi"]:
        x, y = a["doi"], b["doi"]
        doi = x == y or (min(len(x), len(y)) >= 14 and (x.startswith(y) or y.startswith(x)))
    if a["part"] != b["part"] and (a["part"] and b["part"] or not (a["cut"] or b["cut"])):
        return 0.0
    hits, left_a, left_b = match_words(a["w"], b["w"], a["cut"], b["cut"])
    if left_a and left_b and _HAN.match(left_a[0]) and _HAN.match(left_b[0]) and hits >= 2 and max(len(left_a), len(left_b)) <= 3:
        left_a, left_b = [], []  # one character more, less or other changes up to three pairs of characters
    content = lambda r: [w for w in r["m"] if w not in STOP]
    ma, mb = content(a), content(b)
    gap = abs(a["y"] - b["y"]) if a["y"] and b["y"] else None
    generic = min(len(ma), len(mb)) <= 2 and max(len(a["w"]), len(b["w"])) <= 3
    if not a["w"] or not b["w"] or generic:
        # no title to speak of: everything else must agree
        if a["w"] and b["w"] and not (hits and not left_a and not left_b):
            return 0.0
        if doi:
            return 0.95
        if (doi is False and trusted) or (gap or 0) > 1:
            return 0.0
        creators, venue = creators_fit(a["c"], b["c"], given), venue_fits(a["v"], b["v"])
        if creators is None or creators < 1.0 or (gap or 0) > 1 or venue is False or (gap is None and not venue):
            return 0.0
        full = len(a["c"]) == len(b["c"])
        if not (a["w"] and b["w"]):
            return 0.6 if venue and full and gap == 0 and len(a["c"]) + len(b["c"]) >= 2 else 0.0
        return 0.8 if venue or (venue is None and full and gap == 0) else 0.0
    out_a, out_b = [w for w in left_a if w in ma], [w for w in left_b if w in mb]
    if min(len(left_a), len(left_b)) > (1 if hits >= 8 else 0) and not doi:
        # both say something the other doesn't; a misspelling beyond recognition is let pass in a long title
        if not (len(left_a) == len(left_b) == 1 and hits >= 5 and not left_a[0].isdigit() and _close(left_a[0], left_b[0])):
            return 0.0
    shorter = min(len([w for w in a["w"] if w not in STOP]), len([w for w in b["w"] if w not in STOP]))
    if min(len(out_a), len(out_b)) > 0 and not doi:
        return 0.0
    if max(len(out_a), len(out_b)) > 1 and not (a["cut"] or b["cut"] or doi or hits >= min(len(ma), len(mb))):
        return 0.0
    cover = hits / max(shorter, 1)
    if cover < 0.6 and not doi:
        return 0.0
    if doi is False and trusted:
        return 0.0
    if not doi and gap is not None and gap > 2:
        return 0.0
    creators = creators_fit(a["c"], b["c"], given)  # dear, so last
    if doi:
        return 0.97 if (creators is None or creators > 0) and cover >= 0.5 else 0.0
    if creators == 0.0:
        return 0.0
    if gap is not None and gap > (2 if hits >= 4 and creators == 1.0 and not left_a and not left_b else 1):
        return 0.0
    venue = venue_fits(a["v"], b["v"])
    score = 0.45 + 0.25 * min(cover, 1.0)
    if creators is None:
        score -= 0.1 if venue and gap == 0 else 0.3
    else:
        score += 0.15 * creators if creators >= 0.5 else -0.15
    if gap is None:
        score -= 0.02
    elif gap == 0:
        score += 0.05
    if venue is False:
        score -= 0.08
    elif venue:
        score += 0.05
    if doi is False:
        score -= 0.05
    if shorter <= 2 and not venue:
        score -= 0.15
    return max(0.0, min(score, 0.95))


def _close(x: str, y: str) -> bool:
    """Two errors in a long word."""
    if min(len(x), len(y)) < 6:
        return False
    from collatrix.llm.names import _edits

    return _edits(x, y) <= 2


# -- to DataFrames ------------------------------------------------------------------------------------------------
def given_names_of(creators: DataFrame):
    """Given-name statistics from a column ``creators`` (array of struct)."""
    flat = creators.select(F.explode("creators").alias("c")).select(F.col("c.firstName").alias("first_name"), F.col("c.lastName").alias("last_name"))
    return _given_names(flat)


_CREATORS = "array<struct<firstName: string, lastName: string, name: string>>"


def slim(creators: Column) -> Column:
    """The names of creators only; null and null elements are dropped."""
    return F.coalesce(F.transform(F.filter(creators, lambda c: c.isNotNull()), lambda c: F.struct(c["firstName"], c["lastName"], c["name"])), F.array().cast(_CREATORS)).cast(_CREATORS)


_PREPARED = "data string, doi string, about string, part string, cut boolean, words array<string>, mains array<string>, names array<string>, orgs array<array<string>>, year int, venue array<string>"


def prepared(records: DataFrame, given) -> DataFrame:
    """id, data (JSON of ``comparable``), doi, about, part, cut, words, mains, names, orgs, year, venue of each record.

    ``names``: family names of persons; ``orgs``: of each organisation the words that tell it apart.
    ``records``: id (long or string), title, year, doi, venue, kind, creators as ``slim`` gives them. Nulls are allowed anywhere.
    """
    kind = records.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given.value
        strings = pa.list_(pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                rows = [comparable(*v, g) for v in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
                content = lambda ws: sorted({w for w in ws if w not in STOP and len(w) > 1})
                persons = [sorted({"".join(c["family"]) for c in r["c"] if c["kind"] == "p"}) for r in rows]
                orgs = [[ws for c in r["c"] if c["kind"] == "o" for ws in [sorted({w for w in c["family"] if len(w) > 4 and not ORG_WORDS.match(w)})] if ws] for r in rows]
                cols = [
                    pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string()), pa.array([r["doi"] for r in rows], pa.string()), pa.array([r["about"] for r in rows], pa.string()),
                    pa.array([",".join(map(str, r["part"])) for r in rows], pa.string()), pa.array([r["cut"] for r in rows], pa.bool_()), pa.array([content(r["w"]) for r in rows], strings), pa.array([content(r["m"]) for r in rows], strings),
                    pa.array(persons, strings), pa.array(orgs, pa.list_(strings)), pa.array([r["y"] for r in rows], pa.int32()), pa.array([r["v"] for r in rows], strings),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *(c.strip().split(" ")[0] for c in _PREPARED.split(", "))])

    return records.select("id", "title", "year", "doi", "venue", "kind", "creators").mapInArrow(run, f"id {kind}, {_PREPARED}")


def may_match(a: str, b: str) -> Column:
    """What ``same_work`` needs at least of two records, without their words: no two different DOIs of side 0; no two
    different parts, unless an end is missing; years at most two apart.

    Columns of the aliases a and b: doi (its first 14 characters, the least that a cut one has, as a number), part (a number, 0 for none), cut, year, side.
    """
    c = lambda x, name: F.col(f"{x}.{name}")
    alike = c(a, "doi") == c(b, "doi")
    doi = F.coalesce(alike, F.lit(True)) | (c(a, "side") != 0)
    part = (c(a, "part") == c(b, "part")) | (((c(a, "part") == 0) | (c(b, "part") == 0)) & (c(a, "cut") | c(b, "cut")))
    year = F.coalesce(F.abs(c(a, "year") - c(b, "year")) <= 2, F.lit(True)) | F.coalesce(alike, F.lit(False))
    return doi & part & year


def scored(pairs: DataFrame, given) -> DataFrame:
    """a, b, score of pairs (a, b long, data_a, data_b, trusted: whether both DOIs were assigned by authorities); only those taken as one work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given.value
        seen: dict[str, dict] = {}

        def load(text: str) -> dict:
            r = seen.get(text)
            if r is None:
                if len(seen) > 20_000:
                    seen.clear()
                r = seen[text] = json.loads(text)
            return r

        for b in batches:
            scores = [same_work(load(x), load(y), g, t) for x, y, t in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["a", "b", "score"])
            yield out.filter(pa.array([s >= 0.5 for s in scores], pa.bool_()))

    return pairs.select("a", "b", "data_a", "data_b", "trusted").mapInArrow(run, "a long, b long, score double")


def authority(records: DataFrame) -> DataFrame:
    """authority_records as ``prepared`` takes them."""
    return records.select(F.col("rec_id").cast("long").alias("id"), "title", "year", "doi", F.col("container_title").alias("venue"), F.col("item_type").alias("kind"), slim(F.col("creators")).alias("creators"))


def library(items: DataFrame) -> DataFrame:
    """The latest delivery of each item as ``prepared`` takes it; a null item_key is dropped."""
    newest = items.filter("item_key is not null").groupBy("item_key").agg(F.max_by(F.struct("title", "pub_date", "doi", "publication_title", "item_type", "creators"), F.struct(F.coalesce("version", F.lit(-1)), F.col("date_modified"))).alias("r"))
    return newest.select(F.col("item_key").alias("id"), "r.title", F.col("r.pub_date").alias("year"), "r.doi", F.col("r.publication_title").alias("venue"), F.col("r.item_type").alias("kind"), slim(F.col("r.creators")).alias("creators"))


__all__ = ["authority", "comparable", "given_names_of", "language_around", "library", "prepared", "same_work", "scored", "title_parts"]

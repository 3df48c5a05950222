"""Problem 1: variant spellings of names typed by people.

Written forms are parsed (titles, suffixes, particles, initials, inverted and swapped order) and equal parses become one
form, so that copies cost nothing further. The rare tokens of a name (the family name of a person, the place of an
organisation) are compared by a prefix-filtered set-similarity join on their q-grams: a token's q-grams are ordered by
rarity, and two tokens within one typing error of each other must share one of the first PREFIX. Forms that share a
similar rare token and a letter of the given name are verified by a soft weighted token similarity, in which a token
counts by the logarithm of its rarity. Forms of equal detail are joined into components; a form of less detail (an
initial, a dropped name, an acronym) joins the one component it fits, and where it fits several, the one with which it
shares works; otherwise it stays alone.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.llm.components import components
from collatrix.llm.lookalikes import consistent_form
from collatrix.session import release, stage

Q = 3
#: One deletion, insertion or substitution destroys Q q-grams, a transposition Q + 1; one more must be shared.
PREFIX = Q + 2
THRESHOLD = 0.72
#: A given name is established if it makes up this share of all given names; different established names never match.
ESTABLISHED = 1e-3
#: A misspelling is at least this many times rarer than what it stands for.
RARER = 2
#: A token counts as a given name if it makes up this share of them; at most 1 / SHARE tokens can.
SHARE = 1e-5

# Words around a name that are no part of it.
TITLES = {"dr", "dra", "prof", "sir", "mr", "mrs", "ms", "dame", "lord", "lady", "ing", "mag", "herr", "frau", "rev", "fr", "sra", "sr", "don", "dona"}
SUFFIXES = {"jr", "junior", "senior", "ii", "iii", "iv", "phd", "md", "ed", "eds", "hrsg"}
PARTICLES = {"de", "la", "las", "los", "del", "der", "den", "van", "von", "zu", "zum", "zur", "dos", "da", "do", "das", "di", "du", "le", "el", "al", "ter", "ten", "af", "av", "y", "e"}
ORG_NOISE = {"of", "for", "in", "the", "and", "at", "on", "a", "e", "v", "ev", "ltd", "inc", "gmbh", "library", "libr", "ed", "eds", "de", "la", "del", "der", "des", "du", "fur", "für", "y"}
ORG_WORDS = re.compile(r"^(acad|inst|soc|mus|ctr|arch|dept?|grp|univ|wg|lab|assn|academ\w+|institut\w*|societ\w+|museum\w*|cent(re|er|rum|ro)s?|archiv\w*|department\w*|working|groups?|universit\w+|college|laborator\w+|foundation|association|council|committee|commission|school|facult\w+|librar\w+)$")
ORG_SHORT = {"ctr": "centre", "center": "centre", "centr": "centre", "ms": "manuscript", "mss": "manuscript", "dept": "department", "wg": "working group", "natl": "national", "mgmt": "management", "intl": "international", "univ": "university"}
# Short forms of given names.
NICKNAMES = dict(
    beto="roberto", concha="concepcion", mike="michael", uli="ulrich", penny="penelope", nacho="ignacio", ben="benjamin", larry="lawrence", steffi="stefanie",
    jackie="jacqueline", ceci="cecilia", uschi="ursula", rafa="rafael", yoli="yolanda", tino="valentin", andi="andreas", moncho="ramon", dani="daniel", isa="isabel",
    charo="rosario", wolf="wolfgang", tere="teresa", gabo="gabriel", lola="dolores", bastian="sebastian", susi="susanna", paco="francisco", lena="magdalena",
    kit="christopher", lupe="guadalupe", hannes="johannes", theo="theodore", gert="gertrude", mattie="matilda", trish="patricia", ted="theodore", edu="eduardo",
    lalo="eduardo", rick="richard", marga="margarita", hettie="henrietta", trudy="gertrude", pat="patricia", alex="alexander", vicky="victoria", heiner="heinrich",
    fritz="frederick", magda="magdalena", tono="antonio", fred="frederick", tony="antonio", sascha="alexander", niko="nikolaus", chris="christopher", dick="richard",
    tori="victoria", fina="josefina", tilda="matilda", kathi="katharina", sanna="susanna", pancho="francisco", etta="henrietta", seb="sebastian", rita="margarita",
    klaus="nikolaus", pepa="josefina", nardo="leonardo", jan="johannes", bill="william", leo="leonardo", will="william", kathe="katharina", beth="elizabeth",
    heinz="heinrich", betty="elizabeth", liz="elizabeth", lucho="luis", pepe="jose", bob="robert", rob="robert", jim="james", tom="thomas", kate="katharina",
    peggy="margaret", meg="margaret", nick="nicholas", sepp="josef", hansi="johannes", resi="theresia", toni="antonio", manolo="manuel", maite="maria",
)


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case without accents, as look-alike characters are read; letters without decomposition keep."""
    t = unicodedata.normalize("NFKD", (consistent_form(text) or "").lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l"))
    return "".join(c for c in t if not unicodedata.combining(c))


_WORDS = re.compile(r"[^\W\d_]+")


def near(a: str, b: str) -> bool:
    """Whether one typing error (a letter more, less, other, or two swapped) makes a of b."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1 or max(la, lb) < 4:
        return False
    i = 0
    m = min(la, lb)
    while i < m and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else b[i + 1 :] == a[i:]


class Given:
    """What is known about given names: which tokens are such, and which are established."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.like = {*counts, *NICKNAMES}
        self.established = {t for t, n in counts.items() if n >= ESTABLISHED * total} | set(NICKNAMES.values())


def _initials(word: str, given: Given, raw: str) -> list[str] | None:
    """Letters of "JI", "J.I." or "J"; None if the word is a name."""
    if len(word) == 1:
        return [word]
    if len(word) <= 3 and raw.isupper() and word not in given.like:
        return list(word)
    return None


@lru_cache(maxsize=50_000)
def parse(first: str | None, last: str | None, full: str | None, given: Given) -> dict | None:
    """The parsed name, which callers share and don't change: kind (p or o), family (parts without particles), whole (with particles), given (canonical names or initials); None if no letter."""
    first, last, full = ((consistent_form(x) or "").strip() for x in (first, last, full))
    if not first and not last and not full:
        return None
    if not (first or last):
        if org := _organisation(full):
            return org
        return _person_of_full(full, given)
    fw = [fold(w) for w in _WORDS.findall(first)]
    lw = [w for w in (fold(w) for w in _WORDS.findall(last)) if w not in SUFFIXES and w not in PARTICLES]
    fw_named = [w for w in fw if w not in TITLES and len(w) > 1 and w not in PARTICLES]
    if lw and fw_named and all(w in given.like for w in lw) and not any(w in given.like for w in fw_named):
        first, last = last, first  # first and last name in each other's place
    if not last:
        return _person_of_full(first, given)
    return _person(first, last, given)


def _person(first: str, last: str, given: Given) -> dict | None:
    gs: list[str] = []
    all_upper = first.isupper() and len(_WORDS.findall(first)) == 1 and len(first) > 3
    raws = _WORDS.findall(first)
    for raw in raws:
        w = fold(raw)
        if (w in TITLES or w in SUFFIXES) and not (len(raws) == 1 and raw.isupper()):
            continue
        if w in PARTICLES and len(w) > 1 and w not in given.like:
            last = f"{raw} {last}"
            continue
        ini = None if all_upper else _initials(w, given, raw)
        gs += ini if ini else [NICKNAMES.get(w, w)]
    ws = [fold(w) for w in _WORDS.findall(last)]
    ws = [w for w in ws if w not in SUFFIXES and (w not in TITLES or len(ws) > 2)] or ws
    fam = [w for w in ws if w not in PARTICLES] or ws
    if not fam:
        return None
    lead = [w for w in ws if w in PARTICLES]
    return {"kind": "p", "family": fam, "whole": "".join([*lead, *fam]), "given": gs}


def _person_of_full(full: str, given: Given) -> dict | None:
    head, comma, tail = full.partition(",")
    tail_words = [fold(w) for w in _WORDS.findall(tail)]
    if comma and tail_words and not all(w in SUFFIXES for w in tail_words):
        if not all(w in PARTICLES for w in tail_words):
            return _person(tail, head, given)
        head = f"{tail} {head}"
    raws = _WORDS.findall(head if comma else full)
    if not raws:
        return None
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", full if not comma else head)
    if len(words) > 1 and len(words[-1]) <= 3 and words[-1].isupper() and fold(words[-1]) not in given.like and fold(words[-1]) not in ("ii", "iii", "iv") and any(len(w) > 3 for w in words[:-1]):
        return _person(words[-1], " ".join(words[:-1]), given)
    words = [w for w in words if fold(w) not in SUFFIXES and fold(w) not in TITLES] or words
    if len(words) == 1:
        return _person("", words[0], given)
    if len(words) == 2 and fold(words[1]) in given.like and fold(words[0]) not in given.like and len(words[0]) > 2:
        return _person(words[1], words[0], given)
    n = 1
    while n < len(words) - 1 and fold(words[n]) in given.like and fold(words[n]) not in PARTICLES or (n < len(words) - 1 and len(words[n]) == 1):
        n += 1
    return _person(" ".join(words[:n]), " ".join(words[n:]), given)


def _organisation(full: str) -> dict | None:
    raws = _WORDS.findall(full)
    words = [fold(r) for r in raws]
    short = next((r for r in raws if 2 <= len(r) <= 6 and r.isupper()), None)
    has_word = any(ORG_WORDS.match(w) for w in words) or any(w in ("of", "for", "in") for w in words)
    acronym = short is not None and not full.isupper() and len(raws) >= 2 and (raws[0] == short or "(" in full or "," in full) and not any(ORG_WORDS.match(w) for w in words)
    if not (has_word or acronym):
        return None
    if acronym and not has_word:
        rest = [w for r, w in zip(raws, words, strict=True) if r != short and w not in ORG_NOISE]
        return {"kind": "o", "family": rest, "whole": "", "given": ["#" + fold(short)]} if rest else None
    out: list[str] = []
    for w in words:
        if w not in ORG_NOISE:
            out += ORG_SHORT.get(w, w).split()
    return {"kind": "o", "family": out, "whole": "", "given": []} if out else None


def similarity_of_given(a: str, b: str, given: Given) -> float:
    """1 for equal names, less for a typing error or an initial, 0 for a conflict."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.8 if a[0] == b[0] else 0.0
    if a in given.established and b in given.established:
        return 0.0
    return 0.9 if near(a, b) or (len(min(a, b, key=len)) >= 3 and max(a, b, key=len).startswith(min(a, b, key=len)) and len(a) - len(b) in (-2, 2)) else 0.0


def compare(a: dict, b: dict, weight_a: list[float], weight_b: list[float], given: Given) -> tuple[float, int]:
    """(similarity, relation): 0 no match, 2 equal detail, -1 a has less detail than b, 1 b has less detail than a.

    ``weight_a``, ``weight_b``: weights of the family parts; ``a`` and ``b`` may hold those of their given names (``rarity``), else these weigh alike.
    """
    if a["kind"] != b["kind"]:
        return 0.0, 0
    if a["kind"] == "o":
        return _compare_orgs(a, b, weight_a, weight_b)
    fa, fb = "".join(a["family"]), "".join(b["family"])
    wf = max(sum(weight_a), 1.0)
    less = 0  # bit 1: a lacks something, bit 2: b lacks something
    if fa == fb or a["whole"] == fb or fa == b["whole"] or a["whole"] == b["whole"]:
        fs = 1.0
    elif near(fa, fb) or near(a["whole"], b["whole"]) or near(a["whole"], fb) or near(fa, b["whole"]):
        fs = 0.9
    elif len(a["family"]) == len(b["family"]) > 1 and all(x == y or near(x, y) for x, y in zip(a["family"], b["family"], strict=True)):
        fs = 0.85
    else:
        short, long = (a, b) if len(fa) < len(fb) else (b, a)
        s = "".join(short["family"])
        parts = ["".join(long["family"][:k]) for k in range(1, len(long["family"]))] + ["".join(long["family"][k:]) for k in range(1, len(long["family"]))]
        if len(s) < 4 or not any(s == p or (len(p) > 3 and near(s, p)) for p in parts):
            return 0.0, 0
        fs = 0.8
        less |= 1 if short is a else 2
    ga, gb = a["given"], b["given"]
    if not ga or not gb:
        return 0.0, 0
    total = got = 0.0
    for i in range(max(len(ga), len(gb))):
        if i >= len(ga) or i >= len(gb):
            less |= 1 if i >= len(ga) else 2
            continue
        s = similarity_of_given(ga[i], gb[i], given)
        if s == 0.0:
            return 0.0, 0
        if len(ga[i]) != len(gb[i]) and 1 in (len(ga[i]), len(gb[i])):
            less |= 1 if len(ga[i]) == 1 else 2
        w = max(_at(a.get("rarity"), i), _at(b.get("rarity"), i))
        total += w
        got += w * s
    score = (fs * wf + got) / (wf + total)
    if score < THRESHOLD:
        return score, 0
    return score, {0: 2, 1: -1, 2: 1, 3: 3}[less]


def _at(weights: list[float] | None, i: int) -> float:
    """Weight of a given name; one of which nothing is known weighs as an ordinary one."""
    return weights[i] if weights and i < len(weights) else 2.0


def _same_org_token(x: str, y: str) -> float:
    if x == y:
        return 1.0
    if near(x, y) and min(len(x), len(y)) > 4:
        return 0.9
    s, l = (x, y) if len(x) < len(y) else (y, x)
    if len(s) >= 2 and l.startswith(s) and len(l) - len(s) >= 2:
        return 0.85
    if len(s) >= 4 and abs(len(x) - len(y)) <= 2 and _edits(x, y) <= 2 and len(l) >= 8:
        return 0.8
    return 0.0


def _edits(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != d))
    return row[-1]


def _compare_orgs(a: dict, b: dict, weight_a: list[float], weight_b: list[float]) -> tuple[float, int]:
    if a["given"] or b["given"]:
        if a["given"] and b["given"]:
            same = a["given"] == b["given"] and len(a["family"]) == len(b["family"]) and all(any(near(x, y) for y in b["family"]) for x in a["family"])
            return (1.0, 2) if same else (0.0, 0)
        short, long, relation = (a, b, -1) if a["given"] else (b, a, 1)
        rest = list(long["family"])
        for place in short["family"]:
            hit = next((w for w in rest if w == place or near(w, place)), None)
            if hit is None:
                return 0.0, 0
            rest.remove(hit)
        letters = short["given"][0][1:]
        return (0.8, relation) if sorted(w[0] for w in rest) == sorted(letters) else (0.0, 0)
    swap = len(a["family"]) > len(b["family"])
    if swap:
        a, b, weight_a, weight_b = b, a, weight_b, weight_a
    left = list(range(len(b["family"])))
    total = got = 0.0
    for i in sorted(range(len(a["family"])), key=lambda i: -weight_a[i]):
        x = a["family"][i]
        scores = [(_same_org_token(x, b["family"][j]), j) for j in left]
        s, j = max(scores)
        if s == 0.0:
            return 0.0, 0
        left.remove(j)
        w = max(weight_a[i], weight_b[j])
        total += w
        got += w * s
    # words that one form has more: frequent ones take little of the similarity, rare ones all
    score = got / (total + sum(weight_b[j] for j in left))
    if score < THRESHOLD:
        return score, 0
    return score, 2 if not left else 1 if swap else -1


# -- the operator -------------------------------------------------------------------------------------------------
_FORM = "name_id long, sig string, kind string, family array<string>, whole string, given array<string>"


def _given_names(names: DataFrame) -> Given:
    """Counts of tokens as given names (a bounded table by SHARE) over all rows."""
    words = lambda c, g: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{Lu}\p{Ll}+)"), 1), lambda t: F.struct(F.lower(t).alias("t"), F.lit(g).alias("g")))
    both = names.select(F.explode(F.concat(words(names["first_name"], 1), words(names["last_name"], 0))).alias("w")).select("w.t", "w.g")
    counts = stage(both.groupBy("t").agg(F.sum("g").alias("g"), F.sum(1 - F.col("g")).alias("f")), "p1-given")
    total = counts.agg(F.sum("g")).first()[0] or 1
    rows = counts.filter((F.col("g") >= total * SHARE) & (F.col("g") > 3 * F.col("f")) & (F.col("g") > 1)).collect()
    release(counts)
    into: dict[str, int] = {}
    for r in rows:
        t = fold(r["t"])
        if t not in TITLES and t not in PARTICLES:
            into[t] = into.get(t, 0) + r["g"]
    return Given(into, total)


def forms(names: DataFrame, given) -> DataFrame:
    """The parsed form of every row; rows without any letter have none and stay alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given.value
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, f, l, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = parse(f, l, n, g)
                if p is None:
                    continue
                sig = p["kind"] + "|" + " ".join(p["given"]) + "|" + (" ".join(sorted(p["family"])) if p["kind"] == "o" else "".join(p["family"]) + "|" + p["whole"])
                for c, v in zip(out, (i, sig, p["kind"], p["family"], p["whole"], p["given"]), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["name_id", "sig", "kind", "family", "whole", "given"])

    return names.select(F.col("name_id").cast("long"), "first_name", "last_name", "full_name").mapInArrow(run, _FORM)


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct ``t`` within one typing error, by a prefix-filtered join on positional q-grams.

    ``tokens``: distinct non-null t. A transposition counts as one error. Tokens under four letters only equal themselves.
    """
    pad = "^" * (Q - 1)
    t = tokens.filter(F.length("t") >= 4).select("t", F.concat(F.lit(pad), "t", F.lit("$" * (Q - 1))).alias("p"))
    grams = t.select("t", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("p") - (Q - 1)), lambda i: F.substr("p", i, F.lit(Q)))).alias("pos", "g"))
    rarity = grams.groupBy("g").agg(F.count("*").alias("df"))
    ordered = grams.join(rarity, "g").groupBy("t").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "g", "pos"))), 1, PREFIX).alias("prefix"))
    index = stage(ordered.select("t", F.explode("prefix").alias("x")).select("t", F.col("x.g").alias("g"), F.col("x.pos").alias("pos"), F.length("t").alias("n")), "p1-index")
    l, r = index.alias("l"), index.alias("r")
    hits = l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.t") < F.col("r.t")) & (F.abs(F.col("l.pos") - F.col("r.pos")) <= 1) & (F.abs(F.col("l.n") - F.col("r.n")) <= 1))
    pairs = hits.select(F.col("l.t").alias("a"), F.col("r.t").alias("b")).distinct()
    d = F.levenshtein("a", "b")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    return pairs.filter((d <= 1) | ((d == 2) & (F.length("a") == F.length("b")) & (letters(F.col("a")) == letters(F.col("b")))))


def misspelt(rare: Column, common: Column) -> Column:
    """Whether a spelling that occurs ``rare`` times may be an error for one that occurs ``common`` times.

    A matter of proportion, alike at every size of the data; a spelling seen once is never established.
    """
    return (rare <= 1) | (rare * RARER <= common)


def linked_forms(names: DataFrame, records: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(members: name_id, sig; groups: sig, root)."""
    sc = names.sparkSession.sparkContext
    given = sc.broadcast(_given_names(names))
    # ids given twice with different names keep each of their forms
    members = stage(forms(names.dropDuplicates(["name_id", "first_name", "last_name", "full_name"]), given), "p1-forms")
    one = members.groupBy("sig").agg(*(F.first(c).alias(c) for c in ("kind", "family", "whole", "given")), F.count("*").alias("n"))
    one = stage(one, "p1-distinct")
    total = max(one.count(), 2)

    # rare tokens: of persons the family name, whole and in parts; of organisations the rarest words
    fam = one.filter("kind = 'p'").select("sig", F.explode(F.array_distinct(F.concat(F.array(F.array_join("family", ""), F.col("whole")), F.filter("family", lambda x: F.length(x) >= 4)))).alias("t"))
    words = one.filter("kind = 'o'").select("sig", F.explode(F.array_distinct("family")).alias("t"))
    df = stage(fam.unionByName(words).groupBy("t").agg(F.count("*").alias("df")), "p1-df")
    weight = F.log(F.lit(float(total)) / F.col("df")) + 1
    weighed = words.join(df, "t").withColumn("w", weight)
    mass = weighed.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct(-F.col("w"), "t"))).alias("ws"), F.sum("w").alias("all"))
    # the prefix of an organisation: rarest words until those left can't reach the threshold by themselves; spellings that
    # hardly occur may be errors and don't count for what is reached
    mass = mass.select("sig", F.filter("ws", lambda x, i: (i == 0) | (x["col1"] <= -F.log(F.lit(total / 3.0)) - 1) | (F.aggregate(F.slice("ws", 1, i), F.lit(0.0), lambda s, y: s - F.when(y["col1"] <= -F.log(F.lit(total / 3.0)) - 1, 0.0).otherwise(y["col1"])) < (1 - THRESHOLD) * F.col("all"))).alias("ws"))
    rare = stage(fam.unionByName(mass.select("sig", F.explode("ws.t").alias("t"))), "p1-rare")

    similar = similar_tokens(rare.select("t").distinct())
    d1, d2 = df.select(F.col("t").alias("a"), F.col("df").alias("da")), df.select(F.col("t").alias("b"), F.col("df").alias("db"))
    # an error makes a rare spelling: of two names that occur about as often, neither is the other mistyped
    similar = stage(similar.join(d1, "a").join(d2, "b").filter(misspelt(F.least("da", "db"), F.greatest("da", "db"))).select("a", "b"), "p1-similar")
    both = similar.unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))

    letter = F.when(
        F.col("kind") == "p",
        F.array_distinct(F.flatten(F.transform(F.slice("given", 1, 1), lambda g: F.array(F.substring(g, 1, 1), F.when(F.length(g) > 1, F.substring(g, 2, 1)).otherwise(F.substring(g, 1, 1)))))),
    ).otherwise(F.array(F.lit("")))
    keyed = rare.join(one.select("sig", F.explode(letter).alias("c")), "sig")
    spread = keyed.unionByName(keyed.join(both, keyed.t == both.a).select("sig", F.col("b").alias("t"), "c"))
    l, r = stage(spread, "p1-spread").alias("l"), keyed.alias("r")
    cand = l.join(r, (F.col("l.t") == F.col("r.t")) & (F.col("l.c") == F.col("r.c")) & (F.col("l.sig") != F.col("r.sig")))
    cand = cand.select(F.least("l.sig", "r.sig").alias("a"), F.greatest("l.sig", "r.sig").alias("b")).distinct()

    # weights of the tokens of each form, rare ones higher
    sized = one.select("sig", F.posexplode("family").alias("i", "t")).join(df, "t", "left").groupBy("sig").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce(weight, F.lit(1.0)).alias("w")))), lambda x: x["w"]).alias("weights"))
    called = one.select("sig", F.posexplode("given").alias("i", "t"))
    known = called.groupBy("t").agg(F.count("*").alias("df"))
    called = called.join(known, "t").groupBy("sig").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", weight.alias("w")))), lambda x: x["w"]).alias("rarity"))
    full = one.select("sig", "kind", "family", "whole", "given").join(called, "sig", "left").join(sized, "sig")
    # a form travels as one text, so that each is read once in many pairs
    full = full.select("sig", F.to_json(F.struct("kind", "family", "whole", "given", "rarity", "weights")).alias("form"))
    fa, fb = full.select(F.col("sig").alias("a"), F.col("form").alias("form_a")), full.select(F.col("sig").alias("b"), F.col("form").alias("form_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = given.value
        load = lru_cache(maxsize=20_000)(json.loads)
        for b in batches:
            keep: list[tuple] = []
            for a_, b_, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = load(x), load(y)
                score, relation = compare(x, y, x["weights"], y["weights"], g)
                if relation:
                    keep.append((a_, b_, score, relation))
            cols = list(zip(*keep, strict=True)) if keep else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], ["a", "b", "score", "relation"])

    matched = stage(cand.join(fa, "a").join(fb, "b").select("a", "b", "form_a", "form_b").mapInArrow(verify, "a string, b string, score double, relation int"), "p1-matched")
    level = components(one.select(F.col("sig").alias("id")), matched.filter("relation = 2").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    roots = stage(level.select(F.col("id").alias("sig"), F.col("group").alias("root")), "p1-roots")
    # (less, more): what has less detail, and what it may be short for
    up = matched.filter("relation in (1, -1)").select(
        F.when(F.col("relation") == -1, F.col("a")).otherwise(F.col("b")).alias("less"), F.when(F.col("relation") == -1, F.col("b")).otherwise(F.col("a")).alias("more"), "score")
    short = one.select("sig", (F.coalesce(F.length(F.get("given", 0)) == 1, F.lit(False)) | F.coalesce(F.get("given", 0).startswith("#"), F.lit(False))).alias("initial"))
    up = stage(up.join(short.withColumnRenamed("sig", "less"), "less"), "p1-up")
    for initial in (False, False, True, True):
        roots = _attach(up.filter(F.col("initial") == initial), roots, one)
    if records is not None:
        roots = _attach_by_works(up, roots, members, records)
    return members.select("name_id", "sig"), roots


def _named(df: DataFrame, sig: str, root: str) -> DataFrame:
    return df.select(F.col("sig").alias(sig), F.col("root").alias(root))


def _attach(up: DataFrame, roots: DataFrame, one: DataFrame) -> DataFrame:
    """Components of less detail join the one component of more detail that all their forms fit."""
    met = up.join(_named(roots, "less", "low"), "less").join(_named(roots, "more", "high"), "more").filter("low <> high")
    # a fit of both given names counts before a fit of one
    choice = met.groupBy("low", "high").agg(F.max("score").alias("score"))
    only = choice.groupBy("low").agg(F.countDistinct("high").alias("n"), F.max("high").alias("high")).filter("n = 1").select("low", F.col("high").alias("to"))
    only = stage(only, "p1-attach")
    back = only.select(F.col("low").alias("to"), F.col("to").alias("x"))  # never in a circle
    only = only.join(back, "to", "left").filter(F.col("x").isNull() | (F.col("x") != F.col("low"))).select("low", "to")
    # what a component joins may itself join another in the same step
    ahead = only.select(F.col("low").alias("to"), F.col("to").alias("beyond"))
    only = only.join(ahead, "to", "left").select("low", F.coalesce("beyond", "to").alias("to"))
    return stage(roots.join(only, roots.root == only.low, "left").select("sig", F.coalesce("to", "root").alias("root")), "p1-roots")


def _attach_by_works(up: DataFrame, roots: DataFrame, members: DataFrame, records: DataFrame) -> DataFrame:
    """Components that fit several join the one with which they share most works, if one stands out."""
    met = up.join(_named(roots, "less", "low"), "less").join(_named(roots, "more", "high"), "more").filter("low <> high").select("low", "high").distinct()
    met = stage(met, "p1-open")
    doi = F.regexp_extract(F.lower(F.coalesce("doi", F.lit(""))), r"(10\.\d+/\S+)", 1)
    title = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+", "")
    keys = F.array_compact(F.array(F.when(doi != "", doi), F.when(F.length(title) > 20, title)))
    works = records.select(F.explode(keys).alias("work"), F.col("creators.name_id").alias("ids")).select("work", F.explode("ids").alias("name_id")).filter("name_id is not null").distinct()
    of_root = members.select("name_id", "sig").join(roots, "sig").join(works, "name_id").select("root", "work").distinct()
    low = met.join(of_root.select(F.col("root").alias("low"), "work"), "low")
    shared = low.join(of_root.select(F.col("root").alias("high"), "work"), ["high", "work"]).groupBy("low", "high").agg(F.count("*").alias("n"))
    best = shared.groupBy("low").agg(F.max_by("high", "n").alias("to"), F.max("n").alias("top"), F.sum("n").alias("sum")).filter("2 * top > sum").select("low", "to")
    best = stage(best, "p1-best")
    ahead = best.select(F.col("low").alias("to"), F.col("to").alias("beyond"))
    best = best.join(ahead, "to", "left").select("low", F.coalesce("beyond", "to").alias("to"))
    return stage(roots.join(best, roots.root == best.low, "left").select("sig", F.coalesce("to", "root").alias("root")), "p1-roots")


def _with_orcid(members: DataFrame, roots: DataFrame, names: DataFrame) -> DataFrame:
    """(name_id, root): rows with one ORCID belong together, whatever their names."""
    base = members.join(roots, "sig").select("name_id", "root")
    ids = F.regexp_extract(F.upper(F.coalesce("orcid", F.lit(""))), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1)
    known = base.join(names.select("name_id", ids.alias("o")).filter("o <> ''").distinct(), "name_id").select("o", "root").distinct()
    least = known.groupBy("o").agg(F.min("root").alias("least"))
    links = known.join(least, "o").filter("root <> least").select(F.col("root").alias("src"), F.col("least").alias("dst"))
    merged = components(base.select(F.col("root").alias("id")).distinct(), links).select(F.col("id").alias("root"), F.col("group").alias("owner"))
    return base.join(merged, "root").select("name_id", "owner")


def owners(names: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """name_id, owner: one row per distinct name_id; equal owners are one person or organisation.

    Null and empty names stay alone (no row here); repeated rows count once; an id given twice with different names has
    the owners of both. ``records`` (authority_records) help to tell apart what initials leave open.
    """
    members, roots = linked_forms(names, records)
    return _with_orcid(members, roots, names).distinct()


def name_links(names: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """p1_found: name_id_a, name_id_b, every pair inside a group, a < b."""
    g = stage(owners(names, records), "p1-owners")
    l, r = g.alias("l"), g.alias("r")
    pairs = l.join(r, (F.col("l.owner") == F.col("r.owner")) & (F.col("l.name_id") < F.col("r.name_id")))
    return pairs.select(F.col("l.name_id").alias("name_id_a"), F.col("r.name_id").alias("name_id_b")).distinct()

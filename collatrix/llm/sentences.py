"""Problem 10: sentence boundaries across languages and scripts.

Abbreviations, collocations and frequent sentence starters are learned per language from all documents, without labels,
by log-likelihood ratios; then each period is classified by these statistics. Scripts without a doubtful period (Chinese,
Japanese, Hindi) are cut at their own marks. Thai, which separates sentences and phrases alike by a space, is cut where
the space stands between an end that also ends paragraphs and a start that also starts them. Lines with a meaning of
their own (headings, list items, captions, front matter, fenced blocks) are units before any of this.

One pass over the texts counts types and the words after periods; what is an abbreviation, a starter or a collocation is
worked out on these counts, joined exactly and in the cluster. Only what passes the tests reaches the workers, as a broadcast
with a proven bound: an entry needs a share of SHARE of the events of its language, so a language has at most 1 / SHARE entries
of a kind, whatever the number of documents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatrix.session import stage

#: Least share of a language's events that an entry of the broadcast must have; the counts themselves are never cut.
SHARE = 1e-6
# Thresholds of the published unsupervised method.
ABBREVIATION_SCORE = 0.3
STARTER_RATIO = 30.0
COLLOCATION_RATIO = 7.88

# Frequent function words that tell languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is was with that for by as at from which were this no not an".split(),
    "es": "el la los las de del en y que una un con por se sin su según este fue".split(),
    "fr": "le la les des du de et en une un est que dans sur sans au selon ce qui".split(),
    "de": "der die das und in den dem des von ein eine ist war mit im bei nicht zu vor".split(),
}
_LANGUAGE_OF: dict[str, list[str]] = defaultdict(list)
for _l, _ws in FUNCTION_WORDS.items():
    for _w in _ws:
        _LANGUAGE_OF[_w].append(_l)

# Ranges of the scripts; Kana decide between Japanese and Chinese, Latin words are usual guests elsewhere.
_SCRIPTS = [
    ("latin", re.compile(r"[A-Za-zÀ-ɏ]+"), 0.4),
    ("ja", re.compile(r"[぀-ヿ]+"), 5.0),
    ("zh", re.compile(r"[一-鿿]+"), 1.0),
    ("th", re.compile(r"[฀-๿]+"), 1.0),
    ("hi", re.compile(r"[ऀ-ॿ]+"), 1.0),
    ("ar", re.compile(r"[؀-ۿ]+"), 1.0),
    ("ru", re.compile(r"[Ѐ-ӿ]+"), 1.0),
]

OPENERS = "“„«‘‚\"'([{¿¡「『《（【‹—–"
CLOSERS = "”’»\"')]}」』》）】›“"
_END = re.compile(r"[.!?…。！？．؟۔।॥]+")
_DANDA = re.compile(r"[.!?…。！？．؟۔।॥|]+")
_TOKEN = re.compile(r"\S+")
_NUMBER = re.compile(r"[\d.,:/\-–]*\d[\d.,:/\-–]*")
_NUMBERED = re.compile(r"[\d.,]*\d[^\W\d_]{1,2}")
_WORDLY = re.compile(r"\w")
_HEADING = re.compile(r"\s*#{1,6}\s")
_LIST = re.compile(r"\s*(?:[-*+•·‣◦▪–]|\(?\d{1,3}[.)]|[a-z]\))\s+\S")
_FENCE = re.compile(r"\s*(```|~~~)")
_LINE = re.compile(r"[^\n]*(?:\n|$)")
_JAMMED = re.compile(r"[^\W\d_]{3,}[)\]”»’\"]?$")
_NEXT_WORD = re.compile(r"[“«„¿¡(\"—]?([^\W\d_]+)")
_LAST_WORD = re.compile(r"\S+$")
_ADDRESS = re.compile(r"://|www\.|@|doi\.")
_SPEECH = re.compile(r"^[^。！？：“”\s]{0,8}[说問问道写寫答喊叫]")


def language_of(text: str) -> str:
    """Language by script, and by function words for the Latin script; the table's lang column may be missing or wrong."""
    n = {k: sum(map(len, p.findall(text))) * w for k, p, w in (_SCRIPTS[:1] if text.isascii() else _SCRIPTS)}
    best = max(n, key=lambda k: n[k])
    if not n[best]:
        return "en"
    if best != "latin":
        return best
    votes = Counter(l for w in text.lower().split() if w in _LANGUAGE_OF for l in _LANGUAGE_OF[w])
    return max(votes, key=lambda k: (votes[k], k)) if votes else "en"


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is prose) of every block: front matter, fences, headings, list items and lone lines are no prose."""
    out: list[tuple[int, int, bool]] = []
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
    i, prose = 0, None

    def flush() -> None:
        nonlocal prose
        if prose:
            out.append((*prose, True))
        prose = None

    first = next((k for k, (a, b) in enumerate(lines) if text[a:b].strip()), None)
    if first is not None and text[slice(*lines[first])].strip() == "---":
        close = next((k for k in range(first + 1, len(lines)) if text[slice(*lines[k])].strip() in ("---", "...")), None)
        if close is not None:
            out.append((lines[first][0], lines[close][1], False))
            i = close + 1
    while i < len(lines):
        a, b = lines[i]
        line = text[a:b]
        if fence := _FENCE.match(line):
            close = next((k for k in range(i + 1, len(lines)) if text[slice(*lines[k])].strip().startswith(fence[1])), None)
            if close is not None:
                flush()
                out.append((a, lines[close][1], False))
                i = close + 1
                continue
        if not line.strip():
            flush()
        elif _HEADING.match(line) or (_LIST.match(line) and _is_item(text, lines, i, prose)):
            flush()
            out.append((a, b, False))
        else:
            prose = (prose[0] if prose else a, b)
        i += 1
    flush()
    return out


def _is_item(text: str, lines: list[tuple[int, int]], i: int, prose: tuple[int, int] | None) -> bool:
    """A wrapped line of prose may begin with a number or a dash; an item follows a blank line, an item or a heading."""
    if prose is None:
        return True
    before = text[slice(*lines[i - 1])].rstrip()
    mark = re.match(r"\s*([-*+•·‣◦▪])\s", text[slice(*lines[i])])
    return bool(mark) and before.endswith((".", ":", ";", "!", "?"))


@lru_cache(maxsize=1 << 17)
def word_type(token: str) -> str:
    """The type a token counts as: lower case but for single letters, numbers alike, without quotes, brackets and final period."""
    t = token.strip(OPENERS + CLOSERS + ",;:!?…؟،؛।॥|")
    t = t.removesuffix(".")
    if t and t[0] in "0123456789" or t[-1:].isdigit():
        if _NUMBER.fullmatch(t):
            return "##"
        if _NUMBERED.fullmatch(t):
            return "##" + t.lstrip("0123456789.,")
    return t if len(t) == 1 else t.lower()


@lru_cache(maxsize=1 << 17)
def _facts(text: str) -> tuple[str, bool, bool, bool, bool]:
    """type, period, stops, upper, lower of a word: whether it ends with a period of its own or with another mark, and how it begins."""
    t, kind = text.rstrip(CLOSERS), word_type(text)
    c = text.lstrip(OPENERS)[:1]
    return kind, t.endswith(".") and not t.endswith("..") and bool(kind), t.endswith(("!", "?", "؟")), c.isalpha() and not c.islower(), c.islower()


class Token:
    """A word of a block with what the classifier asks about it."""

    __slots__ = ("bare", "end", "lower", "period", "start", "stops", "text", "type", "upper")

    def __init__(self, text: str, start: int) -> None:
        self.text, self.start, self.end = text, start, start + len(text)
        self.bare = text.lstrip(OPENERS)
        self.type, self.period, self.stops, self.upper, self.lower = _facts(text)


class Tokens:
    """The words of a block, each looked at only when it is asked for; signs without any letter or digit (emoji, dashes) are passed over."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.spans = [(m[0], m.start()) for m in _TOKEN.finditer(text, a, b) if _WORDLY.search(m[0])]

    def __len__(self) -> int:
        return len(self.spans)

    def kind(self, i: int) -> str:
        """The type of a word; a short word after a bare number is a unit of measure or of time."""
        t = _facts(self.spans[i][0])[0]
        if i and len(t) < 4 and t.isalpha() and t.islower():
            before = _facts(self.spans[i - 1][0])
            if before[0] == "##" and not before[1]:
                return "##" + t
        return t

    def __getitem__(self, i: int) -> Token:
        out = Token(*self.spans[i])
        out.type = self.kind(i)
        return out


def is_initial(t: str) -> bool:
    return len(t) == 1 and t.isalpha()


class Model:
    """Learned sets per language."""

    def __init__(self) -> None:
        self.abbreviations: dict[str, set[str]] = defaultdict(set)
        self.starters: dict[str, set[str]] = defaultdict(set)
        self.collocations: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.enders: dict[str, set[str]] = defaultdict(set)
        self.heads: set[str] = set()
        self.tails: set[str] = set()

    # -- classification -------------------------------------------------------------------------------------------
    def abbreviated(self, lang: str, t: str) -> bool:
        if t in self.abbreviations[lang]:
            return True
        return "-" in t and t.rsplit("-", 1)[-1] in self.abbreviations[lang]

    def ends_at(self, lang: str, tok: Token, nxt: Token | None, gap: str) -> bool:
        """Whether the period after ``tok`` ends a sentence, with ``nxt`` the word after it and ``gap`` what stands between."""
        if nxt is None:
            return True
        first = nxt.bare[:1]
        cased = first.isupper() or first.islower()
        if first.islower():
            return False
        t, n = tok.type, nxt.type
        sign = any(c in "¿¡" for c in nxt.text[: len(nxt.text) - len(nxt.bare)])
        if t == "##":
            if (t, n) in self.collocations[lang] and n not in self.starters[lang]:
                return False
            return cased or sign or first.isdigit() or n in self.starters[lang]
        initial = is_initial(t)
        if not (initial or self.abbreviated(lang, t)):
            return True
        if t in self.enders[lang]:
            return True
        if sign:
            return True
        if (t, n) in self.collocations[lang] and n not in self.starters[lang]:
            return False
        if n in self.starters[lang] and (t, n) not in self.collocations[lang] and n != "##":
            return not (initial and tok.upper and is_initial(n))
        return False


# -- cutting ------------------------------------------------------------------------------------------------------
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "《": "》"}


_MARKS = re.compile("[" + "".join(map(re.escape, sorted({*_PAIRS, *"".join(_PAIRS.values()), '"'}))) + "]")


def _spans(text: str, a: int, b: int) -> list[tuple[int, int, bool]]:
    """(open, close, is quotation) of the pairs that close inside the block."""
    out, stack, straight = [], [], None
    for m in _MARKS.finditer(text, a, b):
        i, ch = m.start(), m[0]
        if stack and ch in _PAIRS[text[stack[-1]]]:
            if ch == "’" and i + 1 < b and text[i + 1].isalpha() and text[i - 1].isalpha():
                continue
            o = stack.pop()
            out.append((o, i, text[o] not in "(（"))
        elif ch in _PAIRS:
            if ch == "‘" and i > a and text[i - 1].isalpha():
                continue
            stack.append(i)
        elif ch == '"':
            if straight is None:
                straight = i
            else:
                out.append((straight, i, True))
                straight = None
        elif ch in ")）»」』”" and any(ch in _PAIRS[text[o]] for o in stack):
            while ch not in _PAIRS[text[stack[-1]]]:
                stack.pop()
            o = stack.pop()
            out.append((o, i, text[o] not in "(（"))
    return sorted(out)


def _jammed(text: str, a: int, b: int, i: int, j: int, mark: str, lang: str, model: Model) -> bool:
    """Whether two sentences meet at a mark without a space between them."""
    word = _NEXT_WORD.match(text, j, min(b, j + 60))
    if not word or not word[1][0].isupper() or len(mark) > 1:
        return False
    left = _LAST_WORD.search(text[max(a, i - 60) : i])
    if not left or _ADDRESS.search(left[0]):
        return False
    if mark != ".":
        return True
    t = word_type(left[0])
    if is_initial(t) or (model.abbreviated(lang, t) and t not in model.enders[lang]):
        return False
    if word[1].lower() in model.starters[lang]:
        return True
    return bool(_JAMMED.search(left[0])) and (word[1][1:].islower() or len(word[1]) == 1)


def _candidates(text: str, a: int, b: int, lang: str, model: Model) -> list[int]:
    """Ends of sentences by their marks alone, quotations and brackets not yet considered."""
    toks = Tokens(text, a, b)
    at = [(x, x + len(t)) for t, x in toks.spans]
    ends = []
    k, n = 0, len(at)
    for m in (_DANDA if lang == "hi" else _END).finditer(text, a, b):
        i, j = m.start(), m.end()
        mark = m[0]
        while j < b:  # closing quotes and brackets belong to the sentence; French ones stand after a space
            if text[j] in CLOSERS and not (text[j] in "“\"'" and (j + 1 < b and text[j + 1].isalnum()) and lang != "de"):
                j += 1
            elif text[j] in "    " and j + 1 < b and text[j + 1] == "»":
                j += 2
            else:
                break
        if j >= b or not text[j:b].strip():
            ends.append(j)
            continue
        if "|" in mark and (not text[j].isspace() or text[i - 1] in "<>|"):
            continue
        east = mark[-1] in "。！？．" or (lang in ("zh", "ja") and mark[-1] in "!?")
        if east or (lang == "hi" and mark[-1] in "।॥|"):
            if mark[-1] == "．" and i and text[i - 1].isdigit() and text[j].isdigit():
                continue
            ends.append(j)
            continue
        spaced = text[j].isspace()
        while k < n and at[k][1] <= i:
            k += 1
        here = toks[k] if k < n and at[k][0] <= i < at[k][1] else None
        q = k + 1 if here else k
        nxt = toks[q] if q < n else None
        if not spaced:
            if text[j] in ",;:،؛—–-":
                continue
            if lang in ("zh", "ja", "th"):
                continue
            if _jammed(text, a, b, i, j, mark, lang, model):
                ends.append(j)
            continue
        if nxt is None:
            continue
        gap = text[j : nxt.start]
        if re.match(r"\s*[,;:،؛]", text[j:b]) or re.match(r"\s*[—–-]\s*[^\W\d_]?", gap + nxt.text) and nxt.bare.lstrip("—–-")[:1].islower() and gap.strip() + nxt.text[:1] in ("—", "–", "-", "——"):
            continue
        if re.match(r"\s*[—–]\s", gap) and nxt.bare[:1].islower():
            continue
        first = nxt.bare[:1]
        if mark == "." :
            if here is None or not here.type:
                if first.islower():
                    continue
                ends.append(j)
            elif model.ends_at(lang, here, nxt, gap):
                ends.append(j)
        elif set(mark) <= {".", "…"}:
            if (first.isupper() and (nxt.type in model.starters[lang])) and lang not in ("zh", "ja"):
                ends.append(j)
        elif not first.islower():
            ends.append(j)
    return ends


def _thai_ends(text: str, a: int, b: int, model: Model) -> list[int]:
    """Ends of Thai sentences: spaces between a tail and a head of paragraphs."""
    chunks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    ends = []
    for k in range(len(chunks) - 1):
        if text[chunks[k][1] - 1] in "!?" or (tail_of(text, chunks, k) in model.tails and head_of(text, chunks, k + 1) in model.heads):
            ends.append(chunks[k][1])
    return ends


def head_of(text: str, chunks: list[tuple[int, int]], k: int) -> str:
    """What a Thai chunk begins with; a whole short chunk counts as it is."""
    return text[chunks[k][0] : min(chunks[k][1], chunks[k][0] + 4)]


def tail_of(text: str, chunks: list[tuple[int, int]], k: int) -> str:
    """What a Thai chunk ends with; a number goes with the chunk before it."""
    c = text[slice(*chunks[k])]
    if _NUMBER.fullmatch(c):
        return (text[max(chunks[k - 1][0], chunks[k - 1][1] - 4) : chunks[k - 1][1]] if k else "") + "#"
    return c[-4:]


def sentence_spans(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text in code points, end exclusive, no white space at either end; none for null or blank."""
    if not text or not text.strip():
        return []
    out = []
    lang = language_of(text)
    for a, b, prose in blocks(text):
        cuts = [b]
        if prose:
            cuts = [*_cut(text, a, b, lang, model), b]
        at = a
        for c in cuts:
            s, e = at, c
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
            at = c
    return out


def _cut(text: str, a: int, b: int, lang: str, model: Model) -> list[int]:
    ends = _thai_ends(text, a, b, model) if lang == "th" else _candidates(text, a, b, lang, model)
    if not ends:
        return []
    drop: set[int] = set()
    have = set(ends)

    def start_before(o: int) -> int:
        k = bisect_right(ends, o) - 1
        while k >= 0 and ends[k] in drop:
            k -= 1
        return ends[k] if k >= 0 else a

    for o, c, quotation in _spans(text, a, b):
        lo, hi = bisect_right(ends, o), bisect_right(ends, c)
        east_end = quotation and c + 1 in have and c + 1 < b and lang in ("zh", "ja")
        if lo == hi and not east_end:
            continue
        leading = not text[start_before(o) : o].strip()
        if east_end and (text[c + 1] in "とっ" or (leading and _SPEECH.match(text[c + 1 : c + 12]))):
            drop.add(c + 1)
        nxt = ends[hi] if hi < len(ends) else b
        outer = nxt not in drop and not text[c + 1 : nxt].strip(CLOSERS + " .。．")
        if not (leading and outer):
            drop.update(ends[lo:hi])
    kept = [e for e in ends if e not in drop]
    # a dialogue opened by a dash goes on to the words that report it
    out: list[int] = []
    start = a
    for n, e in enumerate(kept):
        said = text[start:e].lstrip()
        if said[:1] in "—–":
            nxt = kept[n + 1] if n + 1 < len(kept) else b
            if re.search(r"\s[—–]\s?[^\W\d_A-ZÀ-ÞА-Я]", text[e:nxt]) and not re.search(r"\s[—–]\s?[^\W\d_A-ZÀ-ÞА-Я]", said):
                if not text[e:nxt].lstrip().startswith(("—", "–")):
                    continue
        out.append(e)
        start = e
    return out


# -- learning -----------------------------------------------------------------------------------------------------
def count(text: str, into: Counter) -> None:
    """The one pass: how often each type stands with (P) and without (N) a final period; types after other sure ends (S); the words
    after each word with a period, by how they begin (U upper case, L lower case, O other); edges of Thai paragraphs."""
    lang = language_of(text)
    if lang in ("zh", "ja"):
        return
    for a, b, prose in blocks(text):
        if not prose:
            continue
        if lang == "th":
            chunks = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
            if chunks:
                into["th", "head", head_of(text, chunks, 0), ""] += 1
                into["th", "tail", tail_of(text, chunks, len(chunks) - 1), ""] += 1
            continue
        toks = Tokens(text, a, b)
        last = len(toks) - 1
        for i in range(last + 1):
            _, period, stops, _, _ = _facts(toks.spans[i][0])
            kind = toks.kind(i)
            into[lang, "P" if period else "N", kind, ""] += 1
            if i == last or not (period or stops):
                continue
            _, _, _, upper, lower = _facts(toks.spans[i + 1][0])
            if not stops:
                into[lang, "U" if upper else "L" if lower else "O", kind, toks.kind(i + 1)] += 1
            elif not lower:
                into[lang, "S", "", toks.kind(i + 1)] += 1


def _ll(k: Column, n: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def ratio(count_a: Column, count_b: Column, count_ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of b following a."""
    p, p1 = count_b / n, count_ab / count_a
    p2 = (count_b - count_ab) / F.greatest(n - count_a, F.lit(1))
    return -2 * (_ll(count_ab, count_a, p) + _ll(count_b - count_ab, n - count_a, p) - _ll(count_ab, count_a, p1) - _ll(count_b - count_ab, n - count_a, p2))


def abbreviation_score(t: Column, with_period: Column, without: Column, n_periods: Column, n: Column) -> Column:
    """Score of a type: likelihood that its period is its own, by length, inner periods and occurrences without one."""
    a = with_period + without
    like = -2 * (_ll(with_period, a, n_periods / n) - _ll(with_period, a, F.lit(0.99)))
    only = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    letters = F.when(only > 0, only).otherwise(F.length(t)).cast("double")
    inner = F.length(t) - F.length(F.replace(t, F.lit("."))) + 1
    return like * F.exp(-letters) * inner * F.pow(letters, -without.cast("double"))


def _counted(docs: DataFrame) -> DataFrame:
    """lang, kind, a, b, n: what ``count`` finds in all texts, added up per slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                into: Counter = Counter()
                for text in batch.column(0).slice(at, 2048).to_pylist():
                    if text and text.strip():
                        count(text, into)
                if into:
                    keys = list(into)
                    cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(list(into.values()), pa.int64())], ["lang", "kind", "a", "b", "n"])

    rows = docs.select("text").filter("text is not null").mapInArrow(run, "lang string, kind string, a string, b string, n long")
    return rows.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> Model:
    """The statistics of all documents; one pass over the texts, counts only are shuffled, and only entries that pass are collected."""
    model = Model()
    counts = stage(_counted(docs), "p10-counts")
    initial = lambda c: (F.length(c) == 1) & F.col(c).rlike(r"\p{L}")
    often = lambda n, total: F.col(n) >= F.col(total) * SHARE
    edges = counts.filter("kind in ('head', 'tail')")
    edges = edges.join(edges.groupBy("kind").agg(F.sum("n").alias("all")), "kind").filter(often("n", "all"))
    for r in edges.select("kind", "a").collect():
        (model.heads if r["kind"] == "head" else model.tails).add(r["a"])

    words = counts.filter("kind in ('P', 'N')")
    types = words.groupBy("lang", "a").agg(F.sum(F.when(F.col("kind") == "P", F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("t"))
    types = stage(types, "p10-types")
    sums = stage(types.groupBy("lang").agg(F.sum("p").alias("all_p"), F.sum("t").alias("all_t"), F.sum(F.when(F.col("a") != "", F.col("t")).otherwise(0)).alias("typed")), "p10-sums")
    score = abbreviation_score(F.col("a"), F.col("p"), F.col("t") - F.col("p"), F.col("all_p"), F.col("typed"))
    short = types.filter((F.col("p") > 0) & (F.col("a") != "##") & F.col("a").rlike(r"\p{L}") & ~F.col("a").rlike(r"[:/\\@<>|]")).join(sums, "lang")
    short = stage(short.filter((score >= ABBREVIATION_SCORE) & often("p", "all_p")).select("lang", "a"), "p10-abbreviations")
    for r in short.collect():
        model.abbreviations[r["lang"]].add(r["a"])

    # the words after periods: of abbreviations, initials and numbers (C), and those that begin sentences (S)
    after = counts.filter("kind in ('U', 'L', 'O')")
    known, tail = short.withColumn("known", F.lit(True)), short.select("lang", F.col("a").alias("end"), F.lit(True).alias("ended"))
    after = after.withColumn("end", F.when(F.col("a").contains("-"), F.substring_index("a", "-", -1))).join(known, ["lang", "a"], "left").join(tail, ["lang", "end"], "left")
    after = stage(after.select("lang", "kind", "a", "b", "n", ((F.col("a") == "##") | initial("a") | F.coalesce("known", "ended", F.lit(False))).alias("open")), "p10-after")
    starts = after.filter("not open and kind <> 'L'").select("lang", "b", "n").unionByName(counts.filter("kind = 'S'").select("lang", "b", "n"))
    starts = stage(starts.groupBy("lang", "b").agg(F.sum("n").alias("s")), "p10-starts")
    all_s = starts.groupBy("lang").agg(F.sum("s").alias("all_s"))
    of_b = types.select("lang", F.col("a").alias("b"), "t")
    s = starts.filter((F.col("b") != "") & ~initial("b")).join(of_b, ["lang", "b"]).join(all_s, "lang").join(sums, "lang")
    s = s.filter((F.col("t") >= F.col("s")) & (F.col("s") / F.col("all_s") > F.col("t") / F.col("all_t")) & often("s", "all_s"))
    s = stage(s.filter(ratio(F.col("all_s"), F.col("t"), F.col("s"), F.col("all_t")) >= STARTER_RATIO).select("lang", "b"), "p10-starters")
    for r in s.collect():
        model.starters[r["lang"]].add(r["b"])

    pairs = after.filter("open").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "U", F.col("n")).otherwise(0)).alias("u"))
    pairs = stage(pairs, "p10-pairs")
    of_a = pairs.groupBy("lang", "a").agg(F.sum("n").alias("a_n"))
    all_c = pairs.groupBy("lang").agg(F.sum("n").alias("all_c"))
    c = pairs.filter("b <> '' and n > 1").join(of_a, ["lang", "a"]).join(of_b, ["lang", "b"]).join(sums, "lang").join(all_c, "lang").withColumn("t", F.greatest("t", "n"))
    # an ordinal's word ("3. Mai") seldom stands elsewhere
    c = c.filter(~((F.col("a") == "##") & (F.col("n") <= 0.5 * F.col("t"))) & (F.col("t") < F.col("all_t")) & (F.col("n") / F.col("a_n") > F.col("t") / F.col("all_t")) & often("n", "all_c"))
    for r in c.filter(ratio(F.col("a_n"), F.col("t"), F.col("n"), F.col("all_t")) >= COLLOCATION_RATIO).select("lang", "a", "b").collect():
        model.collocations[r["lang"]].add((r["a"], r["b"]))
    # An abbreviation that is mostly followed by sentence starters, when by upper case at all, can end sentences.
    begun = pairs.filter("a <> '##'").join(s.withColumn("starts", F.lit(True)), ["lang", "b"], "left")
    begun = begun.groupBy("lang", "a").agg(F.sum("u").alias("u"), F.sum(F.when(F.col("starts"), F.col("u")).otherwise(0)).alias("started"), F.sum("n").alias("n")).join(all_c, "lang")
    for r in begun.filter((F.col("u") > 0) & (F.col("started") > 0.5 * F.col("u")) & often("n", "all_c")).select("lang", "a").collect():
        model.enders[r["lang"]].add(r["a"])
    return model


def sentence_units(docs: DataFrame) -> DataFrame:
    """p10_found: doc_id, start_char, end_char, one row per unit of every document; statistics are learned from all texts.

    Null and blank texts have no unit; repeated rows have their own; other columns aren't read.
    """
    model = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [sentence_spans(t, m) for t in part.column(1).to_pylist()]
                ids = [i for i, f in zip(part.column(0).to_pylist(), found, strict=True) for _ in f]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([s for f in found for s, _ in f], pa.int32()), pa.array([e for f in found for _, e in f], pa.int32())],
                    ["doc_id", "start_char", "end_char"])

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, start_char int, end_char int")

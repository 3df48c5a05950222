"""Problem 5: markup residue in text: HTML and XML, Markdown, wiki and LaTeX markup, and character entities.

A value is parsed into one tree whatever its markup: block nodes (headings, paragraphs, list items, code, formulas, table
rows) inside containers, with the kinds of markup met on the way. Paragraphs then pass points for their length and their
commas to their ancestors, halved at each step up and discounted by the share of text that stands in links; the best
container and its siblings, up to the root, are kept unless they are mostly links (navigation) and score low, so that no
section is lost for being short. What is
kept is rendered as blocks with their kind and as plain text. A value with no block structure is one container and is
kept whole. Signs used as signs, footnote stars, editorial brackets and web addresses are no markup.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in the structure.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "title": 2, "jats:title": 2}
CONTAINERS = "html body div section article main aside nav header footer ul ol dl table tbody thead blockquote jats:sec jats:abstract sec abstract jats:list list".split()
PARAGRAPHS = "p jats:p pre li dt dd tr td th caption figcaption jats:list-item list-item address".split()
INLINE = (
    "a abbr b bold big cite code del dfn em font i ins italic kbd mark q s samp scp sc small span strike strong sub sup tt u var wbr br hr img "
    "jats:italic jats:bold jats:sup jats:sub jats:sc jats:ext-link jats:xref xref ext-link"
).split()
MATH = "math mml:math tex-math jats:tex-math inline-formula disp-formula jats:inline-formula jats:disp-formula".split()
SKIPPED = "script style head noscript template".split()
VOID = "br hr img wbr input meta link col".split()
KNOWN_TAGS = {*HEADINGS, *CONTAINERS, *PARAGRAPHS, *INLINE, *MATH, *SKIPPED, *VOID}

#: A value without any of these characters holds no markup and never leaves the JVM.
SUSPECT = r"[<>&\\{}*_`$~#=|\[']"

_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:\s+[^<>]*)?)(/?)>|<!--.*?(?:-->|$)|<!\[CDATA\[|<!DOCTYPE[^>]*>|<\?\w+[^>]*\?>", re.S | re.I)
_CUT_TAG = re.compile(r"</?([A-Za-z][\w:]*)(?:\s[^<>]*)?$")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
_COMMAND = re.compile(r"\\(?:[A-Za-z]{2,}\*?|[&%$#_{}]|[~^\"'`=.](?=\S)|[A-Za-z](?=\{)|[\[\]()])")
_ACCENT = re.compile(r"\{?\\([`'^\"~=.uvHckrdb])\s*\{?(\\?[A-Za-z]|\\[ij])\}?\}?")
_MATH = re.compile(r"\$\$(.+?)\$\$|\$(?=\S)([^$\n]*[\\^_={}<>+][^$\n]*)(?<=\S)\$(?!\d)|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_TIE = re.compile(r"(?<=[^\s~/(])~(?=[^\s~/])")
_SETS = re.compile(r"\{\s*[\w.+-]{1,3}(?:\s*,\s*(?:[\w.+-]{1,4}|\.{3}|…))+\s*\}|\{\s*-?\d+(?:\.\d+)?\s*\}|\{\s*\}")
_GROUP = re.compile(r"\{[^{}]*[^\W\d_][^{}]*\}")
_HALF_GROUP = re.compile(r"(?:^|\s)\{{1,2}(?=[^\W_“\"'(])|(?<=\w)\}\}?(?=\s|$|[”.,;:)*])|\{\{|\}\}")
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_MD_HEADING = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t#]*$", re.M)
_MD_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|(.+)\|[ \t]*$", re.M)
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:<[^>\n]*>|[^()\s]+)(?:\s+\"[^\"]*\")?\)")
_STRONG = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*\\(])\1(?![\w*])")
_UNDER = re.compile(r"(?<![\w_\\/:.])(_{1,3})(?=[^\s_])([^_\n]*?[^\s_])\1(?![\w_])")
_CODE = re.compile(r"(?<!`)(`{1,2})(?=[^`\s])([^`\n]*?[^`\s])\1(?!`)")
_STRIKE = re.compile(r"(?<!~)~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)")
_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_QUOTES = re.compile(r"(?<!')('{2,5})(?=[^'\s])([^\n]*?[^'\s])\1(?!')")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]*)\]\]")
_WIKI_OUT = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\]\n]+))?\]")
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_ITEM = re.compile(r"^[ \t]*(?:[-+•]|\*{1,4}|\d{1,3}[.)])[ \t]+(?=\S)(.*)$", re.M)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z*]+)\}(\[[^\]]*\])?")
_ACCENTS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "k": "̨", "r": "̊", "d": "̣", "b": "̱"}
# Commands that stand for one sign.
SIGNS = {
    "textendash": "–", "textemdash": "—", "ldots": "…", "dots": "…", "textellipsis": "…", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠",
    "times": "×", "cdot": "·", "pm": "±", "approx": "≈", "sim": "∼", "infty": "∞", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å",
    "copyright": "©", "textregistered": "®", "textquoteright": "’", "textquoteleft": "‘", "quad": " ", "qquad": " ", "par": "\n\n", "newline": "\n",
    "permil": "‰", "degree": "°", "circ": "°", "to": "→", "rightarrow": "→", "in": "∈", "sum": "∑", "int": "∫", "partial": "∂", "nabla": "∇",
}
_DROPPED = {"cite", "ref", "label", "thanks", "footnote", "index", "citep", "citet", "eqref", "pageref", "bibliographystyle"}


@dataclass
class Node:
    """A part of a text: ``kind`` is container, paragraph, heading, item, code, formula or row; leaves hold text."""

    kind: str
    level: int = 0
    text: list[str] = field(default_factory=list)
    linked: int = 0
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    score: float = 0.0

    def add(self, kind: str, level: int = 0) -> Node:
        self.children.append(n := Node(kind, level, parent=self))
        return n

    @property
    def words(self) -> str:
        return re.sub(r"[ \t\r\f\v ]+", " ", "".join(self.text)).strip()


class _Tree(HTMLParser):
    """Builds the tree of an HTML or XML value; unclosed and crossed elements are closed where their parents end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("container")
        self.here, self.leaf = self.root, None
        self.open: list[tuple[str, Node, Node | None]] = []
        self.links = self.skip = 0

    def _leaf(self, kind: str = "paragraph", level: int = 0) -> Node:
        self.leaf = self.here.add(kind, level)
        return self.leaf

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            if tag == "br" and self.leaf is not None:
                self.leaf.text.append("\n")
            return
        self.open.append((tag, self.here, self.leaf))
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "a":
            self.links += 1
        elif tag in HEADINGS:
            self._leaf("heading", HEADINGS[tag])
        elif tag in ("li", "dt", "dd", "jats:list-item", "list-item"):
            self._leaf("item")
        elif tag == "pre":
            self._leaf("code")
        elif tag == "tr":
            self._leaf("row")
        elif tag in ("td", "th"):
            if self.leaf is None or self.leaf.kind != "row":
                self._leaf("row")
            elif self.leaf.text:
                self.leaf.text.append(" | ")
        elif tag in CONTAINERS:
            self.here, self.leaf = self.here.add("container"), None
        elif tag in PARAGRAPHS and not (self.leaf is not None and self.leaf.kind == "item" and not self.leaf.words):
            self._leaf()

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in ("br", "hr") and self.leaf is not None:
            self.leaf.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, here, leaf = self.open.pop()
            if t in SKIPPED:
                self.skip -= 1
            elif t == "a":
                self.links -= 1
            elif t in CONTAINERS:
                self.here, self.leaf = here, None
            elif t in HEADINGS or t in PARAGRAPHS:
                self.leaf = leaf if t in ("td", "th") or (leaf is not None and leaf.kind == "item") else None
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.leaf is None:
            if not data.strip():
                return
            self._leaf()
        self.leaf.text.append(data)
        if self.links:
            self.leaf.linked += len(data)


def _is_markup_tag(m: re.Match, text: str) -> bool:
    name = (m[2] or "").lower()
    if not name:
        return True
    if "://" in m[0] or "@" in m[0]:
        return False
    return name in KNOWN_TAGS or ":" in name or "=" in (m[3] or "") or f"</{name}>" in text.lower() or m[1] == "/" or m[4] == "/"


def _decode(text: str, kinds: set[str]) -> str:
    """Entities as the characters they name, twice where they were escaped twice."""
    for _ in range(3):
        known = any(m[1] is None or m[1] + ";" in html5 for m in _ENTITY.finditer(text))
        if not known:
            break
        kinds.add("entity")
        text = _ENTITY.sub(lambda m: unescape(m[0]), text)
    return text.replace("\xad", "") if "entity" in kinds else text


def _formula(tex: str) -> str:
    """A formula in plain characters as far as they exist; its order and brackets stay."""
    tex = re.sub(r"\\(?:mathrm|text|mathbf|mathit|operatorname)\{([^{}]*)\}", r"\1", tex)
    tex = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", tex)
    tex = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", tex)

    def command(m: re.Match) -> str:
        name = m[1]
        if name in SIGNS:
            return SIGNS[name]
        for size in ("SMALL", "CAPITAL"):
            if (size == "CAPITAL") == name[0].isupper():
                try:
                    return unicodedata.lookup(f"GREEK {size} LETTER {name.upper()}")
                except KeyError:
                    pass
        return name

    tex = re.sub(r"\\([A-Za-z]+)", command, tex)
    tex = re.sub(r"\\[,;:! ]", " ", tex).replace("\\", "")

    def raised(m: re.Match) -> str:
        up = m[1] == "^"
        inner = m[2] if m[2] is not None else m[3]
        if re.fullmatch(r"[\d+\-]+", inner):
            return inner.translate(str.maketrans("0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻" if up else "₀₁₂₃₄₅₆₇₈₉₊₋"))
        return f"{m[1]}{inner}" if len(inner) == 1 else f"{m[1]}({inner})"

    tex = re.sub(r"([\^_])(?:\{([^{}]*)\}|(\w))", raised, tex)
    return re.sub(r"\s+", " ", re.sub(r"[{}]", "", tex)).strip()


def _from_latex(text: str, kinds: set[str]) -> str:
    """LaTeX turned into the line forms the block parser reads; formulas, accents and signs into plain characters."""
    if _TIE.search(text):
        kinds.add("latex")
        text = _TIE.sub(" ", text)

    def math(m: re.Match) -> str:
        kinds.add("latex")
        inner = _formula(next(g for g in m.groups() if g is not None))
        return f"\n\n\0F{inner}\n\n" if m[1] is not None or m[3] is not None else inner

    text = _MATH.sub(math, text)
    if _COMMAND.search(text):
        kinds.add("latex")
        if "\\" in text:
            text = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m[2].lstrip("\\") + _ACCENTS[m[1]]) if m[1] in "`'^\"~=." or "{" in m[0] else m[0], text)
        text = re.sub(r"\\(?:section|chapter|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", r"\n\n# \1\n\n", text)
        text = re.sub(r"\\item\b(?:\[[^\]]*\])?\s*", "\n- ", text)
        text = _ENVIRONMENT.sub("\n", text)
        for _ in range(4):
            text, n = re.subn(r"\\([A-Za-z]+)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", lambda m: "" if m[1] in _DROPPED else m[2], text)
            if not n:
                break
        text = re.sub(r"\{\\[A-Za-z]+\s+([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\([A-Za-z]{2,})\*?\s?", lambda m: SIGNS.get(m[1], ""), text)
        text = re.sub(r"\\([&%$#_{}])", r"\1", text)
    return text


def _braces(text: str, kinds: set[str]) -> str:
    """Protecting braces and templates; sets of numbers keep theirs."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\0S{len(kept) - 1}\0"

    text = _SETS.sub(keep, text)
    if "{" in text or "}" in text:
        for _ in range(6):
            new = _TEMPLATE.sub(lambda m: (kinds.add("wiki"), m[1].rsplit("|", 1)[-1] if " " in m[1] else "")[1], text)
            new = _GROUP.sub(lambda m: (kinds.add("latex"), m[0][1:-1])[1], new)
            if new == text:
                break
            text = new
        if _HALF_GROUP.search(text):
            kinds.add("latex")
            text = re.sub(r"[{}]", "", text)
    return re.sub("\0S(\\d+)\0", lambda m: kept[int(m[1])], text)


def _inline(text: str, kinds: set[str]) -> str:
    """Emphasis, links and code inside a block as plain words."""
    for rule, kind, to in (
        (_MD_LINK, "markdown", r"\1"), (_WIKI_OUT, "wiki", None), (_WIKI_LINK, "wiki", None), (_CODE, "markdown", r"\2"),
        (_WIKI_QUOTES, "wiki", r"\2"), (_STRONG, "markdown", r"\2"), (_UNDER, "markdown", r"\2"), (_STRIKE, "markdown", r"\1"),
    ):
        if rule is _WIKI_OUT:
            new = rule.sub(lambda m: m[1] or "", text)
        elif rule is _WIKI_LINK:
            new = rule.sub(lambda m: "" if re.match(r"(?i)(category|file|image|kategorie|categor[ií]a|catégorie):", m[1]) else m[1].rsplit("|", 1)[-1], text)
        else:
            new = rule.sub(to, text)
        if new != text:
            kinds.add(kind)
            text = new
    return text


def _blocks_of_lines(text: str, into: Node, kinds: set[str]) -> None:
    """Blocks of a text in line forms: fences, headings, tables, items and paragraphs."""
    def heading(m: re.Match) -> str:
        kinds.add("markdown" if m[0].lstrip()[0] == "#" else "wiki")
        return f"\n\n\0H{min(len(m[1]), 6)}{m[2]}\n\n"

    code: list[str] = []

    def fence(m: re.Match) -> str:
        kinds.add("markdown")
        code.append(m[2].rstrip("\n"))
        return f"\n\n\0C{len(code) - 1}\n\n"

    text = _FENCE.sub(fence, text)
    text = _MD_HEADING.sub(heading, text)
    text = _WIKI_HEADING.sub(heading, text)
    if _MD_RULE.search(text):
        kinds.add("markdown")
        text = _MD_RULE.sub("", text)
        text = _MD_ROW.sub(lambda m: "\n\n\0R" + " | ".join(c.strip() for c in m[1].split("|")) + "\n\n", text)
    structured = bool(kinds)
    text = _ITEM.sub(lambda m: "\n\n\0I" + m[1] + "\n\n" if structured or m[0].lstrip()[0] in "-*+•" and m.start() > 0 else m[0], text)
    for part in re.split(r"\n\s*\n", text):
        part = part.strip("\n")
        if not part.strip():
            continue
        mark, body = (part[1], part[2:]) if part.startswith("\0") else ("", part)
        if mark == "C":
            n = into.add("code")
            n.text.append(code[int(body)])
            continue
        level = 0
        if mark == "H":
            level, body = int(body[0]), body[1:]
        kind = {"H": "heading", "I": "item", "R": "row", "F": "formula"}.get(mark, "paragraph")
        n = into.add(kind, level)
        n.text.append(body if kind == "formula" else _inline(body, kinds))


def parse(value: str) -> tuple[Node, set[str]]:
    """The tree of a value and the kinds of markup it holds (html, entity, markdown, wiki, latex); plain text has none."""
    kinds: set[str] = set()
    text = _decode(value, kinds)
    tags = [m for m in _TAG.finditer(text) if _is_markup_tag(m, text)]
    cut = _CUT_TAG.search(text)
    if tags or (cut and cut[1].lower() in KNOWN_TAGS):
        kinds.add("html")
        for m in reversed(tags):
            if (m[2] or "").lower() in MATH and not m[1]:
                end = text.lower().find(f"</{m[2].lower()}>", m.end())
                if end > 0:
                    inner = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", text[m.end() : end])).strip()
                    text = text[: m.start()] + inner + text[end:]
        tree = _Tree()
        tree.feed(re.sub(r"<(?![A-Za-z/!?])", "&lt;", _CUT_TAG.sub("", text) if cut else text))
        tree.close()
        root = tree.root
        stack = [root]
        while stack:
            n = stack.pop()
            stack += n.children
            if n.text and n.kind not in ("code",):
                n.text = [_inline(_braces(_from_latex("".join(n.text), kinds), kinds), kinds)]
        return root, kinds
    root = Node("container")
    if "```" in text or "~~~" in text:
        held: list[str] = []
        body = _FENCE.sub(lambda m: (held.append(m[0]), f"\0Z{len(held) - 1}\0\n")[1], text)
        body = _braces(_from_latex(body, kinds), kinds)
        text = re.sub("\0Z(\\d+)\0", lambda m: held[int(m[1])], body)
    else:
        text = _braces(_from_latex(text, kinds), kinds)
    _blocks_of_lines(text, root, kinds)
    return root, kinds


def _score(root: Node) -> list[Node]:
    """The leaves to keep: those of the best container and of its siblings that score near it."""
    containers: list[Node] = []
    leaves: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n.children or n.kind == "container":
            containers.append(n)
            stack += reversed(n.children)
        else:
            leaves.append(n)
    for leaf in leaves:
        words = leaf.words
        points = 1 + words.count(",") + words.count("，") + words.count("、") + min(len(words) / 100, 3)
        points *= 1 - leaf.linked / max(len("".join(leaf.text)), 1)
        up, share = leaf.parent, 1.0
        while up is not None:
            up.score += points * share
            up, share = up.parent, share / 2
    best = max(containers, key=lambda c: c.score)
    near = max(2.0, best.score * 0.2)
    kept = {id(best)}
    # from the best container up, its siblings: those that score near it, and those that aren't mostly links; in a field of a
    # record a short section is content like a long one
    here = best
    while here.parent is not None:
        for sibling in here.parent.children:
            if sibling is not here and (sibling.score >= near or not _mostly_links(sibling)):
                kept.add(id(sibling))
        here = here.parent

    def inside(n: Node) -> bool:
        while n is not None:
            if id(n) in kept:
                return True
            n = n.parent
        return False

    return [x for x in leaves if inside(x)]


def _mostly_links(node: Node) -> bool:
    """Whether half of the characters below a node or more stand in links."""
    linked = total = 0
    stack = [node]
    while stack:
        n = stack.pop()
        stack += n.children
        linked += n.linked
        total += len("".join(n.text))
    return linked * 2 >= total > 0


def clean(value: str | None) -> tuple[list[dict], str | None, list[str]]:
    """(blocks, text, kinds): the structure kept, the plain text and the markup that was there.

    Null gives no blocks and null text, empty gives no blocks and empty text.
    """
    if not value:
        return [], value, []
    root, kinds = parse(value)
    if not kinds:
        return [{"kind": "paragraph", "level": 0, "text": value}], value, []
    blocks, lines = [], []
    for leaf in _score(root):
        text = "".join(leaf.text).strip("\n") if leaf.kind == "code" else "\n".join(x.strip() for x in leaf.words.split("\n") if x.strip())
        if text:
            blocks.append({"kind": leaf.kind, "level": leaf.level, "text": text})
            lines.append(("- " if leaf.kind == "item" else "") + text)
    return blocks, "\n".join(lines), sorted(kinds)


_BLOCK = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())])
_OUT = "item_key string, field string, value string, blocks array<struct<kind: string, level: int, text: string>>, text string, kinds array<string>"


def clean_fields(items: DataFrame) -> DataFrame:
    """item_key, field, value, blocks, text, kinds for the title and the abstract_note of every distinct item key and value.

    Repeated deliveries of an item stand once; null values have no row; a null item_key is kept. Values without any suspect
    character are settled without Python. Whole texts are parsed, however long.
    """
    both = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("title", "abstract_note")))
    long = items.select("item_key", F.explode(both).alias("v")).select("item_key", "v.field", "v.value").filter("value is not null")
    # Deliveries are told apart by a digest, so that long texts aren't sorted or compared.
    long = long.groupBy("item_key", "field", F.xxhash64("value").alias("h"), F.length("value").alias("n")).agg(F.min("value").alias("value")).drop("h", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                done = [clean(v) for v in b.column(2).to_pylist()]
                cols = [pa.array([x[0] for x in done], pa.list_(_BLOCK)), pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], ["item_key", "field", "value", "blocks", "text", "kinds"])

    suspect = long.filter(F.col("value").rlike(SUSPECT)).mapInArrow(run, _OUT)
    one = F.array(F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.col("value").alias("text")))
    rest = long.filter(~F.col("value").rlike(SUSPECT)).select(
        "item_key", "field", "value", one.alias("blocks"), F.col("value").alias("text"), F.array().cast("array<string>").alias("kinds"))
    return suspect.unionByName(rest)


def marked_up(items: DataFrame) -> DataFrame:
    """p5_found: item_key, field of the values that hold markup, one row each: those whose kept text, as the tree gives it, isn't the value."""
    return clean_fields(items).filter((F.size("kinds") > 0) & ~F.col("text").eqNullSafe(F.col("value"))).select("item_key", "field").distinct()

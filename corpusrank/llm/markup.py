"""Clean text out of HTML, Markdown, wiki and LaTeX markup, mixed at will, without the boilerplate around it.

A text is read once into blocks (headings, paragraphs, lists, tables, code, formulas); which markups occurred falls out of that. The
blocks are then labelled content or boilerplate by a minimum cut: a logistic classifier's costs are the terminal capacities,
edges between neighbouring blocks and between near siblings of the document tree make the labelling smooth, and a maximum
flow separates the two.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.arrays import batches
from corpusrank.shared import spread

MARKUPS = ("html", "markdown", "wiki", "latex")
#: Labelled records the classifier is fitted on, at most. A larger sample does not change ten weights noticeably.
FIT_RECORDS = 2_000

# HTML elements, and the wiki extensions written like them.
_ELEMENTS = """a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col
colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame frameset gallery h1 h2 h3 h4 h5
h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav noscript nowiki object ol
optgroup option output p param picture poem pre progress q ref references rp rt ruby s samp script section select small source span strike strong style sub
summary sup svg syntaxhighlight table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"""
_TAG = re.compile(r"<(/?)(" + "|".join(sorted(_ELEMENTS.split(), key=len, reverse=True)) + r")((?:\s+[^<>]*)?)/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>", re.S | re.I)
_REFERENCE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_CODE = re.compile(
    r"(?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<inside>.*?)(?:^[ ]{0,3}(?P=mark)[`~]*[ \t]*\r?$|\Z))"
    r"|(?P<element><(?P<name>pre|syntaxhighlight)\b(?P<attributes>[^<>]*)>(?P<body>.*?)(?:</(?P=name)\s*>|\Z))"
    r"|(?P<verbatim>\\begin\{(?P<env>verbatim\*?|lstlisting)\}(?:\[[^\]\n]*\])?(?P<listing>.*?)(?:\\end\{(?P=env)\}|\Z))",
    re.S | re.M | re.I,
)
_TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)(?<!`)\1(?!`)")
_FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n(.*?\r?\n)??---[ \t]*(?:\r?\n|\Z)", re.S)
_MATH = re.compile(
    r"\\begin\{(?P<env>equation|align|gather|multline|displaymath|eqnarray|math)(?P<star>\*?)\}(?P<b>.*?)\\end\{(?P=env)(?P=star)\}"
    r"|(?<!\\)\$\$(?P<d>[^$]+?)\$\$|\\\[(?P<s>.+?)\\\]|\\\((?P<p>.+?)\\\)"
    r"|(?<![\\$\w])\$(?=\S)(?P<i>[^$\n]+?)(?<=[^\s\\])\$(?![\d$\w])",
    re.S,
)
_MATH_ELEMENT = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", re.S | re.I)
_COMMAND = re.compile(r"(?<![\w:.\\/])\\[A-Za-z]+\*?")
_LATEX_WORDS = re.compile(r"(?<![\\A-Za-z0-9:.])\\[A-Za-z]+|[A-Za-z0-9})]\\(?:frac|sqrt|sum|prod|alpha|beta|ln|leq?|geq?|cdot|times)\b")
_MD = {
    "heading": re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M),
    "underlined": re.compile(r"(?:\A|(?<=\n\n)|(?<=\r\n\r\n)|(?<=\n))^[ ]{0,3}(?![-=#>|*+]|\d+[.)])(\S[^\n]*?)[ \t]*\r?\n[ ]{0,3}(={3,}|-{3,})[ \t]*\r?$", re.M),
    "strong": re.compile(r"(?<![*\w])\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*(?![*\w])|(?<![_\w])__(?=\S)([^_\n]+?)(?<=\S)__(?![_\w])"),
    "link": re.compile(r"(!?)(?<!\[)\[([^\[\]\n]*)\]\((?:<[^<>\n]*>|[^()\s]+)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)"),
    "table": re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?$", re.M),
}
_UNDER = re.compile(r"\n {0,3}(?:---|===)")
#: Cheap signs without which a pattern cannot match.
_HINTS = {
    "heading": lambda s: "#" in s,
    "underlined": lambda s: _UNDER.search(s),
    "strong": lambda s: "**" in s or "__" in s,
    "link": lambda s: "](" in s,
    "table": lambda s: "|" in s and "--" in s,
}
_WIKI = {
    "heading": re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*\r?$", re.M),
    "marks": re.compile(r"'''"),
    "template": re.compile(r"\{\{[^{}]*\}\}", re.S),
    "link": re.compile(r"\[\[([^\[\]\n]+)\]\]"),
    "table": re.compile(r"^[ \t:]*\{\|", re.M),
}
#: What a text must hold for a pattern to match.
_WIKI_SIGNS = {"heading": "=", "marks": "'''", "template": "{{", "link": "[[", "table": "{|"}
_SECTIONS = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_WRAP = re.compile(r"\\(?:emph|textbf|textit|texttt|textsc|textrm|underline|mbox|title|author|caption|text)\{|\\[{}]|[{}]")
_BRACES = re.compile(r"\{\{|\}\}")
_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?!')([^'\n](?:[^\n]*?[^'\n])?)(?<!')\1(?!')")
_GONE = re.compile(r"~?\\(?:cite[pt]?|ref|label|eqref|pageref|documentclass|usepackage|bibliography|bibliographystyle|maketitle|date|input|include|pagestyle|thispagestyle|begin|end)\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*")
_ROW = re.compile(r"[ \t]*\\\\[ \t]*(?:\\hline)?[ \t]*$", re.M)
#: Private-use characters: around the number of held text, and in the place of removed text, so that places in a text stay the same.
_OPEN, _SHUT, _GAP = "\ue000", "\ue001", "\ue002"
_HELD = re.compile(_OPEN + r"(\d+)" + _SHUT)
_BLOCK_TAGS = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p section summary table tbody td tfoot th thead title tr ul".split())
_BOILER_TAGS = ("footer", "nav", "aside", "header")
_CONTENT_TAGS = ("p", "article", "section", "div", "main", "li", "td")


@dataclass(frozen=True)
class Place:
    """Where in the document tree: the element around (``serial`` is its number), the path above it, and what that path tells."""

    tag: str = ""
    serial: int = 0
    path: int = 0  # of this element, by names
    above: int = 0  # of the one around it
    lists: int = 0
    ordered: bool = False
    boiler: bool = False
    content: bool = False
    head: bool = False

    def inside(self, tag: str, serial: int) -> Place:
        is_list = tag in ("ul", "ol")
        return Place(tag, serial, hash((self.path, tag)), self.path, self.lists + is_list, tag == "ol" if is_list else self.ordered, self.boiler or tag in _BOILER_TAGS, self.content or tag in _CONTENT_TAGS, self.head or tag in ("head", "title"))


@dataclass
class Block:
    """A piece of a record: its text, kind, place in the document tree, and the markups it was written in.

    Blocks of kind 'residue' have no text of their own: markup that left none, such as front matter, comments or empty elements.
    """

    text: str
    kind: str
    place: Place = Place()
    links: int = 0
    markups: set[str] = field(default_factory=set)


class _Keeper:
    """Text that later steps must not touch, behind private-use marks."""

    def __init__(self) -> None:
        self.kept: list[tuple[str, str, set[str]]] = []

    def hold(self, kind: str, text: str, *markups: str) -> str:
        inner = (self.marks(int(m[1])) for m in _HELD.finditer(text)) if _OPEN in text else ()
        self.kept.append((kind, text, set(markups).union(*inner)))
        return f"{_OPEN}{len(self.kept) - 1}{_SHUT}"

    def marks(self, number: int) -> set[str]:
        """The markups of held text, and of what it holds itself."""
        return self.kept[number][2] if number < len(self.kept) else set()

    def back(self, text: str) -> str:
        while _OPEN in text:
            changed = _HELD.sub(lambda m: self.kept[int(m[1])][1] if int(m[1]) < len(self.kept) else "", text)
            if changed == text:
                break
            text = changed
        return text


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _without_templates(text: str) -> str:
    """``text`` without the outermost {{...}}, however deeply they nest; an opening that is never closed stays."""
    cuts: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in _BRACES.finditer(text):
        if m[0] == "{{":
            opened.append(m.start())
        elif opened:
            start = opened.pop()
            while cuts and cuts[-1][0] > start:
                cuts.pop()
            cuts.append((start, m.end()))
    return _without(text, cuts)


def _unwrapped(text: str) -> str:
    r"""``text`` without commands such as \emph{...} around what they hold, however deeply they nest."""
    gone: list[tuple[int, int]] = []
    opened: list[re.Match] = []
    for m in _WRAP.finditer(text):
        if m[0] == "}":
            if opened and len((start := opened.pop())[0]) > 1:
                gone += [start.span(), m.span()]
        elif m[0] not in ("\\{", "\\}"):
            opened.append(m)
    return _without(text, sorted(gone))


def parse(text: str | None) -> list[Block]:
    """The blocks of a text, each with the markups found where it stands. A null or blank text has none."""
    if not text or not text.strip():
        return []
    keep = _Keeper()
    text = re.sub(f"[{_OPEN}{_SHUT}{_GAP}]", "", text)

    def code(m: re.Match) -> str:
        if m["fence"] is not None:
            return "\n\n" + keep.hold("code", f"```{m['info'].strip()}\n{m['inside'].rstrip()}\n```", "markdown") + "\n\n"
        if m["element"] is not None:
            body = re.sub(r"\A\s*<code\b[^<>]*>|</code\s*>\s*\Z", "", m["body"], flags=re.I)
            body = html.unescape(body) if m["name"].lower() == "pre" else body
            lang = re.search(r"lang\s*=\s*[\"']?([\w+-]+)", m["attributes"])
            return "\n\n" + keep.hold("code", f"```{lang[1] if lang else ''}\n{body.strip(chr(10)).rstrip()}\n```", "html") + "\n\n"
        return "\n\n" + keep.hold("code", f"```\n{m['listing'].strip(chr(10)).rstrip()}\n```", "latex") + "\n\n"

    if "`" in text or "~~~" in text or "<" in text or "\\begin" in text:
        text = _CODE.sub(code, text)
    out: list[Block] = []
    if m := _FRONT.match(text):
        out.append(Block("", "residue", markups={"markdown"}))
        text = text[m.end() :]
    if "`" in text:
        text = _TICKS.sub(lambda m: keep.hold("inline", m[2], "markdown"), text)
    if "<" in text:
        def element(m: re.Match) -> str:
            inside = m[1].strip()
            return keep.hold("formula", f"${inside}$", "html", *["latex"] * bool(_COMMAND.search(inside) or _MATH.search(inside)))

        text = _MATH_ELEMENT.sub(element, text)
    if "$" in text or "\\" in text:
        def formula(m: re.Match) -> str:
            if m["p"] is not None or m["i"] is not None:
                return keep.hold("formula", f"${(m['p'] or m['i']).strip()}$", "latex")
            inside = next(x for x in (m["b"], m["d"], m["s"]) if x is not None).strip()
            return "\n\n" + keep.hold("formula", f"$$\n{inside}\n$$", "latex") + "\n\n"

        text = _MATH.sub(formula, text)
    _blocks(text, keep, out)
    return out


def _signs(text: str) -> Iterator[tuple[str, list[re.Pattern]]]:
    """The patterns that may match, by markup."""
    if "\\" in text and _COMMAND.search(text):
        yield "latex", [_LATEX_WORDS]
    yield "html", ([_TAG, _COMMENT] if "<" in text else []) + ([_REFERENCE] if "&" in text else [])
    yield "markdown", [_MD[name] for name, hint in _HINTS.items() if hint(text)]
    yield "wiki", [p for name, p in _WIKI.items() if _WIKI_SIGNS[name] in text]


def _marks(text: str, keep: _Keeper) -> list[tuple[int, str]]:
    """Where in a text which markup occurs, in order. Held text counts where it stood."""
    found = [(m.start(), mark) for m in _HELD.finditer(text) for mark in keep.marks(int(m[1]))] if _OPEN in text else []
    for markup, patterns in _signs(text):
        found += [(m.start(), markup) for p in patterns for m in p.finditer(text)]
    return sorted(found)


def _blank(m: re.Match) -> str:
    return _GAP * (m.end() - m.start())


def _blocks(text: str, keep: _Keeper, out: list[Block]) -> None:
    marks = _marks(text, keep)
    wiki = any(mark == "wiki" for _, mark in marks)
    if "<" in text:
        text = _COMMENT.sub(_blank, text)
        text = re.sub(r"<(script|style|noscript)\b.*?</\1\s*>", _blank, text, flags=re.S | re.I)
        text = re.sub(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>.*?</ref\s*>", _blank, text, flags=re.S | re.I)
    stack, names = [Place()], Counter()
    serial, at = 0, 0
    raw: list[tuple[str, Place, int, int]] = []  # text, place, link characters, where it ends
    piece: list[str] = []
    links = opened = length = 0

    def close(end: int) -> None:
        nonlocal links, length
        if piece:
            raw.append(("".join(piece), stack[-1], links, end))
            piece.clear()
        links = length = 0

    def pop() -> None:
        names[stack.pop().tag] -= 1

    def write(part: str) -> None:
        nonlocal length
        piece.append(part)
        length += len(part)

    for m in _TAG.finditer(text):
        write(text[at : m.start()])
        at, name, end = m.end(), m[2].lower(), m[1] == "/"
        if name == "br":
            write("\n")
        elif name == "a":
            if end:
                links += max(0, length - opened)
            opened = length
        elif name in ("td", "th"):
            write("" if end else " | ")
        elif name in _BLOCK_TAGS:
            close(m.start())
            if name in ("li", "dd", "dt") and not end:
                write("  " * max(0, stack[-1].lists - 1) + ("1. " if stack[-1].ordered else "- "))
            if end:
                while names[name] and stack[-1].tag != name:
                    pop()
                if names[name]:
                    pop()
            elif name != "hr":
                if name in ("p", "li") and stack[-1].tag == name:
                    pop()
                serial += 1
                names[name] += 1
                stack.append(stack[-1].inside(name, serial))
                if name[0] == "h" and name[1:].isdigit():
                    write("#" * int(name[1]) + " ")
    write(text[at:])
    close(len(text) + 1)
    empty, nth = len(out), 0
    for chunk, place, linked, end in raw:
        first = len(out)
        if not place.head:
            _split(chunk.replace(_GAP, ""), place, linked, wiki, keep, out)
        here = set()
        while nth < len(marks) and marks[nth][0] < end:
            here.add(marks[nth][1])
            nth += 1
        if here:
            if len(out) == first:
                out.append(Block("", "residue", place))
            out[first].markups |= here
    if all(b.kind == "residue" for b in out[empty:]):  # nothing but a head: its title is the text
        for chunk, place, linked, _ in raw:
            if place.head:
                _split(chunk.replace(_GAP, ""), place, linked, wiki, keep, out)


def _split(chunk: str, place: Place, linked: int, wiki: bool, keep: _Keeper, out: list[Block]) -> None:
    if "&" in chunk:
        chunk = html.unescape(chunk)
    chunk = chunk.replace("\r\n", "\n").replace("\xa0", " ")
    if "=" in chunk and _WIKI["heading"].search(chunk):
        chunk = _WIKI["heading"].sub(lambda m: f"\n\n{'#' * len(m[1])} {m[2]}\n\n", chunk)
    if "{|" in chunk:
        chunk = re.sub(r"^[ \t:]*\{\|[^\n]*\n(.*?)(?:^\s*\|\}|\Z)", lambda m: "\n\n" + _wiki_rows(m[1]) + "\n\n", chunk, flags=re.S | re.M)
    if "{{" in chunk:
        chunk = _without_templates(chunk)
    if "[[" in chunk:
        chunk = _WIKI["link"].sub(lambda m: "" if re.match(r"\s*(?:file|image|category|datei|fichier|archivo)\s*:", m[1], re.I) else m[1].split("|")[-1].split("#")[0] or m[1].strip("#"), chunk)
    if wiki and "''" in chunk:  # quotes in prose stay as they are
        chunk = _QUOTES.sub(r"\2", _QUOTES.sub(r"\2", chunk))
    if "\\" in chunk:
        chunk = _SECTIONS.sub(lambda m: f"\n\n{'#' * _LEVELS[m[1]]} {m[2]}\n\n", chunk)
        if "\\begin{tabular" in chunk:
            chunk = re.sub(r"\\begin\{tabular[x*]?\}(?:\{[^{}\n]*\})*(.*?)\\end\{tabular[x*]?\}", lambda m: "\n\n" + _ROW.sub("", m[1].replace("\\hline", "")).replace("&", "|") + "\n\n", chunk, flags=re.S)
        chunk = re.sub(r"^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", "- ", chunk, flags=re.M)
        chunk = _unwrapped(chunk)
        chunk = _GONE.sub("", chunk)
        chunk = _COMMAND.sub("", chunk)
        chunk = re.sub(r"\\([%&_#${}])", r"\1", chunk)
    if _HINTS["link"](chunk):
        linked += sum(len(m[2]) for m in _MD["link"].finditer(chunk))
        chunk = _MD["link"].sub(r"\2", chunk)
    if _HINTS["underlined"](chunk):
        chunk = _MD["underlined"].sub(lambda m: f"\n\n{'#' if m[2][0] == '=' else '##'} {m[1]}\n\n", chunk)
    if _HINTS["strong"](chunk):
        chunk = _MD["strong"].sub(lambda m: m[1] or m[2], chunk)
    if _HINTS["table"](chunk):
        chunk = _MD["table"].sub("", chunk)
    parts = [p.strip("\n") for p in re.split(r"\n[ \t]*\n+", chunk) if p.strip()]
    for part in parts:
        lines = []
        for line in part.split("\n"):
            if line.startswith("#") and _MD["heading"].match(line) and lines:
                _add("\n".join(lines), place, 0, keep, out)
                lines = []
            if lines and lines[0].startswith("#") and _MD["heading"].match(lines[0]):
                _add(lines[0], place, 0, keep, out)
                lines = lines[1:]
            lines.append(line)
        _add("\n".join(lines), place, linked if len(parts) == 1 else min(linked, len(part)) if linked > len(chunk) // 2 else 0, keep, out)


def _wiki_rows(table: str) -> str:
    rows = []
    for row in re.split(r"^\s*\|-[^\n]*$", table, flags=re.M):
        cells = [c.strip() for line in row.split("\n") if line.strip() for c in re.split(r"\|\||!!", line.strip().lstrip("|!+"))]
        if cells:
            rows.append("| " + " | ".join(cells) + " |")
    return "\n".join(rows)


def _add(text: str, place: Place, linked: int, keep: _Keeper, out: list[Block]) -> None:
    held = _HELD.fullmatch(text.strip())
    if held and keep.kept[int(held[1])][0] in ("code", "formula"):
        kind, text, _ = keep.kept[int(held[1])]
    else:
        bare = text.lstrip()
        kind = "heading" if bare.startswith("#") and _MD["heading"].match(bare) else "list" if re.match(r"[-*+•] |\d+[.)] ", bare) else "table" if bare.startswith("|") and "|" in bare[1:] else "text"
        text = keep.back(text)
        if kind != "list":
            text = text.strip()
        text = re.sub(r"(?<=\S)[ \t]+\n", "\n", text).rstrip() if "\n" in text else text.rstrip()
    text = keep.back(text)
    if not text.strip(" |\n#-"):
        return
    last = next((b for b in reversed(out) if b.kind != "residue"), None) if kind == "list" else None
    if last and last.kind == "list" and last.place.above == place.above:
        last.text, last.links = last.text + "\n" + text, last.links + linked
    else:
        out.append(Block(text, kind, place, linked))


# --- content or boilerplate ---------------------------------------------------------------------------------------------

_SENTENCE_END = re.compile(r"[.!?:;。](?:\s|$)")


def features(block: Block, place: float) -> list[float]:
    """What the classifier sees of a block: nothing of its tags, which supply the labels."""
    words = block.text.split()
    n = len(words)
    return [
        1.0,
        min(1.0, n / 40),
        math.log1p(n) / 6,
        min(1.0, block.links / max(1, len(block.text))),
        min(3, len(_SENTENCE_END.findall(block.text))) / 3,
        float(block.kind == "text"),
        float(block.kind in ("code", "formula", "heading", "table")),
        float(place < 0.05),
        float(place > 0.95),
        sum([w[0].isupper() for w in words]) / max(1, n),
    ]


#: Log-odds of content, for collections without labelled blocks to fit on.
PRIOR_WEIGHTS = (0.5, 2.0, 2.0, -4.0, 2.0, 0.0, 3.0, 0.0, -0.5, -0.5)


def labels_of(block: Block) -> int | None:
    """1: content, 0: boilerplate, by the tags a block stands in; None without any that tells."""
    return 0 if block.place.boiler else 1 if block.place.content else None


def fit(records: DataFrame, text: str, most: int = FIT_RECORDS) -> tuple[float, ...]:
    """Weights of the classifier, by ridge logistic regression on the labelled blocks of at most ``most`` records that have boilerplate
    elements (the first by a hash of their text, so the same in every run). ``PRIOR_WEIGHTS`` where there is none."""
    some = records.select(F.col(text).cast("string").alias("text")).where(F.lower("text").rlike("<(footer|nav|aside|header)[ >]"))
    first = some.orderBy(F.xxhash64("text"), "text").limit(most).repartition(some.sparkSession.sparkContext.defaultParallelism)
    rows = first.mapInArrow(_labelled, "x array<double>, y int").orderBy("x", "y").collect()  # of ``most`` records
    if len({r["y"] for r in rows}) < 2:
        return PRIOR_WEIGHTS
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    prior = np.array(PRIOR_WEIGHTS)
    w = prior.copy()
    for _ in range(30):  # Newton steps, drawn to the prior
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + (w - prior)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _labelled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        xs, ys = [], []
        for s in batch.column("text").to_pylist():
            blocks = [b for b in parse(s) if b.kind != "residue"]
            for i, b in enumerate(blocks):
                y = labels_of(b)
                if y is not None:
                    xs.append(features(b, i / max(1, len(blocks) - 1)))
                    ys.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["x", "y"])


def max_flow(capacity: list[dict[int, int]], source: int, sink: int) -> list[bool]:
    """Dinic's maximum flow over ``capacity[u][v]``, which it uses up; the nodes on the source's side of a minimum cut."""
    n = len(capacity)
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in capacity[u].items():
                if c > 0 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [x >= 0 for x in level]
        ways = [list(x) for x in capacity]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(capacity[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = 0
                for i, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    capacity[a][b] -= flow
                    capacity[b][a] = capacity[b].get(a, 0) + flow
                    if capacity[a][b] == 0 and not cut:
                        cut = i + 1
                del path[cut:]
                continue
            while ways[u] and not (capacity[u].get(ways[u][-1], 0) > 0 and level[ways[u][-1]] == level[u] + 1):
                ways[u].pop()
            if ways[u]:
                path.append(ways[u][-1])
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def content_blocks(blocks: list[Block], weights: tuple[float, ...], next_to: float = 0.6, siblings: float = 0.4, reach: int = 3) -> list[bool]:
    """Which blocks are content, by minimum cut. Blocks within boilerplate elements get that as evidence of three nats; residue is none."""
    whole = [i for i, b in enumerate(blocks) if b.kind != "residue"]
    if len(whole) < len(blocks):
        kept = dict(zip(whole, content_blocks([blocks[i] for i in whole], weights, next_to, siblings, reach), strict=True))
        return [kept.get(i, False) for i in range(len(blocks))]
    n = len(blocks)
    if not n:
        return []
    odds = []
    for i, b in enumerate(blocks):
        z = sum(w * x for w, x in zip(weights, features(b, i / max(1, n - 1)), strict=True))
        odds.append(max(-20.0, min(20.0, z - 3.0 * (labels_of(b) == 0))))
    if all(z >= 0 for z in odds):
        return [True] * n
    if all(z < 0 for z in odds):
        return [False] * n
    unit = 1_000
    capacity: list[dict[int, int]] = [{} for _ in range(n + 2)]
    for i, z in enumerate(odds):
        capacity[n][i] = int(unit * math.log1p(math.exp(z)))  # paid if labelled boilerplate
        capacity[i][n + 1] = int(unit * math.log1p(math.exp(-z)))  # paid if labelled content
        for j in range(i + 1, min(n, i + 1 + reach)):
            near = next_to * (j == i + 1) + siblings / (j - i) * (blocks[i].place.serial == blocks[j].place.serial or blocks[i].place.above == blocks[j].place.above != 0)
            if blocks[i].place.boiler != blocks[j].place.boiler:
                near *= 0.25
            if near:
                capacity[i][j] = capacity[j][i] = int(unit * near)
    return max_flow(capacity, n, n + 1)[:n]


def clean(text: str | None, weights: tuple[float, ...] = PRIOR_WEIGHTS) -> tuple[str, list[str], list[str], int, int]:
    """(clean text, markups of the content, markups of boilerplate and residue, blocks, blocks dropped as boilerplate)."""
    blocks = parse(text)
    kept = content_blocks(blocks, weights)
    marks: tuple[set[str], set[str]] = (set(), set())
    for b, k in zip(blocks, kept, strict=True):
        marks[not k].update(b.markups)
    n = sum(b.kind != "residue" for b in blocks)
    content, other = ([m for m in MARKUPS if m in x] for x in marks)
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k), content, other, n, n - sum(kept)


def clean_markup(records: DataFrame, key: str, text: str, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(key, clean, content_markups, other_markups, n_blocks, n_dropped), one row a record. Markups are those of the labelled blocks: of what is
    kept, and of what was dropped as boilerplate or left no text.

    ``clean`` keeps headings as '#' lines, list items as '- ' or '1. ' lines, table rows with '|', code in ``` fences and formulas
    in $ or $$; it has no boilerplate. A text without markup comes out as it is, but for its line ends and runs of blank lines. Null, empty and
    blank texts give ''. Rows that repeat a key stay as they are; an empty table gives no rows; other columns are ignored.
    ``weights`` default to those fitted on the records.
    """
    weights = weights or fit(records, text)
    kind = records.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            rows = [clean(s, weights) for s in batch.column("text").to_pylist()]
            texts, marks, others, n, dropped = zip(*rows, strict=True)
            arrays = [pa.array(texts, pa.string()), pa.array(marks, pa.list_(pa.string())), pa.array(others, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], ["key", "clean", "content_markups", "other_markups", "n_blocks", "n_dropped"])

    return spread(records.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))).mapInArrow(run, f"key {kind}, clean string, content_markups array<string>, other_markups array<string>, n_blocks long, n_dropped long")

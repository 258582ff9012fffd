"""Text functions as Columns: query and index tokens, titles, links, paths, snippets. All stay in Catalyst."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query's tokens leave out.
STOP_WORDS = (
    "的 是 了 什么 在 有 和 与 对 从 the is a an what how are was were do does did be been being have has had "
    "it its in on at to for of with by this that these those"
).split()
# Fixed value: what separates the tokens of a query, as the inside of a character class.
SEPARATORS = r"\s!-/:-@\[-`{-~，。！？、；：“”‘’（）·～…"
# Fixed value: characters that make a query go the substring way.
CJK = r"[㐀-鿿]"
MAX_QUERY_TOKENS = 64
# Unicode's white space, as (?U)\s has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FRONT_MATTER = r"\A---[ \t]*\r?\n(?s:(.*?))\r?\n---[ \t]*(?:\r?\n|\z)"


@cache
def _accents() -> tuple[str, str]:
    """Lower-case Latin, Greek and Cyrillic letters that decompose into one base letter and marks, and those bases."""
    pairs = []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch and ch == ch.lower():
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(x: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(x), *_accents()), r"\p{Mn}+", "")


def index_terms(x: Column) -> Column:
    """The terms of a text: runs of letters and numbers, folded. Null gives none."""
    return F.filter(F.split(folded(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def query_tokens(x: Column, most: int = MAX_QUERY_TOKENS) -> Column:
    """Distinct tokens of a query in alphabetical order; of more than ``most`` (0: no bound) the first in the query.

    A token of more than two characters with CJK ones also gives its pairs of characters and its characters.
    """
    parts = F.split(F.lower(F.coalesce(x, F.lit(""))), f"(?U)[{SEPARATORS}]+")
    kept = F.filter(parts, lambda t: ((F.length(t) > 1) | t.rlike(r"^\p{Nd}$")) & ~t.isin(*STOP_WORDS))

    def widened(t: Column) -> Column:
        letters = F.filter(F.split(t, ""), lambda c: c != "")
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike(CJK) & (F.length(t) > 2), F.concat(pairs, F.filter(letters, lambda c: ~c.isin(*STOP_WORDS)), F.array(t))).otherwise(F.array(t))

    distinct = F.array_distinct(F.flatten(F.transform(kept, widened)))
    return F.array_sort(F.slice(distinct, 1, most) if most else distinct)


def query_phrase(x: Column) -> Column:
    """The lower-cased query without separators at its ends; blank for a query of separators alone."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), f"(?U)^[{SEPARATORS}]+|[{SEPARATORS}]+$", "")


def contains_cjk(x: Column) -> Column:
    return F.coalesce(x.rlike(CJK), F.lit(False))


# --- paths ---------------------------------------------------------------------------------------------------------------


def normal_path(x: Column) -> Column:
    return F.translate(x, "\\", "/")


def file_name(x: Column) -> Column:
    return F.element_at(F.split(normal_path(x), "/"), -1)


def file_stem(x: Column) -> Column:
    """The file name without '.md', else without its last extension."""
    name = file_name(x)
    return F.when(F.lower(name).endswith(".md"), F.regexp_replace(name, r"(?i)\.md$", "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def alias(x: Column) -> Column:
    """A link target in the form in which targets are compared."""
    plain = normal_path(F.trim(F.element_at(F.split(x, "#"), 1)))
    return F.lower(F.translate(F.regexp_replace(plain, r"(?i)\.md$", ""), " ", "-"))


def safe_page_path(x: Column) -> Column:
    """Whether a page may be written there: below wiki/, with portable names only and no way out."""
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"
    plain = F.coalesce(normal_path(x), F.lit(""))
    bad_part = F.exists(F.split(plain, "/"), lambda s: (s == "") | (s == "..") | s.rlike(r'[<>:"|?*]|[ .]$|^\.') | s.rlike(reserved))
    return F.coalesce((F.trim(plain) != "") & plain.startswith("wiki/") & ~x.rlike(r"[\x00-\x1f\x7f]|^[A-Za-z]:|^[/\\]") & ~bad_part, F.lit(False))


def slug(x: Column) -> Column:
    """Letters and digits in lower case, blanks and common punctuation as single hyphens, the rest dropped."""
    hyphens = F.regexp_replace(F.trim(x), r"[\-_ \t/\\.,:;!?'\"()\[\]{}]", "-")
    kept = F.lower(F.regexp_replace(hyphens, r"[^\p{L}\p{N}\-]", ""))
    out = F.regexp_replace(F.regexp_replace(kept, "-{2,}", "-"), "^-|-$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "untitled").otherwise(out)


def source_identity(x: Column) -> Column:
    """The path below raw/sources/, else the file name."""
    below = F.regexp_extract(normal_path(x), r"(?:^|/)raw/sources/(.+)$", 1)
    return F.when(below != "", below).otherwise(file_name(x))


def summary_slug(identity: Column) -> Column:
    return slug(F.translate(F.regexp_replace(normal_path(identity), r"\.[^./]*$", ""), "/", "-"))


# --- pages ---------------------------------------------------------------------------------------------------------------


def without_front_matter(x: Column) -> Column:
    return F.regexp_replace(x, FRONT_MATTER, "")


def front_matter(x: Column) -> Column:
    """The lines between the fences at the start; empty without them."""
    return F.regexp_extract(x, FRONT_MATTER, 1)


def front_matter_value(x: Column, key: str) -> Column:
    """The last scalar of ``key``, without quotes; of an inline list its first item; empty if missing."""
    found = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(front_matter(x), F.lit(rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t\r]*$"), 1)), -1)
    first = F.regexp_extract(found, r"^\[\s*([^,\]]*?)\s*[,\]]", 1)
    value = F.when(found.startswith("["), first).otherwise(found)
    return F.trim(F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2"))


def front_matter_list(x: Column, key: str) -> Column:
    """The items of an inline list of ``key``, or its scalar as the only one."""
    found = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(front_matter(x), F.lit(rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t\r]*$"), 1)), -1)
    inside = F.when(found.rlike(r"^\[.*\]$"), F.split(F.regexp_replace(found, r"^\[|\]$", ""), ",")).otherwise(F.array(found))
    return F.filter(F.transform(inside, lambda v: F.regexp_replace(F.trim(v), "^([\"'])(.*)\\1$", "$2")), lambda v: v != "")


def page_title(content: Column, path: Column) -> Column:
    """The front matter's title, else the first heading of level one, else the file's name with blanks."""
    named = front_matter_value(content, "title")
    heading = F.trim(F.regexp_extract(without_front_matter(content), r"(?m)^#[ \t]+(\S.*?)[ \t\r]*$", 1))
    return F.coalesce(F.when(named != "", named), F.when(heading != "", heading), F.translate(file_stem(path), "-", " "))


def wikilinks(x: Column) -> Column:
    """Targets of [[target|name]] and [[target#part]], in order, repeated as written."""
    inside = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\[\[([^\]]+)\]\]"), 1)
    return F.filter(F.transform(inside, lambda v: F.trim(F.regexp_extract(v, r"^([^|#]*)", 1))), lambda v: v != "")


def heading_lines(x: Column) -> Column:
    """Text of the lines that begin with '#', one a line."""
    lines = F.filter(F.split(F.coalesce(x, F.lit("")), "\n"), lambda v: F.trim(v).startswith("#"))
    return F.array_join(F.transform(lines, lambda v: F.trim(F.regexp_replace(F.trim(v), "^#+", ""))), "\n")


def search_title(title: Column, path: Column) -> Column:
    """Title and file name as one text, for the index's title column."""
    return F.concat_ws(" ", title, F.translate(file_stem(path), "-", " "))


def snippet_body(content: Column) -> Column:
    """What snippets are cut of: the content without front matter and blanks at its ends."""
    return F.regexp_replace(without_front_matter(F.coalesce(content, F.lit(""))), r"(?U)^\s+|\s+$", "")


def snippet_of(body: str, low: str, anchor: str, around: int = 80) -> str:
    """``snippet`` of one text: ``body`` is its ``snippet_body``, ``low`` that in lower case, and ``anchor`` is in lower case."""
    at = max(low.find(anchor), 0)
    start, end = max(at - around, 0), min(len(body), at + len(anchor) + around)
    return ("..." if start > 0 else "") + body[start:end].replace("\n", " ").strip(BLANKS) + ("..." if end < len(body) else "")


def snippet(content: Column, anchor: Column, around: int = 80) -> Column:
    """About 2 * ``around`` characters of the body near the first place of ``anchor`` in any letter case, else of its start."""
    body = snippet_body(content)
    at = F.greatest(F.instr(F.lower(body), F.lower(anchor)) - 1, F.lit(0))
    start = F.greatest(at - around, F.lit(0))
    end = F.least(F.length(body), at + F.length(anchor) + around)
    inside = F.regexp_replace(F.translate(F.substring(body, start + 1, F.greatest(end - start, F.lit(0))), "\n", " "), r"(?U)^\s+|\s+$", "")
    return F.concat(F.when(start > 0, "...").otherwise(""), inside, F.when(end < F.length(body), "...").otherwise(""))


def trimmed(x: Column, most: int, marker: str = "\n\n[...truncated...]") -> Column:
    """The first ``most`` characters and a marker, if there are more."""
    return F.when(F.length(x) > most, F.concat(F.regexp_replace(F.substring(x, 1, most), r"(?U)\s+$", ""), F.lit(marker))).otherwise(x)


def language(x: Column, sample: int = 2000) -> Column:
    """'Japanese', 'Korean', 'Chinese' or 'English', by the scripts of the first characters."""
    text = F.substring(F.coalesce(x, F.lit("")), 1, sample)

    def count(chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]", ""))

    kana, hangul, han = count(r"぀-ヿ"), count(r"가-힯"), count(r"一-鿿")
    enough = F.length(text) * 0.05
    return F.when(kana > 0, "Japanese").when((hangul > enough) & (hangul >= han), "Korean").when(han > enough, "Chinese").otherwise("English")


def dated(x: Column, today: Column) -> Column:
    """The date if it is one as YYYY-MM-DD, else ``today``."""
    return F.when(F.coalesce(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), x).otherwise(today)


def canonical_sources(values: Column, identity: Column) -> Column:
    """Sources of a page, anchored to its own: no aggregate pages, state folders, absolute paths or ways out; distinct in any letter case."""
    own = F.lower(normal_path(identity))
    plain = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(normal_path(v), r"^(\./)+", ""))
    allowed = F.filter(
        plain,
        lambda v: (v != "") & ~v.rlike(r"(?i)^(/|[a-z]:/)|(^|/)\.\.(/|$)|^wiki/(index|overview|log)\.md$|^\.[^/]*-wiki(/|$)"),
    )
    anchored = F.transform(allowed, lambda v: F.when((F.lower(v) == own) | (~v.contains("/") & (F.lower(v) == F.lower(file_name(identity)))), identity).otherwise(v))
    full = F.when(F.exists(anchored, lambda v: F.lower(normal_path(v)) == own), anchored).otherwise(F.concat(anchored, F.array(identity)))
    first = lambda v, i: F.array_position(F.transform(full, lambda w: F.lower(w)), F.lower(v)) == i + 1
    return F.filter(full, first)

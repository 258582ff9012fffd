"""Page and review blocks in text that a model wrote."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds of review and what a reader may do about one.
REVIEW_TYPES = ("contradiction", "duplicate", "missing-page", "suggestion")
REVIEW_OPTIONS = ("Create Page", "Skip")
_OPEN = re.compile(r"---\s*(FILE|REVIEW):\s*(.*?)\s*(?:---)?\s*", re.I)
_RESERVED = re.compile(r"(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)", re.I)


def safe_path(path: str) -> bool:
    """Whether a page may be written there; the twin of ``functions.text.safe_page_path`` for single values."""
    if not path.strip() or re.search(r"[\x00-\x1f\x7f]", path) or re.match(r"[A-Za-z]:|[/\\]", path):
        return False
    parts = path.replace("\\", "/").split("/")
    return parts[0] == "wiki" and len(parts) > 1 and all(p and p != ".." and p[0] != "." and p[-1] not in " ." and not re.search(r'[<>:"|?*]', p) and not _RESERVED.match(p) for p in parts)


@dataclass
class Generated:
    """What a model's text holds."""

    files: list[tuple[str, str]] = field(default_factory=list)
    reviews: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    truncated: list[str] = field(default_factory=list)


def read_generated(text: str | None) -> Generated:
    """Pages between FILE and END FILE lines and reviews between REVIEW and END REVIEW lines, whatever their letter case.

    An end inside a code fence of a page is text. Blocks that don't end, have no or an unsafe path, or an unknown type of review are left out with a
    warning; safe paths of pages that don't end are in ``truncated``.
    """
    out, lines = Generated(), (text or "").replace("\r\n", "\n").split("\n")
    at = 0
    while at < len(lines):
        m = _OPEN.fullmatch(lines[at])
        at += 1
        if not m or m[1].upper() == "REVIEW" and not m[2]:
            continue
        kind, name = m[1].upper(), m[2].strip()
        end = _end(lines, at, kind)
        body = lines[at:end] if end is not None else lines[at:]
        at = len(lines) if end is None else end + 1
        if end is None:
            out.warnings.append(f'{kind} block "{name or "(unnamed)"}" does not end; it was left out.')
            if kind == "FILE" and safe_path(name):
                out.truncated.append(name)
        elif kind == "REVIEW":
            _review(name, body, out)
        elif not name:
            out.warnings.append("FILE block without a path was left out.")
        elif not safe_path(name):
            out.warnings.append(f'FILE block with the unsafe path "{name}" was left out.')
        else:
            out.files.append((name, "\n".join(body)))
    return out


def _end(lines: list[str], at: int, kind: str) -> int | None:
    """The line that ends the block begun before line ``at``; for pages, not one within a fence."""
    closing, fence = re.compile(rf"---\s*END\s+{kind}\s*---\s*", re.I), ""
    for i in range(at, len(lines)):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", lines[i]) if kind == "FILE" else None
        if mark and not fence:
            fence = mark[1]
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
            fence = ""
        elif not fence and closing.fullmatch(lines[i]):
            return i
    return None


def _review(header: str, body: list[str], out: Generated) -> None:
    kind, _, title = (x.strip() for x in header.partition("|"))
    if kind.lower() not in REVIEW_TYPES:
        out.warnings.append(f'REVIEW block of the unknown type "{kind.lower()}" was left out.')
        return
    lists: dict[str, list[str]] = {}
    said = []
    for line in body:
        m = re.match(r"\s*(options|pages|search):(.*)", line, re.I)
        if m:
            lists[m[1].lower()] = [v.strip() for v in m[2].split("," if m[1].lower() == "pages" else "|") if v.strip()]
        else:
            said.append(line)
    options = [o for o in lists.get("options", []) if o in REVIEW_OPTIONS] or list(REVIEW_OPTIONS)
    out.reviews.append({"type": kind.lower(), "title": title or "(untitled)", "description": "\n".join(said).strip(), "options": options, "pages": lists.get("pages", []), "search": lists.get("search", [])})


def generated_table(texts: DataFrame) -> DataFrame:
    """(id, files ARRAY<STRUCT<path, content>>, reviews ARRAY<STRUCT>, warnings, truncated) of ``texts(id, text)``."""
    review = pa.struct([("type", pa.string()), ("title", pa.string()), ("description", pa.string()), *((n, pa.list_(pa.string())) for n in ("options", "pages", "search"))])
    file = pa.struct([("path", pa.string()), ("content", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            read = [read_generated(s) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([[{"path": p, "content": c} for p, c in r.files] for r in read], pa.list_(file)),
                    pa.array([r.reviews for r in read], pa.list_(review)),
                    pa.array([r.warnings for r in read], pa.list_(pa.string())),
                    pa.array([r.truncated for r in read], pa.list_(pa.string())),
                ],
                ["id", "files", "reviews", "warnings", "truncated"],
            )

    lists = "options: array<string>, pages: array<string>, search: array<string>"
    return texts.select(texts["id"].cast("string").alias("id"), "text").mapInArrow(
        run, f"id string, files array<struct<path: string, content: string>>, reviews array<struct<type: string, title: string, description: string, {lists}>>, warnings array<string>, truncated array<string>"
    )

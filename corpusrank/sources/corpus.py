"""Corpora as folders of files: scans, documents, fingerprints, and sinks for pages and sources."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.functions import formats
from corpusrank.functions import text as t
from corpusrank.shared import path_exists

# Pages that are no content, and the folders and files a corpus begins with.
NOT_CONTENT = ("wiki/index.md", "wiki/log.md", "wiki/reviews.md")
FOLDERS = ("wiki/concepts", "wiki/entities", "wiki/sources", "raw/sources")


def _files(spark: SparkSession, root: str, below: str, pattern: str | None) -> DataFrame:
    """(path, modified, length, content) of the files below a folder, without those in or of a name with a leading dot."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = f"{root.rstrip('/')}/{below}"
    relative = F.regexp_extract("path", rf"/({below}/.*)$", 1)
    found = reader.load(base).select(relative.alias("path"), F.col("modificationTime").alias("modified"), "length", "content")
    return found.where(~F.col("path").rlike(r"(^|/)\."))


def _first(files: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` files by path, or all. Only paths are sorted; contents are read where they are."""
    if most is None:
        return files
    first = files.select(F.col("path").alias("_path")).orderBy("_path").limit(most)
    return files.join(first, files["path"] == first["_path"], "left_semi")


def wiki_pages(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """The Markdown files of the wiki, or the first ``most`` by path."""
    return _first(_files(spark, root, "wiki", "*.md"), most)


def source_files(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """The raw sources, or the first ``most`` by path."""
    return _first(_files(spark, root, "raw/sources", None), most)


def page_documents(pages: DataFrame) -> DataFrame:
    """Documents of ``pages(path, content STRING)``: what is no content is left out; titles, links, sources and types are read."""
    kept = pages.where(~F.lower("path").isin(*NOT_CONTENT) & F.col("content").isNotNull())
    return kept.select(
        "path",
        t.page_title(F.col("content"), F.col("path")).alias("title"),
        "content",
        F.lit("wiki").alias("kind"),
        t.wikilinks(F.col("content")).alias("links"),
        t.front_matter_list(F.col("content"), "sources").alias("sources"),
        t.front_matter_value(F.col("content"), "type").alias("page_type"),
    )


def source_documents(files: DataFrame) -> DataFrame:
    """Documents of ``files(path, content BINARY)``; unreadable and blank ones are left out."""
    none = F.array().cast("array<string>")
    read = formats.file_texts(files).where("problem is null and trim(text) <> ''")
    return read.select("path", t.file_name(F.col("path")).alias("title"), F.col("text").alias("content"), F.lit("source").alias("kind"), none.alias("links"), none.alias("sources"), F.lit("").alias("page_type"))


def load_documents(spark: SparkSession, root: str, include_sources: bool = True, most: int | None = None) -> DataFrame:
    """All documents of a corpus. With ``most``: the first so many pages, and sources as far as pages leave room."""
    pages = wiki_pages(spark, root, most)
    utf8 = pages.withColumn("content", F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")))
    docs = page_documents(utf8)
    if include_sources and path_exists(spark, f"{root}/raw/sources"):
        left = None if most is None else max(0, most - docs.count())
        docs = docs.unionByName(source_documents(source_files(spark, root, left).select("path", "content")))
    return docs


def fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint): 'number|16 hex digits' over path, length and time of ``files(path, length, modified)``, in order of path.

    Hashes are folded by position-free sums per path, so that only 64 partial sums are gathered, however many files there are.
    """
    one = F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modified").cast("string")), 256)
    slices = [F.sum(F.conv(F.substring(one, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return files.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", *slices).alias("sums")).select(F.concat(F.col("n").cast("string"), F.lit("|"), F.substring(F.sha2("sums", 256), 1, 16)).alias("fingerprint"))


def content_hashes(docs: DataFrame) -> DataFrame:
    """(path, hash): SHA-256 of the text."""
    return docs.select("path", F.sha2("content", 256).alias("hash"))


def cached_sources(files: DataFrame, cache: DataFrame, present: DataFrame) -> DataFrame:
    """(identity): sources of ``files(identity, hash)`` that ``cache(identity, hash, files)`` knows with this hash and whose pages are all ``present(path)``."""
    hit = files.join(cache.select("identity", "hash", "files"), ["identity", "hash"]).select("identity", F.explode_outer("files").alias("path"))
    there = hit.join(present.select("path", F.lit(1).alias("there")).distinct(), "path", "left")
    return there.groupBy("identity").agg(F.count("path").alias("n"), F.count("there").alias("m")).where("n = m").select("identity")


# --- sinks on the driver's file system ---------------------------------------------------------------------------------------


def create(root: str) -> Path:
    """A new corpus with its folders and an empty index; an existing one is left as it is."""
    base = Path(root)
    for f in FOLDERS:
        (base / f).mkdir(parents=True, exist_ok=True)
    for name, text in (("wiki/index.md", "# Wiki Index\n"), ("wiki/log.md", "# Wiki Log\n")):
        if not (base / name).exists():
            (base / name).write_text(text, encoding="utf-8")
    return base


def find(start: str) -> Path | None:
    """The nearest folder upward that holds a wiki."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / "wiki").is_dir()), None)


def write_page(root: str, path: str, content: str) -> Path:
    target = Path(root, path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content, encoding="utf-8")
    return target


def read_page(root: str, path: str, default: str = "") -> str:
    target = Path(root, path)
    return target.read_text(encoding="utf-8") if target.exists() else default


def store_source(root: str, file: str, folder: str = "") -> Path:
    """Copies a file to the raw sources. A different file of that name stays; the copy is numbered from 2 then."""
    origin, place = Path(file), Path(root, "raw/sources", folder)
    place.mkdir(parents=True, exist_ok=True)
    target, n = place / origin.name, 1
    while target.exists() and (n > 1 or target.read_bytes() != origin.read_bytes()):
        n += 1
        target = place / f"{origin.stem}-{n}{origin.suffix}"
    if target.resolve() != origin.resolve():
        shutil.copy2(origin, target)
    return target

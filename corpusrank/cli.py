"""Command line: init, add, ask, search, embed, status. Exits with 0, or 1 for an error it can name, 2 for a wrong call.

``add`` and ``ask`` need a model: a function ``(phase, prompt, most_tokens) -> text`` that the caller names as ``module:function``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from corpusrank.plans import ingest, ladder
from corpusrank.plans.profiles import PROFILES, profile
from corpusrank.shared import materialise, path_exists
from corpusrank.sources import corpus, embedding

_CHUNKS = "page_id string, chunk_index int, heading_path string, text string, vector array<float>, dims int"
_PAGES = "page_id string, title string, hash string, model string"


def _session() -> SparkSession:
    return SparkSession.builder.appName("corpusrank").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusrank", description=__doc__)
    top.add_argument("--root", default=".", help="folder of the corpus")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    add = sub.add_parser("add")
    add.add_argument("files", nargs="+")
    add.add_argument("--model", required=True)
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--model", required=True)
    ask.add_argument("--json", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--profile", choices=sorted(PROFILES), default="balanced")
    search.add_argument("--json", action="store_true")
    embed = sub.add_parser("embed")
    embed.add_argument("store", help="folder for the vector store")
    sub.add_parser("status")
    return top


def _model(name: str):
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no model {name!r}: {e}") from e


def _stored(spark: SparkSession, store: str) -> list:
    """The chunks and pages of a store, read whole before it is written again; empty ones where it does not exist yet."""
    have = path_exists(spark, f"{store}/pages")
    return [materialise(spark.read.parquet(f"{store}/{name}"), name) if have else spark.createDataFrame([], ddl) for name, ddl in (("chunks", _CHUNKS), ("pages", _PAGES))]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            print(corpus.create(args.root))
            return 0
        root = corpus.find(args.root)
        if root is None:
            print(f"no corpus at or above {args.root}", file=sys.stderr)
            return 1
        if args.command == "add":
            for file in args.files:
                done = ingest.ingest(str(root), file, _model(args.model))
                print(json.dumps({"file": file, "identity": done.identity, "written": done.written, "skipped": done.skipped, "reviews": done.reviews, "cached": done.from_cache}, ensure_ascii=False))
            return 0
        spark = _session()
        docs = corpus.load_documents(spark, str(root))
        if args.command == "status":
            for r in ingest.status(docs).collect():
                print(f"{r['kind']}: {r['documents']} documents, {r['characters']} characters")
        elif args.command == "embed":
            new_chunks, new_pages, counts = embedding.embed_changes(docs, *_stored(spark, args.store), "hashing-64", embedding.hashing_embedder())
            new_chunks, new_pages = materialise(new_chunks, "chunks"), materialise(new_pages, "pages")
            new_chunks.write.mode("overwrite").parquet(f"{args.store}/chunks")
            new_pages.write.mode("overwrite").parquet(f"{args.store}/pages")
            print(json.dumps(counts))
        elif args.command == "ask":
            answer, cited, note = ingest.ask(spark, ladder.build(docs), args.question, _model(args.model))
            pages = [r["path"] for r in cited.where("cited").orderBy("number").collect()] if cited is not None else []
            print(json.dumps({"answer": answer, "cited": pages, "note": note}, ensure_ascii=False) if args.json else "\n".join([answer, *(f"- {p}" for p in pages)]))
        else:
            asked = spark.createDataFrame([(1, args.query, None)], "query_id long, query string, vector array<float>")
            rows = ladder.search(ladder.build(docs), asked, args.top_k, profile(args.profile).options).results.orderBy("rank").collect()
            for r in rows:
                print(json.dumps(r.asDict(), ensure_ascii=False) if args.json else f"{r['rank']}. {r['title']} ({r['path']})\n   {r['snippet']}")
        return 0
    except (ValueError, KeyError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

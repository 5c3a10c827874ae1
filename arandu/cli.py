"""Command line: ingest a folder, or query a collection."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from .operators.retrieval import cli_filters
from .operators.scoring import PROFILES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arandu", description="Index documents and query them with Spark.")
    p.add_argument("input_path", nargs="?", help="a file, a folder, or a collection's folder")
    p.add_argument("--output-dir", help="the collection's folder")
    yes_no = argparse.BooleanOptionalAction
    p.add_argument("--build-search", action=yes_no, default=True, help="derive search records")
    p.add_argument("--build-chunks", action=yes_no, default=True, help="derive chunks")
    p.add_argument("--build-embeddings", action="store_true", help="derive vectors of chunks")
    p.add_argument("--force-embeddings", action="store_true", help="derive vectors anew")
    p.add_argument("--query", help="search the chunks")
    p.add_argument("--answer", action="store_true", help="answer the query from what is found; needs a model")
    p.add_argument("--limit", type=int, default=6, help="most results")
    p.add_argument("--latest", action="store_true", help="input_path is a folder of collections: take the last one; ten results unless --limit says otherwise")
    p.add_argument("--add", action="store_true", help="add the files to the collection that --output-dir holds")
    p.add_argument("--strict", action="store_true", help="exit with 1 if a file could not be parsed")
    p.add_argument("--archetype", help="only this archetype")
    p.add_argument("--file-name", help="only this file")
    p.add_argument("--file-type", help="only this type")
    p.add_argument("--ranking-profile", choices=PROFILES, default="legal")
    return p


def main(argv: Sequence[str] | None = None, model: Callable[[str, str], str] | None = None) -> int:
    """model: answers questions; without one, the service that the settings name."""
    from pyspark.sql import SparkSession

    from .collection import Collection, latest
    from .config import settings
    from .operators.answers import service_model
    from .sinks.writers import answer_lines, result_lines
    from .sources.files import parse_files, scan

    args = parser().parse_args(argv)
    if args.answer and not args.query:
        parser().error("--answer needs --query")
    if not args.input_path:
        parser().error("input_path is missing")
    spark = SparkSession.builder.appName("arandu").getOrCreate()
    source = latest(spark, args.input_path) if args.latest else Collection(spark, args.input_path)
    if source is None:
        parser().error("no collection in input_path")
    if source.is_collection():
        own = source
        if args.build_embeddings:
            print(own.build_embeddings(args.force_embeddings))
    else:
        if not args.output_dir:
            parser().error("--output-dir is missing")
        own = Collection(spark, args.output_dir)
        if args.add:
            print(own.add(parse_files(scan(spark, args.input_path)), args.build_embeddings))
        else:
            print(own.ingest(args.input_path, args.build_embeddings, args.build_search, args.build_chunks))
    if args.query:
        filters = cli_filters(args.archetype, args.file_name, args.file_type)
        limit = max(10 if args.latest and args.limit == parser().get_default("limit") else args.limit, 1)
        if args.answer:
            known = settings(env_file=".env")
            missing = [] if model else known.missing_for_answers()
            ask = model or (None if missing else service_model(known.model_endpoint, known.model_key, known.model_name))
            print(answer_lines(own.answer(args.query, ask, filters, limit, args.ranking_profile, missing, persist=True)))
        else:
            print(result_lines(own.context(args.query, persist=True, filters=filters, limit=limit, profile=args.ranking_profile)["chunks"]))
    if args.strict and (failed := own.failures().limit(20).collect()):
        print("\n".join(f"{r['source_path']}: {r['error']}" for r in failed))
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

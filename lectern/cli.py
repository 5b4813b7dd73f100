"""python -m lectern.cli inspect|translate INPUT: a thin front of plans.documents.

INPUT is a folder or file of documents that ``sources.pages`` can open (PDFs
where the PDF library is installed, or extracted pages as JSON), or a Parquet
table of lines (schemas.LINE). Pages without text, page sizes and images count
with the first kind; documents that cannot be opened are listed, and do not stop
the others.
"""

from __future__ import annotations

import argparse
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import report, translate
from .plans import documents
from .sources import artefacts, pages, sinks, visuals
from .sources.scratch import written
from .sources.tables import raw_lines
from .sources.visuals import drawings, page_areas

#: Failures that are shown; all are in the table of pages.
SHOWN = 100


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lectern", description="Inspect positioned documents, or translate them up to the plan of their pages")
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("input")
    both.add_argument("--report", required=True, help="folder for the JSON reports")
    both.add_argument("--source", default="Japanese")
    both.add_argument("--each", action="store_true", help="a report file for each document, named after it")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("inspect", parents=[both])
    t = commands.add_parser("translate", parents=[both])
    t.add_argument("--model", required=True)
    t.add_argument("--target", default="English")
    t.add_argument("--cache", help="folder of the cache's versions")
    t.add_argument("--no-cache", action="store_true")
    return out


@dataclass(frozen=True)
class Input:
    """Lines; rules, pages, names (doc_id, name) and failures (file, error) where the input tells of them."""

    lines: DataFrame
    rules: DataFrame | None = None
    pages: DataFrame | None = None
    names: DataFrame | None = None
    failures: DataFrame | None = None


def load(spark: SparkSession, path: str) -> Input:
    """Files are numbered by a hash of their path. What an extractor says of them is read once and written."""
    if not re.search(r"\.(pdf|jsonl)$|\*", path.lower()) and not documents_in(path):
        return Input(spark.read.parquet(path))
    read = written(pages.read_pages(spark, path), "pages")
    there = read.filter("error IS NULL").withColumns({"doc_id": F.xxhash64("file"), "page": F.col("page") - 1})
    root = pages.resolved(path)[1].rstrip("/")
    below = F.when(F.startswith("file", F.lit(root + "/")), F.substr("file", F.lit(len(root) + 2))).otherwise(F.regexp_extract("file", "[^/]+$", 0))
    names = there.select("doc_id", below.alias("name")).distinct()
    return Input(raw_lines(there), drawings(there), page_areas(there), names, read.filter("error IS NOT NULL").select("file", "error"))


def write_out(reports: DataFrame, given: Input, path: str, each: bool) -> DataFrame:
    """The reports as they were written: a folder of lines, or a file for each document."""
    if not each:
        sinks.write_reports(reports, path)
        return reports.sparkSession.read.json(path)
    held = written(reports, "reports")
    named = held.join(given.names, "doc_id", "left") if given.names is not None else held.withColumn("name", F.lit(None).cast("string"))
    name = F.coalesce("name", F.concat(F.lit("document-"), F.col("doc_id").cast("string")))
    artefacts.write_report_files(named.select("*").withColumn("name", name), path, F.col("name"))
    return held


def documents_in(path: str) -> bool:
    """Whether a folder holds documents, and not the parts of a table."""
    try:
        return next(pages.files_of(path), None) is not None
    except FileNotFoundError:
        return False


def main(arguments: list[str] | None = None, backend: translate.Backend | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    given = load(spark, a.input)
    if given.failures is not None:
        for r in given.failures.orderBy("file").limit(SHOWN).collect():
            print(f"cannot be opened: {r['file']}: {r['error']}")
    ocr = any(visuals.engines().values())
    if a.command == "inspect":
        out = documents.inspect(given.lines, documents.Options(source_language=a.source, can_read_images=ocr), given.rules, given.pages)
        write_out(out, given, a.report, a.each)
        print(f"reports: {a.report}")
        return
    options = documents.Options(a.source, a.target, a.model, use_cache=not a.no_cache, can_read_images=ocr)
    out = documents.translate_documents(given.lines, backend or translate.EchoBackend(a.target), options, given.rules, cache_root=a.cache, pages=given.pages)
    for r in report.summary(write_out(out, given, a.report, a.each)).toLocalIterator():
        print(r["line"])


if __name__ == "__main__":
    main()

"""Whole runs: inspect documents, or translate them up to the plan of where each text goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fit, grids, lines, qa, quality, report, segment, translate
from ..sources import sinks
from ..sources.cache_log import CacheLog
from ..sources.scratch import forget, written


@dataclass(frozen=True)
class Options:
    source_language: str = "Japanese"
    target_language: str = "English"
    model: str = "echo"
    mode: str = "auto"
    min_font_scale: float = 0.9
    use_cache: bool = True
    page_width: float = 595.0
    merge: bool = False
    can_read_images: bool = False
    can_edit_images: bool = False

    def check(self) -> None:
        if not self.model:
            raise ValueError("no model was chosen")
        if not self.source_language or not self.target_language:
            raise ValueError("source and target languages must be chosen")
        if self.source_language == self.target_language:
            raise ValueError("source and target languages must differ")


def units_of(page_lines: DataFrame, options: Options, rules: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    merged = lines.merge_rows(page_lines) if options.merge else page_lines
    found = grids.detect_grids(rules) if rules is not None else None
    return segment.segment(merged, options.source_language, found, options.page_width, pages)


def inspect(page_lines: DataFrame, options: Options = Options(), rules: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """One nested row per document. Nothing is translated.

    ``pages``: doc_id, page, width, height, image_area of every page, also of
    those without text.
    """
    routes = quality.route(quality.page_quality(page_lines, pages), options.mode, options.can_read_images, options.can_edit_images)
    return report.inspection(units_of(page_lines, options, rules, pages), routes)


def translated_units(units: DataFrame, backend: translate.Backend, options: Options, cache: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Units with translation, or with error, and the written tables that they are read from. Each distinct miss is asked for once. Without a cache in use, nothing is looked up."""
    keyed = translate.with_keys(units, options.source_language, options.target_language, options.model)
    if cache is not None and options.use_cache:
        found = translate.lookup(keyed, cache)
    else:
        found = keyed.withColumn("cached", F.lit(None).cast("string"))
    found = written(found, "found")
    fresh = written(translate.translate_misses(translate.distinct_misses(found), backend), "fresh")
    return translate.resolve(found, fresh), [found, fresh]


def translate_documents(
    page_lines: DataFrame, backend: translate.Backend, options: Options = Options(), rules: DataFrame | None = None, cache: DataFrame | None = None, cache_root: str | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """The report of a run: sizes and lines of every unit, and the checks of the planned pages.

    Units that stay without a translation are in it with their error, and their
    document does not pass. With ``cache_root``, units are looked up in the log
    there (unless a ``cache`` is given), and what is new is added to it as a
    generation; without the use of a cache nothing is looked up or added. Lines
    that no translated line covers are put back as they were, with their size, and
    are checked with the rest. ``pages`` as for ``inspect``: pages that nothing
    stands on are in the report too. A run with nothing to translate is an error.
    A table that only leads to the next is deleted when that is written.
    """
    options.check()
    units, own = units_of(page_lines, options, rules, pages), []
    log = CacheLog(page_lines.sparkSession, cache_root) if cache_root is not None and options.use_cache else None
    if log is not None and cache is None:
        units = written(units, "units")
        own = [units]
        cache = log.lookup(translate.with_keys(units, options.source_language, options.target_language, options.model))
    resolved, held = translated_units(units, backend, options, cache)
    if held[0].isEmpty():
        raise ValueError("there is nothing to translate")
    if log is not None:
        fresh = resolved.filter("fresh")
        rows = translate.cache_rows(fresh, options.source_language, options.target_language, options.model)
        if not fresh.isEmpty():
            log.append(sinks.upsert(rows.drop("ord").limit(0), rows))
    placed = written(fit.with_sizes(resolved, options.min_font_scale).drop("cache_key", "fresh"), "placed")
    forget(*held, *own)
    items = qa.rendered(placed.filter("translation IS NOT NULL").select("doc_id", "page", F.xxhash64("unit_id").alias("ord"), F.col("translation").alias("text"), "bbox"))
    kept = written(kept_lines(page_lines, placed), "kept")
    crossings = qa.rule_crossings(items, rules) if rules is not None else items.filter("false").select("doc_id", "page")
    expected = qa.expected_regions(placed.filter("translation IS NOT NULL"))
    verdicts = written(qa.page_verdicts(items, qa.text_collisions(items), crossings, qa.outside_safe(items, expected)), "verdicts")
    return report.render_report(placed, verdicts, kept, pages)


def kept_lines(page_lines: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, page, ord, text, bbox, final_size: the lines of translated pages that no line of a translated unit covers. They keep their text and get their own size back."""
    done = placed.filter("translation IS NOT NULL")
    covering = done.select("doc_id", "page", F.explode("line_boxes").alias("bbox"))
    sized = page_lines.filter(tx.not_blank(F.col("text"))).select("doc_id", "page", "ord", "text", "bbox", qa.reinserted_size(F.col("spans")).alias("final_size"))
    return qa.uncovered(sized.join(done.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi"), covering)

"""Translating units: cache, batches, a pluggable backend, and the recovery of what it left out.

A backend is any object with ``translate(units) -> str``: it gets a list of
{"id", "kind", "text"} and returns its reply, JSON or prose around JSON.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

BATCH, ATTEMPTS, LONGEST_WAIT, DEPTH = 4, 6, 30, 3
#: States of a service that are worth another attempt.
RETRY_STATES = (429, 500, 502, 503, 504)


class Backend(Protocol):
    def translate(self, units: list[dict]) -> str: ...


class ServiceError(RuntimeError):
    """A failed call; ``status`` decides whether it is tried again."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


class LeftOut(RuntimeError):
    """A unit for which the backend gave no translation, however it was asked."""


#: What a request may fail with and become error rows: the service, the network, an unreadable or refused text. All else is a fault of the program and stops the job.
FAILURES = (ServiceError, LeftOut, OSError, ValueError)


class EchoBackend:
    """A stand-in without a network: each text in brackets with the language."""

    def __init__(self, target: str):
        self.target = target

    def translate(self, units: list[dict]) -> str:
        return json.dumps({"translations": [{"id": u["id"], "translation": f"[{self.target}] {u['text']}"} for u in units]}, ensure_ascii=False)


def with_keys(units: DataFrame, source: str, target: str, model: str) -> DataFrame:
    return units.withColumn("cache_key", tx.cache_key(F.col("text"), F.lit(source), F.lit(target), F.lit(model)))


def lookup(units: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds cached (null for a miss; an empty cached text is a miss too). The cache is not assumed to be small."""
    c = cache.select("cache_key", F.nullif("translation", F.lit("")).alias("cached"))
    return units.join(c, "cache_key", "left")


def distinct_misses(found: DataFrame) -> DataFrame:
    """One unit per cache key among the misses: the first in order. Equal texts cost one call."""
    first = F.min_by(F.struct("doc_id", "page", "unit_ord", "unit_id", "kind", "text"), F.struct("doc_id", "page", "unit_ord"))
    return found.filter("cached IS NULL").groupBy("cache_key").agg(first.alias("u")).select("cache_key", "u.*")


def batches(misses: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds batch: ``size`` units of a document each, in order."""
    order = Window.partitionBy("doc_id").orderBy("page", "unit_ord")
    return misses.withColumn("_n", F.row_number().over(order) - 1).withColumn("batch", F.expr(f"_n DIV {size}")).drop("_n")


def parse_translations(replies: DataFrame) -> DataFrame:
    """doc_id, batch, reply -> doc_id, batch, i, unit_id, translation: items with an id and a text; of equal ids the last."""
    schema = "translations array<struct<id:string,unit_id:string,segment_id:string,translation:string,translated_text:string>>"
    r = replies.select("doc_id", "batch", F.posexplode(tx.parse_reply(F.col("reply"), schema)["translations"]).alias("i", "t"))
    r = r.select("doc_id", "batch", "i", tx.normalize_id(tx.first_filled(F.col("t.id"), F.col("t.unit_id"), F.col("t.segment_id"))).alias("unit_id"), tx.strip(tx.first_filled(F.col("t.translation"), F.col("t.translated_text"))).alias("translation"))
    r = r.filter("unit_id != '' AND translation != ''")
    return r.groupBy("doc_id", "batch", "unit_id").agg(F.max_by("translation", "i").alias("translation"))


def missing(pending: DataFrame, parsed: DataFrame) -> DataFrame:
    """The pending units without a translation in their batch's reply."""
    return pending.join(parsed, ["doc_id", "batch", "unit_id"], "left_anti")


def read_reply(reply: str) -> dict[str, str]:
    """id -> translation of one reply, as ``parse_translations`` reads it: as it is, else with missing commas put in."""
    a, b = reply.find("{"), reply.rfind("}")
    if a < 0 or b < a:
        return {}
    raw = reply[a : b + 1]
    for text in (raw, tx.repaired(raw)):
        try:
            found, _ = json.JSONDecoder().raw_decode(text)  # what follows a complete object does no harm
            break
        except json.JSONDecodeError:
            continue
    else:
        return {}
    items = found.get("translations", [])
    out = {}
    for x in items if isinstance(items, list) else []:
        if isinstance(x, dict):
            key = str(x.get("id") or x.get("unit_id") or x.get("segment_id") or "").strip().strip("`").strip()
            text = str(x.get("translation") or x.get("translated_text") or "").strip()
            if key and text:
                out[key] = text
    return out


def call(backend: Backend, units: list[dict], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> str:
    """One request, tried again with growing waits while the service says so."""
    for n in range(attempts):
        try:
            return backend.translate(units)
        except ServiceError as e:
            if e.status not in RETRY_STATES or n == attempts - 1:
                raise
            sleep(min(LONGEST_WAIT, 2**n))
    raise AssertionError("unreachable")


def translate_units(backend: Backend, units: list[dict], **options) -> dict[str, str]:
    """Translations of a batch. What a reply leaves out is halved and asked again, at last one by one; then it is an error."""
    out: dict[str, str] = {}
    work = [(units, 0)]
    while work:
        part, depth = work.pop()
        known = {u["id"] for u in part}
        out |= {k: v for k, v in read_reply(call(backend, part, **options)).items() if k in known}
        left = [u for u in part if u["id"] not in out]
        if not left:
            continue
        if depth > DEPTH:
            raise LeftOut(f"no translation for {left[0]['id']}")
        if len(left) > 1 and depth < DEPTH:
            work += [(left[: len(left) // 2], depth + 1), (left[len(left) // 2 :], depth + 1)]
        else:
            work += [([u], DEPTH + 1) for u in left]
    return out


def translate_misses(misses: DataFrame, backend: Backend, size: int = BATCH) -> DataFrame:
    """cache_key, doc_id, page, unit_ord, kind, text -> cache_key, translation, error.

    Requests hold ``size`` units of a document, in order (``batches``); a request that
    fails (``FAILURES``) becomes error rows. Write the result before it is read: a
    recomputed partition pays its calls again.
    """

    def ask(rows: list[tuple[str, str, str]]) -> pd.DataFrame:
        # keys name units in requests: unit ids repeat between documents
        try:
            got, error = translate_units(backend, [{"id": k, "kind": kind, "text": t} for k, kind, t in rows]), None
        except FAILURES as e:
            got, error = {}, f"{type(e).__name__}: {e}"
        return pd.DataFrame({"cache_key": [r[0] for r in rows], "translation": [got.get(r[0]) for r in rows], "error": [error] * len(rows)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for pdf in frames:
            for doc_id, batch, *row in zip(pdf.doc_id, pdf.batch, pdf.cache_key, pdf.kind, pdf.text):
                if held and (doc_id, batch) != at:
                    yield ask(held)
                    held = []
                at = (doc_id, batch)
                held.append(tuple(row))
        if held:
            yield ask(held)

    dealt = batches(misses, size).repartition("doc_id", "batch").sortWithinPartitions("doc_id", "batch", "page", "unit_ord")
    return dealt.select("doc_id", "batch", "cache_key", "kind", "text").mapInPandas(run, "cache_key string, translation string, error string")


def resolve(found: DataFrame, fresh: DataFrame) -> DataFrame:
    """Units of ``lookup`` with translation from the cache or from ``fresh`` (and whether it is from there), or an error."""
    f = fresh.select("cache_key", F.col("translation").alias("new"), F.col("error").alias("_error"))
    out = found.join(f, "cache_key", "left").withColumns({"translation": F.coalesce("cached", "new"), "fresh": F.col("cached").isNull() & F.col("new").isNotNull()})
    return out.withColumn("error", F.when(F.col("translation").isNull(), F.coalesce("_error", F.lit("the backend gave no translation")))).drop("new", "cached", "_error")


def cache_rows(resolved: DataFrame, source: str, target: str, model: str) -> DataFrame:
    """Rows for the cache, with their order."""
    r = resolved.filter("translation IS NOT NULL")
    return r.select("cache_key", F.col("text").alias("source_text"), F.lit(source).alias("source_language"), F.lit(target).alias("target_language"), F.lit(model).alias("model"), "translation", F.lit(0).cast("long").alias("ord"))


def untranslated(resolved: DataFrame) -> DataFrame:
    """Units that must not be there before rendering."""
    return resolved.filter("translation IS NULL").select("doc_id", "unit_id")

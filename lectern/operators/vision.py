"""Reading the texts of images with a vision model: once for each content, with what was read kept before it is used.

A conversation about an image is a state machine over response modes and attempts
in each: a refused mode leads to the next one, a busy service to another attempt
after a wait, and what cannot be read in the last mode is an error row.
"""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import sent_size
from ..sources.readings import ReadingLog
from .regions import place_regions, read_regions
from .translate import FAILURES, LONGEST_WAIT, RETRY_STATES, ServiceError

#: Response modes in the order in which they are tried, attempts in each, states that mean a mode is refused, longest edge sent.
MODES, ATTEMPTS, REFUSED, LONGEST_EDGE = ("json_object", "text"), 5, (400, 404, 422), 2400
#: Scales an image (bytes, format) to a width and height, as bytes of the same format.
Resize = Callable[[bytes, str, int, int], bytes]


class Backend(Protocol):
    def read(self, data_url: str, width: int, height: int, mode: str) -> str: ...


@dataclass(frozen=True)
class State:
    mode: int = 0
    attempt: int = 0


@dataclass(frozen=True)
class Failed:
    why: str


def after(state: State, status: int | None, modes: int = len(MODES), attempts: int = ATTEMPTS) -> State | Failed:
    """Where a call that failed with ``status`` (None: its reply held no object) leads."""
    next_mode = State(state.mode + 1) if state.mode + 1 < modes else None
    if status is None:
        return next_mode or Failed("no JSON object in the reply")
    if status in REFUSED and next_mode:
        return next_mode
    if status not in RETRY_STATES:
        return Failed(f"the service answered {status}")
    if state.attempt + 1 < attempts:
        return State(state.mode, state.attempt + 1)
    return (next_mode if status == 429 else None) or Failed(f"the service answered {status} {attempts} times")


def holds_object(reply: str) -> bool:
    """Whether a reply has a JSON object, as it is or repaired."""
    a, b = reply.find("{"), reply.rfind("}")
    for text in (reply[a : b + 1], tx.repaired(reply[a : b + 1])) if 0 <= a < b else ():
        try:
            json.JSONDecoder().raw_decode(text)
            return True
        except json.JSONDecodeError:
            continue
    return False


def converse(backend: Backend, data_url: str, width: int, height: int, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str, int, str | None]:
    """(reply, mode, calls, error) about one image."""
    state, calls = State(), 0
    while True:
        calls += 1
        try:
            reply = backend.read(data_url, width, height, MODES[state.mode])
            if holds_object(reply):
                return reply, MODES[state.mode], calls, None
            status = None
        except ServiceError as e:
            status = e.status
        found = after(state, status)
        if isinstance(found, Failed):
            return None, MODES[state.mode], calls, found.why
        if found.mode == state.mode:
            sleep(min(LONGEST_WAIT, 2**state.attempt))
        state = found


def ask(images: DataFrame, backend: Backend, resize: Resize | None = None, longest: int = LONGEST_EDGE) -> DataFrame:
    """digest, ext, bytes, image_w, image_h (one row for each digest) -> digest, reply, mode, calls, error, sent_w, sent_h, scale, image_w, image_h.

    Without ``resize`` images go as they are. Write the result before it is read: a
    recomputed partition pays its calls again.
    """
    size = sent_size(F.col("image_w"), F.col("image_h"), longest) if resize else F.struct(F.col("image_w").alias("w"), F.col("image_h").alias("h"), F.lit(1.0).alias("scale"))
    rows = images.withColumn("s", size).select("digest", "ext", "bytes", "image_w", "image_h", F.col("s.w").alias("sent_w"), F.col("s.h").alias("sent_h"), F.col("s.scale").alias("scale"))
    schema = "digest string, reply string, mode string, calls int, error string, sent_w int, sent_h int, scale double, image_w int, image_h int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for digest, ext, data, iw, ih, sw, sh, scale in f.itertuples(index=False):
                try:
                    sent = resize(bytes(data), ext, sw, sh) if resize and scale < 1 else bytes(data)
                    url = f"data:image/{(ext or 'png').lower()};base64,{base64.b64encode(sent).decode()}"
                    reply, mode, calls, error = converse(backend, url, sw, sh)
                except FAILURES as e:
                    reply, mode, calls, error = None, None, 0, f"{type(e).__name__}: {e}"
                out.append((digest, reply, mode, calls, error, sw, sh, scale, iw, ih))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def readings(images: DataFrame, backend: Backend, root: str, resize: Resize | None = None) -> DataFrame:
    """What is known of every distinct image: from the readings kept under ``root``, or asked for now and kept there first. Failed ones are asked again by the next run."""
    log = ReadingLog(images.sparkSession, root)
    known = log.read()
    once = images.select("digest", "ext", "bytes", "image_w", "image_h").groupBy("digest").agg(F.min_by(F.struct("ext", "bytes", "image_w", "image_h"), F.struct("ext", "image_w", "image_h")).alias("i")).select("digest", "i.*")
    open_ = once.join(known.filter("error IS NULL").select("digest"), "digest", "left_anti")
    log.append(ask(open_, backend, resize))
    return log.read().join(once.select("digest"), "digest", "left_semi")


def image_regions(placements: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """The regions of all placements, as ``place_regions`` has them, from ``readings``."""
    return place_regions(placements, images, read_regions(found.filter("error IS NULL")))

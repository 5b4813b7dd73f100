"""Requests to a chat service: what is asked, the shape of a reply, and a client around any way of sending.

The wording is this engine's own and a parameter; a service is any function
``send(body) -> reply`` that raises ``ServiceError`` with the state it got. No
vendor's client is here.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from .translate import ServiceError

Send = Callable[[dict], dict]

SEGMENTS = (
    "Put these parts of a document from {source} into {target}. Each goes back into its own place on the page, so keep headings and labels short, and keep cells and rows apart. "
    "Leave names, codes, numbers, dates, amounts and addresses as they are. Leave nothing out and add nothing.\n"
    'Answer with one JSON object, {{"translations": [{{"id": "...", "translation": "..."}}]}}, that has every one of these ids once, spelled as here: {ids}\n\nParts:\n{parts}'
)
REGIONS = (
    "This picture of {width} x {height} pixels is part of a document in {source}. Find every piece of readable text in it and put it into {target}; leave pictures, logos and ornaments aside. "
    "Give the tightest box of each piece in pixels from the upper left corner. Keep numbers, names and codes as they are.\n"
    'Answer with one JSON object, {{"regions": [{{"bbox": [x0, y0, x1, y1], "source_text": "...", "translation": "...", "confidence": 0.0}}]}}; its list is empty where there is no text.'
)
SYSTEM = "You translate documents and answer with the JSON object that is asked for, and nothing else."


def segment_body(units: list[dict], source: str, target: str, model: str, wording: str = SEGMENTS) -> dict:
    """The request for a batch of units (id, kind, text)."""
    ids = json.dumps([u["id"] for u in units], ensure_ascii=False)
    asked = wording.format(source=source, target=target, ids=ids, parts=json.dumps(units, ensure_ascii=False, indent=1))
    return {"model": model, "temperature": 0, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": asked}]}


def region_body(data_url: str, width: int, height: int, source: str, target: str, model: str, mode: str, most_tokens: int = 6000, wording: str = REGIONS) -> dict:
    """The request for an image; ``mode`` is the response format it asks for, or "text" for none."""
    asked = wording.format(source=source, target=target, width=width, height=height)
    content = [{"type": "text", "text": asked}, {"type": "image_url", "image_url": {"url": data_url}}]
    body = {"model": model, "temperature": 0, "max_tokens": most_tokens, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": content}]}
    return body if mode == "text" else body | {"response_format": {"type": mode}}


def content_of(reply: dict) -> str:
    """The text of a reply's first message: a string, or the texts of its parts."""
    try:
        content = reply["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError):
        raise ServiceError(502, "a reply without a message") from None
    if isinstance(content, list):
        return "".join(str(p.get("text") or "") if isinstance(p, dict) else str(p) for p in content)
    return "" if content is None else str(content)


@dataclass
class ChatBackend:
    """A backend of ``translate`` over a way of sending."""

    send: Send
    source: str
    target: str
    model: str
    wording: str = SEGMENTS

    def translate(self, units: list[dict]) -> str:
        return content_of(self.send(segment_body(units, self.source, self.target, self.model, self.wording)))


@dataclass
class VisionBackend:
    """A backend of ``vision`` over a way of sending."""

    send: Send
    source: str
    target: str
    model: str
    wording: str = REGIONS

    def read(self, data_url: str, width: int, height: int, mode: str) -> str:
        return content_of(self.send(region_body(data_url, width, height, self.source, self.target, self.model, mode, wording=self.wording)))

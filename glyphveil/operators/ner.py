"""Entity recognisers behind HTTP, and the mapping of what they say to spans.

A recogniser that can't be reached or says nonsense finds nothing; a job never fails for it. Answers
are in characters, spans in bytes. Requests go out from the executors, a few at a time, over
connections that each thread keeps open.
"""

from __future__ import annotations

import http.client
import json
import threading
import urllib.parse
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphveil import fixed
from glyphveil.errors import DetectorError
from glyphveil.functions.spans import SPANS

#: (url, body, headers, seconds) -> (status, text)
Post = Callable[[str, dict, dict, float], tuple[int, str]]


_open = threading.local()


def http_post(url: str, body: dict, headers: dict, seconds: float) -> tuple[int, str]:
    """A POST over this thread's connection to the host, which is opened anew if it was closed meanwhile."""
    at = urllib.parse.urlsplit(url)
    if at.scheme not in ("http", "https") or not at.netloc:
        raise ValueError(f"{url!r} is no HTTP address")
    held = _open.__dict__.setdefault("connections", {})
    key = at.scheme, at.netloc, seconds
    for again in (True, False):
        kept = key in held
        if not kept:
            held[key] = (http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection)(at.netloc, timeout=seconds)
        try:
            held[key].request("POST", urllib.parse.urlunsplit(("", "", at.path or "/", at.query, "")), json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
            r = held[key].getresponse()
            return r.status, r.read().decode("utf-8")
        except (http.client.HTTPException, OSError):
            held.pop(key).close()
            if not (kept and again):
                raise
    raise AssertionError


class Recogniser:
    """What drivers share: ask(text) gives rows of (label, start, end, text or None), in characters. parallel: requests at a time of one worker."""

    name = "ner"
    parallel = 4
    labels: dict[str, str]

    def ask(self, text: str) -> list[tuple]:
        raise NotImplementedError

    def spans(self, text: str | None) -> list[dict]:
        if not text:
            return []
        try:
            rows = self.ask(text)
        except Exception:  # noqa: BLE001  whatever it was, it found nothing
            return []
        out = []
        for label, start, end, told in rows:
            try:
                name, start, end = self.labels.get(str(label).upper()), int(start), int(end)
            except (TypeError, ValueError):
                continue
            piece = text[start:end] if name and 0 <= start < end else ""
            if piece:
                value = told if isinstance(told, str) and told else piece
                out.append({"detector": name, "value": value, "offset": len(text[:start].encode()), "length": len(piece.encode())})
        return out

    def detect(self, text: Column) -> Column:
        me = self

        @F.pandas_udf(SPANS)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with ThreadPoolExecutor(me.parallel) as pool:
                for texts in batches:
                    yield pd.Series(list(pool.map(me.spans, texts)))

        return run(text)


class StubRecogniser(Recogniser):
    """Finds nothing, without leaving the JVM."""

    name = "stub"

    def detect(self, text: Column) -> Column:
        return F.array().cast(SPANS)


@dataclass
class HuggingFaceRecogniser(Recogniser):
    """A hosted token classifier: {inputs, options} to {base}/models/{model}; rows of entity_group, start, end. Per-token rows are skipped."""

    api_key: str
    model: str = fixed.HF_MODEL
    base_url: str = fixed.HF_URL
    seconds: float = 30
    labels: dict = field(default_factory=lambda: dict(fixed.HF_LABELS))
    post: Post = http_post
    name: str = "huggingface"

    def __post_init__(self) -> None:
        if not self.api_key:
            raise DetectorError("the recogniser needs an API key")

    def ask(self, text: str) -> list[tuple]:
        status, body = self.post(f"{self.base_url.rstrip('/')}/models/{self.model}", {"inputs": text, "options": {"wait_for_model": True}}, {"Authorization": f"Bearer {self.api_key}"}, self.seconds)
        rows = json.loads(body) if status == 200 else []
        if not isinstance(rows, list):
            return []
        return [(x["entity_group"], x["start"], x["end"], None) for x in rows if isinstance(x, dict) and None not in (x.get("entity_group"), x.get("start"), x.get("end"))]


@dataclass
class SpacyRecogniser(Recogniser):
    """A server of one's own: {text} to its URL; entities of label, start_char, end_char and maybe text, which is then the value."""

    server_url: str
    api_key: str | None = None
    seconds: float = 30
    labels: dict | None = None
    post: Post = http_post
    name: str = "spacy"

    def __post_init__(self) -> None:
        if not self.server_url:
            raise DetectorError("the recogniser needs a server URL")
        self.labels = dict(self.labels if self.labels is not None else fixed.SPACY_LABELS)

    def ask(self, text: str) -> list[tuple]:
        status, body = self.post(self.server_url, {"text": text}, {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}, self.seconds)
        got = json.loads(body) if status == 200 else {}
        rows = got.get("entities") if isinstance(got, dict) else None
        return [(x["label"], x["start_char"], x["end_char"], x.get("text")) for x in rows or [] if isinstance(x, dict) and None not in (x.get("label"), x.get("start_char"), x.get("end_char"))]


def _entity_spans(text: Column, rows: Column, labels: dict[str, str], names: tuple[str, str, str], told: str | None = None) -> Column:
    label, start, end = names
    known = F.create_map(*[F.lit(x) for p in labels.items() for x in p])

    def span(e: Column) -> Column:
        head, piece = F.substring(text, F.lit(1), e[start]), F.substring(text, e[start] + 1, e[end] - e[start])
        value = F.coalesce(F.when(e[told] != "", e[told]), piece) if told else piece
        return F.struct(F.try_element_at(known, F.upper(e[label])).alias("detector"), value.alias("value"), F.octet_length(head).alias("offset"), F.octet_length(piece).alias("length"))

    fine = F.filter(rows, lambda e: (e[start] >= 0) & (e[end] > e[start]))
    return F.coalesce(F.filter(F.transform(fine, span), lambda s: s["detector"].isNotNull() & (s["length"] > 0)), F.array().cast(SPANS))


def entities_from_json(text: Column, body: Column, labels: dict[str, str] = fixed.HF_LABELS) -> Column:
    """Spans from answers that lie in a column already (rows of entity_group, start, end), without Python."""
    rows = F.from_json(body, "array<struct<entity_group: string, start: int, end: int>>")
    return _entity_spans(text, rows, labels, ("entity_group", "start", "end"))


def spacy_entities_from_json(text: Column, body: Column, labels: dict[str, str] = fixed.SPACY_LABELS) -> Column:
    """The same of a server's answers: {entities: [{label, start_char, end_char, text}]}; a text that is told is the value."""
    rows = F.from_json(body, "struct<entities: array<struct<label: string, start_char: int, end_char: int, text: string>>>")["entities"]
    return _entity_spans(text, rows, labels, ("label", "start_char", "end_char"), "text")

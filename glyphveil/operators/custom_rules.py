"""Rules of tenants: patterns that nobody has vetted, run in Python with a time limit.

Java's matcher can't be stopped, so a pattern with catastrophic backtracking would hold a task for
ever; the regex module takes a timeout, after which the rule gives nothing for that text, and is told
in the column of failed rules. The limit counts the worker's CPU seconds, not the wall's, so a busy
machine doesn't shorten it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphveil.errors import CustomRuleError
from glyphveil.functions.spans import SPANS
from glyphveil.sources.rules import load_rules

_FLAGS = {"i": "I", "m": "M", "s": "S", "x": "X"}
#: Those without a meaning here: doubled names are allowed and studying is done anyway, odd escapes are errors anyway.
_NEEDLESS = "JSX"
_LOOP = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})([?+]?)")


def _rewritten(pattern: str, lazy: bool, strict_end: bool) -> str:
    """The pattern with greedy and lazy loops changed for each other, and with $ for the very end of the text; escapes and classes stay."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            step = 2
            out.append(pattern[i : i + step])
        elif c == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end += pattern[end : end + 1] == "]"
            while end < n and pattern[end] != "]":
                named = pattern.find(":]", end) if pattern.startswith("[:", end) else -1
                end = named + 2 if named >= 0 else end + (2 if pattern[end] == "\\" else 1)
            step = end + 1 - i
            out.append(pattern[i : i + step])
        elif c == "(" and pattern.startswith("(?", i):
            step = 2
            out.append("(?")
        elif lazy and (m := _LOOP.match(pattern, i)):
            step = m.end() - i
            loop = m[0][: len(m[0]) - len(m[1])]
            out.append(loop + {"": "?", "?": "", "+": "+"}[m[1]])
        else:
            step = 1
            out.append(r"\Z" if c == "$" and strict_end else c)
        i += step
    return "".join(out)


@dataclass(frozen=True)
class CustomRule:
    """flags: i, m, s, x as usual; u for text rather than bytes; U changes greedy and lazy loops for each other; A takes only matches that begin where the one before ended, the first at the start; D lets $ match at the very end alone, unless m is there; J, S and X change nothing."""

    name: str
    pattern: str
    flags: str = "u"

    def compiled(self):
        """The pattern, compiled when first needed; a bad one is an error."""
        import regex

        bits = regex.V0
        for f in self.flags:
            if f in _FLAGS:
                bits |= getattr(regex, _FLAGS[f])
            elif f not in "uAUD" + _NEEDLESS:
                raise CustomRuleError(f"rule {self.name!r} has flag {f!r}, which isn't supported")
        if "u" not in self.flags:
            bits |= regex.ASCII
        try:
            regex.compile(self.pattern, bits)
            pattern = _rewritten(self.pattern, "U" in self.flags, "D" in self.flags and "m" not in self.flags)
            return regex.compile(rf"\G(?:{pattern}" + ("\n)" if "x" in self.flags else ")") if "A" in self.flags else pattern, bits)
        except regex.error as e:
            raise CustomRuleError(f"rule {self.name!r} has a bad pattern: {e}") from e


@dataclass(frozen=True)
class CustomRuleSet:
    rules: tuple[CustomRule, ...] = ()

    @staticmethod
    def from_list(rows: Iterable) -> CustomRuleSet:
        """From maps with name and pattern, and flags if not u."""
        out = []
        for i, row in enumerate(rows.values() if isinstance(rows, dict) else rows):
            if not isinstance(row, dict):
                raise CustomRuleError(f"rule {i} is no map")
            for key in ("name", "pattern"):
                if not isinstance(row.get(key), str) or not row[key]:
                    raise CustomRuleError(f"rule {i} has no {key}")
            out.append(CustomRule(row["name"], row["pattern"], "u" if row.get("flags") is None else str(row["flags"])))
        return CustomRuleSet(tuple(out))

    @staticmethod
    def load(path: str) -> CustomRuleSet:
        return CustomRuleSet.from_list(load_rules(path))

    def is_empty(self) -> bool:
        return not self.rules

    def count(self) -> int:
        return len(self.rules)


class CustomRuleDetector:
    """All matches of all rules, in order of rules, under the pack's name; empty matches are dropped, overlaps are left to the engine."""

    def __init__(self, name: str, rules: CustomRuleSet, seconds: float = 1.0) -> None:
        self.name, self.rules, self.seconds = name, rules, seconds

    @cached_property
    def _patterns(self) -> list[tuple]:
        return [(r.compiled(), "u" in r.flags) for r in self.rules.rules]

    def spans(self, text: str | None) -> list[dict]:
        return self.tried(text)["spans"]

    def tried(self, text: str | None) -> dict:
        """The spans of a text, and the names of the rules that the limit ended."""
        out: list[dict] = []
        failed: list[str] = []
        if not text:
            return {"spans": out, "failed": failed}
        raw = text.encode("utf-8", "surrogatepass")
        for rule, (pattern, unicode) in zip(self.rules.rules, self._patterns, strict=True):
            # Without u a pattern sees bytes; as Latin-1 each byte is a character.
            seen = text if unicode else raw.decode("latin-1")
            try:
                found = [(m.start(), m.end()) for m in pattern.finditer(seen, timeout=self.seconds) if m.end() > m.start()]
            except TimeoutError:
                failed.append(rule.name)
                continue
            at, byte = 0, 0
            for a, b in found:
                if unicode:
                    byte += len(seen[at:a].encode("utf-8", "surrogatepass"))
                    size = len(seen[a:b].encode("utf-8", "surrogatepass"))
                    value, at = seen[a:b], b
                else:
                    byte, size = a, b - a
                    value = raw[a:b].decode("utf-8", "replace")
                out.append({"detector": self.name, "value": value, "offset": byte, "length": size})
                byte += size
        return {"spans": out, "failed": failed}

    @cached_property
    def _run(self):
        [r.compiled() for r in self.rules.rules]  # a bad pattern is told when the scan is planned, not by a task
        me = CustomRuleDetector(self.name, self.rules, self.seconds)

        @F.pandas_udf(f"struct<spans: {SPANS}, failed: array<string>>")
        def run(texts: pd.Series) -> pd.DataFrame:
            got = [me.tried(t) for t in texts]
            return pd.DataFrame({"spans": [g["spans"] for g in got], "failed": [g["failed"] for g in got]}, columns=["spans", "failed"])

        return run

    def detect(self, text: Column) -> Column:
        return self._run(text)["spans"]

    def failed(self, text: Column) -> Column:
        """The names of the rules that the limit ended for this text; empty if its spans are complete. Computed with detect(), not again."""
        return self._run(text)["failed"]


def registered(engine, packs: Sequence, auto: bool = True):
    """engine with a detector for each {name, path} of packs; a malformed entry or file is an error."""
    for entry in packs if auto else ():
        if not isinstance(entry, dict) or not entry.get("name") or not entry.get("path"):
            raise CustomRuleError("a pack entry needs name and path")
        engine = engine.register(CustomRuleDetector(entry["name"], CustomRuleSet.load(entry["path"])))
    return engine


INSPECTED = "name string, path string, exists boolean, readable boolean, rule_count int, valid boolean, error string"


def inspect_packs(spark: SparkSession, packs: Sequence) -> DataFrame:
    """What can be said of each configured pack, without ever failing."""
    rows = []
    for entry in packs:
        get = lambda k: entry[k] if isinstance(entry, dict) and isinstance(entry.get(k), str) else ""  # noqa: B023, E731
        name, path = get("name"), get("path")
        count, valid, error = 0, False, None
        if not name or not path:
            error = "a pack entry needs name and path"
        else:
            try:
                count, valid = CustomRuleSet.load(path).count(), True
            except Exception as e:  # noqa: BLE001  told in the report instead
                error = str(e)
        rows.append((name, path, bool(path) and os.path.isfile(path), bool(path) and os.access(path, os.R_OK), count, valid, error))
    return spark.createDataFrame(rows, INSPECTED)

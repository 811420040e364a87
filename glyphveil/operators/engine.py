"""The engine: detectors in order, a strategy, and what they make of a text column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphveil.errors import DetectorError
from glyphveil.functions.kernels import once
from glyphveil.functions.spans import SPANS, resolve, weave
from glyphveil.operators import reports
from glyphveil.operators.detectors import DEFAULTS, Detector
from glyphveil.operators.strategies import Mask, Strategy


@dataclass(frozen=True)
class Engine:
    """Immutable: every with_ and register gives a new engine. ner is asked last.

    everywhere: a detected value is replaced wherever else it occurs between the detections of its text, also
    where no detector takes it, as within a longer number. Detections, reports and audits stay as they are.
    """

    strategy: Strategy = field(default_factory=Mask)
    detectors: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    audit: bool = False
    ner: Any = None
    everywhere: bool = False

    def register(self, detector: Detector) -> Engine:
        """With the detector; one of the same name is replaced in its place."""
        if not detector.name:
            raise DetectorError("a detector needs a name")
        return replace(self, detectors=self.detectors | {detector.name: detector})

    def extend(self, alias: str, detector: Detector) -> Engine:
        if alias != detector.name:
            raise DetectorError(f"{alias!r} isn't the detector's name {detector.name!r}")
        return self.register(detector)

    def with_strategy(self, strategy: Strategy) -> Engine:
        return replace(self, strategy=strategy)

    def with_enabled(self, enabled: bool) -> Engine:
        return replace(self, enabled=enabled)

    def with_audit(self, audit: bool) -> Engine:
        return replace(self, audit=audit)

    def with_ner(self, ner: Any) -> Engine:
        return replace(self, ner=ner)

    def with_everywhere(self, everywhere: bool) -> Engine:
        return replace(self, everywhere=everywhere)

    def collect(self, text: Column) -> Column:
        """All detections in order of registration, recognised entities last; empty for null or empty text."""
        parts = [d.detect(text) for d in self.detectors.values()] + ([self.ner.detect(text)] if self.ner else [])
        none = F.array().cast(SPANS)
        return F.coalesce(F.concat(*parts), none) if parts else none

    def detections(self, text: Column) -> Column:
        """Detections without overlaps, in order of place."""
        return resolve(self.collect(text))

    def scan(self, text: Column) -> Column:
        """A report struct (total, counts, samples), also if the engine isn't enabled."""
        return once(self.detections(text), reports.report)

    def replaced(self, text: Column, spans: Column, strategy: Strategy | None = None) -> Column:
        """text with resolved spans replaced by the strategy."""
        s = strategy or self.strategy
        if hasattr(s, "apply_all"):
            return once(s.apply_all(spans), lambda new: weave(text, F.zip_with(spans, new, lambda x, n: F.struct(*[x[c].alias(c) for c in ("detector", "value", "offset", "length")], n.alias("new"))), lambda x: x["new"], self.everywhere))
        return weave(text, spans, lambda x: s.apply(x["value"], x["detector"]), self.everywhere)

    def redact(self, text: Column, strategy: Strategy | None = None) -> Column:
        """text with its detections replaced; as it was if the engine isn't enabled; null for null."""
        if not self.enabled:
            return text
        if hasattr(strategy or self.strategy, "apply_all"):
            return self.replaced(text, self.detections(text), strategy)
        return once(self.detections(text), lambda spans: self.replaced(text, spans, strategy))

    def audited(self, spans: Column) -> Column:
        """Counts, total and strategy of a redaction, without values; null without detections, or if audits are off."""
        struct = F.struct(reports.counts(spans).alias("counts"), F.size(spans).alias("total"), F.lit(self.strategy.name).alias("strategy"))
        return F.when((F.size(spans) > 0) & F.lit(self.audit and self.enabled), struct)

    def apply(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with detections, redacted and audit. The spans are computed once; nothing is shuffled."""
        df = df.withColumn("detections", self.detections(F.col(text)))
        redacted = self.replaced(F.col(text), F.col("detections")) if self.enabled else F.col(text)
        return df.withColumn("redacted", redacted).withColumn("audit", self.audited(F.col("detections")))


def default_engine(*more: Detector, strategy: Strategy | None = None) -> Engine:
    """IBANs, e-mail addresses and cards, and the detectors given."""
    e = Engine(strategy or Mask())
    for d in (*DEFAULTS, *more):
        e = e.register(d)
    return e

"""The built-in detectors: a pattern, a checksum, a name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphveil import fixed
from glyphveil.functions import kernels
from glyphveil.functions.spans import SPANS, matches, named


@runtime_checkable
class Detector(Protocol):
    """name, and detect(text): an array of spans (detector, value, offset, length) with byte offsets."""

    name: str

    def detect(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class PatternDetector:
    """Matches of the patterns that the check accepts.

    hint: what the text must hold for any match; rows without it skip the patterns. Several patterns
    give each place once, in order of places.
    """

    name: str
    patterns: tuple[str, ...]
    check: Callable[[Column], Column] | None = None
    hint: Callable[[Column], Column] | None = None

    def detect(self, text: Column) -> Column:
        found = [matches(text, p) for p in self.patterns]
        spans = found[0]
        if len(found) > 1:
            ranked = F.transform(F.concat(*found), lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["value"].alias("value")))
            spans = F.array_sort(F.array_distinct(ranked))
        if self.check:
            spans = F.filter(spans, lambda x: self.check(x["value"]))
        spans = named(spans, self.name)
        none = F.array().cast(SPANS)
        return F.when(self.hint(text), spans).otherwise(none) if self.hint else spans


def _some_digit(t: Column) -> Column:
    return t.rlike("[0-9]")


def _some_iban(t: Column) -> Column:
    return t.rlike("[A-Za-z]{2}[0-9]{2}[ A-Za-z0-9]")


def _some_card(t: Column) -> Column:
    return t.rlike("(?:[0-9][ \\-]?){12}[0-9]")


EMAIL = PatternDetector("email", (fixed.EMAIL,), None, lambda t: F.contains(t, F.lit("@")))
IBAN = PatternDetector("iban", (fixed.IBAN_COMPACT, fixed.IBAN_SPACED), kernels.iban, _some_iban)
CREDIT_CARD = PatternDetector("credit_card", (fixed.CREDIT_CARD,), kernels.credit_card, _some_card)
CODICE_FISCALE = PatternDetector("codice_fiscale", (fixed.CODICE_FISCALE,), kernels.codice_fiscale)
P_IVA = PatternDetector("p_iva", (fixed.ELEVEN_DIGITS,), kernels.luhn, _some_digit)
PHONE_IT = PatternDetector("phone_it", (fixed.PHONE_IT,), kernels.phone_it, _some_digit)
ADDRESS_IT = PatternDetector("address_it", (fixed.ADDRESS_IT,))
STEUER_ID = PatternDetector("steuer_id", (fixed.ELEVEN_DIGITS,), kernels.steuer_id, _some_digit)
UST_IDNR = PatternDetector("ust_idnr", (fixed.UST_IDNR,), kernels.ust_idnr, _some_digit)
PHONE_DE = PatternDetector("phone_de", (fixed.PHONE_DE,), kernels.phone_de, _some_digit)
ADDRESS_DE = PatternDetector("address_de", (fixed.ADDRESS_DE,))
DNI = PatternDetector("dni", (fixed.DNI,), kernels.dni, _some_digit)
NIE = PatternDetector("nie", (fixed.NIE,), kernels.nie, _some_digit)
CIF = PatternDetector("cif", (fixed.CIF,), kernels.cif, _some_digit)
PHONE_ES = PatternDetector("phone_es", (fixed.PHONE_ES,), kernels.phone_es, _some_digit)
ADDRESS_ES = PatternDetector("address_es", (fixed.ADDRESS_ES,))

#: Registered before packs, in this order.
DEFAULTS = (IBAN, EMAIL, CREDIT_CARD)
BUILT_IN = {d.name: d for d in (EMAIL, IBAN, CREDIT_CARD, CODICE_FISCALE, P_IVA, PHONE_IT, ADDRESS_IT, STEUER_ID, UST_IDNR, PHONE_DE, ADDRESS_DE, DNI, NIE, CIF, PHONE_ES, ADDRESS_ES)}

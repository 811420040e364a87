"""Packs: the detectors of a country, under a name."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from glyphveil.errors import PackError
from glyphveil.operators import detectors as d


@dataclass(frozen=True)
class Pack:
    name: str
    country_code: str
    description: str
    detectors: tuple


ITALY = Pack("italy", "IT", "Italian fiscal codes, VAT numbers, phone numbers and addresses", (d.CODICE_FISCALE, d.P_IVA, d.PHONE_IT, d.ADDRESS_IT))
GERMANY = Pack("germany", "DE", "German tax ids, VAT numbers, phone numbers and addresses", (d.STEUER_ID, d.UST_IDNR, d.PHONE_DE, d.ADDRESS_DE))
SPAIN = Pack("spain", "ES", "Spanish identity and company numbers, phone numbers and addresses", (d.DNI, d.NIE, d.CIF, d.PHONE_ES, d.ADDRESS_ES))
KNOWN = {p.name: p for p in (ITALY, GERMANY, SPAIN)}


class PackRegistry:
    """Packs by name or as objects, in order; the first that isn't a pack is an error."""

    def __init__(self, entries: Iterable) -> None:
        self.entries = list(entries)

    def packs(self) -> list[Pack]:
        out = []
        for x in self.entries:
            p = KNOWN.get(x) if isinstance(x, str) else x
            if p is None:
                raise PackError(f"there is no pack {x!r}")
            if not isinstance(p, Pack):
                raise PackError(f"{x!r} is no pack")
            out.append(p)
        return out

    def detectors(self) -> list:
        """All packs' detectors in order; the same one twice if two packs have it."""
        out = []
        for p in self.packs():
            for x in p.detectors:
                if not isinstance(x, d.Detector):
                    raise PackError(f"pack {p.name} has an entry that is no detector: {x!r}")
                out.append(x)
        return out

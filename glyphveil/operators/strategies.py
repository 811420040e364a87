"""What stands in place of a detected value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphveil.errors import StrategyError
from glyphveil.fixed import LEGACY_TENANT, MASK, TOKEN_WHOLE
from glyphveil.functions.spans import SPANS
from glyphveil.tenancy import Tenant, tenant_column


@runtime_checkable
class Strategy(Protocol):
    """name, and apply(value, detector) as columns."""

    name: str

    def apply(self, value: Column, detector: Column) -> Column: ...


@dataclass(frozen=True)
class Mask:
    token: str = MASK
    name: str = "mask"

    def apply(self, value: Column, detector: Column) -> Column:
        return F.lit(self.token)


@dataclass(frozen=True)
class Hash:
    """[hash:...] of detector, salt and value."""

    salt: str
    size: int = 16
    name: str = "hash"

    def __post_init__(self) -> None:
        if not self.salt:
            raise StrategyError("hash needs a salt")
        if not 4 <= self.size <= 64:
            raise StrategyError("hash takes 4 to 64 digits")

    def apply(self, value: Column, detector: Column) -> Column:
        return F.concat(F.lit("[hash:"), F.sha2(F.concat_ws(":", detector, F.lit(self.salt), value), 256).substr(1, self.size), F.lit("]"))


@dataclass(frozen=True)
class Tokenise:
    """[tok:detector:...] of salt, detector and value. Tenants other than the legacy one have the salt to themselves.

    tenant may be a column, so that one plan serves rows of many tenants. Tokens are pure functions of
    their row; storing them is a step of its own (token_entries, then a store's put).
    """

    salt: str
    size: int = 16
    tenant: Tenant = None
    legacy: str = LEGACY_TENANT
    name: str = "tokenise"

    def __post_init__(self) -> None:
        if not self.salt:
            raise StrategyError("tokenise needs a salt")
        if not 8 <= self.size <= 64:
            raise StrategyError("tokenise takes 8 to 64 digits")

    def effective_salt(self) -> Column:
        if self.tenant is None:
            return F.lit(self.salt)
        t = tenant_column(self.tenant, self.legacy)
        return F.when(t == self.legacy, F.lit(self.salt)).otherwise(F.concat(F.lit(f"{self.salt}:"), t))

    def apply(self, value: Column, detector: Column) -> Column:
        return F.concat(F.lit("[tok:"), detector, F.lit(":"), F.sha2(F.concat_ws(":", self.effective_salt(), detector, value), 256).substr(1, self.size), F.lit("]"))


@dataclass(frozen=True)
class Drop:
    name: str = "drop"

    def apply(self, value: Column, detector: Column) -> Column:
        return F.lit("")


@dataclass(frozen=True)
class FunctionStrategy:
    """A caller's function of two columns."""

    name: str
    make: Callable[[Column, Column], Column]

    def apply(self, value: Column, detector: Column) -> Column:
        return self.make(value, detector)


@dataclass(frozen=True)
class PythonStrategy:
    """A caller's Python function (value, detector) -> str, called for each distinct pair of an Arrow batch.

    It can't be called within an expression, so the engine asks for all replacements of a row's spans at once.
    """

    name: str
    make: Callable[[str, str], str]

    def apply(self, value: Column, detector: Column) -> Column:
        raise StrategyError("a Python strategy works on whole arrays of spans")

    def apply_all(self, spans: Column) -> Column:
        make = self.make

        @F.pandas_udf("array<string>")
        def replaced(all_: pd.Series) -> pd.Series:
            known: dict[tuple[str, str], str] = {}
            out = []
            for row in all_:
                new = []
                for x in row if row is not None else ():
                    key = x["value"], x["detector"]
                    if key not in known:
                        known[key] = make(*key)
                    new.append(known[key])
                out.append(new)
            return pd.Series(out)

        return replaced(F.coalesce(spans, F.array().cast(SPANS)))


NAMES = ("mask", "hash", "tokenise", "drop")


def make_strategy(name: str, salt: str = "", mask_token: str = MASK, hash_size: int = 16, token_size: int = 16, tenant: Tenant = None) -> Strategy:
    """The strategy of that name; hash and tokenise need a salt."""
    if name == "mask":
        return Mask(mask_token)
    if name == "hash":
        return Hash(salt, hash_size)
    if name == "tokenise":
        return Tokenise(salt, token_size, tenant)
    if name == "drop":
        return Drop()
    raise StrategyError(f"there is no strategy {name!r}; there are {', '.join(NAMES)}")


def token_detector(token: Column) -> Column:
    """The detector that a token names, unknown if it has another form."""
    return F.when(token.rlike(TOKEN_WHOLE), F.regexp_extract(token, TOKEN_WHOLE, 1)).otherwise("unknown")

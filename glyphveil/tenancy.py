"""Whose data it is: a constant, a column, or what a callable says when a plan is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphveil.fixed import LEGACY_TENANT


def default_tenant(tenant: str | None = None) -> str:
    """The tenant, or the default one if it is null or empty; "0" is a tenant."""
    return tenant if tenant not in (None, "") else LEGACY_TENANT


class LazyTenant:
    """Asks again at each use. A resolver that was bound to this object itself gives the fallback."""

    def __init__(self, resolve: Callable[[], object] | None = None, fallback: str | None = None) -> None:
        self.resolve, self.fallback = resolve, fallback

    def __call__(self) -> str:
        got = self.resolve() if self.resolve and self.resolve is not self else self
        if got is self or isinstance(got, LazyTenant):
            return default_tenant(self.fallback)
        return got() if callable(got) else str(got)


Tenant = Column | str | Callable[[], str] | None


def tenant_column(tenant: Tenant, legacy: str = LEGACY_TENANT) -> Column:
    if tenant is None:
        return F.lit(legacy)
    if isinstance(tenant, Column):
        return tenant
    return F.lit(tenant() if callable(tenant) else default_tenant(tenant))

"""Settings, with their environment variables, and what is built from them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from glyphveil import fixed
from glyphveil.errors import DetectorError, RedactorError
from glyphveil.operators import custom_rules, ner
from glyphveil.operators.detectors import BUILT_IN
from glyphveil.operators.engine import Engine
from glyphveil.operators.packs import ITALY, PackRegistry
from glyphveil.operators.strategies import Strategy, make_strategy
from glyphveil.tenancy import Tenant


@dataclass
class Config:
    """The defaults hold where neither argument nor environment says otherwise."""

    enabled: bool = True
    strategy: str = "mask"
    salt: str = ""
    mask_token: str = fixed.MASK
    hash_hex_length: int = 16
    token_hex_length: int = 16
    detectors: tuple = ("iban", "email", "credit_card")
    audit_trail_enabled: bool = False
    audit_trail: bool = False
    ner_enabled: bool = False
    ner_driver: Any = "stub"
    huggingface_api_key: str = ""
    huggingface_model: str = fixed.HF_MODEL
    huggingface_base_url: str = fixed.HF_URL
    huggingface_timeout: int = 30
    spacy_server_url: str = ""
    spacy_api_key: str | None = None
    spacy_timeout: int = 30
    spacy_entity_map: dict | None = None
    token_store: str = "memory"
    token_store_path: str = "pii_token_maps"
    token_store_prefix: str = "pii_token:"
    token_store_ttl: int = 0
    default_tenant: str = fixed.LEGACY_TENANT
    custom_rules_auto_register: bool = False
    custom_rule_packs: list = field(default_factory=list)
    packs: tuple = (ITALY,)


#: Environment variables of the fields above.
VARIABLES = {
    "enabled": "PII_REDACTOR_ENABLED",
    "strategy": "PII_REDACTOR_STRATEGY",
    "salt": "PII_REDACTOR_SALT",
    "mask_token": "PII_REDACTOR_MASK_TOKEN",
    "hash_hex_length": "PII_REDACTOR_HASH_LENGTH",
    "token_hex_length": "PII_REDACTOR_TOKEN_LENGTH",
    "audit_trail_enabled": "PII_REDACTOR_AUDIT_TRAIL",
    "audit_trail": "PII_REDACTOR_AUDIT_TRAIL_V2",
    "ner_enabled": "PII_REDACTOR_NER_ENABLED",
    "ner_driver": "PII_REDACTOR_NER_DRIVER",
    "huggingface_api_key": "PII_REDACTOR_HUGGINGFACE_API_KEY",
    "huggingface_model": "PII_REDACTOR_HUGGINGFACE_MODEL",
    "huggingface_base_url": "PII_REDACTOR_HUGGINGFACE_BASE_URL",
    "huggingface_timeout": "PII_REDACTOR_HUGGINGFACE_TIMEOUT",
    "spacy_server_url": "PII_REDACTOR_SPACY_SERVER_URL",
    "spacy_api_key": "PII_REDACTOR_SPACY_API_KEY",
    "spacy_timeout": "PII_REDACTOR_SPACY_TIMEOUT",
    "token_store": "PII_REDACTOR_TOKEN_STORE",
    "token_store_path": "PII_REDACTOR_TOKEN_STORE_TABLE",
    "token_store_prefix": "PII_REDACTOR_TOKEN_STORE_CACHE_PREFIX",
    "token_store_ttl": "PII_REDACTOR_TOKEN_STORE_CACHE_TTL",
    "default_tenant": "PII_REDACTOR_DEFAULT_TENANT_ID",
    "custom_rules_auto_register": "PII_REDACTOR_CUSTOM_RULES_AUTO_REGISTER",
}


def from_environment(env: Mapping[str, str] | None = None, **given: Any) -> Config:
    env = os.environ if env is None else env
    out = Config()
    for name, variable in VARIABLES.items():
        if (raw := env.get(variable)) is not None:
            kind = type(getattr(out, name))
            setattr(out, name, raw.strip().lower() in ("1", "true", "on", "yes") if kind is bool else int(raw) if kind is int else raw)
    if VARIABLES["audit_trail"] not in env and out.audit_trail_enabled:
        out.audit_trail = True
    for name, value in given.items():
        setattr(out, name, value)
    return out


def build_strategy(c: Config, tenant: Tenant = None) -> Strategy:
    return make_strategy(c.strategy, c.salt, c.mask_token, c.hash_hex_length, c.token_hex_length, tenant)


def build_ner(c: Config):
    """The recogniser; a stub if it is off or unknown. An object that is none is an error."""
    if not c.ner_enabled:
        return ner.StubRecogniser()
    if c.ner_driver == "huggingface":
        return ner.HuggingFaceRecogniser(c.huggingface_api_key, c.huggingface_model, c.huggingface_base_url, c.huggingface_timeout)
    if c.ner_driver == "spacy":
        return ner.SpacyRecogniser(c.spacy_server_url, c.spacy_api_key, c.spacy_timeout, c.spacy_entity_map)
    if isinstance(c.ner_driver, str):
        return ner.StubRecogniser()
    if not isinstance(c.ner_driver, ner.Recogniser):
        raise DetectorError(f"{c.ner_driver!r} is no recogniser")
    return c.ner_driver


def build_engine(c: Config, tenant: Tenant = None) -> Engine:
    """Detectors by name or as objects (unknown names are skipped), then packs, then rule packs, then the recogniser."""
    e = Engine(build_strategy(c, tenant), {}, c.enabled, c.audit_trail or c.audit_trail_enabled, build_ner(c) if c.ner_enabled else None)
    for d in c.detectors:
        d = BUILT_IN.get(d) if isinstance(d, str) else d
        if d is not None:
            e = e.register(d)
    for d in PackRegistry(c.packs).detectors():
        e = e.register(d)
    return custom_rules.registered(e, c.custom_rule_packs, c.custom_rules_auto_register)


def build_store(spark: SparkSession, c: Config):
    from glyphveil.sources import vault

    if c.token_store == "memory":
        return vault.MemoryStore(spark)
    if c.token_store == "database":
        return vault.TableStore(spark, c.token_store_path, c.default_tenant)
    if c.token_store == "cache":
        return vault.ExpiringStore(spark, c.token_store_path, c.token_store_prefix, c.token_store_ttl, c.default_tenant)
    raise RedactorError(f"there is no token store {c.token_store!r}")

"""What is configured, without secrets, as a table of one row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from glyphveil.operators.detectors import BUILT_IN
from glyphveil.operators.packs import PackRegistry
from glyphveil.sources.config import Config

_STORES = {"memory": "MemoryStore", "database": "TableStore", "cache": "ExpiringStore"}
SNAPSHOT = (
    "enabled boolean, default_strategy string, audit_trail_enabled boolean, token_store struct<driver: string, class: string>, "
    "ner struct<enabled: boolean, driver: string, configured: boolean>, detectors array<struct<name: string, class: string>>, "
    "packs array<struct<name: string, country_code: string, description: string, class: string>>, "
    "custom_rules struct<auto_register: boolean, configured_count: int>"
)


def snapshot(spark: SparkSession, c: Config) -> DataFrame:
    """Never salts or keys: they aren't read."""
    registry = PackRegistry(c.packs)
    listed = [BUILT_IN.get(d) if isinstance(d, str) else d for d in c.detectors]
    by_name = {d.name: type(d).__name__ for d in [*listed, *registry.detectors()] if d is not None}
    driver = c.ner_driver if isinstance(c.ner_driver, str) else type(c.ner_driver).__name__
    configured = {"huggingface": bool(c.huggingface_api_key), "spacy": bool(c.spacy_server_url), "stub": True}.get(driver, False)
    row = (
        c.enabled,
        c.strategy,
        c.audit_trail or c.audit_trail_enabled,
        (c.token_store, _STORES.get(c.token_store, "unknown")),
        (c.ner_enabled, driver, c.ner_enabled and configured),
        list(by_name.items()),
        [(p.name, p.country_code, p.description, type(p).__name__) for p in registry.packs()],
        (c.custom_rules_auto_register, len(c.custom_rule_packs)),
    )
    return spark.createDataFrame([row], SNAPSHOT)


def snapshot_json(spark: SparkSession, c: Config) -> str:
    return json.dumps(snapshot(spark, c).first().asDict(recursive=True), ensure_ascii=False)

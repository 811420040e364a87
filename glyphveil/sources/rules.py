"""Rule files: YAML with a list `rules`."""

from __future__ import annotations

import os

from glyphveil.errors import CustomRuleError


def load_rules(path: str) -> list:
    """The entries under `rules`; none if the file is empty or says nothing of rules."""
    try:
        import yaml
    except ImportError as e:
        raise CustomRuleError("rule files need PyYAML") from e
    if not os.path.isfile(path) or not os.access(path, os.R_OK):
        raise CustomRuleError(f"{path} isn't there or can't be read")
    try:
        with open(path, encoding="utf-8") as f:
            got = yaml.safe_load(f)
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise CustomRuleError(f"{path} is malformed: {e}") from e
    rules = got.get("rules") if isinstance(got, dict) else None
    if rules is None:
        return []
    if not isinstance(rules, list | dict):
        raise CustomRuleError(f"{path}: rules must be a list")
    return rules if isinstance(rules, list) else list(rules.values())

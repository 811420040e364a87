"""Exceptions of the library."""


class RedactorError(Exception):
    """Base of all."""


class DetectorError(RedactorError):
    """A detector with an empty name, or registered under another than its own."""


class StrategyError(RedactorError):
    """A strategy that is unknown, or lacks what it needs."""


class PackError(RedactorError):
    """A pack that doesn't exist, or whose detectors aren't detectors."""


class CustomRuleError(RedactorError):
    """A rule or rule file that can't be used."""

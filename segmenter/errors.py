"""Typed errors: usability guards (S5, P2), commits of keyed tables."""


class DataQualityError(ValueError):
    """The input cannot be analysed (empty, no header, too few rows, missing columns)."""


class ConflictError(RuntimeError):
    """Another writer committed the version first."""

"""Registered queries, grouped by subject."""

from importlib import import_module

SUBJECTS = (
    "metrics", "framing", "splits", "projection", "transforms", "fitting", "perturbation",
    "selecting", "relating", "auditing", "resampling", "deciding", "files", "streams", "extending",
)


def load():
    """(queries, sql) of every subject, imported once."""
    from . import base

    for subject in SUBJECTS:
        import_module(f"{__name__}.{subject}")
    return dict(base.QUERIES), dict(base.SQL)

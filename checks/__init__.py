"""Queries over the given tables and the SQL each of them must agree with."""

from importlib import import_module

PARTS = ["prep", "order", "scores", "rank", "spectra", "projections", "features", "study"]


def registry() -> dict:
    """{name: (spark query, SQL or None)} over all parts."""
    out: dict = {}
    for part in PARTS:
        out.update(import_module(f"checks.{part}").QUERIES)
    return out

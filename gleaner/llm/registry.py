"""Queries of this subpackage and their DuckDB counterparts."""

from importlib import import_module

MODULES = ("quality", "toxicity", "rules", "mixing", "decontam", "sharding", "extract", "substrings", "chat", "simhash")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")

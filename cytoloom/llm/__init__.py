"""Operators for training data. Nothing else in the library imports this subpackage."""

from importlib import import_module

_MODULES: list[str] = ["similar", "topn", "split", "peaks", "pack", "mix", "truncated"]


def _collect(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"cytoloom.llm.{m}"), what)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")

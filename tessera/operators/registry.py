"""The slug registry. An operator is ``f(inputs, **params) -> dict``: inputs and outputs are DataFrames (or models) by port."""

from __future__ import annotations

from collections.abc import Callable

OPERATORS: dict[str, Callable] = {}
IN, IN1, IN2, OUT = "input data", "input data 1", "input data 2", "output data"


class ParameterError(ValueError):
    """A required parameter is absent or has a value the operator does not take."""


def operator(*slugs: str):
    def add(f):
        for s in slugs:
            OPERATORS[s] = f
        return f

    return add


def run(slug: str, inputs: dict | None = None, **params) -> dict:
    _load()
    if slug not in OPERATORS:
        raise ParameterError(f"unknown operator: {slug}")
    return OPERATORS[slug](inputs or {}, **params)


def need(value, name: str):
    if value is None or value == [] or value == "":
        raise ParameterError(f"parameter {name} is required")
    return value


def names(value) -> list[str]:
    """One name or a list of them, as a list."""
    return [value] if isinstance(value, str) else list(value or [])


def flag(value) -> bool:
    return value in (True, 1, "1", "true", "True", "yes", "on")


def _load() -> None:
    from tessera.operators import geo, linkage, mining, ml, modes, neural, privacy, profile, quality, relational, routes, sgd, stats, strings, survival, text  # noqa: F401
    from tessera.sources import readers, writers  # noqa: F401

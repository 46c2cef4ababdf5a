"""Operators: functions from named DataFrames and parameters to named DataFrames, found by slug."""

from tessera.operators.registry import OPERATORS, operator, run  # noqa: F401

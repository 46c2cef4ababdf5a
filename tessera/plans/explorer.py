"""Verb pipelines: a table goes through steps one after another; other tables come in by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.registry import IN1, IN2, run

_TWO = {"join", "concat-rows", "add-rows", "set-intersection", "intersection", "difference", "add-columns"}


class Explorer:
    """``Explorer(df).step('filter', formula=...).step('sort', ...).df``; every step is lazy."""

    def __init__(self, df: DataFrame, tables: dict[str, DataFrame] | None = None):
        self.df, self.tables, self.steps = df, tables or {}, []

    def step(self, slug: str, data_source: str | None = None, **params) -> Explorer:
        inputs = {IN1: self.df, IN2: self.tables[data_source]} if slug in _TWO else {"input data": self.df}
        if slug == "group" and not params.get("attributes"):
            return self
        if slug == "split" and "delimiter" in params:
            slug = "split-text"
        made = Explorer(run(slug, inputs, **params)["output data"], self.tables)
        made.steps = [*self.steps, (slug, params)]
        return made

    def preview(self, rows: int = 50, most: int = 1000) -> list[dict]:
        return [r.asDict() for r in self.df.limit(min(rows, most)).collect()]


def explore(df: DataFrame, steps: list[dict], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Steps [{slug, ...}] in their order."""
    e = Explorer(df, tables)
    for s in steps:
        s = dict(s)
        e = e.step(s.pop("slug"), **s)
    return e.df

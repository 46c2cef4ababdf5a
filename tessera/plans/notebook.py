"""SQL notebooks: cells are queries over tables and earlier cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Notebook:
    """Each named cell becomes a view that later cells may read; {name} in a query is a variable."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, **variables):
        self.spark, self.variables, self.results = spark, variables, {}
        for name, df in (tables or {}).items():
            df.createOrReplaceTempView(name)

    def sql(self, query: str, name: str | None = None, save: str | None = None, mode: str = "overwrite") -> DataFrame:
        text = query.format(**self.variables) if self.variables and "{" in query else query
        df = self.spark.sql(text)
        return self._keep(df, name, save, mode)

    def python(self, f: Callable, name: str | None = None) -> DataFrame:
        """A trusted callable of (spark, results of named cells)."""
        return self._keep(f(self.spark, dict(self.results)), name, None, "overwrite")

    def _keep(self, df: DataFrame, name, save, mode) -> DataFrame:
        if name:
            df.createOrReplaceTempView(name)
            self.results[name] = df
        if save:
            df.write.mode(mode).parquet(save)
        return df

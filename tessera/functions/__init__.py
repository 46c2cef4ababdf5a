"""The expression language: trees of calls, operators, columns and literals, compiled to Spark columns."""

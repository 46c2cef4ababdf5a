"""A PySpark-native analytics engine: operators, functions, sources and workflows that are DataFrames from end to end."""

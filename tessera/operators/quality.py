"""Expectations about columns and tables; all that look at single rows are answered in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.registry import IN, OUT, ParameterError, need, operator

#: Expectations by name: the condition under which a row is unexpected (rows with null are left out unless it is about null).
ROWS = {
    "expect_column_values_to_not_be_null": lambda c, **_: c.isNull(),
    "expect_column_values_to_be_null": lambda c, **_: c.isNotNull(),
    "expect_column_values_to_be_between": lambda c, min_value=None, max_value=None, strict_min=False, strict_max=False, **_: _outside(c, min_value, max_value, strict_min, strict_max),
    "expect_column_values_to_be_in_set": lambda c, value_set=(), **_: ~c.isin(list(value_set)),
    "expect_column_values_to_not_be_in_set": lambda c, value_set=(), **_: c.isin(list(value_set)),
    "expect_column_values_to_match_regex": lambda c, regex=None, **_: ~c.rlike(regex),
    "expect_column_values_to_not_match_regex": lambda c, regex=None, **_: c.rlike(regex),
    "expect_column_values_to_match_like_pattern": lambda c, like_pattern=None, **_: ~c.like(like_pattern),
    "expect_column_value_lengths_to_be_between": lambda c, min_value=None, max_value=None, **_: _outside(F.length(c), min_value, max_value, False, False),
    "expect_column_value_lengths_to_equal": lambda c, value=None, **_: F.length(c) != value,
    "expect_column_values_to_be_dateutil_parseable": lambda c, **_: F.try_to_timestamp(c).isNull(),
    "expect_column_values_to_be_json_parseable": lambda c, **_: F.try_parse_json(c).isNull(),
    "expect_column_values_to_match_strftime_format": lambda c, strftime_format=None, **_: F.try_to_timestamp(c, F.lit(strftime_format)).isNull(),
    "expect_column_pair_values_to_be_equal": lambda c, other=None, **_: ~c.eqNullSafe(F.col(other)),
    "expect_column_pair_values_a_to_be_greater_than_b": lambda c, other=None, or_equal=False, **_: c < F.col(other) if or_equal else c <= F.col(other),
}
#: Expectations about one number of a column.
AGGREGATED = {
    "expect_column_max_to_be_between": F.max, "expect_column_min_to_be_between": F.min, "expect_column_mean_to_be_between": F.avg, "expect_column_median_to_be_between": F.median,
    "expect_column_stdev_to_be_between": F.stddev, "expect_column_sum_to_be_between": F.sum, "expect_column_unique_value_count_to_be_between": F.count_distinct,
    "expect_column_proportion_of_unique_values_to_be_between": lambda c: F.count_distinct(c) / F.count(c), "expect_column_most_common_value_to_be_in_set": lambda c: F.mode(c, True),
}
_ABOUT_NULL = {"expect_column_values_to_not_be_null", "expect_column_values_to_be_null", "expect_column_pair_values_to_be_equal"}


def _outside(c: Column, lo, hi, strict_lo, strict_hi) -> Column:
    bad = F.lit(False)
    if lo is not None:
        bad = bad | ((c <= lo) if strict_lo else (c < lo))
    if hi is not None:
        bad = bad | ((c >= hi) if strict_hi else (c > hi))
    return bad


def check(df: DataFrame, expectations: list[dict]) -> DataFrame:
    """One row an expectation {expectation, column, ...}: success, element_count, unexpected_count, unexpected_percent, observed."""
    rows, sums = [], [F.count("*").alias("_n")]
    for i, e in enumerate(expectations):
        kind, column = need(e.get("expectation"), "expectation"), e.get("column")
        extra = {k: v for k, v in e.items() if k not in ("expectation", "column", "mostly")}
        if kind in ROWS:
            c = F.col(column)
            bad = ROWS[kind](c, **extra)
            if kind not in _ABOUT_NULL:
                bad = bad & c.isNotNull()
            sums += [F.count_if(bad).alias(f"u{i}"), F.count_if(c.isNotNull()).alias(f"s{i}")]
        elif kind in AGGREGATED:
            sums.append(AGGREGATED[kind](F.col(column)).alias(f"o{i}"))
    row = df.agg(*sums).first()
    total = row["_n"]
    for i, e in enumerate(expectations):
        kind, column = e["expectation"], e.get("column")
        bad, observed = None, None
        if kind in ROWS:
            bad = row[f"u{i}"]
            looked = total if kind in _ABOUT_NULL else row[f"s{i}"]
            ok = bad <= (1 - float(e.get("mostly", 1))) * looked + 1e-9
        elif kind in AGGREGATED:
            observed = row[f"o{i}"]
            lo, hi = e.get("min_value"), e.get("max_value")
            ok = observed in e["value_set"] if "value_set" in e else observed is not None and (lo is None or observed >= lo) and (hi is None or observed <= hi)
        elif kind == "expect_column_values_to_be_unique":
            bad = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
            ok = bad == 0
        elif kind in ("expect_compound_columns_to_be_unique", "expect_select_column_values_to_be_unique_within_record"):
            bad = df.groupBy(*e["column_list"]).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] if "compound" in kind else df.filter(F.size(F.array_distinct(F.array(*e["column_list"]))) < len(e["column_list"])).count()
            ok = bad == 0
        elif kind == "expect_column_to_exist":
            ok = column in df.columns
        elif kind == "expect_table_row_count_to_equal":
            observed, ok = total, total == e["value"]
        elif kind == "expect_table_row_count_to_be_between":
            observed, ok = total, (e.get("min_value") is None or total >= e["min_value"]) and (e.get("max_value") is None or total <= e["max_value"])
        elif kind == "expect_table_column_count_to_equal":
            observed, ok = len(df.columns), len(df.columns) == e["value"]
        elif kind == "expect_table_columns_to_match_set":
            observed, ok = ",".join(df.columns), set(df.columns) == set(e["column_set"])
        elif kind == "expect_table_columns_to_match_ordered_list":
            observed, ok = ",".join(df.columns), df.columns == list(e["column_list"])
        elif kind == "expect_column_values_to_be_of_type":
            observed = dict(df.dtypes)[column]
            ok = observed == e["type_"]
        elif kind == "expect_column_distinct_values_to_be_in_set":
            bad = df.select(column).distinct().filter(~F.col(column).isin(list(e["value_set"]))).count()
            ok = bad == 0
        elif kind == "expect_column_distinct_values_to_contain_set":
            there = df.filter(F.col(column).isin(list(e["value_set"]))).select(column).distinct().count()
            ok = there == len(set(e["value_set"]))
        elif kind == "expect_column_quantile_values_to_be_between":
            found = df.approxQuantile(column, e["quantiles"], 0.001)
            observed, ok = str(found), all((lo is None or x >= lo) and (hi is None or x <= hi) for x, (lo, hi) in zip(found, e["value_ranges"], strict=True))
        else:
            raise ParameterError(f"unknown expectation: {kind}")
        rows.append((kind, column, bool(ok), total, bad, None if bad is None or not total else 100.0 * bad / total, None if observed is None else str(observed)))
    return df.sparkSession.createDataFrame(rows, "expectation string, column string, success boolean, element_count long, unexpected_count long, unexpected_percent double, observed string")


@operator("validation")
def validation(inputs, validations=None, validation=None, **params):
    found = validations or [{"expectation": validation} | params]
    made = check(inputs[IN], found)
    return {OUT: made, "results": made}


@operator("validation-report")
def report(inputs, **_):
    return {OUT: inputs["input results"].groupBy("success").agg(F.count("*").alias("expectations"))}

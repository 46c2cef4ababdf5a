"""Queries over whole tables for the functions of expression trees, family by family, each with its SQL."""

from __future__ import annotations

from tessera.functions.expressions import Tree, binary, call, ident
from tessera.queries import by_slug, functions_query

_n, _g, _b, _s, _r, _d, _e = (ident(x) for x in ("c_name", "c_mktsegment", "c_acctbal", "p_size", "p_retailprice", "o_orderdate", "props"))


def family(name: str, tbl: str, key: str, rows: list[tuple[str, Tree, str]], source: str | None = None) -> None:
    """Rows (column, tree, SQL) over a table."""
    functions_query(name, tbl, key, {a: t for a, t, _ in rows}, f"SELECT {key}, {', '.join(f'{sql} AS {a}' for a, _, sql in rows)} FROM {source or tbl}")


def _rounded(rows: list[tuple[str, Tree, str]], digits: int = 6) -> list[tuple[str, Tree, str]]:
    return [(a, call("round", t, digits), f"round({sql}, {digits})") for a, t, sql in rows]


def _joined(array: Tree) -> Tree:
    return call("array_join", call("cast_array", array, "string"), "|")


# --- text

_padded = call("concat", "  ", _n, " ")
_blank = call("concat", " \t", _n, "\n ")
_two_lines = call("concat", _n, "\n", _g)
_dashed = call("concat", _g, "-", _n, "-", _g)

family("fn_text_spark", "customer", "c_custkey", [
    ("low", call("lower", _n), "lower(c_name)"), ("ini", call("initcap", _g), "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"), ("asc1", call("ascii", _n), "ascii(c_name)"),
    ("b64", call("base64", _n), "to_base64(c_name::BLOB)"), ("un64", call("decode", call("unbase64", call("base64", _n)), "UTF-8"), "c_name"), ("hx", call("hex", _n), "hex(c_name)"),
    ("unhx", call("decode", call("unhex", call("hex", _n)), "UTF-8"), "c_name"), ("enc", call("decode", call("encode", _n, "UTF-8"), "UTF-8"), "c_name"), ("cat2", call("concat", _n, _g), "c_name || c_mktsegment"),
    ("fmt", call("format_string", "%s-%s", _n, _g), "c_name || '-' || c_mktsegment"), ("num", call("format_number", call("abs", _b), 2), "format('{:,.2f}', abs(c_acctbal))"), ("loc", call("locate", "#", _n), "instr(c_name, '#')"),
    ("lt", call("ltrim", _padded), "ltrim('  ' || c_name || ' ')"), ("rt", call("rtrim", _padded), "rtrim('  ' || c_name || ' ')"), ("tri", call("trim", _padded), "trim('  ' || c_name || ' ')"),
    ("rp", call("rpad", _g, 14, "."), "rpad(c_mktsegment, 14, '.')"), ("rpt", call("repeat", _g, 2), "repeat(c_mktsegment, 2)"), ("si", call("substring_index", _n, "#", 1), "split_part(c_name, '#', 1)"),
    ("rx", call("regexp_extract", _n, "([0-9]+)", 1), "regexp_extract(c_name, '([0-9]+)', 1)"), ("spl", _joined(call("split", _g, "I")), "array_to_string(string_split(c_mktsegment, 'I'), '|')"), ("sh1", call("sha1", _n), "sha1(c_name)"),
    ("ine", call("instr", _n, "0"), "instr(c_name, '0')"), ("acc", call("strip_accents", call("concat", "éàçõ", _g)), "strip_accents('éàçõ' || c_mktsegment)"), ("acc2", call("strip_accents2", call("concat", "ü", _g)), "strip_accents('ü' || c_mktsegment)"),
    ("ln", call("len", _n), "length(c_name)"), ("st", call("str", ident("c_nationkey")), "c_nationkey::VARCHAR"), ("bs", call("basestring", ident("c_nationkey")), "c_nationkey::VARCHAR"),
])

family("fn_text_tests", "customer", "c_custkey", [
    ("b", call("between", _b, 0, 5000), "c_acctbal BETWEEN 0 AND 5000"), ("c", call("contains", _g, "IL"), "contains(c_mktsegment, 'IL')"), ("sw", call("startswith", _g, "B"), "starts_with(c_mktsegment, 'B')"), ("ew", call("endswith", _g, "Y"), "ends_with(c_mktsegment, 'Y')"),
    ("lk", call("like", _g, "%U%"), "c_mktsegment LIKE '%U%'"), ("rl", call("rlike", _n, "0[1-5]$"), "regexp_matches(c_name, '0[1-5]$')"), ("ss", call("substr", _n, 3, 4), "substr(c_name, 3, 4)"), ("inn", call("isin", _g, ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("nul", call("isNull", _g), "c_mktsegment IS NULL"), ("nnl", call("isNotNull", _g), "c_mktsegment IS NOT NULL"), ("nn2", call("isnotnull", _g), "c_mktsegment IS NOT NULL"), ("nu2", call("isnull", _b), "c_acctbal IS NULL"), ("nan", call("isnan", _b), "isnan(c_acctbal)"),
    ("ast", call("astype", ident("c_nationkey"), "string"), "c_nationkey::VARCHAR"), ("cs", call("cast", _n, "integer"), "TRY_CAST(c_name AS INTEGER)"), ("al", call("alias", _n, "other"), "c_name"),
    ("al1", call("isalnum", _n), "regexp_full_match(c_name, '[A-Za-z0-9]+')"), ("al2", call("isalpha", _g), "regexp_full_match(c_mktsegment, '[A-Za-z]+')"), ("dg", call("isdigit", call("substr", _n, 10, 3)), "regexp_full_match(substr(c_name, 10, 3), '[0-9]+')"),
    ("dc", call("isdecimal", call("substr", _n, 10, 3)), "regexp_full_match(substr(c_name, 10, 3), '[0-9]+')"), ("nm", call("isnumeric", call("substr", _n, 10, 3)), "regexp_full_match(substr(c_name, 10, 3), '[0-9]+')"), ("sp", call("isspace", call("substr", _n, 9, 1)), "regexp_full_match(substr(c_name, 9, 1), '\\s+')"),
    ("lo", call("islower", call("lower", _n)), "lower(c_name) <> upper(c_name)"), ("up", call("isupper", _g), "c_mktsegment = upper(c_mktsegment)"), ("ti", call("istitle", call("initcap", _g)), "true"), ("ident", call("isidentifier", _g), "regexp_full_match(c_mktsegment, '[A-Za-z_][A-Za-z0-9_]*')"), ("pr", call("isprintable", _two_lines), "false"),
])

family("fn_text_python", "customer", "c_custkey", [
    ("cap", call("capitalize", _n), "upper(c_name[1]) || lower(c_name[2:])"), ("tit", call("title", _g), "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"), ("cf", call("casefold", _n), "lower(c_name)"),
    ("cen", call("center", _g, 13, "*"), "rpad(repeat('*', (13 - length(c_mktsegment)) // 2 + (13 - length(c_mktsegment)) % 2) || c_mktsegment, 13, '*')"), ("tab", call("expandtabs", call("concat", _g, "\t", _n)), "c_mktsegment || repeat(' ', 8 - length(c_mktsegment) % 8) || c_name"),
    ("fnd", call("find", _n, "0"), "instr(c_name, '0') - 1"), ("idx", call("index", _n, "0"), "instr(c_name, '0') - 1"), ("rf", call("rfind", _n, "0"), "CASE WHEN contains(c_name, '0') THEN length(c_name) - instr(reverse(c_name), '0') ELSE -1 END"), ("ri", call("rindex", _n, "0"), "CASE WHEN contains(c_name, '0') THEN length(c_name) - instr(reverse(c_name), '0') ELSE -1 END"),
    ("lj", call("ljust", _g, 14, "."), "rpad(c_mktsegment, 14, '.')"), ("rj", call("rjust", _g, 14, "."), "lpad(c_mktsegment, 14, '.')"), ("short", call("rjust", _g, 3), "c_mktsegment"), ("zf", call("zfill", call("str", ident("c_nationkey")), 4), "lpad(c_nationkey::VARCHAR, 4, '0')"),
    ("par", _joined(call("partition", _n, "#")), "split_part(c_name, '#', 1) || '|#|' || split_part(c_name, '#', 2)"), ("rpar", _joined(call("rpartition", _dashed, "-")), "c_mktsegment || '-' || c_name || '|-|' || c_mktsegment"),
    ("rsp", _joined(call("rsplit", _dashed, "-", 1)), "c_mktsegment || '-' || c_name || '|' || c_mktsegment"), ("rep", call("replace", _n, "0", "o"), "replace(c_name, '0', 'o')"), ("lin", _joined(call("splitlines", _two_lines)), "c_name || '|' || c_mktsegment"),
    ("swp", call("swapcase", call("concat", call("lower", _g), _g)), "c_mktsegment || lower(c_mktsegment)"), ("ls", call("lstrip", _blank), "c_name || chr(10) || ' '"), ("rs", call("rstrip", _blank), "' ' || chr(9) || c_name"), ("sts", call("strip", _blank), "c_name"),
    ("cnt", call("count", _n, "0"), "length(c_name) - length(replace(c_name, '0', ''))"), ("jn", call("join", "+", call("split", _g, "I")), "replace(c_mktsegment, 'I', '+')"), ("url", call("urlsplit", call("concat", "http://", call("lower", _g), ".org/x")), "lower(c_mktsegment) || '.org'"),
    ("cpf", call("validate_codes", "52998224725"), "true"), ("cpf2", call("validate_codes", "52998224724"), "false"), ("comp", call("complete_cpf_cnpj", call("str", ident("c_custkey"))), "lpad(c_custkey::VARCHAR, 11, '0')"), ("who", call("physical_or_legal_person", call("str", ident("c_custkey"))), "'physical'"),
])

# --- numbers

_x = binary("/", _s, 100.0)
_neg = binary("-", _s, 25)
_price = "p_retailprice"
family("fn_trigonometry", "part", "p_partkey", _rounded([
    *((f, call(f, _x), f"{f}(p_size / 100.0)") for f in ("acos", "asin", "atan", "cos", "cosh", "sinh", "tan", "tanh", "sin")),
    ("at2", call("atan2", _s, _r), f"atan2(p_size, {_price})"), ("deg", call("degrees", _x), "degrees(p_size / 100.0)"), ("rad", call("radians", _r), f"radians({_price})"), ("hyp", call("hypot", _s, _r), f"sqrt(p_size * p_size + {_price} * {_price})"),
    ("arcsin", call("arcsin", _x), "asin(p_size / 100.0)"), ("arccos", call("arccos", _x), "acos(p_size / 100.0)"), ("arctan", call("arctan", _x), "atan(p_size / 100.0)"), ("arctan2", call("arctan2", _s, _r), f"atan2(p_size, {_price})"),
    ("d2r", call("deg2rad", _r), f"radians({_price})"), ("r2d", call("rad2deg", _x), "degrees(p_size / 100.0)"), ("td", call("toDegrees", _x), "degrees(p_size / 100.0)"), ("ash", call("arcsinh", _s), "asinh(p_size)"), ("ach", call("arccosh", binary("+", _s, 1)), "acosh(p_size + 1)"), ("ath", call("arctanh", _x), "atanh(p_size / 100.0)"),
]))

family("fn_exponents", "part", "p_partkey", _rounded([
    ("e", call("exp", _x), "exp(p_size / 100.0)"), ("em1", call("expm1", _x), "exp(p_size / 100.0) - 1"), ("lg", call("log", _r), f"ln({_price})"), ("lg3", call("log", 3, _r), f"ln({_price}) / ln(3)"), ("l1p", call("log1p", _s), "ln(1 + p_size)"), ("lg2", call("log2", _r), f"log2({_price})"),
    ("ri", call("rint", binary("/", _s, 2)), "round_even(p_size / 2, 0)"), ("br", call("bround", binary("/", _s, 4), 1), "round_even(p_size / 4, 1)"), ("ar", call("around", binary("/", _s, 4), 1), "round_even(p_size / 4, 1)"), ("e2", call("exp2", _x), "pow(2, p_size / 100.0)"),
    ("lae", call("logaddexp", _x, 0.25), "ln(exp(p_size / 100.0) + exp(0.25))"), ("la2", call("logaddexp2", _x, 0.25), "log2(pow(2, p_size / 100.0) + pow(2, 0.25))"), ("rec", call("reciprocal", _r), f"1 / {_price}"), ("sq", call("square", _r), f"{_price} * {_price}"), ("fp", call("float_power", _s, 1.5), "pow(p_size, 1.5)"), ("pw", call("power", _s, 2), "pow(p_size, 2)"),
]))

family("fn_numpy", "part", "p_partkey", [
    ("fx", call("fix", binary("/", _neg, 2)), "trunc((p_size - 25) / 2)::BIGINT"), ("tr", call("trunc", binary("/", _neg, 2)), "trunc((p_size - 25) / 2)::BIGINT"), ("neg", call("negative", _s), "-p_size"), ("ad", call("add", _s, 1), "p_size + 1"), ("sb", call("subtract", _s, 1), "p_size - 1"), ("ml", call("multiply", _s, 2), "p_size * 2"),
    ("dv", call("divide", _s, 4), "p_size / 4"), ("td", call("true_divide", _s, 4), "p_size / 4"), ("fd", call("floor_divide", _neg, 4), "floor((p_size - 25) / 4)::BIGINT"), ("rm", call("remainder", _neg, 7), "((p_size - 25) % 7 + 7) % 7"), ("md", call("mod", _neg, 7), "((p_size - 25) % 7 + 7) % 7"), ("fm", call("fmod", _neg, 7), "(p_size - 25) % 7"), ("mdl", call("modulo", _neg, 7), "(p_size - 25) % 7"),
    ("cl", call("clip", _s, 10, 20), "least(greatest(p_size, 10), 20)"), ("nn", call("nan_to_num", _r), _price), ("fa", call("fabs", _neg), "abs(p_size - 25)"), ("sg", call("sign", _neg), "sign(p_size - 25)::DOUBLE"), ("mx", call("maximum", _s, 25), "greatest(p_size, 25)"), ("mn", call("minimum", _s, 25), "least(p_size, 25)"),
    ("la", call("logical_and", binary("-", _s, 5), _neg), "p_size <> 5 AND p_size <> 25"), ("lo", call("logical_or", binary("-", _s, 5), _neg), "p_size <> 5 OR p_size <> 25"), ("ln", call("logical_not", _neg), "p_size = 25"), ("lx", call("logical_xor", binary("-", _s, 5), _neg), "(p_size <> 5) <> (p_size <> 25)"),
    ("eq", call("equal", _s, 10), "p_size = 10"), ("ne", call("not_equal", _s, 10), "p_size <> 10"), ("gt", call("greater", _s, 10), "p_size > 10"), ("ge", call("greater_equal", _s, 10), "p_size >= 10"), ("lt", call("less", _s, 10), "p_size < 10"), ("le", call("less_equal", _s, 10), "p_size <= 10"),
    ("ae", call("array_equiv", call("array", _s, 1), call("array", 10, 1)), "p_size = 10"), ("nv", call("nanvl", _r, 0.0), _price), ("ls", call("least", _s, 10, 20), "least(p_size, 10, 20)"), ("when", call("when", binary(">", _s, 40), "big", binary(">", _s, 20), "middle", "small"), "CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'middle' ELSE 'small' END"),
    ("bn", call("bin", _s), "bin(p_size)"), ("cv", call("conv", call("str", _s), 10, 16), "hex(p_size)"), ("sr", call("shiftRight", _s, 1), "p_size >> 1"), ("sru", call("shiftRightUnsigned", _s, 2), "p_size >> 2"), ("sl", call("left_shift", _s, 3), "p_size << 3"), ("inv", call("invert", _s), "~p_size"), ("lit", call("lit", 3), "3"), ("col", call("col", "p_size"), "p_size"), ("ex", call("expr", "p_size * 2"), "p_size * 2"), ("nif", call("nullif", _s, 10), "nullif(p_size, 10)"), ("ifn", call("ifnull", _s, 0), "ifnull(p_size, 0)"),
    ("str2", call("element_at", call("array", _s, 7), 2), "7"), ("st", call("to_json", call("struct", _s)), "'{\"p_size\":' || p_size || '}'"),
])

# --- times

_day = "o_orderdate::DATE"
family("fn_times", "orders", "o_orderkey", [
    ("am", call("add_months", _d, 1), f"({_day} + INTERVAL 1 MONTH)::DATE"), ("ds", call("date_sub", _d, 3), f"({_day} - 3)"), ("dw", call("dateofweek", _d), "dayofweek(o_orderdate) + 1"), ("fu", call("from_unixtime", binary("*", ident("o_orderkey"), 1000)), "strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%d %H:%M:%S')"),
    ("h", call("hour", _d), "hour(o_orderdate)"), ("mi", call("minute", _d), "minute(o_orderdate)"), ("se", call("second", _d), "second(o_orderdate)"), ("mb", call("round", call("months_between", call("trunc", _d, "month"), call("lit", "2000-01-01")), 6), f"(year(o_orderdate) - 2000) * 12.0 + month(o_orderdate) - 1"),
    ("nd", call("next_day", _d, "Mon"), f"({_day} + (8 - isodow(o_orderdate))::INTEGER)"), ("tt", call("date_format", call("to_timestamp", call("date_format", _d, "yyyyMMdd"), "yyyyMMdd"), "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"), ("tr", call("trunc", _d, "year"), "date_trunc('year', o_orderdate)::DATE"),
    ("fz", call("date_format", call("from_utc_timestamp", _d, "+02:00"), "yyyy-MM-dd HH:mm"), "strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M')"), ("tz", call("date_format", call("to_utc_timestamp", _d, "+02:00"), "yyyy-MM-dd HH:mm"), "strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M')"),
    ("ut", call("unix_timestamp", call("date_format", _d, "yyyy-MM-dd HH:mm:ss")), "epoch(date_trunc('second', o_orderdate))::BIGINT"), ("dt", call("date", _d), _day), ("to", call("toordinal", _d), f"({_day} - DATE '0001-01-01') + 1"), ("fo", call("fromordinal", call("toordinal", _d)), _day), ("wd", call("weekday", _d), "isodow(o_orderdate) - 1"), ("iw", call("isoweekday", _d), "isodow(o_orderdate)"),
    ("iso", call("isoformat", _d), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"), ("s2t", call("date_format", call("str2time", call("date_format", _d, "dd/MM/yyyy"), "dd/MM/yyyy"), "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"), ("sp", call("date_format", call("strptime", call("date_format", _d, "dd/MM/yyyy"), "dd/MM/yyyy"), "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"), ("cb", call("date_format", call("combine", _d, "12:30:00"), "yyyy-MM-dd HH:mm"), "strftime(o_orderdate, '%Y-%m-%d') || ' 12:30'"),
    ("ft", call("date_format", call("fromtimestamp", ident("o_custkey")), "yyyy-MM-dd HH:mm:ss"), "strftime(make_timestamp(o_custkey * 1000000), '%Y-%m-%d %H:%M:%S')"), ("uf", call("date_format", call("utcfromtimestamp", ident("o_custkey")), "yyyy-MM-dd HH:mm:ss"), "strftime(make_timestamp(o_custkey * 1000000), '%Y-%m-%d %H:%M:%S')"),
    ("tot", call("total_seconds", call("timedelta", 1, 5)), "86405.0"), ("td", call("datediff", call("today"), call("current_date")), "0"), ("nw", call("isnotnull", call("now")), "true"), ("un", call("isnotnull", call("utcnow")), "true"), ("ct", call("isnotnull", call("current_timestamp")), "true"), ("dp", call("date_patterning", call("date_format", _d, "dd/MM/yyyy")), _day),
    ("wi", call("date_format", call("window", _d, 86400), "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
])

# --- arrays, maps and JSON

_a, _b2 = call("array", _s, binary("%", _s, 7), 3, 3), call("array", _s, 5, 3)
_A, _B = "[p_size, p_size % 7, 3, 3]", "[p_size, 5, 3]"
_sorted = lambda t: _joined(call("array_sort", t))
_list = lambda sql: f"array_to_string(list_sort({sql}), '|')"
family("fn_arrays", "part", "p_partkey", [
    ("dis", _sorted(call("array_distinct", _a)), _list(f"list_distinct({_A})")), ("exc", _sorted(call("array_except", _a, _b2)), _list(f"list_distinct(list_filter({_A}, lambda x: NOT list_contains({_B}, x)))")), ("its", _sorted(call("array_intersect", _a, _b2)), _list(f"list_distinct(list_intersect({_A}, {_B}))")), ("uni", _sorted(call("array_union", _a, _b2)), _list(f"list_distinct({_A} || {_B})")),
    ("mx", call("array_max", _a), f"list_max({_A})"), ("mn", call("array_min", _a), f"list_min({_A})"), ("pos", call("array_position", _a, 3), f"list_position({_A}, 3)"), ("rem", _joined(call("array_remove", _a, 3)), f"array_to_string(list_filter({_A}, lambda x: x <> 3), '|')"), ("rpt", _joined(call("array_repeat", _s, 3)), "array_to_string([p_size, p_size, p_size], '|')"),
    ("ov", call("arrays_overlap", call("array", _s), call("array", 1, 2, 3)), "p_size IN (1, 2, 3)"), ("zip", call("size", call("arrays_zip", _a, _b2)), "4"), ("fl", _joined(call("flatten", call("array", _a, _b2))), f"array_to_string({_A} || {_B}, '|')"), ("sq", _joined(call("sequence", 1, binary("+", binary("%", _s, 5), 1))), "array_to_string(range(1, p_size % 5 + 2), '|')"), ("sli", _joined(call("slice", _a, 2, 2)), f"array_to_string({_A}[2:3], '|')"),
    ("shu", _sorted(call("shuffle", _a)), _list(_A)), ("srt", _joined(call("sort_array", _a)), _list(_A)), ("app", _joined(call("array_append", _a, 9)), f"array_to_string({_A} || [9], '|')"), ("cmp", call("size", call("array_compact", call("array", _s, call("nullif", _s, _s)))), "1"),
    ("mk", _joined(call("map_keys", call("create_map", "a", _s, "b", 2))), "'a|b'"), ("mv", _joined(call("map_values", call("create_map", "a", _s, "b", 2))), "p_size || '|2'"), ("mc", call("size", call("map_concat", call("create_map", "a", _s), call("create_map", "b", 2))), "2"), ("cas", _joined(call("array_cast", _b2, "string")), f"array_to_string({_B}, '|')"),
    ("si", _joined(call("set_of_ints", call("split", "3,3,1", ","))), "'3|1'"), ("ss", _joined(call("set_of_strings", call("split", "b,,b,a", ","))), "'b|a'"), ("sf", _joined(call("set_of_floats", call("split", "1.5,1.5", ","))), "'1.5'"),
    ("js", call("get_json_object", call("to_json", call("struct", _s, _r)), "$.p_size"), "p_size::VARCHAR"), ("fj", call("element_at", call("from_json", call("to_json", call("array", _s, 2)), "array<int>"), 1), "p_size"), ("soj", call("schema_of_json", '{"a":1}'), "'STRUCT<a: BIGINT>'"),
])

by_slug("fn_explode", "part", "transformation", "SELECT p_partkey, unnest([p_size, p_size + 1]) AS x FROM part", ["p_partkey", "x"], expression=[{"alias": "x", "tree": call("explode", call("array", _s, binary("+", _s, 1)))}])
by_slug("fn_explode_outer", "part", "transformation", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS x FROM part", ["p_partkey", "x"], expression=[{"alias": "x", "tree": call("explode_outer", call("array_compact", call("array", call("when", binary(">", _s, 25), _s))))}])
by_slug("fn_posexplode_size", "part", "transformation", "SELECT p_partkey, unnest([0, 1]) AS pos, p_size AS col FROM part", ["p_partkey", "posexplode(xs) AS (pos, col)"], expression=[{"alias": "xs", "tree": call("array", _s, _s)}])

# --- windows

_ORDER = [{"attribute": "o_orderdate", "f": "asc"}, {"attribute": "o_orderkey", "f": "asc"}]
_total = ident("o_totalprice")
by_slug("win_distribution", "orders", "window-transformation", "SELECT o_orderkey, cume_dist() OVER w AS cd, percent_rank() OVER w AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", ["o_orderkey", "cd", "pr"], partition_attribute=["o_custkey"], order_by=_ORDER, expressions=[{"alias": "cd", "tree": call("cume_dist")}, {"alias": "pr", "tree": call("percent_rank")}])
by_slug("win_aggregates", "orders", "window-transformation", "SELECT o_orderkey, min(o_totalprice) OVER w AS lo, round(avg(o_totalprice) OVER w, 4) AS mean, round(sum(o_totalprice) OVER w, 2) AS total, round(stddev(o_totalprice) OVER w, 3) AS sd, last_value(o_orderkey) OVER w AS la FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", ["o_orderkey", "lo", "round(mean, 4) AS mean", "round(total, 2) AS total", "round(sd, 3) AS sd", "la"], partition_attribute=["o_custkey"], order_by=_ORDER, type="rows", rows_from=3, rows_to=0, expressions=[{"alias": "lo", "tree": call("min", _total)}, {"alias": "mean", "tree": call("avg", _total)}, {"alias": "total", "tree": call("sum", _total)}, {"alias": "sd", "tree": call("std", _total)}, {"alias": "la", "tree": call("last", ident("o_orderkey"))}])

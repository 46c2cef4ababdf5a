"""Expression trees to Spark columns.

A tree is a dict: ``Literal`` (value, raw), ``Identifier`` (name), ``CallExpression`` (callee.name, arguments),
``BinaryExpression`` and ``LogicalExpression`` (operator, left, right), ``UnaryExpression`` (operator, argument),
``ConditionalExpression`` (test, consequent, alternate), ``ArrayExpression`` (elements), ``MemberExpression`` (object,
property) or ``Compound``. Nothing is evaluated in Python: a tree becomes one Column that Catalyst optimises.
"""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Tree = dict


class ExpressionError(ValueError):
    """A tree that is malformed or names an unknown function."""


#: Functions that are Spark's under the same name and take columns for all arguments.
SAME = """
    coalesce isnull isnan nanvl greatest least hash monotonically_increasing_id struct abs acos asin atan atan2 bin cbrt cos
    cosh degrees exp expm1 floor ceil hypot log10 log1p log2 pow radians rint signum sin sinh sqrt tan tanh crc32 md5 sha1
    ascii base64 concat initcap length levenshtein lower ltrim regexp_replace reverse rtrim soundex trim unbase64 hex unhex
    upper current_date current_timestamp datediff dayofmonth dayofweek dayofyear hour last_day minute month quarter second
    weekofyear year weekday array array_contains array_distinct array_except array_intersect array_max array_min array_position
    array_remove array_repeat array_sort array_union arrays_overlap arrays_zip explode explode_outer posexplode flatten sequence
    shuffle size slice sort_array create_map map_concat map_keys map_values isnotnull now date_add date_sub add_months
    substring array_append array_compact nullif ifnull
""".split()

#: Other spellings of the same functions.
ALIASES = {
    "dateofweek": "dayofweek", "toDegrees": "degrees", "toRadians": "radians", "arcsin": "asin", "arccos": "acos", "arctan": "atan",
    "arctan2": "atan2", "deg2rad": "radians", "rad2deg": "degrees", "power": "pow", "sign": "signum", "absolute": "abs", "fabs": "abs",
    "isNull": "isnull", "isNotNull": "isnotnull", "len": "length", "strip_accents2": "strip_accents", "today": "current_date", "utcnow": "now",
    "array_cast": "cast_array", "size_of": "size", "mod": "remainder", "fix": "truncate", "startsWith": "startswith", "endsWith": "endswith",
    "true_divide": "divide", "rindex": "rfind", "basestring": "str", "not_equals": "not_equal", "equals": "equal",
}

_TYPES = {"integer": "int", "decimal": "double", "text": "string", "character": "string", "datetime": "timestamp", "bool": "boolean", "str": "string", "float": "double", "long": "bigint"}


def spark_type(name: str) -> str:
    return _TYPES.get(name.lower(), name.lower())


def _accents() -> tuple[str, str]:
    """Letters of Latin blocks that are a base letter with marks, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def strip_accents(c: Column) -> Column:
    found, base = _accents()
    return F.regexp_replace(F.translate(c, found, base), r"\p{Mn}", "")


def group_datetime(c: Column, seconds, side="start") -> Column:
    """Start or end of the tumbling window of so many seconds that holds the time."""
    return F.window(c, f"{int(seconds)} seconds")[side]


def _literal(x):
    return x if isinstance(x, Column) else F.lit(x)


def _text_or_default(f):
    return lambda *a: f(*[_literal(x) for x in a])


# --- text functions with Python's meaning


def _chars(test: Callable[[str], bool], end: int = 0x30000) -> str:
    """The inside of a character class that holds what passes the test."""
    found = [c for c in range(end) if not 0xD800 <= c < 0xE000 and test(chr(c))]
    runs = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


_BLANKS = _chars(str.isspace)
_DIGITS = _chars(lambda c: c.isdigit() and not c.isdecimal())
_NUMERALS = _chars(lambda c: c.isnumeric() and unicodedata.category(c)[0] != "N")
#: Where Python ends a line.
_LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def _stripped(c: Column, chars: str | None, left: bool, right: bool) -> Column:
    inside = _BLANKS if chars is None else "".join(rf"\x{{{ord(x):X}}}" for x in chars)
    if not inside:
        return c
    return F.regexp_replace(c, "|".join([rf"\A[{inside}]+"] * left + [rf"[{inside}]+\z"] * right), "")


def _justified(c: Column, n: int, fill: str, left: bool) -> Column:
    """Filled up to n characters; longer texts stay."""
    return F.when(F.length(c) >= n, c).otherwise((F.lpad if left else F.rpad)(c, n, fill))


def _centred(c: Column, n, fill: str = " ") -> Column:
    n, size = int(n), F.length(c)
    room = n - size
    before = F.floor(room / 2).cast("int") + (room.bitwiseAND(F.lit(n)).bitwiseAND(F.lit(1)))
    return F.when(size >= n, c).otherwise(F.rpad(F.concat(F.repeat(F.lit(fill), before), c), n, fill))


def _zero_filled(c: Column, n) -> Column:
    signed = F.concat(F.substring(c, 1, 1), F.lpad(F.substring(c, 2, 2**31 - 1), max(int(n) - 1, 0), "0"))
    return F.when(F.length(c) >= int(n), c).when(c.rlike(r"\A[+-]"), signed).otherwise(F.lpad(c, int(n), "0"))


def _upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def _folded(c: Column) -> Column:
    """Lower case, and beyond it where Python folds more."""
    more = {x: x.casefold() for x in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(x) < 0xE000 and x.casefold() != x.lower()}
    found = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])
    each = F.transform(F.split(c, ""), lambda x: F.coalesce(found[x], F.lower(x)))
    return F.when(c.rlike(f"[{''.join(more)}]"), F.array_join(each, "")).otherwise(F.translate(F.lower(c), "ς", "σ"))


def _titled(c: Column) -> Column:
    """Every run of letters with its first one large."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(\p{L}+|[^\p{L}]+)"), F.lit(0)), _upper_first), "")


def _tabs_expanded(c: Column, n=8) -> Column:
    """Blanks up to the next of every n columns of the line."""
    n = int(n)
    if n <= 0:
        return F.replace(c, F.lit("\t"), F.lit(""))
    parts = F.split(c, "\t")
    used = lambda text: F.length(F.regexp_extract(text, r"([^\r\n]*)\z", 1)) % n
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), parts[0], lambda text, x: F.concat(text, F.repeat(F.lit(" "), n - used(text)), x))


def _lines(c: Column) -> Column:
    without_last = F.regexp_replace(c, rf"(?:{_LINE_ENDS})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(without_last, _LINE_ENDS))


def _parted(c: Column, sep: str, last: bool) -> Column:
    """Text before, the separator, text after; without a separator all text comes first, or last."""
    at = F.length(c) - F.instr(F.reverse(c), sep[::-1]) - len(sep) + 2 if last else F.instr(c, sep)
    empty = F.lit("")
    return F.when(c.isNull(), F.lit(None)).when(F.instr(c, sep) == 0, F.array(empty, empty, c) if last else F.array(c, empty, empty)).otherwise(
        F.array(F.substring(c, F.lit(1), at - 1), F.lit(sep), F.substring(c, at + len(sep), F.length(c)))
    )


def _split_from_right(c: Column, sep: str, n=-1) -> Column:
    parts, n = F.split(c, F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E"))), int(n)
    if n < 0:
        return parts
    more = F.size(parts) - n
    return F.when(c.isNull() | (more <= 1), parts).otherwise(F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), more), sep)), F.slice(parts, more + 1, F.lit(n)) if n else F.array().cast("array<string>")))


def _last_place(c: Column, s: str) -> Column:
    found = F.instr(F.reverse(c), s[::-1])
    return F.when(found == 0, -1).otherwise(F.length(c) - found - len(s) + 1)


# --- numbers with NumPy's meaning


def _modulo(a: Column, b) -> Column:
    """The rest with the sign of the divisor."""
    b = _literal(b)
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _clipped(c: Column, low=None, high=None) -> Column:
    out = c
    if low is not None:
        out = F.when(out < _literal(low), _literal(low)).otherwise(out)
    if high is not None:
        out = F.when((out > _literal(high)) & ~F.isnan(c.cast("double")), _literal(high)).otherwise(out)
    return out


def _no_nan(c: Column, nan=0.0, posinf=None, neginf=None) -> Column:
    most = 1.7976931348623157e308
    big, small = F.lit(float("inf")), F.lit(float("-inf"))
    return F.when(F.isnan(c), F.lit(float(nan))).when(c == big, F.lit(most if posinf is None else float(posinf))).when(c == small, F.lit(-most if neginf is None else float(neginf))).otherwise(c)


def _log_sum(a: Column, b: Column, base: float) -> Column:
    """Logarithm of the sum of two powers; base 1 stands for the natural one."""
    if base == 1.0:
        return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
    return F.greatest(a, b) + F.log1p(F.pow(F.lit(base), -F.abs(a - b))) / F.log(F.lit(base))


def _truth(c) -> Column:
    """Numbers other than zero are true."""
    return _literal(c).cast("boolean")


def _set_of(kind: str):
    return lambda a: F.array_distinct(F.filter(a, lambda x: x.cast("string") != "")).cast(f"array<{kind}>")


def _when(*args):
    if len(args) < 2:
        raise ExpressionError("when needs a condition and a value")
    out = F.when(args[0], args[1])
    for i in range(2, len(args) - 1, 2):
        out = out.when(args[i], args[i + 1])
    return out.otherwise(args[-1]) if len(args) % 2 and args[-1] is not None else out


#: Functions with arguments that must stay Python values, or with meanings of their own.
OWN: dict[str, Callable] = {
    "when": _when,
    "col": lambda name: F.col(name) if isinstance(name, str) else name,
    "lit": F.lit,
    "expr": F.expr,
    "log": lambda *a: F.log(a[0]) if len(a) == 1 else F.log(float(a[0]), a[1]),
    "round": lambda c, n=0: F.round(c, int(n)),
    "around": lambda c, n=0: F.bround(c, int(n)),
    "bround": lambda c, n=0: F.bround(c, int(n)),
    "conv": lambda c, a, b: F.conv(c, int(a), int(b)),
    "rand": lambda seed=None: F.rand(seed),
    "randn": lambda seed=None: F.randn(seed),
    "bitwiseNOT": F.bitwise_not, "bitwiseNot": F.bitwise_not, "invert": F.bitwise_not,
    "shiftLeft": lambda c, n: F.shiftleft(c, int(n)), "left_shift": lambda c, n: F.shiftleft(c, int(n)),
    "shiftRight": lambda c, n: F.shiftright(c, int(n)), "right_shift": lambda c, n: F.shiftright(c, int(n)),
    "shiftRightUnsigned": lambda c, n: F.shiftrightunsigned(c, int(n)),
    "sha2": lambda c, n=256: F.sha2(c, int(n)),
    "concat_ws": lambda sep, *c: F.concat_ws(sep, *map(_literal, c)),
    "decode": lambda c, charset: F.decode(c, charset), "encode": lambda c, charset: F.encode(c, charset),
    "format_number": lambda c, n: F.format_number(c, int(n)),
    "format_string": lambda fmt, *c: F.format_string(fmt, *map(_literal, c)),
    "instr": lambda c, s: F.instr(c, s), "locate": lambda s, c, pos=1: F.locate(s, c, int(pos)),
    "find": lambda c, s: F.instr(c, s) - 1, "index": lambda c, s: F.instr(c, s) - 1,
    "lpad": lambda c, n, p=" ": F.lpad(c, int(n), p), "rpad": lambda c, n, p=" ": F.rpad(c, int(n), p),
    "rjust": lambda c, n, p=" ": _justified(c, int(n), p, True), "ljust": lambda c, n, p=" ": _justified(c, int(n), p, False), "zfill": _zero_filled,
    "capitalize": _upper_first, "title": _titled, "casefold": _folded,
    "strip": lambda c, x=None: _stripped(c, x, True, True), "lstrip": lambda c, x=None: _stripped(c, x, True, False), "rstrip": lambda c, x=None: _stripped(c, x, False, True),
    "partition": lambda c, s: _parted(c, s, False), "rpartition": lambda c, s: _parted(c, s, True), "rsplit": _split_from_right, "rfind": _last_place,
    "trunc": lambda c, f=None: OWN["truncate"](c) if f is None else F.trunc(c, f),
    "regexp_extract": lambda c, p, g=1: F.regexp_extract(c, p, int(g)),
    "repeat": lambda c, n: F.repeat(c, int(n)),
    "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)),
    "split": lambda c, p, n=-1: F.split(c, p, int(n)),
    "substring_index": lambda c, d, n: F.substring_index(c, d, int(n)),
    "translate": lambda c, a, b: F.translate(c, a, b) if isinstance(a, str) else map_values(c, a, b),
    "date_format": lambda c, f: F.date_format(c, f), "date_trunc": lambda unit, c: F.date_trunc(unit, c),
    "from_unixtime": lambda c, f="yyyy-MM-dd HH:mm:ss": F.from_unixtime(c, f),
    "from_utc_timestamp": lambda c, tz: F.from_utc_timestamp(c, tz), "to_utc_timestamp": lambda c, tz: F.to_utc_timestamp(c, tz),
    "months_between": lambda a, b, r=True: F.months_between(a, b, r), "next_day": lambda c, d: F.next_day(c, d),
    "to_date": lambda c, f=None: F.try_to_date(c, f) if f else F.try_to_date(c),
    "to_timestamp": lambda c, f=None: F.try_to_timestamp(c, F.lit(f)) if f else F.try_to_timestamp(c),
    "strptime": lambda c, f=None: F.try_to_timestamp(c, F.lit(f)) if f else F.try_to_timestamp(c),
    "unix_timestamp": lambda c=None, f="yyyy-MM-dd HH:mm:ss": F.unix_timestamp(c, f) if c is not None else F.unix_timestamp(),
    "array_join": lambda c, d, null=None: F.array_join(c, d) if null is None else F.array_join(c, d, null),
    "element_at": lambda c, k: F.try_element_at(c, _literal(k)),
    "from_json": lambda c, schema: F.from_json(c, schema), "to_json": F.to_json,
    "get_json_object": lambda c, p: F.get_json_object(c, p), "json_tuple": lambda c, *f: F.json_tuple(c, *f), "schema_of_json": F.schema_of_json,
    "group_datetime": group_datetime, "window": group_datetime,
    "set_of_ints": _set_of("int"), "set_of_strings": _set_of("string"), "set_of_floats": _set_of("double"),
    "strip_accents": strip_accents,
    "strip_punctuation": lambda c: F.regexp_replace(c, r"\p{Punct}", ""),
    "extract_numbers": lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double")),
    "cast_array": lambda c, t: c.cast(f"array<{spark_type(t)}>"),
    "cast": lambda c, t: c.try_cast(spark_type(t)), "astype": lambda c, t: c.try_cast(spark_type(t)), "str": lambda c: c.cast("string"),
    "alias": lambda c, name: c.alias(name),
    "between": lambda c, a, b: c.between(a, b),
    "contains": lambda c, s: c.contains(s), "startswith": lambda c, s: c.startswith(s), "endswith": lambda c, s: c.endswith(s),
    "like": lambda c, p: c.like(p), "rlike": lambda c, p: c.rlike(p), "substr": lambda c, a, n=None: c.substr(int(a), int(n)) if n is not None else F.substring(c, int(a), 2**31 - 1),
    "isin": lambda c, *v: c.isin(*(v[0] if len(v) == 1 and isinstance(v[0], (list, tuple)) else v)),
    "count": lambda c, s: F.regexp_count(c, F.concat(F.lit("\\Q"), F.lit(s), F.lit("\\E"))),
    "center": _centred,
    "swapcase": lambda c: F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), ""),
    "isalnum": lambda c: c.rlike(r"\A[\p{L}\p{N}]+\z"), "isalpha": lambda c: c.rlike(r"\A\p{L}+\z"), "isdigit": lambda c: c.rlike(rf"\A[\p{{Nd}}{_DIGITS}]+\z"),
    "isdecimal": lambda c: c.rlike(r"\A\p{Nd}+\z"), "isnumeric": lambda c: c.rlike(rf"\A[\p{{N}}{_NUMERALS}]+\z"), "isspace": lambda c: c.rlike(rf"\A[{_BLANKS}]+\z"),
    "islower": lambda c: (c == F.lower(c)) & (c != F.upper(c)), "isupper": lambda c: (c == F.upper(c)) & (c != F.lower(c)), "istitle": lambda c: (c == _titled(c)) & (F.lower(c) != F.upper(c)),
    "isidentifier": lambda c: c.rlike(r"\A[\p{L}_][\p{L}\p{Nd}_]*\z"), "isprintable": lambda c: ~c.rlike(r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}"),
    "splitlines": _lines, "expandtabs": _tabs_expanded,
    "join": lambda sep, c: F.array_join(c, sep), "urlsplit": lambda c, part="HOST": F.parse_url(c, F.lit(part)),
    "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "exp2": lambda c: F.pow(F.lit(2.0), c),
    "truncate": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)),
    "logaddexp": lambda a, b: _log_sum(a, _literal(b), 1.0), "logaddexp2": lambda a, b: _log_sum(a, _literal(b), 2.0),
    "add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": operator.truediv, "modulo": operator.mod, "remainder": _modulo, "fmod": operator.mod,
    "clip": _clipped, "nan_to_num": _no_nan, "array_equiv": lambda a, b: a.eqNullSafe(_literal(b)),
    "equal": operator.eq, "not_equal": operator.ne, "greater": operator.gt, "greater_equal": operator.ge, "less": operator.lt, "less_equal": operator.le,
    "logical_and": lambda a, b: _truth(a) & _truth(b), "logical_or": lambda a, b: _truth(a) | _truth(b), "logical_not": lambda a: ~_truth(a), "logical_xor": lambda a, b: _truth(a) != _truth(b),
    "combine": lambda d, t: F.try_to_timestamp(F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), _literal(t))),
    "negative": operator.neg, "reciprocal": lambda c: 1 / c, "square": lambda c: c * c, "maximum": lambda a, b: F.greatest(a, _literal(b)), "minimum": lambda a, b: F.least(a, _literal(b)), "float_power": lambda a, b: F.pow(a.cast("double"), _literal(b)), "floor_divide": lambda a, b: F.floor(a / b),
    "isoweekday": lambda c: F.weekday(c) + 1, "isoformat": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "str2time": lambda c, f: F.try_to_timestamp(c, F.lit(f)),
    "date": lambda c: c.cast("date"), "fromtimestamp": lambda c: F.timestamp_seconds(c), "utcfromtimestamp": lambda c: F.timestamp_seconds(c), "toordinal": lambda c: F.datediff(c.cast("date"), F.lit("0001-01-01").cast("date")) + 1,
    "fromordinal": lambda c: F.date_add(F.lit("0001-01-01").cast("date"), c - 1), "timedelta": lambda days=0, seconds=0: F.make_dt_interval(F.lit(int(days)), F.lit(0), F.lit(0), F.lit(float(seconds))), "total_seconds": lambda c: sum((F.extract(F.lit(u), c).cast("double") * n for u, n in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))), F.lit(0.0)),
    "ith": lambda c, i: __import__("pyspark.ml.functions", fromlist=["x"]).vector_to_array(c)[int(i)],
    "validate_codes": lambda c: valid_cpf(c) | valid_cnpj(c), "complete_cpf_cnpj": lambda c, n=11: F.lpad(F.regexp_replace(c, r"\D", ""), int(n), "0"),
    "physical_or_legal_person": lambda c: F.when(F.length(F.regexp_replace(c, r"\D", "")) <= 11, "physical").otherwise("legal"),
    "date_patterning": lambda c, *f: F.coalesce(*(F.try_to_date(c, x) for x in (f or ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyyMMdd")))),
}

#: Functions whose second and later arguments are text or numbers, not columns, whatever the tree says.
_COLUMN_LITERALS = {"regexp_replace", "array_contains", "array_position", "array_remove", "array_repeat", "date_add", "date_sub", "add_months", "slice", "sequence", "pow", "atan2", "hypot", "coalesce", "greatest", "least", "nanvl", "concat", "array", "create_map", "substring", "array_append", "struct", "nullif", "ifnull", "levenshtein", "datediff"}


def map_values(c: Column, pairs: dict, missing: str = "null") -> Column:
    """Look values up; what has no partner becomes null or stays (``missing='keep'``)."""
    found = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]
    return F.coalesce(found, c) if missing == "keep" else found


def _check_digit(digits: Column, weights: list[int]) -> Column:
    total = reduce(operator.add, (F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)))
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _valid_code(c: Column, n: int, first: list[int], second: list[int]) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    sound = (F.length(d) == n) & ~d.rlike(r"^(\d)\1*$")
    return F.coalesce(F.when(sound, (_check_digit(d, first) == F.substring(d, n - 1, 1).cast("int")) & (_check_digit(d, second) == F.substring(d, n, 1).cast("int"))).otherwise(False), F.lit(False))


def valid_cpf(c: Column) -> Column:
    """Check digits of the public CPF scheme."""
    return _valid_code(c, 11, list(range(10, 1, -1)), list(range(11, 1, -1)))


def valid_cnpj(c: Column) -> Column:
    """Check digits of the public CNPJ scheme."""
    return _valid_code(c, 14, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])


_BINARY = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod, "**": lambda a, b: F.pow(a, _literal(b)),
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "=": operator.eq, "===": operator.eq,
    "!=": operator.ne, "<>": operator.ne, "!==": operator.ne, "&&": operator.and_, "&": operator.and_, "and": operator.and_, "||": operator.or_, "|": operator.or_, "or": operator.or_,
}
_UNARY = {"-": operator.neg, "+": lambda x: x, "!": operator.invert, "~": operator.invert, "not": operator.invert}

#: Functions over a window.
WINDOWED = {
    "max": F.max, "min": F.min, "count": F.count, "avg": F.avg, "mean": F.avg, "sum": F.sum, "std": F.stddev, "stddev": F.stddev,
    "lag": lambda c, n=1, d=None: F.lag(c, int(n), d), "lead": lambda c, n=1, d=None: F.lead(c, int(n), d), "first": F.first, "last": F.last,
    "ntile": lambda n: F.ntile(int(n)), "cume_dist": F.cume_dist, "percent_rank": F.percent_rank, "rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number,
}


def functions() -> list[str]:
    return sorted({*SAME, *OWN, *ALIASES})


class Compiler:
    """Compiles trees; ``window`` puts window functions over that specification, ``bind`` turns a name into a column."""

    def __init__(self, window: WindowSpec | None = None, bind: Callable[[str], Column] = F.col, extra: dict[str, Callable] | None = None):
        self.window, self.bind, self.extra = window, bind, extra or {}

    def column(self, tree: Tree) -> Column:
        return _literal(self.value(tree))

    def value(self, tree: Tree):
        """A Column, or the Python value of a literal."""
        kind = tree.get("type")
        method = getattr(self, f"_{kind}", None)
        if method is None:
            raise ExpressionError(f"unknown kind of expression: {kind}")
        return method(tree)

    def _Literal(self, tree):
        return tree.get("value")

    def _Identifier(self, tree):
        return self.bind(tree["name"])

    def _ArrayExpression(self, tree):
        values = [self.value(x) for x in tree["elements"]]
        return F.array(*map(_literal, values)) if any(isinstance(v, Column) for v in values) else values

    def _MemberExpression(self, tree):
        at = tree["property"]
        inner = self.value(tree["object"])
        return inner[at["name"] if at["type"] == "Identifier" and not tree.get("computed") else self.value(at)]

    def _ConditionalExpression(self, tree):
        return F.when(self.column(tree["test"]), self.column(tree["consequent"])).otherwise(self.column(tree["alternate"]))

    def _UnaryExpression(self, tree):
        if tree["operator"] not in _UNARY:
            raise ExpressionError(f"unknown operator: {tree['operator']}")
        x = self.value(tree["argument"])
        if isinstance(x, (int, float)) and not isinstance(x, bool) and tree["operator"] in "+-":
            return _UNARY[tree["operator"]](x)
        return _UNARY[tree["operator"]](_literal(x))

    def _BinaryExpression(self, tree):
        if tree["operator"] not in _BINARY:
            raise ExpressionError(f"unknown operator: {tree['operator']}")
        return _BINARY[tree["operator"]](self.column(tree["left"]), self.column(tree["right"]))

    _LogicalExpression = _BinaryExpression

    def _CallExpression(self, tree):
        name = tree["callee"]["name"]
        args = [self.value(x) for x in tree.get("arguments", [])]
        if self.window is not None and name in WINDOWED:
            return WINDOWED[name](*args).over(self.window)
        if name in self.extra:
            return self.extra[name](*args)
        name = ALIASES.get(name, name)
        if name in OWN:
            if name not in ("col", "expr", "lit", "when", "concat_ws", "format_string", "locate", "join", "date_trunc", "rand", "randn", "log", "timedelta"):
                args[:1] = [_literal(args[0])] if args else []
            return OWN[name](*args)
        if name in SAME:
            return getattr(F, name)(*[x if isinstance(x, Column) else F.lit(x) for x in args])
        raise ExpressionError(f"unknown function: {name}")


def compile_expression(tree: Tree, **options) -> Column:
    return Compiler(**options).column(tree)


def window_spec(partition_by: list[str] | None = None, order_by: list[tuple[str, bool]] | None = None, rows: tuple | None = None, between: tuple | None = None) -> WindowSpec:
    """A window; bounds of None are open. order_by: (name, ascending)."""
    spec = Window.partitionBy(*(partition_by or []))
    if order_by:
        spec = spec.orderBy(*(F.asc(n) if up else F.desc(n) for n, up in order_by))
    ends = lambda b: (Window.unboundedPreceding if b[0] is None else b[0], Window.unboundedFollowing if b[1] is None else b[1])
    if rows is not None:
        spec = spec.rowsBetween(*ends(rows))
    if between is not None:
        spec = spec.rangeBetween(*ends(between))
    return spec


# --- a small text form, for people


def call(name: str, *args) -> Tree:
    return {"type": "CallExpression", "callee": {"type": "Identifier", "name": name}, "arguments": [as_tree(a) for a in args]}


def ident(name: str) -> Tree:
    return {"type": "Identifier", "name": name}


def as_tree(x) -> Tree:
    return x if isinstance(x, dict) else {"type": "Literal", "value": x, "raw": repr(x)}


def binary(op: str, left, right) -> Tree:
    return {"type": "BinaryExpression", "operator": op, "left": as_tree(left), "right": as_tree(right)}

"""MySQL functions as Spark SQL text; arguments are Spark SQL already."""

from __future__ import annotations

import re

from millrace.errors import EngineError
from millrace.functions import fulltext

#: Functions that a session answers, by the name of the value.
SESSION = {
    "DATABASE": "DATABASE", "SCHEMA": "DATABASE", "USER": "USER", "CURRENT_USER": "USER", "SESSION_USER": "USER", "SYSTEM_USER": "USER", "VERSION": "VERSION",
    "CONNECTION_ID": "CONNECTION_ID", "LAST_INSERT_ID": "LAST_INSERT_ID", "ROW_COUNT": "ROW_COUNT", "FOUND_ROWS": "FOUND_ROWS", "CURRENT_ROLE": "CURRENT_ROLE",
}
UNITS = {"SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"}
#: Format letters that DATE_FORMAT knows, and Spark's.
DATE_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss", "S": "ss"}


def _is_text(x: str) -> bool:
    return x.startswith("'")


def _is_number(x: str) -> bool:
    return re.fullmatch(r"-?\s*\d+(\.\d*)?", x) is not None


def temporal(x: str) -> str:
    """A string literal as a date or a timestamp, whichever it spells."""
    if not _is_text(x):
        return x
    body = x[1:-1]
    return f"DATE{x}" if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", body) else f"TIMESTAMP_NTZ{x}"


def date_add(x: str, n: str, unit: str, sign: int = 1) -> str:
    if unit not in UNITS:
        raise EngineError(1064, f"Unknown interval unit {unit}")
    x, n = temporal(x), f"({n})" if sign > 0 else f"(-({n}))"
    if _is_text(n[1:-1]) or n.startswith("(-('"):
        n = f"CAST({n} AS INT)" if sign > 0 else f"(-CAST({n[3:-2]} AS INT))"
    if unit in ("SECOND", "MINUTE", "HOUR"):
        place = {"HOUR": f"0, {n}", "MINUTE": f"0, 0, {n}", "SECOND": f"0, 0, 0, {n}"}[unit]
        return f"(CAST({x} AS TIMESTAMP_NTZ) + make_dt_interval({place}))"
    part = {"YEAR": f"{n}", "QUARTER": f"0, 3 * {n}", "MONTH": f"0, {n}", "WEEK": f"0, 0, {n}", "DAY": f"0, 0, 0, {n}"}[unit]
    return f"({x} + make_interval({part}))"


def date_format(x: str, pattern: str) -> str:
    out = ""
    for part in re.findall(r"%.?|[A-Za-z]+|[^%A-Za-z]", pattern, re.DOTALL):
        if part[0] != "%":
            # Letters are quoted in Spark's patterns, a quote is doubled.
            out += f"\\'{part}\\'" if part.isalpha() else "\\'\\'" if part == "'" else part
        elif part == "%%":
            out += "%"
        elif part[1:] in DATE_LETTERS:
            out += DATE_LETTERS[part[1:]]
        else:
            raise EngineError(1235, f"DATE_FORMAT does not support {part}")
    return f"date_format({temporal(x)}, '{out}')"


def substring(x: str, at: str, n: str | None = None) -> str:
    """Place 0 gives the empty string."""
    call = f"substring({x}, {at}{'' if n is None else f', {n}'})"
    if _is_number(at):
        return call if float(at.replace(" ", "")) else f"substring({x}, 1, 0)"
    return f"(CASE WHEN {at} = 0 THEN substring({x}, 1, 0) ELSE {call} END)"


def binary(x: str) -> str:
    """``x`` as a text without a collation: what searches letters one by one takes no other, and MySQL's REPLACE and TRIM tell case."""
    return x if _is_text(x) else f"CAST({x} AS STRING)"


def trim(x: str, side: str = "BOTH", what: str | None = None) -> str:
    """Without ``what`` all white space at the ends goes."""
    x = binary(x)
    if what is not None:
        return f"trim({side} {what} FROM {x})"
    if side in ("BOTH", "LEADING"):
        x = f"regexp_replace({x}, '^\\\\s+', '')"
    if side in ("BOTH", "TRAILING"):
        x = f"regexp_replace({x}, '\\\\s+$', '')"
    return x


def extreme(name: str, *args: str) -> str:
    """NULL if any argument is; text and number literals together compare as text."""
    if len(args) < 2:
        raise EngineError(1582, f"Incorrect parameter count in the call to native function '{name.upper()}'")
    if any(map(_is_text, args)) and any(map(_is_number, args)):
        args = tuple(f"CAST({a} AS STRING)" for a in args)
    if any(a.upper() == "NULL" for a in args):
        return "NULL"
    nulls = " OR ".join(f"{a} IS NULL" for a in args if not (_is_number(a) or _is_text(a)))
    call = f"{name}({', '.join(args)})"
    return f"(CASE WHEN {nulls} THEN NULL ELSE {call} END)" if nulls else call


def condition(c: str, a: str, b: str) -> str:
    if _is_number(c):
        c = f"{c} <> 0"
    elif _is_text(c):
        c = truthy(c)
    return f"if({c}, {a}, {b})"


def truthy(x: str) -> str:
    """Whether a text's leading number is not 0."""
    return f"(coalesce(try_cast(regexp_extract({binary(x)}, '^\\\\s*([+-]?[0-9]+([.][0-9]*)?)', 1) AS DOUBLE), 0D) <> 0D)"


def json_value(x: str) -> str:
    """The JSON text of any value."""
    if x.upper() == "NULL":
        return "'null'"
    return f"regexp_extract(to_json(named_struct('v', {x}), map('ignoreNullFields', 'false')), '(?s)^.\"v\":(.*).$', 1)"


def json_array(*args: str) -> str:
    return f"concat('[', concat_ws(', ', {', '.join(map(json_value, args))}), ']')" if args else "'[]'"


def json_object(*args: str) -> str:
    """Keys are sorted; an odd number of arguments is error 1582, a NULL key 3158."""
    if len(args) % 2:
        raise EngineError(1582, "Incorrect parameter count in the call to native function 'JSON_OBJECT'")
    if any(k.upper() == "NULL" for k in args[::2]):
        raise EngineError(3158, "JSON documents may not contain NULL member names.")
    if not args:
        return "'{}'"
    pairs = ", ".join(f"struct(CAST({k} AS STRING) AS k, {json_value(v)} AS v)" for k, v in zip(args[::2], args[1::2], strict=True))
    return f"concat('{{', array_join(transform(array_sort(array({pairs})), x -> concat({json_value('x.k')}, ': ', x.v)), ', '), '}}')"


def json_extract(doc: str, path: str) -> str:
    """Strings stay quoted; only $ and $.a.b are paths, others give NULL."""
    if _is_text(path) and not re.fullmatch(r"'\$(\.\w+)*'", path):
        return "CAST(NULL AS STRING)"
    return f"to_json(variant_get(parse_json({doc}), {path}))"


def json_text(doc: str, path: str) -> str:
    return f"get_json_object({doc}, {path})"


def json_unquote(x: str) -> str:
    x = binary(x)
    return f"(CASE WHEN {x} LIKE '\"%\"' THEN get_json_object(concat('[', {x}, ']'), '$[0]') ELSE {x} END)"


def json_set(doc: str, *pairs: str) -> str:
    if len(pairs) % 2 or not pairs:
        raise EngineError(1582, "Incorrect parameter count in the call to native function 'JSON_SET'")
    paths = ", ".join(f"CAST({p} AS STRING)" for p in pairs[::2])
    values = ", ".join(json_value(v) for v in pairs[1::2])
    return f"millrace_json_set({doc}, array({paths}), array({values}))"


def match_against(columns: list[str], query: str) -> str:
    return fulltext.match_sql(columns, query)


def _one(template: str):
    return lambda *args: template.format(*args, all=", ".join(args))


def _strip(side: str):
    return lambda x, what=None: f"trim({side} {what or repr(' ')} FROM {binary(x)})"


FUNCTIONS = {
    "LENGTH": _one("CAST(octet_length({0}) AS BIGINT)"),
    "CHAR_LENGTH": _one("CAST(char_length({0}) AS BIGINT)"),
    "SUBSTRING": substring, "SUBSTR": substring, "MID": substring,
    "LTRIM": _strip("LEADING"), "RTRIM": _strip("TRAILING"),
    "GREATEST": lambda *a: extreme("greatest", *a), "LEAST": lambda *a: extreme("least", *a),
    "IF": condition, "IFNULL": _one("coalesce({0}, {1})"),
    "REPLACE": lambda x, a, b: x if a == "''" else f"replace({binary(x)}, {a}, {b})",
    "SUBSTRING_INDEX": lambda x, a, n: f"substring_index({binary(x)}, {a}, {n})",
    "NULLIF": _one("if({0} = {1}, NULL, {0})"),
    "DATEDIFF": lambda a, b: f"CAST(datediff({temporal(a)}, {temporal(b)}) AS BIGINT)",
    "NOW": lambda *_: "CAST(date_trunc('SECOND', now()) AS TIMESTAMP_NTZ)", "CURRENT_TIMESTAMP": lambda *_: "CAST(date_trunc('SECOND', now()) AS TIMESTAMP_NTZ)",
    "LOCALTIME": lambda *_: "CAST(date_trunc('SECOND', now()) AS TIMESTAMP_NTZ)", "LOCALTIMESTAMP": lambda *_: "CAST(date_trunc('SECOND', now()) AS TIMESTAMP_NTZ)",
    "CURDATE": lambda *_: "current_date()", "CURRENT_DATE": lambda *_: "current_date()",
    "JSON_EXTRACT": json_extract, "JSON_UNQUOTE": json_unquote, "JSON_OBJECT": json_object, "JSON_ARRAY": json_array, "JSON_SET": json_set,
    "TRUTHY": truthy,
}
FUNCTIONS |= {name: (lambda fn: lambda *a: f"millrace_{fn}({', '.join(a)})")(name.lower()) for name in (
    "ST_GEOMFROMTEXT", "ST_GEOMETRYFROMTEXT", "ST_POINTFROMTEXT", "ST_LINEFROMTEXT", "ST_LINESTRINGFROMTEXT", "ST_POLYFROMTEXT", "ST_POLYGONFROMTEXT", "ST_MPOINTFROMTEXT",
    "ST_MULTIPOINTFROMTEXT", "ST_MLINEFROMTEXT", "ST_MULTILINESTRINGFROMTEXT", "ST_MPOLYFROMTEXT", "ST_MULTIPOLYGONFROMTEXT", "ST_GEOMCOLLFROMTEXT", "ST_GEOMETRYCOLLECTIONFROMTEXT",
    "ST_ASTEXT", "ST_ASWKT", "ST_SRID", "ST_GEOMETRYTYPE", "ST_DIMENSION", "ST_ISEMPTY", "ST_X", "ST_Y", "ST_LATITUDE", "ST_LONGITUDE",
)}


def _srid(g: str, srid: str | None = None) -> str:
    return f"millrace_st_srid({g})" if srid is None else f"millrace_st_srid_set({g}, {srid})"


FUNCTIONS["ST_SRID"] = _srid

"""Column-expression helpers. All of them compile to built-in Spark
expressions (no Python workers), so they stay inside whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number, optionally signed, with an optional exponent.
# Spark's cast also accepts Java suffixes such as "5d"; the guard rejects them.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c: str | Column) -> Column:
    """Text or number -> double; anything unparseable, NaN or null -> 0.0."""
    c = col_of(c)
    text = c.cast("string")
    parsed = F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))
    return F.when(F.isnan(parsed) | parsed.isNull(), F.lit(0.0)).otherwise(parsed)


def safe_div(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    """num / den when den > 0, else default (guarded division)."""
    num, den = col_of(num), col_of(den)
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def floor_week(day: str | Column) -> Column:
    """Week number of a relative day; negative days floor (-1 -> -1)."""
    return F.floor(col_of(day) / F.lit(7.0)).cast("int")


def code_lookup(c: str | Column, table: tuple[Mapping[str, int], int],
                accept_codes: bool = True) -> Column:
    """Map category text to its integer code, default when unmapped.

    With ``accept_codes`` a value that already is a valid code (e.g. "1" for
    gender) is kept, so already-encoded uploads are not reset to defaults.
    """
    mapping, default = table
    c = col_of(c).cast("string")
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    looked = F.create_map(*pairs)[c]
    if accept_codes:
        codes = sorted(set(mapping.values()))
        as_code = F.when(c.isin([str(v) for v in codes]), c.cast("int"))
        looked = F.coalesce(looked, as_code)
    return F.coalesce(looked, F.lit(default)).cast("int")


def fixed(x: str | Column, digits: int) -> Column:
    """Text of x with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(col_of(x), digits))


def percent_text(x: str | Column, na: str = "N/A") -> Column:
    """0.1234 -> '12.3%'; null -> 'N/A'."""
    x = col_of(x)
    return F.when(x.isNull(), F.lit(na)).otherwise(
        F.format_string("%.1f%%", F.bround(x * 100.0, 1)))


def fill_template(template: str, **values: Column) -> Column:
    """Concatenate the literal pieces of ``template`` with ``{name}`` columns."""
    parts = re.split(r"(\{[a-z_]+\})", template)
    cols = []
    for p in parts:
        if not p:
            continue
        if p.startswith("{") and p.endswith("}"):
            cols.append(values[p[1:-1]].cast("string"))
        else:
            cols.append(F.lit(p))
    return F.concat(*cols)


def literal_map(mapping: Mapping) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def pick(values: list, index: Column) -> Column:
    """values[index] for a 0-based integer column (null when out of range)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


# ───────────────────────── DuckDB twins (oracle SQL) ─────────────────────────

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: list) -> str:
    return "[" + ", ".join(sql_str(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def sql_pick(values: list, index_sql: str) -> str:
    return f"{sql_list(values)}[CAST(({index_sql}) AS INTEGER) + 1]"


def sql_fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', round_even({x}, {digits}))"


def sql_percent_text(x: str, na: str = "N/A") -> str:
    return f"CASE WHEN {x} IS NULL THEN {sql_str(na)} ELSE printf('%.1f%%', round_even(({x}) * 100.0, 1)) END"


def sql_fill_template(template: str, **values: str) -> str:
    parts = re.split(r"(\{[a-z_]+\})", template)
    out = []
    for p in parts:
        if not p:
            continue
        if p.startswith("{") and p.endswith("}"):
            out.append(f"CAST(({values[p[1:-1]]}) AS VARCHAR)")
        else:
            out.append(sql_str(p))
    return "(" + " || ".join(out) + ")"


def sql_case_map(x: str, mapping: Mapping, default_sql: str = "NULL") -> str:
    def lit(v):
        if isinstance(v, str):
            return sql_str(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    whens = " ".join(f"WHEN {sql_str(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE CAST({x} AS VARCHAR) {whens} ELSE {default_sql} END)"


def sql_code_lookup(x: str, table: tuple[Mapping[str, int], int],
                    accept_codes: bool = True) -> str:
    mapping, default = table
    inner = sql_case_map(x, mapping, "NULL")
    if accept_codes:
        codes = ", ".join(sql_str(str(v)) for v in sorted(set(mapping.values())))
        inner = (f"COALESCE({inner}, CASE WHEN CAST({x} AS VARCHAR) IN ({codes}) "
                 f"THEN CAST(CAST({x} AS VARCHAR) AS INTEGER) END)")
    return f"CAST(COALESCE({inner}, {default}) AS INTEGER)"


def sql_coerce_numeric(x: str) -> str:
    t = f"CAST({x} AS VARCHAR)"
    return (f"(CASE WHEN regexp_matches({t}, {sql_str(NUMERIC_TEXT)}) "
            f"AND NOT isnan(TRY_CAST(trim({t}) AS DOUBLE)) "
            f"THEN TRY_CAST(trim({t}) AS DOUBLE) ELSE 0.0 END)")

"""Text templates with ``{slot}`` placeholders, rendered as a Spark Column
or as SQL (for the oracle), so one fixed format serves both engines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLOT = re.compile(r"\{(\w+)\}")


def parts(template: str) -> list[tuple[bool, str]]:
    """(is_slot, text) pieces of a template, in order."""
    out, pos = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            out.append((False, template[pos:m.start()]))
        out.append((True, m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append((False, template[pos:]))
    return out


def render(template: str, **slots: Column) -> Column:
    """The template as a Column: literals and slot Columns concatenated."""
    return F.concat(*[slots[t] if is_slot else F.lit(t) for is_slot, t in parts(template)])


def sql_literal(text: str) -> str:
    """A SQL string expression for ``text`` (quotes doubled, newlines as chr(10))."""
    pieces = text.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in pieces]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


def render_sql(template: str, **slots: str) -> str:
    """The template as a SQL expression over the given slot expressions."""
    return "(" + " || ".join(slots[t] if is_slot else sql_literal(t)
                             for is_slot, t in parts(template)) + ")"


def float_text(x: Column) -> Column:
    """A float or double as Python's ``str()`` writes it: shortest digits, plain from 1e-4 up to 1e16."""
    s = x.cast("string")
    part = lambda n: F.regexp_extract(s, r"^(-?)(\d+)\.(\d+)E(-?\d+)$", n)
    sign, exponent = part(1), part(4).try_cast("int")
    fraction = F.when(part(3) == "0", "").otherwise(part(3))
    digits = F.concat(part(2), fraction)
    padded = F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), F.lit("0"))
    after = F.substr(padded, exponent + 2)
    plain = F.concat(sign, F.substr(padded, F.lit(1), exponent + 1), F.lit("."),
                     F.when(after == "", "0").otherwise(after))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    power = F.when(F.abs(exponent) >= 100, F.concat(F.when(exponent < 0, "-").otherwise("+"),
                                                    F.abs(exponent).cast("string"))).otherwise(power)
    scientific = F.concat(sign, part(2), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)),
                          F.lit("e"), power)
    return (F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
            .when(exponent.isNull(), s)
            .when((exponent < 0) & (exponent >= -4), small)
            .when((exponent >= 0) & (exponent < 16), plain).otherwise(scientific))


def cell_text(column: Column, kind: T.DataType, null_text: str) -> Column:
    """A value as a text cell; lists of floats as Python prints them."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        items = F.transform(column, lambda x: F.coalesce(float_text(x), F.lit(null_text)))
        return F.coalesce(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), F.lit(null_text))
    return F.coalesce(column.cast("string"), F.lit(null_text))

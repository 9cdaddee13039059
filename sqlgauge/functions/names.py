"""Load-time name and type rules as Column expressions (B1, B2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.functions.querylog import strip_ws

# ---- fixed values: declared type -> target type; first matching rule wins ----
# (substrings looked for in the upper-cased declaration, target type name)
TYPE_RULES = [
    (("INT",), "BIGINT"),
    (("CHAR", "CLOB", "TEXT"), "TEXT"),
    (("BLOB",), "BYTEA"),
    ((), "TEXT"),                      # empty or missing declaration
    (("REAL", "FLOA", "DOUB"), "DOUBLE PRECISION"),
    (("NUMERIC", "DECIMAL", "MONEY"), "NUMERIC"),
    (("BOOL",), "BOOLEAN"),
]
FALLBACK_TYPE = "TEXT"                 # anything else, DATE and DATETIME included
# Identifier cleaning: characters kept, name for an empty result, prefix
# for a leading digit.
IDENT_KEEP = "a-z0-9_"
EMPTY_IDENT = "col"
DIGIT_PREFIX = "_"
# ---- end of fixed values ----

# Target type name -> Spark type.  NUMERIC is unbounded in the source model;
# Spark needs a precision, so it maps to DECIMAL(38,18) (lossy beyond that).
SPARK_TYPES = {
    "BIGINT": T.LongType(),
    "TEXT": T.StringType(),
    "BYTEA": T.BinaryType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "NUMERIC": T.DecimalType(38, 18),
    "BOOLEAN": T.BooleanType(),
}


def map_type(declared: Column) -> Column:
    """B1: declared (SQLite-style) type -> target type name."""
    d = F.upper(F.coalesce(declared, F.lit("")))
    expr = None
    for needles, target in TYPE_RULES:
        cond = (d == "") if not needles else None
        for n in needles:
            c = d.contains(n)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    return expr.otherwise(F.lit(FALLBACK_TYPE))


def spark_type_name(target: Column) -> Column:
    m = F.create_map(*[x for k, v in SPARK_TYPES.items()
                       for x in (F.lit(k), F.lit(v.simpleString()))])
    return m[target]


def sanitize(name: Column) -> Column:
    """B2: strip, lower-case, every char outside [a-z0-9_] -> '_';
    empty -> 'col'; a leading digit gets a '_' prefix.  NULL stays NULL."""
    s = F.regexp_replace(F.lower(strip_ws(name)), f"[^{IDENT_KEEP}]", "_")
    return (F.when(name.isNull(), F.lit(None).cast("string"))
            .when(s == "", F.lit(EMPTY_IDENT))
            .when(s.rlike("^[0-9]"), F.concat(F.lit(DIGIT_PREFIX), s))
            .otherwise(s))

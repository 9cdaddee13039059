"""Query-log text operators as Column expressions (JVM-side, no UDF).

Classify SQL strings into five complexity tiers and pull SQL out of model
responses.  Rules follow a Python regex classifier; the Java patterns below
are written so that every line of a log gives the same answer:

* ``(?U)`` makes ``\\b``, ``\\s`` and ``\\w`` Unicode-aware, as in Python.
* No regex repeats a group: Java recurses once per group iteration and a
  single long literal would overflow the stack and kill the executor.  String
  literals are therefore removed in two flat steps (see ``strip_literals``).
* Whitespace trimming uses ``trim(col, chars)`` with Python's whitespace set,
  which is linear; ``^\\s+|\\s+$`` is quadratic on long inner blanks.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: tiers, labels, feature names (must equal the reference) ----
TIER_LABELS = {
    1: "Tier 1: Simple SELECT/WHERE/ORDER BY",
    2: "Tier 2: JOINs",
    3: "Tier 3: GROUP BY/HAVING/aggregates",
    4: "Tier 4: Subqueries / set operations",
    5: "Tier 5: Window functions / CTEs / deep nesting",
}
# Feature name -> tier it implies, in the order features are reported.
FEATURE_TIERS = [
    ("join", 2),
    ("aggregate", 3),
    ("group_by", 3),
    ("having", 3),
    ("subquery", 4),
    ("set_operation", 4),
    ("window_function", 5),
    ("cte", 5),
    ("deep_nesting", 5),
]
FEATURES = [name for name, _ in FEATURE_TIERS]
AGGREGATE_NAMES = ["count", "sum", "avg", "min", "max", "group_concat", "string_agg"]
SET_OPERATORS = ["union", "intersect", "except"]
FROM_TERMINATORS = ["where", "group", "order", "having"]
# ---- end of fixed values ----

_MARK = "\u0001"  # stands in for one removed literal between the two steps
_ESCAPE = "\u0002"


def _word(w: str) -> str:
    return rf"\b{w}\b"


RX_SELECT = "(?U)" + _word("select")
RX_JOIN = "(?U)" + _word("join")
RX_AGG = "(?U)\\b(?:" + "|".join(AGGREGATE_NAMES) + ")\\s*\\("
RX_GROUP_BY = "(?U)\\bgroup\\s+by\\b"
RX_HAVING = "(?U)" + _word("having")
RX_SETOP = "(?U)\\b(?:" + "|".join(SET_OPERATORS) + ")\\b"
RX_WINDOW = "(?U)\\bover\\s*\\("
RX_CTE = "(?U)\\bwith\\b[\\s\\S]*?\\bas\\s*\\("
# Text between the first FROM and the next clause word (or the end). UNIX_LINES
# (d) makes $ mean "end, or before a final \n", exactly like Python's $.
RX_FROM_SEGMENT = ("(?Usd)\\bfrom\\b(.*?)(?:"
                   + "|".join(_word(w) for w in FROM_TERMINATORS) + "|$)")
# First fenced block, optional sql tag, any case, across lines.
RX_FENCE = "(?Uis)```(?:sql)?\\s*(.*?)```"


def python_whitespace() -> str:
    """Every character Python's str.strip() removes, derived from its rule."""
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


_WS = python_whitespace()


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.trim(c, F.lit(_WS))


def _guarded(text: Column, needles: list[str], regex_test: Column) -> Column:
    """``regex_test``, evaluated only when ``text`` holds one of the literal
    ``needles`` the pattern cannot match without (a cheap substring scan)."""
    pre = None
    for n in needles:
        c = text.contains(n)
        pre = c if pre is None else (pre | c)
    return F.when(pre, regex_test).otherwise(F.lit(False))


def strip_literals(sql: Column) -> Column:
    """Replace string literals with empty ones: ``'a''b'`` -> ``''``.

    Step 1 marks every ``'...'`` run without inner quotes; step 2 folds a run
    of adjacent marks (one doubled-quote literal) into a single ``''``.  The
    same is then done for double quotes.  A text that holds the mark itself is
    escaped before and unescaped after.  Text without a quote character skips
    the regexes.
    """
    escaped = F.replace(F.replace(sql, F.lit(_ESCAPE), F.lit(_ESCAPE + "a")), F.lit(_MARK), F.lit(_ESCAPE + "b"))
    stripped = _strip_unmarked(escaped)
    restored = F.replace(F.replace(stripped, F.lit(_ESCAPE + "b"), F.lit(_MARK)), F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))
    return F.when(sql.contains(_MARK), restored).otherwise(_strip_unmarked(sql))


def _strip_unmarked(sql: Column) -> Column:
    """``strip_literals`` of a text without the mark."""
    s1 = F.regexp_replace(F.regexp_replace(sql, "'[^']*'", _MARK), _MARK + "+", "''")
    s = F.when(sql.contains("'"), s1).otherwise(sql)
    s2 = F.regexp_replace(F.regexp_replace(s, '"[^"]*"', _MARK), _MARK + "+", '""')
    return F.when(s.contains('"'), s2).otherwise(s)


def count_selects(normalised: Column) -> Column:
    """Number of ``select`` words (on lower-cased, literal-free text)."""
    return F.when(normalised.contains("select"), F.regexp_count(normalised, F.lit(RX_SELECT))) \
        .otherwise(F.lit(0))


def normalise_sql(query: Column) -> Column:
    """Lower-case and strip literals: the text every rule below looks at."""
    return strip_literals(F.lower(F.coalesce(query, F.lit(""))))


def from_segment(s: Column) -> Column:
    """Text between the first FROM and the next clause word (or the end)."""
    return F.when(s.contains("from"), F.regexp_extract(s, RX_FROM_SEGMENT, 1)).otherwise(F.lit(""))


def feature_flags(s: Column, n_select: Column, segment: Column | None = None,
                  has_cte: Column | None = None) -> dict[str, Column]:
    """Boolean Column per feature, given normalised text and its select count."""
    segment = from_segment(s) if segment is None else segment
    has_cte = cte_flag(s) if has_cte is None else has_cte
    return {
        "join": _guarded(s, ["join"], s.rlike(RX_JOIN))
                | (segment.contains(",") & ~segment.contains("select")),
        "aggregate": _guarded(s, ["("], s.rlike(RX_AGG)),
        "group_by": _guarded(s, ["group"], s.rlike(RX_GROUP_BY)),
        "having": _guarded(s, ["having"], s.rlike(RX_HAVING)),
        "subquery": (n_select > 1) & ~has_cte,
        "set_operation": _guarded(s, SET_OPERATORS, s.rlike(RX_SETOP)),
        "window_function": _guarded(s, ["over"], s.rlike(RX_WINDOW)),
        "cte": has_cte,
        "deep_nesting": n_select >= 3,
    }


def cte_flag(s: Column) -> Column:
    return _guarded(s, ["with"], s.rlike(RX_CTE))


def tier_label(tier: Column) -> Column:
    m = F.create_map(*[x for k, v in TIER_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return m[tier]


def with_complexity(df: DataFrame, query_col: str = "query",
                    tier_col: str = "tier", features_col: str = "features",
                    label_col: str | None = "label") -> DataFrame:
    """Add tier (int), features (array<string>, fixed order) and label columns.

    Blank or NULL text is tier 1 with no features.  The normalised text and
    the feature flags are projected once each, so no regex runs twice.
    """
    s_col, n_col, seg_col, cte_col = "__qlog_s", "__qlog_nsel", "__qlog_seg", "__qlog_cte"
    out = df.withColumn(s_col, normalise_sql(F.col(query_col)))
    out = out.select("*", count_selects(F.col(s_col)).alias(n_col),
                     from_segment(F.col(s_col)).alias(seg_col),
                     cte_flag(F.col(s_col)).alias(cte_col))
    flags = feature_flags(F.col(s_col), F.col(n_col), F.col(seg_col), F.col(cte_col))
    flag_cols = {f"__qlog_f_{k}": v for k, v in flags.items()}
    out = out.select("*", *[v.alias(k) for k, v in flag_cols.items()])
    blank = F.col(query_col).isNull() | (strip_ws(F.col(query_col)) == "")
    names = [(name, F.col(f"__qlog_f_{name}")) for name in FEATURES]
    tier = F.lit(1)
    for t in (2, 3, 4, 5):
        hit = None
        for name, implied in FEATURE_TIERS:
            if implied == t:
                c = F.col(f"__qlog_f_{name}")
                hit = c if hit is None else (hit | c)
        tier = F.when(hit, F.lit(t)).otherwise(tier)
    features = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in names]),
                        lambda x: x.isNotNull())
    out = out.withColumn(tier_col, F.when(blank, F.lit(1)).otherwise(tier).cast("int"))
    out = out.withColumn(features_col, F.when(blank, F.array().cast("array<string>"))
                         .otherwise(features))
    if label_col:
        out = out.withColumn(label_col, tier_label(F.col(tier_col)))
    return out.drop(s_col, n_col, seg_col, cte_col, *flag_cols)


def extract_sql(text: Column) -> Column:
    """SQL from a model response.

    First fenced block (optional ``sql`` tag, any case, spanning lines), else
    the whole text; then strip, drop every trailing ``;``, strip again.
    NULL or empty text gives ``''``.  ``regexp_extract`` yields ``''`` both
    for "no match" and "empty block", hence the explicit ``rlike`` test.
    """
    t = F.coalesce(text, F.lit(""))
    fenced = _guarded(t, ["```"], t.rlike(RX_FENCE))
    body = F.when(fenced, F.regexp_extract(t, RX_FENCE, 1)).otherwise(t)
    return strip_ws(F.rtrim(strip_ws(body), F.lit(";")))

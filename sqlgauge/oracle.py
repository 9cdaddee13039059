"""DuckDB SQL for the correctness gate: the same answers, computed by SQL.

Each builder returns SQL text that DuckDB runs over the pre-registered test
tables.  DuckDB's RE2 has no backtracking stack, so the plain Python patterns
can be used here (no ``(?U)``: in RE2 that flag means "ungreedy").
"""

from __future__ import annotations

from sqlgauge.functions.querylog import (AGGREGATE_NAMES, FEATURE_TIERS,
                                          FROM_TERMINATORS, SET_OPERATORS,
                                          TIER_LABELS)
from sqlgauge.sources import derived


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_literals_sql(x: str) -> str:
    s = f"regexp_replace({x}, {lit(chr(39) + '(?:[^' + chr(39) + ']|' + chr(39) * 2 + ')*' + chr(39))}, {lit(chr(39) * 2)}, 'g')"
    return f"regexp_replace({s}, {lit('\"(?:[^\"]|\"\")*\"')}, {lit('\"\"')}, 'g')"


def _w(word: str) -> str:
    return rf"\b{word}\b"


def classify_cte(source_sql: str, query_col: str = "query", key: str = "log_id") -> str:
    """CTE chain ``cls`` with key, tier, features (comma text), label, flags."""
    agg = r"\b(" + "|".join(AGGREGATE_NAMES) + r")\s*\("
    setop = r"\b(" + "|".join(SET_OPERATORS) + r")\b"
    seg = r"(?s)\bfrom\b(.*?)(" + "|".join(_w(w) for w in FROM_TERMINATORS) + "|$)"
    cte = r"\bwith\b[\s\S]*?\bas\s*\("
    flags = {
        "join": f"(regexp_matches(s, {lit(_w('join'))}) OR (strpos(seg, ',') > 0 AND strpos(seg, 'select') = 0))",
        "aggregate": f"regexp_matches(s, {lit(agg)})",
        "group_by": f"regexp_matches(s, {lit(r'\bgroup\s+by\b')})",
        "having": f"regexp_matches(s, {lit(_w('having'))})",
        "subquery": "(nsel > 1 AND NOT has_cte)",
        "set_operation": f"regexp_matches(s, {lit(setop)})",
        "window_function": f"regexp_matches(s, {lit(r'\bover\s*\(')})",
        "cte": "has_cte",
        "deep_nesting": "(nsel >= 3)",
    }
    flag_cols = ",\n  ".join(f"{v} AS f_{k}" for k, v in flags.items())
    tier = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"f_{n}" for n, t in FEATURE_TIERS if t == tier_) + f" THEN {tier_}"
        for tier_ in (5, 4, 3, 2)) + " ELSE 1 END"
    feats = "concat_ws(',', " + ", ".join(
        f"CASE WHEN f_{n} THEN '{n}' END" for n, _ in FEATURE_TIERS) + ")"
    label = "CASE tier " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in TIER_LABELS.items()) + " END"
    return f"""
src AS ({source_sql}),
norm AS (SELECT *, {strip_literals_sql(f"lower(coalesce({query_col}, ''))")} AS s FROM src),
pre AS (SELECT *, len(regexp_extract_all(s, {lit(_w('select'))})) AS nsel,
               regexp_extract(s, {lit(seg)}, 1) AS seg,
               regexp_matches(s, {lit(cte)}) AS has_cte FROM norm),
flg AS (SELECT *,
  {flag_cols}
  FROM pre),
tiered AS (SELECT *, CAST({tier} AS INTEGER) AS tier, {feats} AS features FROM flg),
cls AS (SELECT *, {label} AS label FROM tiered)"""


def python_ws_lit() -> str:
    from sqlgauge.functions.querylog import python_whitespace
    return lit(python_whitespace())


def extract_sql_expr(x: str) -> str:
    fence = r"(?is)```(?:sql)?\s*(.*?)```"
    t = f"coalesce({x}, '')"
    body = f"CASE WHEN regexp_matches({t}, {lit(fence)}) THEN regexp_extract({t}, {lit(fence)}, 1) ELSE {t} END"
    ws = python_ws_lit()
    return f"trim(rtrim(trim({body}, {ws}), ';'), {ws})"


# ---- D keys ----

def strip_literals() -> str:
    return (f"SELECT log_id, {strip_literals_sql('query')} AS stripped "
            f"FROM ({derived.query_log_sql()}) q")


def select_count() -> str:
    return (f"WITH {classify_cte(derived.query_log_sql())[1:]} "
            "SELECT log_id, CAST(nsel AS INTEGER) AS n_select FROM cls")


def classify() -> str:
    return (f"WITH {classify_cte(derived.query_log_sql())[1:]} "
            "SELECT log_id, source, tier, features, label FROM cls")


def extract_sql() -> str:
    return (f"SELECT log_id, {extract_sql_expr('response')} AS extracted "
            f"FROM ({derived.query_log_sql()}) q")


def tier_histogram() -> str:
    return (f"WITH {classify_cte(derived.query_log_sql())[1:]}, "
            "cnt AS (SELECT tier, count(*) AS n FROM cls GROUP BY tier), "
            "tiers AS (SELECT CAST(range AS INTEGER) AS tier FROM range(1, 6)), "
            "h AS (SELECT tiers.tier, coalesce(cnt.n, 0) AS n FROM tiers LEFT JOIN cnt ON tiers.tier = cnt.tier) "
            "SELECT tier, n, repeat('#', CAST(floor(40 * n / greatest((SELECT sum(n) FROM h), 1)) AS INTEGER)) AS bar FROM h")


def tier_counts() -> str:
    return (f"WITH {classify_cte(derived.query_log_sql())[1:]} "
            "SELECT tier, count(*) AS n FROM cls GROUP BY tier")


def feature_counts() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(count_if(f_{n}) AS BIGINT) AS n FROM cls" for n, _ in FEATURE_TIERS)
    return (f"WITH {classify_cte(derived.query_log_sql())[1:]} "
            f"SELECT feature, n FROM ({parts}) x WHERE n > 0")


# ---- B keys ----

def map_type_sql(x: str) -> str:
    from sqlgauge.functions.names import FALLBACK_TYPE, TYPE_RULES
    d = f"upper(coalesce({x}, ''))"
    whens = []
    for needles, target in TYPE_RULES:
        cond = " OR ".join(f"strpos({d}, {lit(n)}) > 0" for n in needles) if needles else f"{d} = ''"
        whens.append(f"WHEN {cond} THEN {lit(target)}")
    return "CASE " + " ".join(whens) + f" ELSE {lit(FALLBACK_TYPE)} END"


def sanitize_sql(x: str) -> str:
    from sqlgauge.functions.names import DIGIT_PREFIX, EMPTY_IDENT, IDENT_KEEP
    s = f"regexp_replace(lower(trim({x}, {python_ws_lit()})), {lit('[^' + IDENT_KEEP + ']')}, '_', 'g')"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} = '' THEN {lit(EMPTY_IDENT)} "
            f"WHEN regexp_matches({s}, '^[0-9]') THEN {lit(DIGIT_PREFIX)} || {s} ELSE {s} END")


def map_types() -> str:
    return (f"SELECT column_id, declared, {map_type_sql('declared')} AS target_type "
            f"FROM ({derived.declarations_sql()}) d")


def sanitize_names() -> str:
    return (f"SELECT column_id, raw_name, {sanitize_sql('raw_name')} AS clean_name "
            f"FROM ({derived.raw_names_sql()}) n")


def name_collisions() -> str:
    return (f"WITH c AS (SELECT db_id, table_name, raw_name AS raw, {sanitize_sql('raw_name')} AS clean_name "
            f"FROM ({derived.raw_names_sql()}) n), "
            "r AS (SELECT DISTINCT db_id, table_name, clean_name, raw FROM c) "
            "SELECT db_id, table_name, clean_name, count(*) AS n_raw, min(raw) AS first_raw, "
            "max(raw) AS last_raw FROM r GROUP BY db_id, table_name, clean_name HAVING count(*) > 1")


def cast_audit(table: str, source: str, targets: dict[str, str]) -> str:
    parts = []
    for c, t in targets.items():
        parts.append(
            f"SELECT {lit(table)} AS table_name, {lit(c)} AS column_name, {lit(t)} AS target_type, "
            f"count(CAST({c} AS VARCHAR)) AS n_values, "
            f"count(CASE WHEN CAST({c} AS VARCHAR) IS NOT NULL AND "
            f"TRY_CAST(CAST({c} AS VARCHAR) AS {t}) IS NULL THEN 1 END) AS n_bad FROM ({source}) s")
    return " UNION ALL ".join(parts)


def pk_check(keys: dict[str, tuple[str, ...]], tables: list[str]) -> str:
    parts = []
    for t in sorted(tables):
        pk = keys.get(t)
        if not pk:
            continue
        cols = ", ".join(pk)
        anynull = " OR ".join(f"{c} IS NULL" for c in pk)
        parts.append(
            f"SELECT {lit(t)} AS table_name, {lit(', '.join(pk))} AS key_columns, "
            "CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, "
            "CAST(coalesce(sum(CASE WHEN anynull THEN n END), 0) AS BIGINT) AS n_null_key, "
            "CAST(count(CASE WHEN NOT anynull AND n > 1 THEN 1 END) AS BIGINT) AS n_dup_keys, "
            "CAST(coalesce(sum(CASE WHEN NOT anynull AND n > 1 THEN n END), 0) AS BIGINT) AS n_dup_rows "
            f"FROM (SELECT {cols}, count(*) AS n, ({anynull}) AS anynull FROM {t} GROUP BY {cols}) g")
    body = " UNION ALL ".join(parts)
    return (f"SELECT *, CASE WHEN n_null_key > 0 THEN 'null key' WHEN n_dup_keys > 0 "
            f"THEN 'duplicate key' ELSE 'ok' END AS verdict FROM ({body}) x")


def fk_check(fks, tables: list[str], derived: dict[str, str] | None = None) -> str:
    """From the rule: a child row whose key parts are all set needs a parent row with
    these values; a parent key (no part NULL) that occurs twice is not unique."""
    source = {t: t for t in tables} | {t: f"({sql})" for t, sql in (derived or {}).items()}
    parts = []
    for fk in fks:
        if fk.table not in source or fk.ref_table not in source:
            continue
        child, parent = source[fk.table], source[fk.ref_table]
        complete = " AND ".join(f"c.{a} IS NOT NULL" for a in fk.columns)
        match = " AND ".join(f"p.{r} = c.{a}" for a, r in zip(fk.columns, fk.ref_columns))
        orphans = f"FROM {child} c WHERE {complete} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {match})"
        cols, refs = ", ".join(fk.columns), ", ".join(fk.ref_columns)
        whole = " AND ".join(f"{r} IS NOT NULL" for r in fk.ref_columns)
        parts.append(
            f"SELECT {lit(fk.name)} AS fk_name, {lit(fk.table)} AS table_name, "
            f"{lit(', '.join(fk.columns))} AS columns, {lit(fk.ref_table)} AS ref_table, "
            f"{lit(', '.join(fk.ref_columns))} AS ref_columns, "
            f"(SELECT count(*) FROM {child} c) AS n_child_rows, "
            f"(SELECT count(*) FROM {child} c WHERE {complete}) AS n_checked, "
            f"(SELECT count(*) {orphans}) AS n_orphan_rows, "
            f"(SELECT count(*) FROM (SELECT DISTINCT {cols} {orphans}) o) AS n_orphan_keys, "
            f"(SELECT count(*) FROM (SELECT {refs} FROM {parent} q WHERE {whole} GROUP BY {refs} "
            "HAVING count(*) > 1) d) AS n_parent_dup_keys")
    body = " UNION ALL ".join(parts)
    return ("SELECT *, CASE WHEN n_parent_dup_keys > 0 OR n_orphan_rows > 0 THEN 'skipped' "
            "ELSE 'accepted' END AS status, CASE WHEN n_parent_dup_keys > 0 THEN "
            "'referenced key is not unique' WHEN n_orphan_rows > 0 THEN "
            "CAST(n_orphan_rows AS VARCHAR) || ' row(s) without parent' END AS reason "
            f"FROM ({body}) x")


def load_stats(dbs: list[tuple[str, list[str]]], keys: dict[str, tuple[str, ...]]) -> str:
    """Per database: ok when every keyed table has unique, non-null keys
    (column names of the test tables never collide)."""
    per_db = []
    for name, tables in dbs:
        checks = pk_check(keys, tables)
        per_db.append(
            f"SELECT {lit(name)} AS db_id, count(CASE WHEN verdict <> 'ok' THEN 1 END) = 0 AS ok, "
            f"count(*) AS tables, sum(n_rows) AS rows FROM ({checks}) k")
    body = " UNION ALL ".join(per_db)
    return ("SELECT CAST(count(CASE WHEN ok THEN 1 END) AS BIGINT) AS databases, "
            "CAST(count(CASE WHEN NOT ok THEN 1 END) AS BIGINT) AS failed, "
            "CAST(coalesce(sum(CASE WHEN ok THEN tables END), 0) AS BIGINT) AS tables, "
            "CAST(coalesce(sum(CASE WHEN ok THEN rows END), 0) AS BIGINT) AS rows "
            f"FROM ({body}) d")


def running_costs(scored_sql: str) -> str:
    """G12 as window sums over any scored table."""
    w = "OVER (PARTITION BY strategy ORDER BY example_id ROWS UNBOUNDED PRECEDING)"
    return ("SELECT strategy, example_id, CAST(input_tokens AS BIGINT) AS input_tokens, "
            "CAST(output_tokens AS BIGINT) AS output_tokens, round(cost_usd, 8) AS cost_usd, "
            f"CAST(sum(input_tokens) {w} AS BIGINT) AS running_input_tokens, "
            f"CAST(sum(output_tokens) {w} AS BIGINT) AS running_output_tokens, "
            f"round(sum(cost_usd) {w}, 8) AS running_cost_usd FROM ({scored_sql}) s")


# ---- C keys (catalog profile of one database) ----

DUCK_TO_SPARK_TYPE = {"BIGINT": "BIGINT", "INTEGER": "INT", "VARCHAR": "STRING", "DOUBLE": "DOUBLE",
                      "TIMESTAMP": "TIMESTAMP_NTZ", "FLOAT": "FLOAT", "FLOAT[]": "ARRAY<FLOAT>",
                      "BOOLEAN": "BOOLEAN", "DATE": "DATE"}


def table_columns(table: str) -> list[str]:
    """Column names of a test table."""
    from sqlgauge.sources.tables import TEST_COLUMNS
    return list(TEST_COLUMNS[table])


def _values(rows: list[tuple]) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, (int, float)):
            return str(x)
        return lit(str(x))
    return ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)


def _meta_ctes(db_name: str, tables: list[str], keys) -> str:
    in_list = ", ".join(lit(t) for t in tables)
    ty = "CASE data_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in DUCK_TO_SPARK_TYPE.items()) \
        + " ELSE upper(data_type) END"
    pk_rows = [(t, c, i + 1) for t in tables for i, c in enumerate(keys.primary_keys.get(t, ()))]
    fk_rows = [(fk.table, fk.name, ", ".join(fk.columns), fk.ref_table, ", ".join(fk.ref_columns))
               for fk in keys.foreign_keys if fk.table in tables and fk.ref_table in tables]
    fk_cte = (f"fk(table_name, fk_name, cols, ref_table, ref_cols) AS (VALUES {_values(fk_rows)})"
              if fk_rows else
              "fk AS (SELECT ''::VARCHAR AS table_name, ''::VARCHAR AS fk_name, ''::VARCHAR AS cols, "
              "''::VARCHAR AS ref_table, ''::VARCHAR AS ref_cols WHERE false)")
    return (f"cols AS (SELECT DISTINCT table_name, column_name, ordinal_position AS o, {ty} AS ty "
            f"FROM information_schema.columns WHERE table_name IN ({in_list})), "
            f"pk(table_name, column_name, pos) AS (VALUES {_values(pk_rows)}), {fk_cte}")


def _ddl_cte(db_name: str) -> str:
    from sqlgauge.functions.text import render_sql, sql_literal
    from sqlgauge.operators import catalog as C
    col_line = render_sql(C.COLUMN_TEMPLATE, name="c.column_name", type="c.ty",
                          not_null=f"CASE WHEN pk.pos IS NOT NULL THEN {lit(C.NOT_NULL)} ELSE '' END")
    pk_line = render_sql(C.PRIMARY_KEY_TEMPLATE,
                         columns=f"string_agg(column_name, {lit(C.KEY_COLUMN_SEP)} ORDER BY pos)")
    fk_line = render_sql(C.FOREIGN_KEY_TEMPLATE, columns="cols", ref_table="ref_table",
                         ref_columns="ref_cols")
    ddl = render_sql(C.DDL_TEMPLATE, table="table_name",
                     body=f"string_agg(line, {sql_literal(C.DDL_LINE_SEP)} ORDER BY o)")
    return (
        "lines AS ("
        f"SELECT c.table_name, c.o, {col_line} AS line "
        "FROM cols c LEFT JOIN pk ON pk.table_name = c.table_name AND pk.column_name = c.column_name "
        f"UNION ALL SELECT table_name, 100000, {pk_line} FROM pk GROUP BY table_name "
        "UNION ALL SELECT table_name, 200000 + row_number() OVER (PARTITION BY table_name ORDER BY fk_name), "
        f"{fk_line} FROM fk), "
        f"ddl AS (SELECT {lit(db_name)} AS db_id, table_name, {ddl} AS ddl FROM lines GROUP BY table_name)")


def _samples_cte(db_name: str, tables: list[str], keys, limit: int) -> str:
    from sqlgauge.operators import catalog as C
    parts = []
    for t in sorted(tables):
        cols = table_columns(t)
        pk = list(keys.primary_keys.get(t, ()))
        order = ", ".join(f"{c} ASC NULLS LAST" for c in pk + [c for c in cols if c not in pk])
        as_text = {"embedding": "replace(CAST(embedding AS VARCHAR), 'NULL', 'None')"}
        cells = ", ".join(f"coalesce({as_text.get(c, f'CAST({c} AS VARCHAR)')}, 'None')" for c in cols)
        parts.append(
            f"SELECT {lit(db_name)} AS db_id, {lit(t)} AS table_name, "
            f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS sample_pos, "
            f"concat_ws({lit(C.CELL_SEP)}, {cells}) AS row_text "
            f"FROM (SELECT * FROM {t} ORDER BY {order} LIMIT {limit}) s")
    return "smp AS (" + " UNION ALL ".join(parts) + ")"


def _blocks_cte(db_name: str) -> str:
    from sqlgauge.functions.text import render_sql, sql_literal
    from sqlgauge.operators import catalog as C
    block = render_sql(C.SAMPLE_TEMPLATE, n="CAST(n AS VARCHAR)", header="header", body="b")
    return (
        f"hdr AS (SELECT table_name, string_agg(column_name, {lit(C.CELL_SEP)} ORDER BY o) AS header "
        "FROM cols GROUP BY table_name), "
        f"body AS (SELECT db_id, table_name, count(*) AS n, string_agg(row_text, "
        f"{sql_literal(C.SAMPLE_ROW_SEP)} ORDER BY sample_pos) AS b FROM smp GROUP BY db_id, table_name), "
        f"sblock AS (SELECT body.db_id, body.table_name, {block} AS sample_block "
        "FROM body JOIN hdr ON hdr.table_name = body.table_name)")


def catalog_with(db_name: str, tables: list[str], keys, limit: int = 3) -> str:
    from sqlgauge.functions.text import render_sql, sql_literal
    from sqlgauge.operators import catalog as C
    min_line = render_sql(C.MIN_TEMPLATE, table="table_name",
                          columns=f"string_agg(column_name, {lit(C.MIN_COLUMN_SEP)} ORDER BY o)")
    return ("WITH " + _meta_ctes(db_name, tables, keys) + ", " + _ddl_cte(db_name) + ", "
            + _samples_cte(db_name, tables, keys, limit) + ", " + _blocks_cte(db_name) + ", "
            "full_text AS (SELECT ddl.db_id, string_agg(CASE WHEN sample_block IS NULL THEN ddl "
            f"ELSE ddl || {sql_literal(C.DDL_SAMPLE_SEP)} || sample_block END, {sql_literal(C.TABLE_SEP)} "
            "ORDER BY ddl.table_name) AS schema_text "
            "FROM ddl LEFT JOIN sblock ON sblock.table_name = ddl.table_name GROUP BY ddl.db_id), "
            f"min_lines AS (SELECT table_name, {min_line} AS line FROM cols GROUP BY table_name), "
            f"min_text AS (SELECT {lit(db_name)} AS db_id, string_agg(line, {sql_literal(C.MIN_LINE_SEP)} "
            "ORDER BY table_name) AS schema_text_min FROM min_lines) ")


def cat_row_counts(db_name: str, tables: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(db_name)} AS db_id, {lit(t)} AS table_name, count(*) AS row_count FROM {t}"
        for t in sorted(tables))


def cat_columns(db_name, tables, keys) -> str:
    return ("WITH " + _meta_ctes(db_name, tables, keys) + " "
            f"SELECT {lit(db_name)} AS db_id, c.table_name, c.column_name, c.ty AS data_type, "
            "pk.pos IS NULL AS is_nullable, CAST(c.o AS INTEGER) AS ordinal, "
            "CAST(pk.pos AS INTEGER) AS pk_position FROM cols c LEFT JOIN pk "
            "ON pk.table_name = c.table_name AND pk.column_name = c.column_name")


def each(parts: list[str]) -> str:
    """The rows of several queries (each may have its own WITH)."""
    return " UNION ALL ".join(f"SELECT * FROM ({q}) q{i}" for i, q in enumerate(parts))


def cat_profile(db_name, tables, keys, limit=3) -> str:
    """C8/C9 from the catalog, the declared keys and plain counts."""
    parts = []
    for t in sorted(tables):
        n_fk = sum(fk.table == t and fk.ref_table in tables for fk in keys.foreign_keys)
        parts.append(
            f"SELECT {lit(db_name)} AS db_id, {lit(t)} AS table_name, "
            "CAST((SELECT count(DISTINCT column_name) FROM information_schema.columns "
            f"WHERE table_name = {lit(t)}) AS INTEGER) AS n_columns, "
            f"{lit(', '.join(keys.primary_keys.get(t, ())))} AS primary_key, "
            f"CAST({n_fk} AS INTEGER) AS n_foreign_keys, count(*) AS row_count, "
            f"CAST(least(count(*), {limit}) AS INTEGER) AS n_samples FROM {t}")
    return " UNION ALL ".join(parts)


def cat_samples(db_name, tables, keys, limit=3) -> str:
    return catalog_with(db_name, tables, keys, limit) + "SELECT db_id, table_name, sample_pos, row_text FROM smp"


def ddl_text(db_name, tables, keys) -> str:
    return catalog_with(db_name, tables, keys) + "SELECT db_id, table_name, ddl FROM ddl"


def sample_text(db_name, tables, keys, limit=3) -> str:
    return catalog_with(db_name, tables, keys, limit) + "SELECT db_id, table_name, sample_block FROM sblock"


def schema_text(db_name, tables, keys, limit=3) -> str:
    return catalog_with(db_name, tables, keys, limit) + "SELECT db_id, schema_text FROM full_text"


def schema_text_min(db_name, tables, keys) -> str:
    return catalog_with(db_name, tables, keys) + "SELECT db_id, schema_text_min FROM min_text"


# ---- E, F, G keys: the replayed benchmark over the shop database ----

def template_sql(t) -> str:
    """A prompt Template's user text as a SQL expression over q/min/full columns."""
    cols = {"question": "question", "schema_min": "schema_text_min", "schema_full": "schema_text"}
    return " || ".join(cols[x] if is_slot else lit(x) for is_slot, x in t.parts())


def _cells(q: str) -> str:
    return (f"SELECT concat_ws(chr(31), *COLUMNS(*)) AS r FROM "
            f"(SELECT coalesce(CAST(COLUMNS(*) AS VARCHAR), 'None') FROM ({q}) q0) q1")


def multiset_equal(a: str, b: str) -> str:
    return (f"(SELECT coalesce(bool_and(d = 0), true) FROM (SELECT r, sum(side) AS d FROM ("
            f"SELECT 1 AS side, r FROM ({_cells(a)}) x UNION ALL "
            f"SELECT -1 AS side, r FROM ({_cells(b)}) y) u GROUP BY r) z)")


def benchmark_with(db_name: str, tables: list[str], keys) -> str:
    """CTEs: prompts, gen (replayed answers, tokens, cost), scored."""
    from sqlgauge.operators import benchmark as BM
    from sqlgauge.operators import generate as GN
    from sqlgauge.operators import prompts as PR
    from sqlgauge.plans.gold import GOLD
    ex_rows = [(f"q{i:02d}_{g.key}", g.question, g.sql) for i, g in enumerate(GOLD)]
    resp_rows, ver_parts = [], []
    for i, g in enumerate(GOLD):
        for s in PR.STRATEGIES:
            variant = BM.replay_variant(i, s)
            ex = f"q{i:02d}_{g.key}"
            resp_rows.append((ex, s, BM.replay_text(i, s, g.alt, g.wrong)))
            if variant in ("failing", "refused"):
                eq, kind = "NULL", variant
            else:
                eq, kind = multiset_equal(g.oracle("sql"), g.oracle(variant)), "ok"
            ver_parts.append(f"SELECT {lit(ex)} AS example_id, {lit(s)} AS strategy, "
                             f"CAST({eq} AS BOOLEAN) AS eq, {lit(kind)} AS kind")
    prompt_parts = []
    for name, t in PR.STRATEGIES.items():
        mx = t.max_tokens or PR.DEFAULT_MAX_TOKENS
        prompt_parts.append(
            f"SELECT example_id, question, gold_sql, {lit(name)} AS strategy, {lit(t.system)} AS system, "
            f"{template_sql(t)} AS \"user\", {mx} AS max_tokens FROM ex, full_text, min_text")
    rates = {m: (a, b) for m, a, b in GN.DEFAULT_PRICES}
    rin, rout = rates[GN.DEFAULT_MODEL]
    ws = python_ws_lit()
    return (catalog_with(db_name, tables, keys)[:-1] + ", "
            f"ex(example_id, question, gold_sql) AS (VALUES {_values(ex_rows)}), "
            f"resp(example_id, strategy, response) AS (VALUES {_values(resp_rows)}), "
            "prompts AS (" + " UNION ALL ".join(prompt_parts) + "), "
            f"gen AS (SELECT p.*, {lit(GN.DEFAULT_MODEL)} AS model, r.response, "
            f"{extract_sql_expr('trim(r.response, ' + ws + ')')} AS sql, "
            "CAST(ceil(length(p.system || p.\"user\") / 4) AS BIGINT) AS input_tokens, "
            f"CAST(ceil(length(trim(r.response, {ws})) / 4) AS BIGINT) AS output_tokens "
            "FROM prompts p JOIN resp r ON r.example_id = p.example_id AND r.strategy = p.strategy), "
            f"costed AS (SELECT *, input_tokens / 1e6 * {rin} + output_tokens / 1e6 * {rout} AS cost_usd FROM gen), "
            "ver AS (" + " UNION ALL ".join(ver_parts) + "), "
            "scored AS (SELECT c.*, v.eq, CASE WHEN v.kind = 'ok' THEN v.eq ELSE false END AS correct, "
            "CASE WHEN v.kind <> 'ok' THEN 'generated_failed' WHEN v.eq THEN 'match' ELSE 'differ' END AS verdict "
            "FROM costed c JOIN ver v ON v.example_id = c.example_id AND v.strategy = c.strategy) ")


def prompt_set(db_name, tables, keys) -> str:
    return benchmark_with(db_name, tables, keys) + \
        "SELECT example_id, strategy, system, \"user\", max_tokens FROM prompts"


def generate_replay(db_name, tables, keys) -> str:
    return benchmark_with(db_name, tables, keys) + \
        "SELECT example_id, strategy, model, sql, input_tokens, output_tokens FROM gen"


def token_cost(db_name, tables, keys, models: list[str]) -> str:
    from sqlgauge.operators import generate as GN
    prices = _values(GN.DEFAULT_PRICES)
    model_rows = " UNION ALL ".join(f"SELECT {lit(m)} AS model" for m in models)
    return benchmark_with(db_name, tables, keys) + (
        "SELECT g.example_id, g.strategy, m.model, g.input_tokens, g.output_tokens, "
        "round(coalesce(g.input_tokens / 1e6 * p.input_rate + g.output_tokens / 1e6 * p.output_rate, 0.0), 10) "
        f"AS cost_usd FROM gen g, ({model_rows}) m LEFT JOIN (VALUES {prices}) p(model, input_rate, output_rate) "
        "ON p.model = m.model")


def score_rows(db_name, tables, keys) -> str:
    return benchmark_with(db_name, tables, keys) + "SELECT example_id, strategy, eq AS equal FROM scored"


def score_verdict(db_name, tables, keys) -> str:
    return benchmark_with(db_name, tables, keys) + \
        "SELECT example_id, strategy, correct, verdict FROM scored"


def strategy_report(db_name, tables, keys) -> str:
    return benchmark_with(db_name, tables, keys) + (
        "SELECT strategy, CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS n_correct, count(*) AS n, "
        "round(sum(cost_usd), 6) AS cost_usd, CAST(CASE WHEN count(*) > 0 THEN "
        "round(100.0 * sum(CAST(correct AS BIGINT)) / count(*), 2) ELSE 0.0 END AS DOUBLE) AS accuracy_pct "
        "FROM scored GROUP BY strategy")


def overall_report(db_name, tables, keys) -> str:
    return benchmark_with(db_name, tables, keys) + (
        "SELECT CAST(coalesce(sum(CAST(correct AS BIGINT)), 0) AS BIGINT) AS n_correct, count(*) AS n, "
        "round(coalesce(sum(cost_usd), 0.0), 6) AS cost_usd, CAST(CASE WHEN count(*) > 0 THEN "
        "round(100.0 * sum(CAST(correct AS BIGINT)) / count(*), 2) ELSE 0.0 END AS DOUBLE) AS accuracy_pct "
        "FROM scored")


def question_report(db_name, tables, keys) -> str:
    return benchmark_with(db_name, tables, keys) + (
        "SELECT example_id, strategy, CASE WHEN correct THEN 'PASS' ELSE 'FAIL' END AS mark, "
        "sql AS generated_sql, gold_sql, CASE WHEN NOT correct THEN verdict END AS why FROM scored")


def cost_report(db_name, tables, keys) -> str:
    w = ("OVER (PARTITION BY strategy ORDER BY example_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return benchmark_with(db_name, tables, keys) + (
        "SELECT strategy, example_id, input_tokens, output_tokens, round(cost_usd, 8) AS cost_usd, "
        f"CAST(sum(input_tokens) {w} AS BIGINT) AS running_input_tokens, "
        f"CAST(sum(output_tokens) {w} AS BIGINT) AS running_output_tokens, "
        f"round(sum(cost_usd) {w}, 8) AS running_cost_usd FROM scored")


# ---- G6 and P keys ----

def normalise_rows(sql: str) -> str:
    return ("SELECT k AS o_orderkey, concat_ws('|', *COLUMNS(* EXCLUDE (k))) AS row_text FROM "
            "(SELECT o_orderkey AS k, coalesce(CAST(COLUMNS(*) AS VARCHAR), 'None') FROM "
            f"({sql}) q) r")


def cube_of_log() -> str:
    """The cube with latencies over the whole derived log (see the query's docstring)."""
    return ("WITH sc AS (SELECT tier, source AS strategy, 'm' || CAST(log_id % 3 AS VARCHAR) AS model, "
            "log_id % 4 <> 1 AS correct, CAST(log_id % 16 AS DOUBLE) / 16 AS cost_usd, "
            f"log_id * 7919 % 1000 AS ms FROM ({classify()}) c) "
            "SELECT model, strategy, tier, CAST(GROUPING(model, strategy, tier) AS BIGINT) AS level, "
            "count(*) AS n, CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS n_correct, "
            "CAST(round(100.0 * sum(CAST(correct AS BIGINT)) / count(*), 2) AS DOUBLE) AS accuracy_pct, "
            "round(sum(cost_usd), 6) AS cost_usd, CAST(quantile_cont(ms, 0.5) AS DOUBLE) AS p50_ms, "
            "CAST(quantile_cont(ms, 0.95) AS DOUBLE) AS p95_ms FROM sc GROUP BY CUBE (model, strategy, tier)")


def history(db_name, tables, keys) -> str:
    """The second of two appended runs: the scores as they are."""
    return (f"SELECT 'round_2' AS run_id, strategy, n, n_correct FROM ({strategy_report(db_name, tables, keys)}) r")


def history_runs(db_name, tables, keys) -> str:
    from sqlgauge.plans.gold import GOLD
    rows = " UNION ALL ".join(f"SELECT {lit(f'q{i:02d}_{g.key}')} AS example_id, count(*) AS n FROM ({g.oracle('sql')}) g"
                              for i, g in enumerate(GOLD))
    return benchmark_with(db_name, tables, keys)[:-1] + f", sizes AS ({rows}) " + (
        "SELECT s.example_id, s.strategy, s.correct, z.n AS logged_rows, z.n AS kept_rows "
        "FROM scored s JOIN sizes z ON z.example_id = s.example_id")


def history_diff(before: str, after: str) -> str:
    return (f"SELECT coalesce(b.example_id, a.example_id) AS example_id, coalesce(b.strategy, a.strategy) AS strategy, "
            "b.correct AS before, a.correct AS after, CASE WHEN b.example_id IS NULL THEN 'added' "
            "WHEN a.example_id IS NULL THEN 'removed' WHEN b.correct = a.correct THEN 'same' "
            f"WHEN a.correct THEN 'fixed' ELSE 'broken' END AS change FROM ({before}) b FULL JOIN ({after}) a "
            "ON a.example_id = b.example_id AND a.strategy = b.strategy")


def repair_rounds(scored: str, most: int) -> str:
    """Each round's failed answers asked again: every 17th unanswered, right by a rule on the id."""
    ctes, asked = [f"r0 AS ({scored})"], "SELECT 0 AS round, strategy, correct FROM r0"
    for r in range(1, most + 1):
        ctes.append(f"r{r} AS (SELECT strategy, example_id, example_id % 17 <> {r} "
                    f"AND (example_id + {r * r}) % {r + 2} = 0 AS correct FROM r{r - 1} WHERE NOT correct)")
        asked += f" UNION ALL SELECT {r} AS round, strategy, correct FROM r{r}"
    w = "OVER (PARTITION BY strategy ORDER BY round)"
    return (f"WITH {', '.join(ctes)}, a AS ({asked}), "
            "g AS (SELECT round, strategy, count(*) AS asked, count_if(correct) AS fixed FROM a GROUP BY ALL), "
            # A round after one that fixed nothing at all never ran.
            "t AS (SELECT round, sum(fixed) AS f FROM g GROUP BY round) "
            f"SELECT CAST(round AS INTEGER) AS round, strategy, asked, CAST(fixed AS BIGINT) AS fixed, "
            f"CAST(sum(fixed) {w} AS BIGINT) AS correct, first_value(asked) {w} AS n FROM g "
            "WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.round > 0 AND t.round < g.round AND t.f = 0)")


def index_recall() -> str:
    return ("WITH v AS (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL) "
            "SELECT count(*) AS n_queries, CAST(sum(least(5, (SELECT count(*) FROM v) - 1)) AS BIGINT) AS n_expected, "
            "true AS enough FROM v WHERE vec_id % 50 = 0")


WORDS_OF = (r"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            r"'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}]+')")


def bm25_ctes(queries: str, docs: str) -> str:
    """CTEs ending in ``hits`` (grp, qid, id, score); queries: grp, qid, text; docs: grp, id, text."""
    return (
        f"q AS (SELECT grp, qid, term, count(*) AS times FROM (SELECT grp, qid, unnest({WORDS_OF.format(x='text')}) AS term "
        f"FROM ({queries}) x) y GROUP BY ALL), "
        f"t AS (SELECT grp, id, {WORDS_OF.format(x='text')} AS words FROM ({docs}) x), "
        "s AS (SELECT grp, count(*) AS n_all, avg(len(words)) AS mean FROM t GROUP BY grp), "
        "p AS (SELECT grp, id, len, term, CAST(count(*) AS DOUBLE) AS times FROM (SELECT grp, id, len(words) AS len, "
        "unnest(words) AS term FROM t) y GROUP BY ALL), "
        "f AS (SELECT grp, term, count(*) AS n FROM p GROUP BY ALL), "
        "w AS (SELECT p.grp, p.term, p.id, CAST(floor(ln((n_all - n + 0.5e0) / (n + 0.5e0)) * p.times * 2.2e0 / "
        "(p.times + 1.2e0 * (0.25e0 + 0.75e0 * len / mean)) * 1000000) AS BIGINT) AS weight "
        "FROM p JOIN f ON f.grp = p.grp AND f.term = p.term JOIN s ON s.grp = p.grp WHERE 2 * n < n_all), "
        "r AS (SELECT q.grp, q.qid, w.id, CAST(sum(q.times * w.weight) AS BIGINT) AS score "
        "FROM q JOIN w ON w.grp = q.grp AND w.term = q.term GROUP BY ALL), "
        "hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank "
        "FROM r WHERE score > 0)")


def bm25_documents() -> str:
    return ("WITH " + bm25_ctes("SELECT '' AS grp, item_id AS qid, text FROM benchmark WHERE item_id IS NOT NULL",
                                "SELECT '' AS grp, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL")
            + " SELECT qid AS item_id, rank, id AS doc_id, score FROM hits WHERE rank <= 10")


def schema_context(dbs: list[tuple[str, list[str]]], keys) -> str:
    names = [(d, t, o, n) for d, tables in dbs for t in tables for o, n in enumerate([t, *table_columns(t)])]
    fks = sorted({(d, f.table, f.ref_table) for d, tables in dbs for f in keys.foreign_keys
                  if f.table in tables and f.ref_table in tables})
    return (
        f"WITH RECURSIVE names(db_id, table_name, o, name) AS (VALUES {_values(names)}), "
        f"fk(db_id, table_name, referred) AS (VALUES {_values(fks)}), "
        "reach AS (SELECT * FROM fk UNION SELECT r.db_id, r.table_name, f.referred FROM reach r "
        "JOIN fk f ON f.db_id = r.db_id AND f.table_name = r.referred), "
        "texts AS (SELECT db_id, table_name, string_agg(replace(name, '_', ' '), ' ' ORDER BY o) AS text "
        "FROM names GROUP BY ALL), "
        + bm25_ctes(f"SELECT db_id AS grp, example_id AS qid, question AS text FROM ({derived.questions_sql()}) e",
                    "SELECT db_id AS grp, table_name AS id, text FROM texts") + ", "
        "best AS (SELECT qid, grp, id FROM hits WHERE rank <= 3), "
        "needed AS (SELECT qid, id FROM best UNION SELECT b.qid, r.referred FROM best b "
        "JOIN reach r ON r.db_id = b.grp AND r.table_name = b.id) "
        "SELECT qid AS example_id, string_agg(id, ',' ORDER BY id) AS tables, CAST(count(*) AS INTEGER) AS n_declared "
        "FROM needed GROUP BY qid")


def generate_calls() -> str:
    return ("SELECT example_id, strategy, CASE WHEN length(user_text) % 13 <> 0 THEN trim(reverse(user_text)) END AS response, "
            "CASE WHEN length(user_text) % 13 <> 0 THEN length(system) + length(user_text) END AS input_tokens, "
            "CASE WHEN length(user_text) % 13 <> 0 THEN length(user_text) END AS output_tokens, "
            "CASE WHEN length(user_text) % 13 = 0 THEN 'length divisible by 13' END AS error "
            f"FROM ({derived.calls_sql()}) c")


def score_pairs(pairs: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {lit(name)} AS pair, CAST({multiset_equal(a, b)} AS BOOLEAN) AS equal"
                              for name, a, b in pairs)


def benchmark_cube(db_name, tables, keys) -> str:
    src = "SELECT example_id AS g_example_id, gold_sql AS query FROM ex"
    cls = classify_cte(src, "query")
    return benchmark_with(db_name, tables, keys)[:-1] + "," + cls[1:] + (
        ", sc AS (SELECT s.*, c.tier FROM scored s JOIN cls c ON c.g_example_id = s.example_id) "
        "SELECT model, strategy, tier, CAST(GROUPING(model, strategy, tier) AS BIGINT) AS level, "
        "count(*) AS n, CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS n_correct, "
        "CAST(round(100.0 * sum(CAST(correct AS BIGINT)) / count(*), 2) AS DOUBLE) AS accuracy_pct, "
        "round(sum(cost_usd), 6) AS cost_usd FROM sc GROUP BY CUBE (model, strategy, tier)")


def repair_gain(db_name, tables, keys) -> str:
    from sqlgauge.plans.gold import GOLD
    alt = " UNION ALL ".join(
        f"SELECT {lit(f'q{i:02d}_{g.key}')} AS example_id, CAST({multiset_equal(g.oracle('sql'), g.oracle('alt'))} "
        "AS BOOLEAN) AS eq_alt" for i, g in enumerate(GOLD))
    return benchmark_with(db_name, tables, keys)[:-1] + f", alt_eq AS ({alt}) " + (
        "SELECT strategy, count(*) AS n, CAST(sum(CAST(correct AS BIGINT)) AS BIGINT) AS correct_before, "
        "CAST(sum(CAST(correct OR (NOT correct AND a.eq_alt) AS BIGINT)) AS BIGINT) AS correct_after, "
        "CAST(sum(CAST(correct OR (NOT correct AND a.eq_alt) AS BIGINT)) - sum(CAST(correct AS BIGINT)) "
        "AS BIGINT) AS gain FROM scored s JOIN alt_eq a ON a.example_id = s.example_id GROUP BY strategy")


def similar_topk(k: int) -> str:
    return (
        "WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings), "
        "c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY label, pos), "
        "cent AS (SELECT label, list(m ORDER BY pos) AS centroid FROM c GROUP BY label), "
        "s AS (SELECT cent.label, e.vec_id, list_cosine_similarity(cent.centroid, "
        "CAST(e.embedding AS DOUBLE[])) AS score FROM cent, embeddings e), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) "
        f"SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {k}")


def load_log(dbs: list[tuple[str, list[str]]], keys) -> str:
    """Per database: loaded when every keyed table passes; else the first
    failing table (by name) is the error and nothing is counted."""
    per_db = []
    for name, tables in dbs:
        checks = pk_check(keys, tables)
        per_db.append(
            f"SELECT {lit(name)} AS db_id, count(CASE WHEN verdict <> 'ok' THEN 1 END) = 0 AS ok, "
            "count(*) AS tables, sum(n_rows) AS rows, "
            "min(CASE WHEN verdict <> 'ok' THEN table_name || ': primary key ' || verdict END) AS error "
            f"FROM ({checks}) k")
    body = " UNION ALL ".join(per_db)
    return ("SELECT db_id, ok, CAST(CASE WHEN ok THEN tables ELSE 0 END AS BIGINT) AS tables, "
            "CAST(CASE WHEN ok THEN rows ELSE 0 END AS BIGINT) AS rows, error "
            f"FROM ({body}) d")


def bench_examples(n: int) -> str:
    return (f"WITH {classify_cte(derived.query_log_sql())[1:]} "
            f"SELECT log_id, query, tier, label FROM cls ORDER BY log_id LIMIT {n}")

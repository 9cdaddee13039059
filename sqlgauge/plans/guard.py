"""Read-only guard for submitted SQL.

A Spark session sees every table and runs any statement, so read-only is
enforced before execution: the text is parsed (not run), the parsed plan and
every nested plan (CTE bodies, subqueries) are walked and any node that
writes, changes state or runs a script is refused.  After analysis, the
analyzed plan is walked again: for reflection calls (the parsed plan only
shows unresolved names) and for every leaf that reads data, which must be
one of the run database's own tables -- names built during analysis, such
as ``IDENTIFIER('parquet.`/path`')``, cannot reach other files or
namespaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Plan nodes that are not Commands but still write or execute.
DENIED_NODES = {
    "InsertIntoStatement", "InsertIntoDir", "UnresolvedExecuteImmediate",
    "ExecuteImmediateQuery", "Call", "CompoundBody", "SingleStatement",
    "CreateTableAsSelect", "ReplaceTableAsSelect", "AppendData",
    "OverwriteByExpression", "OverwritePartitionsDynamic", "DeleteFromTable",
    "UpdateTable", "MergeIntoTable", "CacheTableAsSelect", "UncacheTable",
    "CacheTable",
}
# Leaves that read no table: literals, ranges, references to CTEs.
SAFE_LEAVES = {"LocalRelation", "Range", "OneRowRelation", "CTERelationRef", "UnionLoopRef"}
# Functions that call into the JVM by reflection.
DENIED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
DENIED_EXPRESSIONS = {"CallMethodViaReflection", "TryReflect"}


class GuardError(Exception):
    """Raised when a statement is not a read-only query."""


def _iter(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _norm_path(p: str) -> str:
    p = str(p)
    if p.startswith("file:"):
        p = p[len("file:"):]
        while p.startswith("//"):
            p = p[1:]
    return p.rstrip("/")


class _Scope:
    """What a run may read: the database's parquet paths or its namespace."""

    def __init__(self, roots=None, namespace: str | None = None):
        self.roots = {_norm_path(r) for r in (roots or [])}
        self.namespace = namespace

    def allows(self, node) -> bool:
        name = node.getClass().getSimpleName()
        if name in SAFE_LEAVES:
            return True
        if name != "LogicalRelation":
            return False
        try:
            cat = node.catalogTable()
            if cat.isDefined():
                db = cat.get().identifier().database()
                db = db.get() if hasattr(db, "isDefined") and db.isDefined() else db
                return self.namespace is not None and str(db) == self.namespace
            it = node.relation().location().rootPaths().iterator()
            paths = []
            while it.hasNext():
                paths.append(_norm_path(it.next().toString()))
            return bool(paths) and all(p in self.roots for p in paths)
        except Exception:  # noqa: BLE001 - anything unverifiable is refused
            return False


class _Walker:
    """Walks plans, nested plans and expressions with a stack of its own, so any depth will do."""

    def __init__(self, spark: SparkSession, allow_qualified: bool, scope: _Scope | None = None):
        kind = spark.sparkContext._jvm.java.lang.Class.forName
        catalyst = "org.apache.spark.sql.catalyst."
        self.command = kind(catalyst + "plans.logical.Command")
        self.logical = kind(catalyst + "plans.logical.LogicalPlan")
        self.subquery = kind(catalyst + "expressions.SubqueryExpression")
        self.allow_qualified = allow_qualified
        self.scope = scope

    def walk(self, plan) -> None:
        left = [(self.plan, plan)]
        while left:
            visit, node = left.pop()
            left.extend(visit(node))

    def plan(self, node) -> list:
        """Refuse a plan node or return what to visit below it."""
        name = node.getClass().getSimpleName()
        if self.command.isInstance(node) or name in DENIED_NODES:
            raise GuardError(f"read-only: {name} is not allowed")
        if self.scope is not None and node.children().isEmpty() and not self.scope.allows(node):
            raise GuardError(f"read-only: {name} reads data outside the database")
        if name == "UnresolvedRelation" and not self.allow_qualified:
            parts = list(_iter(node.multipartIdentifier()))
            if len(parts) > 1:
                raise GuardError(
                    f"read-only: qualified name {'.'.join(parts)} is outside the database")
        below = [(self.plan, c) for c in _iter(node.children())]
        below += [(self.plan, c) for c in _iter(node.innerChildren()) if self.logical.isInstance(c)]
        return below + [(self.expr, e) for e in _iter(node.expressions())]

    def expr(self, e) -> list:
        """Refuse an expression or return what to visit below it."""
        name = e.getClass().getSimpleName()
        if name in DENIED_EXPRESSIONS:
            raise GuardError(f"read-only: {name} is not allowed")
        if name == "UnresolvedFunction":
            fn = str(e.nameParts().last()).lower()
            if fn in DENIED_FUNCTIONS:
                raise GuardError(f"read-only: function {fn} is not allowed")
        nested = [(self.plan, e.plan())] if self.subquery.isInstance(e) else []
        return nested + [(self.expr, c) for c in _iter(e.children())]


def check_parsed(spark: SparkSession, sql: str, allow_qualified: bool = False) -> None:
    """Parse only (nothing runs) and refuse anything but a read-only query."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    plan = parser.parsePlan(sql)
    _Walker(spark, allow_qualified).walk(plan)


def check_analyzed(df: DataFrame, scope: _Scope | None = None) -> None:
    """Walk the analyzed plan (with subqueries and CTE bodies) for reflection
    and, given a scope, for any leaf that reads outside the database (names
    built at analysis time, e.g. ``IDENTIFIER('parquet.`/path`')``)."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    _Walker(spark, True, scope).walk(plan)


def scope_of(db) -> _Scope:
    """The read scope of a Database: its namespace, else its parquet paths."""
    if getattr(db, "namespace", None):
        return _Scope(namespace=db.namespace)
    return _Scope(roots=db.paths.values())


def guarded_sql(spark: SparkSession, sql: str, allow_qualified: bool = False,
                db=None) -> DataFrame:
    """``spark.sql`` for read-only queries only; raises GuardError otherwise."""
    check_parsed(spark, sql, allow_qualified)
    df = spark.sql(sql)
    check_analyzed(df, None if (allow_qualified or db is None) else scope_of(db))
    return df

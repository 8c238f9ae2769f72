"""Admission of ad-hoc SQL: a walk over the plan that Spark's own parser gives, then analysis against registered views only.

Admitted is a single read-only statement over known tables, without unsafe functions or file relations, with bounded joins
and nesting. Its result is limited. Works on a classic session (the parser is reached over its JVM).
"""

from __future__ import annotations

import difflib
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

MAX_ROWS, MAX_JOINS, MAX_DEPTH, TIMEOUT_S = 50_000, 8, 6, 15.0

# Schemas and functions that no statement may name.
BANNED_SCHEMAS = {"pg_catalog", "information_schema", "pg_toast", "pg_temp", "mysql", "performance_schema", "sys", "sqlite_master", "sqlite_temp_master"}
BANNED_FUNCTIONS = {
    "pg_read_file", "pg_read_binary_file", "pg_ls_dir", "pg_sleep", "lo_import", "lo_export", "dblink", "dblink_exec", "copy",
    "load_file", "sys_exec", "sys_eval", "xp_cmdshell", "sp_executesql", "query_to_xml", "pg_stat_file", "current_setting", "set_config",
    "load_extension", "readfile", "writefile", "eval", "system",
}
#: Spark's own functions that run code, read files' names, name the user or fail on purpose.
BANNED_SPARK = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "raise_error", "assert_true", "version", "spark_partition_id", "try_variant_get_unsafe"}
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "range"}
#: Nodes of a parsed read; any other node makes a statement something else.
READS = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving",
    "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "OneRowRelation", "Generate", "Pivot", "Unpivot", "Window", "WithWindowDefinition", "UnresolvedSubqueryColumnAliases", "UnresolvedTableAlias", "Sample", "PipeExpression", "UnresolvedOrdinal", "LocalRelation", "ResolvedInlineTable", "CTERelationRef", "WithCTE", "CTERelationDef", "Deduplicate", "UnresolvedTVFAliases", "UnresolvedPivot", "AsOfJoin",
}


@dataclass(frozen=True)
class Finding:
    rule: str
    message: str
    severity: str = "error"
    hint: str | None = None


@dataclass
class Admission:
    findings: list[Finding] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    joins: int = 0
    depth: int = 0
    estimated_rows: int = 0
    frame: DataFrame | None = None

    @property
    def ok(self) -> bool:
        return not any(f.severity == "error" for f in self.findings)

    @property
    def rules(self) -> set[str]:
        return {f.rule for f in self.findings if f.severity == "error"}


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


@dataclass
class _Seen:
    relations: list[list[str]] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    table_functions: list[str] = field(default_factory=list)
    others: list[str] = field(default_factory=list)
    joins: int = 0
    cartesian: int = 0
    star: bool = False
    depth: int = 0


def _expression(e, seen: _Seen, depth: int, scope: frozenset[str]) -> None:
    name = _name(e)
    if name == "UnresolvedFunction":
        seen.functions.append(_seq(e.nameParts())[-1].lower())
    elif "Star" in name:
        seen.star = True
    elif name in {"CurrentUser", "CallMethodViaReflection", "InputFileName"}:
        seen.functions.append({"CurrentUser": "current_user", "CallMethodViaReflection": "reflect", "InputFileName": "input_file_name"}[name])
    if name in ("ListQuery", "Exists", "ScalarSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _plan(e.plan(), seen, depth + 1, scope)
    for child in _seq(e.children()):
        _expression(child, seen, depth, scope)


def _plan(node, seen: _Seen, depth: int, scope: frozenset[str] = frozenset()) -> None:
    """scope: the names that WITH clauses around the node define; a table of such a name is meant only outside of them."""
    name = _name(node)
    seen.depth = max(seen.depth, depth)
    if name not in READS:
        seen.others.append(name)
        return
    if name == "UnresolvedRelation":
        parts = [p.lower() for p in _seq(node.multipartIdentifier())]
        if len(parts) > 1 or parts[0] not in scope:
            seen.relations.append(parts)
    elif name == "UnresolvedTableValuedFunction":
        seen.table_functions.append(_seq(node.name())[-1].lower())
    elif name in ("Join", "AsOfJoin"):
        seen.joins += 1
        kind = node.joinType().toString()
        if name == "Join" and node.condition().isEmpty() and "Cross" not in kind and "Using" not in kind:
            seen.cartesian += 1
    elif name == "LateralJoin":
        seen.joins += 1
        _plan(node.right().plan(), seen, depth + 1, scope)
    inner = depth
    if name == "UnresolvedWith":
        for pair in _seq(node.cteRelations()):
            _plan(pair.productElement(1), seen, depth + 1, scope)
            scope = scope | {pair.productElement(0).lower()}
    elif name == "SubqueryAlias" and _name(node.child()) != "UnresolvedRelation":
        inner = depth + 1
    for e in _seq(node.expressions()):
        _expression(e, seen, depth, scope)
    for child in _seq(node.children()):
        _plan(child, seen, inner, scope)


def statements(sql: str) -> int:
    """How many statements a text holds: what stands between semicolons outside literals and comments, if anything does."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", "x", sql)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", bare, flags=re.DOTALL)
    return sum(bool(part.strip()) for part in bare.split(";"))


def _near(word: str, known: list[str], cutoff: float) -> str | None:
    own = difflib.get_close_matches(word, known, 1, cutoff)
    return f"Did you mean {own[0]}?" if own else None


@contextmanager
def _registered(spark: SparkSession, views: dict[str, DataFrame]) -> Iterator[None]:
    """Temporary views for as long as a statement is resolved; views that the session had under their names come back."""
    before = {t.name.lower(): spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary and t.name.lower() in views}
    try:
        for name, frame in views.items():
            frame.createOrReplaceTempView(name)
        yield
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def admit(spark: SparkSession, sql: str, views: dict[str, DataFrame], rows: dict[str, int] | None = None, max_rows: int = MAX_ROWS, max_joins: int = MAX_JOINS, max_depth: int = MAX_DEPTH) -> Admission:
    """Findings, and a limited DataFrame if there is no error. views: the allowed tables by lower-case name; rows: their sizes, if known."""
    out = Admission()
    add = lambda rule, message, severity="error", hint=None: out.findings.append(Finding(rule, message, severity, hint))
    if statements(sql) > 1:
        add("multiple_statements", "Only one statement is allowed.")
        return out
    sql = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (ParseException, AnalysisException) as error:
        add("parse_failed", str(error).split("\n")[0])
        return out
    seen = _Seen()
    _plan(plan, seen, 1)
    out.joins, out.depth = seen.joins, seen.depth
    if seen.others:
        add("non_read_statement", f"Only reads are allowed ({', '.join(sorted(set(seen.others)))}).")
        return out
    for parts in seen.relations:
        if set(parts) & BANNED_SCHEMAS:
            add("banned_schema", f"{'.'.join(parts)} is not readable.")
        elif len(parts) > 1 or parts[0] not in views:
            add("unknown_table", f"{'.'.join(parts)} is not a known table.", hint=_near(parts[-1], sorted(views), 0.6))
        elif parts[0] not in out.tables:
            out.tables.append(parts[0])
    for f in sorted({f for f in seen.functions if f in BANNED_FUNCTIONS | BANNED_SPARK} | {f for f in seen.table_functions if f not in TABLE_FUNCTIONS}):
        add("banned_function", f"{f} is not allowed.")
    if seen.cartesian:
        add("cartesian_join", "A join needs a condition; say CROSS JOIN if all pairs are meant.")
    if seen.joins > max_joins:
        add("too_many_joins", f"{seen.joins} joins; at most {max_joins} are allowed.")
    if seen.depth > max_depth:
        add("excessive_nesting", f"Nested {seen.depth} deep; at most {max_depth} is allowed.")
    if seen.star:
        add("select_star", "Name the columns that are needed.", "warning")
    out.estimated_rows = sum((rows or {}).get(t, 0) for t in out.tables)
    if not out.ok:
        return out
    try:
        with _registered(spark, {name: views[name] for name in out.tables}):
            frame = spark.sql(sql)
    except (AnalysisException, PySparkException) as error:
        condition = error.getCondition() or ""
        rule = "unknown_column" if "UNRESOLVED_COLUMN" in condition else "ungrouped_aggregate_select" if "MISSING_GROUP_BY" in condition or "MISSING_AGGREGATION" in condition else "unknown_table" if "TABLE_OR_VIEW" in condition else "banned_function" if "UNRESOLVED_ROUTINE" in condition else "parse_failed"
        add(rule, str(error).split("\n")[0])
        return out
    if "GlobalLimit" not in frame._jdf.queryExecution().analyzed().toString().split("\n")[0]:
        add("missing_limit", f"Limited to {max_rows} rows.", "warning")
    out.frame = frame.limit(max_rows)
    return out


@dataclass
class Result:
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    warnings: list[str] = field(default_factory=list)
    error: str | None = None


def execute(spark: SparkSession, sql: str, views: dict[str, DataFrame], max_rows: int = MAX_ROWS, timeout: float = TIMEOUT_S) -> Result:
    """Rows of an admitted statement, at most max_rows, or why there are none; the job is cancelled after timeout seconds."""
    own = admit(spark, sql, views, max_rows=max_rows + 1)
    if not own.ok:
        return Result(error="; ".join(f.message for f in own.findings if f.severity == "error"))
    sc, group = spark.sparkContext, f"ask-{id(own)}"
    timer = threading.Timer(timeout, sc.cancelJobGroup, [group])
    sc.setJobGroup(group, sql[:100], interruptOnCancel=True)
    timer.start()
    try:
        rows = [tuple(r) for r in own.frame.collect()]
    except Exception as error:  # translated for the user below
        return Result(error=f"The query took more than {timeout:g} seconds." if "cancel" in str(error).lower() else f"The query failed: {str(error).splitlines()[0][:200]}")
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    out = Result(own.frame.columns, rows[:max_rows], len(rows) > max_rows, [f.message for f in own.findings])
    if out.truncated:
        out.warnings.append(f"Truncated to {max_rows} rows; aggregate further.")
    return out

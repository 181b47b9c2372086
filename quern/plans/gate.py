"""The gate: one read-only query, parsed and checked before anything runs, then executed within bounds.

Checks look at the parsed, unresolved plan: no command or statement node anywhere, only relations of the namespace
or of the query's own WITH clause, no table-valued functions, no functions that reach outside SQL.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.limits import Limits
from quern.sources.catalog import Namespace

#: Functions that run code, read files or touch the session.
DENIED = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length current_database current_catalog current_user session_user user version spark_partition_id monotonically_increasing_id raise_error assert_true sleep read_files from_protobuf to_protobuf".split())
#: Error classes by the beginning of Spark's condition.
CONDITIONS = (
    ("PARSE_EMPTY_STATEMENT", "empty_sql"),
    ("PARSE_SYNTAX_ERROR", "parse_error"),
    ("INVALID_SQL_SYNTAX", "parse_error"),
    ("UNSUPPORTED_FEATURE", "parse_error"),
    ("TABLE_OR_VIEW_NOT_FOUND", "unknown_table"),
    ("UNRESOLVED_COLUMN", "unknown_column"),
    ("UNRESOLVED_FIELD", "unknown_column"),
    ("AMBIGUOUS_REFERENCE", "ambiguous_column"),
    ("AMBIGUOUS_COLUMN", "ambiguous_column"),
)


_analysing = threading.RLock()


class GateError(ValueError):
    """kind is one of the error classes; detail names what is unknown where that is known."""

    def __init__(self, kind: str, message: str = "", detail: str | None = None):
        super().__init__(message or kind)
        self.kind, self.detail = kind, detail


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    has_more: bool
    size: int


def statements(sql: str) -> list[str]:
    """The text cut at semicolons outside quotes and comments; blank parts are left out."""
    out, part = [], []
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", sql, re.S):
        if m[0] == ";":
            out.append("".join(part))
            part = []
        else:
            part.append(m[0])
    out.append("".join(part))
    return [x for x in out if re.sub(r"--[^\n]*|/\*.*?\*/", "", x, flags=re.S).strip()]


def seq(x) -> list:
    """A Scala sequence as a list."""
    return [x.apply(i) for i in range(x.size())]


def class_name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


_KINDS: dict[str, frozenset[str]] = {}


def _kinds(node) -> frozenset[str]:
    """The simple names of a node's class, its ancestors and their interfaces; asked of the JVM once a class."""
    c = node.getClass()
    name = c.getName()
    if name not in _KINDS:
        todo, found = [c], set()
        while todo:
            c = todo.pop()
            found.add(c.getSimpleName())
            todo += list(c.getInterfaces())
            if c.getSuperclass() is not None:
                todo.append(c.getSuperclass())
        _KINDS[name] = frozenset(found)
    return _KINDS[name]


def walk(plan) -> Iterator[tuple[str, object]]:
    """("plan", node) and ("expression", node) of a plan, its expressions and their subqueries, in pre-order."""
    todo = [("plan", plan)]
    while todo:
        kind, node = todo.pop()
        yield kind, node
        below = []
        if kind == "plan":
            below += [("expression", e) for e in seq(node.expressions())]
            below += [("plan", x) for x in (seq(node.innerChildren()) if class_name(node) == "UnresolvedWith" else [])]
            below += [("plan", x) for x in seq(node.children())]
        else:
            below += [("expression", x) for x in seq(node.children())]
            if "PlanExpression" in _kinds(node):
                below.append(("plan", node.plan()))
        todo += reversed(below)


class Gate:
    def __init__(self, spark: SparkSession, namespace: Namespace, limits: Limits = Limits()):
        self.spark, self.namespace, self.limits = spark, namespace, limits

    def parse(self, sql: str):
        """The unresolved plan of one query; raises GateError."""
        if not isinstance(sql, str) or not sql.strip():
            raise GateError("empty_sql")
        if "\0" in sql:
            raise GateError("parse_error", "NUL character")
        if len(sql) > self.limits.sql_chars:
            raise GateError("sql_too_long")
        parts = statements(sql)
        if not parts:
            raise GateError("empty_sql")
        if len(parts) > 1:
            raise GateError("multiple_statements")
        try:
            return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(parts[0])
        except PySparkException as e:
            raise self.error(e) from None

    def validate(self, sql: str):
        """The plan, once nothing in it is forbidden."""
        plan = self.parse(sql)
        names = {x.lower() for x in self.namespace.views}
        ctes, relations = set(), []
        for kind, node in walk(plan):
            name = class_name(node)
            if kind == "plan":
                if any(re.search(r"Command|ParsedStatement|^InsertInto|^Write|^Unresolved(?:Identifier|DBObject)", k) for k in _kinds(node)):
                    raise GateError("forbidden_sql", name)
                if name == "UnresolvedWith":
                    ctes |= {t._1().lower() for t in seq(node.cteRelations())}
                elif name == "UnresolvedRelation":
                    relations.append([p for p in seq(node.multipartIdentifier())])
                elif name in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "ScriptTransformation", "LogicalRDD"):
                    raise GateError("forbidden_sql", name)
            elif name == "UnresolvedFunction":
                f = [p for p in seq(node.nameParts())]
                if len(f) > 1 or f[-1].lower() in DENIED:
                    raise GateError("forbidden_sql", ".".join(f))
        for r in relations:
            if len(r) > 1:
                raise GateError("forbidden_sql", ".".join(r))
            if r[0].lower() not in names | ctes:
                raise GateError("unknown_table", r[0], r[0])
        return plan

    def error(self, e: Exception) -> GateError:
        condition = (e.getCondition() or "") if isinstance(e, PySparkException) else ""
        for start, kind in CONDITIONS:
            if condition.startswith(start):
                found = re.search(r"`([^`]+)`(?!\.)", str(e)) if kind.startswith("unknown") else None
                return GateError(kind, str(e).split("\n")[0], found[1] if found else None)
        return GateError("execution_error", str(e).split("\n")[0])

    def dataframe(self, sql: str) -> DataFrame:
        """The validated query as a DataFrame, resolved against the namespace."""
        self.validate(sql)
        with _analysing:  # databases that run side by side have views of the same names; a resolved plan needs them no more
            self.namespace.register()
            try:
                return self.spark.sql(statements(sql)[0])
            except PySparkException as e:
                raise self.error(e) from None

    def execute(self, sql: str, rows: int | None = None, size: int | None = None, seconds: float | None = None) -> Result:
        """At most `rows` rows, whether there are more, and their size as text; stops at the size or time limit.

        At the time limit the query's jobs are cancelled by their tag and the caller goes on; tasks in a long loop may not
        notice, so that a cluster should set spark.task.reaper.enabled, which ends them with their executor.  Queries of
        several threads have a tag and a limit each.
        """
        rows = rows or self.limits.rows
        df = self.dataframe(sql)
        got = [tuple(r) for r in self.collect(df.limit(rows + 1), seconds)]
        total, kept = 0, []
        for r in got[:rows]:
            total += sum(len(str(v)) for v in r if v is not None)
            if size is not None and total > size:
                raise GateError("result_too_large")
            kept.append(r)
        return Result(df.columns, kept, len(got) > rows, total)

    def collect(self, df: DataFrame, seconds: float | None = None) -> list:
        """The rows of a frame within the time limit; GateError if it fails or is late."""
        tag, late = f"gate-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds or self.limits.query_seconds, stop)
        timer.daemon = True
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            raise GateError("timeout") if late.is_set() else self.error(e) from None
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def error_of(self, sql: str) -> str | None:
        """The error class of a query, None if it resolves; nothing runs."""
        try:
            self.dataframe(sql)
        except GateError as e:
            return e.kind
        return None

    def tables(self, sql: str) -> list[str]:
        """Lower-cased names of the relations that a query names, its own WITH names left out."""
        ctes, found = set(), set()
        for kind, node in walk(self.parse(sql)):
            name = class_name(node)
            if kind == "plan" and name == "UnresolvedWith":
                ctes |= {t._1().lower() for t in seq(node.cteRelations())}
            elif kind == "plan" and name == "UnresolvedRelation":
                found.add(seq(node.multipartIdentifier())[-1].lower())
        return sorted(found - ctes)

    def ordered(self, sql: str) -> bool:
        """Whether the outermost query has ORDER BY."""
        plan = self.parse(sql)
        while class_name(plan) in ("GlobalLimit", "LocalLimit", "Offset", "UnresolvedWith", "UnresolvedHint"):
            plan = plan.children().apply(0)
        return class_name(plan) == "Sort" and bool(getattr(plan, "global")())


def text_size(df: DataFrame) -> DataFrame:
    """One row: rows, and the size of all values as text, computed where the data is."""
    each = [F.coalesce(F.char_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("size"))

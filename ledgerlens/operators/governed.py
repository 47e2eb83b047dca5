"""Governed read-only queries: statement check, allowed tables, row cap, masking, audit and history."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words a read-only statement must not contain.
BLOCKED_WORDS = [
    "INSERT",
    "UPDATE",
    "DELETE",
    "DROP",
    "ALTER",
    "TRUNCATE",
    "CREATE",
    "REPLACE",
    "MERGE",
    "CALL",
    "EXEC",
    "EXECUTE",
    "GRANT",
    "REVOKE",
    "COPY",
    "ATTACH",
    "DETACH",
    "PRAGMA",
    "VACUUM",
    "ANALYZE",
    "SET",
    "RESET",
    "LOAD",
]

# Limits and texts users of the surface see.
DEFAULT_ROWS = 100
MAX_ROWS = 1000
MASK = "[MASKED]"
REASON_EMPTY = "SQL is empty."
REASON_MULTIPLE = "Multiple SQL statements are not allowed."
REASON_KIND = "Only SELECT/WITH statements are allowed."
REASON_COMPARED = "Masked columns may be selected, but not compared, grouped or sorted by."
REASON_COMPUTED = "Masked columns must not be used in calls that can fail or reveal them: {}."

AUDIT_SCHEMA = (
    "id string, sql_text string, status string, blocked_reason string, row_count bigint, elapsed_ms double, at timestamp"
)


@dataclass(frozen=True)
class Policy:
    """Limits of one data source."""

    default_rows: int = DEFAULT_ROWS
    max_rows: int = MAX_ROWS
    mask_fields: tuple[str, ...] = ()
    allow_tables: tuple[str, ...] = ()
    #: Whether masked columns may decide which rows come back (filters, joins, groups, order); each answer then tells something of their values.
    compare_masked: bool = False

    def cap(self, requested: int | None) -> int:
        return max(1, min(requested or self.default_rows, self.max_rows))


def normalised(sql_text: Column) -> Column:
    """Comments outside quotes removed, trailing semicolons cut, white space collapsed."""
    quoted = r"""('[^']*(?:'|$)|"[^"]*(?:"|$))"""
    text = F.regexp_replace(sql_text, quoted + r"|--[^\r\n]*|/\*[\s\S]*?(?:\*/|$)", "$1 ")
    text = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r";+\s*$", "")
    return F.regexp_replace(text, r"\s+", " ")


def _bare(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"""'[^']*(?:'|$)|"[^"]*(?:"|$)""", "''"))


def _reason(text: Column, bare: Column) -> Column:
    """Refusal of a normalised statement; the word list is searched word by word only when one of its words occurs."""
    word = F.coalesce(
        *[F.when(bare.rlike(rf"\b{w}\b"), F.lit(f"Dangerous keyword blocked: {w}.")) for w in BLOCKED_WORDS]
    )
    return (
        F.when(text == "", REASON_EMPTY)
        .when(bare.rlike(r";\s*\S"), REASON_MULTIPLE)
        .when(~(bare.startswith("SELECT ") | bare.startswith("WITH ")), REASON_KIND)
        .when(bare.rlike(rf"\b(?:{'|'.join(BLOCKED_WORDS)})\b"), word)
    )


def blocked_reason(sql_text: Column) -> Column:
    """Why a statement is refused, or null when it is read-only."""
    text = F.trim(normalised(F.coalesce(sql_text, F.lit(""))))
    return _reason(text, _bare(text))


def review_statements(df: DataFrame, sql_col: str = "sql_text") -> DataFrame:
    """Add ``allowed`` and ``reason`` to a table of statements; no statement is run."""
    text = df.withColumn("_text", F.trim(normalised(F.coalesce(F.col(sql_col), F.lit("")))))
    out = text.withColumn("_bare", _bare(F.col("_text"))).withColumn("reason", _reason(F.col("_text"), F.col("_bare")))
    return out.withColumn("allowed", F.col("reason").isNull()).drop("_text", "_bare")


def limited(df: DataFrame, policy: Policy, requested: int | None = None) -> DataFrame:
    """The row cap always holds, also when the statement brings a larger limit of its own."""
    return df.limit(policy.cap(requested))


def masked(df: DataFrame, fields: tuple[str, ...], places: frozenset[int] = frozenset()) -> DataFrame:
    """Replace non-null cells of the columns named (any case) or at the places given by a fixed text; nulls stay null."""
    hidden = {f.lower() for f in fields}
    return df.select(
        *[
            F.when(F.col(f"`{c}`").isNotNull(), F.lit(MASK)).alias(c) if c.lower() in hidden or i in places else F.col(f"`{c}`")
            for i, c in enumerate(df.columns)
        ]
    )


def mask_credentials(text: Column) -> Column:
    """Hide the user and password part of URLs."""
    return F.regexp_replace(text, r"://[^@/]+@", "://***@")


class TableNotAllowed(Exception):
    """A statement names a table outside the allowed ones."""


# Parts of an analysed statement that bring rows without a table, that run outside code, and that pair columns by place.
ROWLESS = {"OneRowRelation", "LocalRelation", "CTERelationRef", "Range"}
OUTSIDE_CODE = {"CallMethodViaReflection", "TryReflect", "ScriptTransformation"}
BY_PLACE = {"Union", "Intersect", "Except"}
# Nodes that show what an expression gives, and nodes whose rows depend on the values of whole rows.
SHOWING = {"Project", "Aggregate", "Window", "Generate", "Expand"}
COMPARING = {"Intersect", "Except", "Distinct", "Deduplicate"}
# Expressions that never fail on a value; only these may stand around a masked column. Their results are masked.
NEVER_FAILING = {
    "AttributeReference", "Alias", "Literal", "OuterReference", "ScalarSubquery", "Upper", "Lower", "StringTrim", "StringTrimLeft", "StringTrimRight", "Length", "Concat", "ConcatWs",
    "Coalesce", "IsNull", "IsNotNull", "If", "CaseWhen", "EqualTo", "EqualNullSafe", "Not", "And", "Or", "Like", "Contains", "StartsWith", "EndsWith", "Substring", "StringSplit",
    "StringReplace", "Reverse", "Md5", "Sha2", "Explode", "PosExplode", "Inline", "CreateNamedStruct", "GetStructField", "CreateArray", "CreateMap", "AggregateExpression", "Max", "Min", "Count",
    "First", "Last", "CollectList", "CollectSet", "MaxBy", "MinBy", "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnspecifiedFrame", "UnspecifiedFrame$",
    "UnboundedPreceding", "UnboundedPreceding$", "UnboundedFollowing", "UnboundedFollowing$", "CurrentRow", "CurrentRow$", "SortOrder", "Lag", "Lead", "RowNumber", "Rank", "DenseRank",
}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _ids(attributes) -> list[int]:
    return [a.exprId().id() for a in _items(attributes)]


def _plan_nodes(plan, tables: set[str]) -> list:
    """Nodes of an analysed plan, subqueries included, down to the allowed tables' own views."""
    if plan.nodeName() == "View":
        name = plan.desc().identifier()
        if plan.isTempView() and name.database().isEmpty() and name.table().lower() in tables:
            return [plan]
        raise TableNotAllowed(f"not an allowed table: {name.table()}")
    below = [*_items(plan.children()), *_items(plan.innerChildren())]
    if plan.children().size() == 0 and plan.nodeName() not in ROWLESS:
        raise TableNotAllowed("the statement reads something that is not an allowed table")
    return [plan, *[n for b in below for n in _plan_nodes(b, tables)]]


def _expressions(expression) -> list:
    return [expression, *[e for c in _items(expression.children()) for e in _expressions(c)]]


def _hidden_ids(nodes: list, fields: set[str]) -> set[int]:
    """Attributes of the plan that are made from a masked column under whatever name."""
    hidden = {a.exprId().id() for n in nodes if n.nodeName() == "View" for a in _items(n.output()) if a.name().lower() in fields}
    named = {n.id(): _ids(n.child().output()) for n in nodes if n.nodeName() == "CTERelationDef"}
    grown = -1
    while grown != len(hidden):
        grown = len(hidden)
        for n in nodes:
            kind, output = n.nodeName(), _ids(n.output())
            if kind == "View":
                continue
            if kind == "CTERelationRef":
                hidden.update(i for i, source in zip(output, named.get(n.cteId(), []), strict=False) if source in hidden)
                continue
            below = [_ids(c.output()) for c in _items(n.children())]
            if kind in BY_PLACE:
                hidden.update(i for k, i in enumerate(output) if any(b[k] in hidden for b in below))
                continue
            aliases = {e.exprId().id(): e for x in _items(n.expressions()) for e in _expressions(x) if e.nodeName() == "Alias"}
            passed = {i for b in below for i in b}
            for i in output:
                if i in aliases and _over(aliases[i], hidden):
                    hidden.add(i)
                elif i not in aliases and i not in passed and passed & hidden:
                    hidden.add(i)
    return hidden


def _over(expression, hidden: set[int]) -> bool:
    """Whether an expression reads a masked column, itself or through a subquery."""
    for e in _expressions(expression):
        kind = e.nodeName()
        if kind == "AttributeReference" and e.exprId().id() in hidden:
            return True
        if kind in {"ScalarSubquery", "ListQuery", "LateralSubquery"} and hidden.intersection(_ids(e.plan().output())):
            return True
        if kind == "OuterReference" and e.e().exprId().id() in hidden:
            return True
    return False


def _fails_on_values(expression) -> str | None:
    """The first call of an expression that can fail on a value, and so tell it in its error."""
    for e in _expressions(expression):
        kind = e.nodeName()
        if kind == "Cast" and e.dataType().typeName() == "string":
            continue
        if kind not in NEVER_FAILING:
            return kind
    return None


def check_masked_flow(nodes: list, hidden: set[int], compare: bool) -> None:
    """Refuse a plan in which masked columns decide about rows (unless ``compare``) or go through a call that can fail on them."""
    for n in nodes:
        kind = n.nodeName()
        if kind in {"View", "CTERelationRef"}:  # their expressions are only their own columns
            continue
        over = [x for x in _items(n.expressions()) if _over(x, hidden)]
        failing = next((f for f in map(_fails_on_values, over) if f is not None and not (compare and f in {"InSubquery", "ListQuery", "In", "Exists"})), None)
        if failing is not None and kind in SHOWING:
            raise PermissionError(REASON_COMPUTED.format(failing))
        keys = []
        if kind == "Aggregate":
            keys = _items(n.groupingExpressions())
        elif kind == "Window":
            keys = [*_items(n.partitionSpec()), *_items(n.orderSpec())]
        decides = (over and kind not in SHOWING) or any(_over(x, hidden) for x in keys)
        if kind in COMPARING:
            decides = decides or any(hidden.intersection(_ids(c.output())) for c in _items(n.children()))
        if decides and not compare:
            raise PermissionError(REASON_COMPARED)
        if failing is not None:
            raise PermissionError(REASON_COMPUTED.format(failing))


class ReadOnlyGateway:
    """Runs checked statements in a child session that knows only the allowed tables."""

    def __init__(self, tables: Mapping[str, DataFrame], policy: Policy, audit_path: str | None = None):
        if not tables:
            raise ValueError("a gateway needs at least one table")
        self.policy = policy
        self.audit_path = audit_path
        self.parent: SparkSession = next(iter(tables.values())).sparkSession
        allowed = policy.allow_tables or tuple(tables)
        self.child = self.parent.newSession()
        self.child.conf.set("spark.sql.session.timeZone", "UTC")
        self.child.conf.set("spark.sql.runSQLOnFiles", "false")
        self._shared: list[str] = []
        self._tables = {name.lower() for name in allowed if name in tables}
        for name in allowed:
            if name in tables:
                # a frame reaches another session through a global view under a name nobody can guess
                shared = f"gw_{uuid.uuid4().hex}"
                tables[name].createOrReplaceGlobalTempView(shared)
                self.child.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT * FROM global_temp.{shared}")
                self._shared.append(shared)
        self._cache: dict[str, DataFrame] = {}

    def check(self, sql: str) -> str | None:
        """The refusal of one statement, or None."""
        row = self.parent.range(1).select(blocked_reason(F.lit(sql)).alias("r")).first()
        return row.r

    def run(self, sql: str, max_rows: int | None = None) -> DataFrame:
        """Checked, capped and masked result; lazy until it is written or collected."""
        reason = self.check(sql)
        if reason:
            raise PermissionError(reason)
        try:
            df = self.child.sql(sql)
        except PySparkException as error:
            if "TABLE_OR_VIEW_NOT_FOUND" in str(error.getCondition()) or "UNSUPPORTED_DATASOURCE_FOR_DIRECT_QUERY" in str(
                error.getCondition()
            ):
                raise TableNotAllowed(str(error)) from error
            raise
        plan = df._jdf.queryExecution().analyzed()
        nodes = _plan_nodes(plan, self._tables)
        calls = {e.nodeName() for n in nodes if n.nodeName() != "View" for x in _items(n.expressions()) for e in _expressions(x)}
        if OUTSIDE_CODE & (calls | {n.nodeName() for n in nodes}):
            raise PermissionError("Calls of outside code are not allowed.")
        hidden = _hidden_ids(nodes, {f.lower() for f in self.policy.mask_fields})
        check_masked_flow(nodes, hidden, self.policy.compare_masked)
        places = frozenset(k for k, i in enumerate(_ids(plan.output())) if i in hidden)
        return masked(limited(df, self.policy, max_rows), self.policy.mask_fields, places)

    def cached(self, sql: str, max_rows: int | None = None) -> DataFrame:
        """The same request (white space aside) is computed once per gateway."""
        key = hashlib.sha256(f"{' '.join(sql.split())}|{max_rows}".encode()).hexdigest()
        if key not in self._cache:
            self._cache[key] = self.run(sql, max_rows).persist()
        return self._cache[key]

    def release(self) -> None:
        """Drop cached results and the views behind this gateway."""
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()
        for name in self._shared:
            self.parent.catalog.dropGlobalTempView(name)
        self._shared.clear()

    def audited(self, sql: str, max_rows: int | None = None) -> tuple[list, dict]:
        """Run, collect at most the row cap, and append one audit row: succeeded, blocked or failed."""
        start = time.time()
        rows: list = []
        status, reason = "succeeded", None
        try:
            rows = self.run(sql, max_rows).collect()
        except (PermissionError, TableNotAllowed) as error:
            status, reason = "blocked", str(error)
        except PySparkException as error:
            # the class alone: messages quote the values that a call failed on
            status, reason = "failed", error.getCondition() or type(error).__name__
        entry = {
            "id": hashlib.sha256(f"{start}|{sql}".encode()).hexdigest()[:16],
            "sql_text": sql,
            "status": status,
            "blocked_reason": reason,
            "row_count": len(rows),
            "elapsed_ms": (time.time() - start) * 1000.0,
            "at": datetime.now(timezone.utc),
        }
        if self.audit_path:
            self.parent.createDataFrame([tuple(entry.values())], AUDIT_SCHEMA).write.mode("append").parquet(self.audit_path)
        return rows, entry

    def audit_log(self) -> DataFrame:
        """All audit rows written so far."""
        return self.parent.read.parquet(self.audit_path)


def audit_rollup(audit: DataFrame, by: str) -> DataFrame:
    """Runs, refused share and latency percentiles per source."""
    from ledgerlens.operators.ordering import exact_quantiles

    counts = audit.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg("elapsed_ms").alias("avg_ms"),
    )
    q = exact_quantiles(audit, [by], "elapsed_ms", [0.5, 0.95])
    wide = q.groupBy(by).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50_ms"),
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95_ms"),
    )
    return counts.join(wide, by, "left").withColumn("blocked_share", F.col("blocked") / F.col("runs"))


def latest_history(history: DataFrame, session: str, updated: str, tie: str, payload: list[str]) -> DataFrame:
    """Newest statement per session with the session's favorites; an aggregate, so hot sessions combine early."""
    newest = F.max_by(F.struct(*payload), F.struct(F.col(updated), F.col(tie))).alias("latest")
    out = history.groupBy(session).agg(
        newest, F.count(F.lit(1)).alias("statements"), F.count_if(F.col("favorite")).alias("favorites")
    )
    return out.select(session, "statements", "favorites", *[F.col(f"latest.{p}").alias(p) for p in payload])

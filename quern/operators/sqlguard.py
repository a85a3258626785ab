"""A read-only SQL surface over one view: checked on the parsed plan, capped and timed out."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Words that no statement may hold.
DENIED = ("insert", "update", "delete", "drop", "create", "alter", "truncate", "merge", "copy", "attach", "detach", "pragma", "install", "load", "export", "import", "call", "grant", "revoke", "vacuum", "set")
MAX_ROWS, TIMEOUT_S = 1000, 5.0
#: What may be called: aggregates, windows and plain functions of values; nothing that reaches the JVM, files, time or the session.
FUNCTIONS = frozenset(
    """
    abs any any_value approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_join array_max array_min
    array_position array_size array_sort arrays_overlap avg bit_length bool_and bool_or btrim bround cardinality cast ceil ceiling char_length
    character_length coalesce collect_list collect_set concat concat_ws contains corr count count_if count_min_sketch covar_pop covar_samp
    cume_dist date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank
    element_at endswith every exists exp explode extract filter first first_value float floor format_number get greatest hour if ifnull
    ilike initcap instr int isnan isnotnull isnull kurtosis lag last last_day last_value lcase lead least left length levenshtein like ln
    locate log log10 log2 lower lpad ltrim make_date max max_by mean median min min_by minute mod mode month months_between nth_value ntile
    nullif nvl nvl2 percent_rank percentile percentile_approx percentile_cont percentile_disc pmod position posexplode pow power quarter
    rank regexp regexp_count regexp_extract regexp_like regexp_replace regr_slope repeat replace reverse right rlike round row_number rpad
    rtrim second sequence sign signum size skewness slice some split split_part sqrt startswith std stddev stddev_pop stddev_samp string
    substr substring substring_index sum timestamp to_date to_timestamp transform translate trim trunc try_cast try_divide ucase unnest
    upper var_pop var_samp variance weekday weekofyear width_bucket year
    """.split()
)
_WRAPPERS = ("Distinct", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "UnresolvedWith")
_ROOTS = ("Project", "Aggregate", "Filter", "UnresolvedHaving", "SubqueryAlias", "WithWindowDefinition", *_WRAPPERS)
#: What a plan may be made of; anything else, such as a name that is computed, a function as a table or a command, is not a plain SELECT.
_PLANS = frozenset((*_ROOTS, "Join", "Generate", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "Union", "Except", "Intersect", "Pivot", "LateralJoin"))


class UnsafeSql(ValueError):
    """The statement is not a single SELECT over the allowed table and columns."""


class SqlFailed(RuntimeError):
    """The statement was accepted, and failed or took too long."""


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Walk:
    """A parsed plan, with the names of common table expressions that each part of it sees."""

    def __init__(self, table: str, columns: list[str]) -> None:
        self.table, self.columns = table.lower(), {c.lower() for c in columns}
        self.aliases: set[str] = set()
        self.attributes: list[str] = []

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in _PLANS:
            raise UnsafeSql(f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            # An expression sees those before it, and not itself: a name that stands for no expression yet is a table.
            for entry in _each(node.cteRelations()):
                self.plan(entry._2(), scope)
                scope = scope | {entry._1().lower()}
        elif kind == "UnresolvedRelation":
            name = node.tableName()
            if name.lower() != self.table and name.lower() not in scope:
                raise UnsafeSql(f"table {name} is not allowed")
        elif kind == "SubqueryAlias":
            self.aliases.add(node.alias().lower())
        elif kind == "UnresolvedSubqueryColumnAliases":
            self.aliases |= {c.lower() for c in _each(node.outputColumnNames())}
        for expression in _each(node.expressions()):
            self.expression(expression, scope)
        for child in _each(node.children()):
            self.plan(child, scope)

    def expression(self, e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "Alias":
            self.aliases.add(e.name().lower())
        elif kind == "MultiAlias":
            self.aliases |= {n.lower() for n in _each(e.names())}
        elif kind == "UnresolvedFunction":
            called = e.nameParts().mkString(".").lower()
            if called not in FUNCTIONS:
                raise UnsafeSql(f"function {called} is not allowed")
        elif kind == "UnresolvedAttribute":
            self.attributes.append(e.nameParts().last())
        elif "UnresolvedIdentifier" in kind or "TableArgument" in kind:
            raise UnsafeSql(f"{kind} is not allowed")
        elif hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(e.plan(), scope)
        for child in _each(e.children()):
            self.expression(child, scope)


def validate(spark: SparkSession, sql: str, table: str, columns: list[str]) -> str:
    """The statement without its final semicolon, or UnsafeSql.

    Tables are the allowed one and the common table expressions in whose scope a name stands, both as the parser
    found them: what a literal or a comment says is no name.  Columns are the allowed ones and names given in the statement.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise UnsafeSql("empty statement")
    denied = re.search(rf"(?i)\b({'|'.join(DENIED)})\b", text)
    if denied:
        raise UnsafeSql(f"{denied[1].lower()} is not allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    root = plan
    # A set operation is no SELECT, also where it is made distinct, sorted or cut.
    while (kind := root.getClass().getSimpleName()) in _WRAPPERS:
        root = root.children().apply(0)
    if kind not in _ROOTS:
        raise UnsafeSql(f"only SELECT is allowed, not {kind}")
    walk = _Walk(table, columns)
    walk.plan(plan, frozenset())
    for name in walk.attributes:
        if name.lower() not in walk.columns and name.lower() not in walk.aliases:
            raise UnsafeSql(f"column {name} is not allowed")
    return text


def execute(jobs: DataFrame, sql: str, columns: list[str], table: str = "jobs", max_rows: int = MAX_ROWS) -> DataFrame:
    """The checked statement over a view of the allowed columns alone, so that * shows no more; at most ``max_rows`` rows."""
    spark = jobs.sparkSession
    allowed = [c for c in columns if c in jobs.columns]
    text = validate(spark, sql, table, allowed)
    jobs.select(*allowed).createOrReplaceTempView(table)
    try:
        return spark.sql(text).limit(max_rows)
    except Exception as failure:
        raise SqlFailed(str(failure)) from failure


def collect_within(df: DataFrame, seconds: float = TIMEOUT_S) -> list:
    """The rows, or SqlFailed when the time is over: the tagged jobs are cancelled."""
    spark, tag = df.sparkSession, f"guard-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as failure:
        raise SqlFailed(str(failure)) from failure
    finally:
        timer.cancel()
        spark.removeTag(tag)


def unfenced(answer: str) -> str:
    """The first fenced block of a model's answer, or all of it."""
    block = re.search(r"```(?:sql)?\s*\n?(.*?)```", answer, re.S | re.I)
    return (block[1] if block else answer).strip()


def describe(df: DataFrame, table: str = "jobs") -> str:
    """The schema as a prompt shows it."""
    return f"Table {table}:\n" + "\n".join(f"  {f.name}: {f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))


@dataclass
class Answer:
    """What a question led to: a statement and rows, or an error."""

    question: str
    sql: str | None = None
    rows: list | None = None
    error: str | None = None

    def as_json(self, n: int = 20) -> list[dict]:
        return [row.asDict(recursive=True) for row in (self.rows or [])[:n]]


def ask(jobs: DataFrame, question: str, model: Callable[[str], str] | None, columns: list[str], seconds: float = TIMEOUT_S) -> Answer:
    """Question to rows through a pluggable model; failures become the answer's error."""
    if model is None:
        return Answer(question, error="no language model is configured")
    try:
        said = model(f"{describe(jobs.select(*[c for c in columns if c in jobs.columns]))}\n\nQuestion: {question}\nSQL:")
    except Exception as failure:
        return Answer(question, error=f"the model failed: {failure}")
    sql = unfenced(said)
    try:
        return Answer(question, sql, collect_within(execute(jobs, sql, columns), seconds))
    except (UnsafeSql, SqlFailed) as failure:
        return Answer(question, sql, error=str(failure))


def register_dialect(spark: SparkSession) -> None:
    """``list_contains``, as users of the surface know it."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION list_contains(l ARRAY<STRING>, x STRING) RETURNS BOOLEAN RETURN array_contains(l, x)")

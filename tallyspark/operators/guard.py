"""Ad-hoc SQL: one SELECT over allowed relations and functions, with a cap on rows and time.

The parsed plan is walked node by node; what is not known to be harmless is refused, be it a relation, a function or a kind of node.
A checked query runs in a session of its own that has only the given views.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

ROWS, SECONDS, CHARS = 100, 5.0, 4000

# Functions that an ad-hoc query may call.
FUNCTIONS = frozenset(
    "abs any any_value avg between bool_and bool_or bround cast ceil ceiling coalesce concat count count_if cume_dist date_diff date_format date_part datediff day dayofweek dense_rank every exp extract first first_value floor greatest if ifnull lag last last_value lead least left length ln log lower ltrim max max_by mean median min min_by month ntile nullif percent_rank percentile_cont percentile_disc power pow rank regexp_like replace right round row_number rtrim sign some split_part sqrt startswith stddev stddev_pop stddev_samp sum substr substring trim trunc try_cast try_divide upper var_pop variance when year make_date corr".split()
)
# Spark's names of the plan nodes and expressions that a SELECT without functions parses to.
PLANS = frozenset(
    "Project Aggregate Sort GlobalLimit LocalLimit Distinct Filter Union Intersect Except UnresolvedWith UnresolvedHaving SubqueryAlias Join WithWindowDefinition Offset UnresolvedSubqueryColumnAliases OneRowRelation UnresolvedRelation".split()
)
EXPRESSIONS = frozenset(
    "Literal UnresolvedAttribute UnresolvedStar UnresolvedAlias Alias SortOrder UnresolvedFunction Cast TryCast CaseWhen If Coalesce Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual UnresolvedBetween Between In InSubquery ListQuery Exists ScalarSubquery IsNull IsNotNull IsTrue IsFalse IsNotTrue IsNotFalse IsUnknown IsNotUnknown Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Concat Substring StringTrim StringTrimLeft StringTrimRight CurrentDate Extract UnresolvedExtractValue WindowExpression UnresolvedWindowExpression WindowSpecDefinition WindowSpecReference SpecifiedWindowFrame UnspecifiedFrame$ UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ RowFrame$ RangeFrame$ MultiAlias CreateNamedStruct UnresolvedOrdinal Grouping".split()
)
_SUBQUERIES = frozenset("ListQuery Exists ScalarSubquery".split())


#: Marks for bound parameters; a query that has one without a value fails to resolve.
PARAMETERS = frozenset({"NamedParameter", "PosParameter"})


class Refused(ValueError):
    """The query is not allowed; the message says why."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def _name(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1]


def _walk_plan(plan, allowed: set[str], visible: frozenset[str], kinds: frozenset[str]) -> None:
    """visible: the common table expressions that a name can mean here."""
    todo = [(plan, visible)]
    while todo:
        node, visible = todo.pop()
        kind = _name(node)
        if kind not in PLANS:
            raise Refused(f"only SELECT is allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = [str(x).lower() for x in _items(node.multipartIdentifier())]
            if not (len(parts) == 1 and parts[0] in visible) and ".".join(parts) not in allowed:
                raise Refused(f"no relation {'.'.join(parts)} is open to queries")
            if not node.options().isEmpty():
                raise Refused("options of a relation are not allowed")
        elif kind == "UnresolvedWith":
            if node.allowRecursion():
                raise Refused("recursive queries are not allowed")
            for entry in _items(node.cteRelations()):
                # its own name and later ones are not visible in its body
                todo.append((entry._2(), visible))
                visible |= {str(entry._1()).lower()}
        elif kind == "LocalLimit" and _name(node.child()) in ("UnresolvedRelation", "SubqueryAlias", "Join"):
            raise Refused("a sample is not allowed")  # TABLESAMPLE (n ROWS) is a limit right on a relation
        elif kind == "WithWindowDefinition":
            for pair in _items(node.windowDefinitions().toSeq()):
                _walk_expression(pair._2(), allowed, visible, kinds)
        for e in _items(node.expressions()):
            _walk_expression(e, allowed, visible, kinds)
        todo += [(x, visible) for x in _items(node.children())]


def _walk_expression(expression, allowed: set[str], visible: frozenset[str], kinds: frozenset[str]) -> None:
    todo = [expression]
    while todo:
        node = todo.pop()
        kind = _name(node)
        if kind not in kinds:
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            parts = [str(x).lower() for x in _items(node.nameParts())]
            if len(parts) > 1 or parts[0] not in FUNCTIONS:
                raise Refused(f"the function {'.'.join(parts)} is not allowed")
        if kind in _SUBQUERIES:
            _walk_plan(node.plan(), allowed, visible, kinds)
        if kind == "InSubquery":
            todo.append(node.query())
        todo += _items(node.children())


def check(spark: SparkSession, sql: str, allowed: set[str], parameters: bool = False) -> None:
    """Raises Refused unless sql is one SELECT (or a set operation of such) over the allowed names."""
    if len(sql) > CHARS or "\0" in sql:
        raise Refused("the query is too long or has a NUL character")
    try:
        sql.encode("utf-8")
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except UnicodeEncodeError as e:
        raise Refused("the query is not valid text") from e
    except Exception as e:
        raise Refused(f"it does not parse as one statement: {str(e)[:200]}") from e
    _walk_plan(plan, {x.lower() for x in allowed}, frozenset(), EXPRESSIONS | PARAMETERS if parameters else EXPRESSIONS)


def guarded(sql: str, views: dict[str, DataFrame], rows: int = ROWS, args: dict | list | None = None) -> DataFrame:
    """The result of a checked query over the given frames alone, at most so many rows. It runs in a session of its own, which has
    these views only and in which files cannot be named as tables. args: values of :names (a dictionary) or of question marks (a list), which are bound, never read as SQL."""
    if args is not None and any(isinstance(v, Column) for v in (args.values() if isinstance(args, dict) else args)):
        raise Refused("a parameter is a value, not an expression")
    spark = next(iter(views.values())).sparkSession
    check(spark, sql, set(views), parameters=args is not None)
    own = spark.newSession()
    for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in views.items():
        moved = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed())
        moved.createOrReplaceTempView(name)
    return (own.sql(sql) if args is None else own.sql(sql, args)).limit(rows)


def repaired(sql: str, views: dict[str, DataFrame], repair, rows: int = ROWS) -> DataFrame:
    """guarded(), with one repair: repair(sql, message) is asked once for another query if the first is refused or fails to
    resolve; what is wrong with the second is an error."""
    from pyspark.errors import PySparkException

    try:
        return guarded(sql, views, rows)
    except (Refused, PySparkException) as e:
        return guarded(repair(sql, str(e)), views, rows)


class _Watch:
    """Cancels the jobs of a tag when the time is over, and again every moment until the work returns, as a query may start further jobs."""

    def __init__(self, context, seconds: float):
        self.context, self.seconds, self.tag, self.over, self.late = context, seconds, f"guard-{uuid.uuid4().hex}", threading.Event(), False

    def _run(self) -> None:
        if self.over.wait(self.seconds):
            return
        self.late = True
        while not self.over.is_set():
            self.context.cancelJobsWithTag(self.tag)
            self.over.wait(0.2)

    def __enter__(self) -> _Watch:
        self.context.addJobTag(self.tag)
        threading.Thread(target=self._run, daemon=True).start()
        return self

    def __exit__(self, *error) -> None:
        self.over.set()
        self.context.removeJobTag(self.tag)
        if self.late and error[0] is None:
            raise TimeoutError(f"the query took more than {self.seconds} s")


def collected(df: DataFrame, seconds: float = SECONDS) -> list:
    """The rows, or an error after so many seconds: the query's jobs are cancelled, also those that start later."""
    with _Watch(df.sparkSession.sparkContext, seconds):
        return df.collect()


def answered(sql: str, views: dict[str, DataFrame], rows: int = ROWS, args: dict | list | None = None, seconds: float = SECONDS) -> list:
    """guarded() and collected() under one watch: the time of parsing and planning counts, and an answer that comes late is an error."""
    with _Watch(next(iter(views.values())).sparkSession.sparkContext, seconds):
        return guarded(sql, views, rows, args).collect()

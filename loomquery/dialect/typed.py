"""Rules that depend on types, settled on the plan that Spark's analyzer makes.

Division of integers drops the remainder, and sums and averages of integers
are decimals. The analyzed plan says which divisions and aggregates have
integers below them and where in the text they stand; the text is changed
there and analyzed again, until nothing is left to change. Only analysis is
asked of Spark, no job.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomquery.dialect.tokens import DialectError

_INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def _seq(java) -> list:
    return [java.apply(i) for i in range(java.size())]


def _origin(e) -> tuple[int, int] | None:
    o = e.origin()
    if o.startIndex().isEmpty() or o.stopIndex().isEmpty():
        return None
    return o.startIndex().get(), o.stopIndex().get()


def _kind(e) -> str:
    return e.dataType().catalogString() if e.resolved() else ""


def _walk_expression(e, text: str, found: set) -> None:
    """Add the changes (begin, end, new text) that an expression asks for."""
    name = e.getClass().getSimpleName()
    if name in ("ScalarSubquery", "Exists", "ListQuery"):
        _walk(e.plan(), text, found)
    elif name == "InSubquery":
        _walk(e.query().plan(), text, found)
    for c in _seq(e.children()):
        _walk_expression(c, text, found)
    at = _origin(e)
    if at is None:
        return
    piece = text[at[0] : at[1] + 1]
    if name == "Divide":
        left, right = e.left(), e.right()
        inner = [x.child() if x.getClass().getSimpleName() == "Cast" and _kind(x) == "double" else x for x in (left, right)]
        if all(_kind(x) in _INTEGERS for x in inner):
            slash = _last(text, at[0], at[1] + 1)  # division goes from left to right
            found.add((slash, slash + 1, " div "))
    elif name in ("Sum", "Average"):
        child = e.child()
        m = re.match(r"\s*(sum|avg)\s*\(\s*(distinct\s)?", piece, re.I)
        if m and _kind(child) in _INTEGERS:
            close = _closing(text, at[0] + piece.index("("))
            begin = at[0] + m.end()
            kind = "DECIMAL(38,0)" if name == "Sum" else "DECIMAL(28,6)"
            found.add((begin, close, f"CAST({text[begin:close]} AS {kind})"))


def _depths(text: str, begin: int, end: int):
    """(position, character, depth of brackets) outside of quotes."""
    depth, quote, i = 0, "", begin
    while i < end:
        c = text[i]
        if quote:
            i += quote == "'" and c == "\\"
            quote = "" if c == quote else quote
        elif c in "'`":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            yield i, c, depth
        i += 1


def _closing(text: str, at: int) -> int:
    return next(i for i, c, depth in _depths(text, at, len(text)) if c == ")" and not depth)


def _last(text: str, begin: int, end: int) -> int:
    """The last / that stands in no bracket."""
    return max(i for i, c, depth in _depths(text, begin, end) if c == "/" and not depth)


def _walk(plan, text: str, found: set) -> None:
    if plan.getClass().getSimpleName() == "SubqueryAlias" and plan.child().getClass().getSimpleName() == "View":
        return  # a table: its own expressions are of another text
    for c in _seq(plan.children()):
        _walk(c, text, found)
    for e in _seq(plan.expressions()):
        _walk_expression(e, text, found)


def settle(spark: SparkSession, text: str, args: dict) -> tuple[DataFrame, str]:
    """The DataFrame of a query, and its text with types settled."""
    for _ in range(1000):
        df = spark.sql(text, args=args) if args else spark.sql(text)
        found: set[tuple[int, int, str]] = set()
        _walk(df._jdf.queryExecution().analyzed(), text, found)
        if not found:
            return df, text
        # all at once, so that equal expressions stay equal; what holds another change waits for it
        inner = [c for c in found if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in found)]
        for begin, end, new in sorted(inner, reverse=True):
            text = text[:begin] + new + text[end:]
    raise DialectError("types don't settle")

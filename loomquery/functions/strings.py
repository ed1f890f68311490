"""Substrings by SQL regular expressions, and text casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomquery.dialect.tokens import DialectError

_PLAIN = set("|*+?{},()[]")


def similar_regex(similar: str, escape: str = "\\") -> tuple[str, int]:
    """(a Java regular expression for the whole text, the group to return) of a SQL regular expression.

    Two marks, each the escape character and a double quote, bound the part
    to return; without them it is the whole text.
    """
    if len(escape) > 1:
        raise DialectError("an escape is one character")
    parts: list[str] = [""]
    at, in_set = 0, False
    while at < len(similar):
        c = similar[at]
        if escape and c == escape:
            at += 1
            if at == len(similar):
                raise DialectError("a pattern can't end in its escape")
            if similar[at] == '"':
                parts.append("")
            else:
                parts[-1] += _literal(similar[at])
        elif in_set:
            in_set = c != "]"
            parts[-1] += "\\" + c if c in "\\[&" else c
        elif c == "%":
            parts[-1] += ".*"
        elif c == "_":
            parts[-1] += "."
        elif c in _PLAIN:
            in_set = c == "["
            # groups of the pattern capture nothing, so the marked part is the first group
            parts[-1] += "(?:" if c == "(" else c
        else:
            parts[-1] += _literal(c)
        at += 1
    if len(parts) == 1:
        return f"(?s)^({parts[0]})$", 1
    if len(parts) != 3:
        raise DialectError("a pattern has two marks or none")
    # what stands before the part is as short as it can be
    before = parts[0].replace(".*", ".*?")
    return f"(?s)^(?:{before})({parts[1]})(?:{parts[2]})$", 1


def _literal(c: str) -> str:
    return c if c.isalnum() or c in " _" else "\\" + c


def substring_similar(text: Column, similar: str, escape: str = "\\") -> Column:
    """The part of a text that a SQL regular expression marks; NULL if it doesn't match."""
    regex, group = similar_regex(similar, escape)
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, group))


def substring_regex(text: Column, regex: str) -> Column:
    """The first match of a regular expression, or its first group where it has one; NULL without a match."""
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, 1 if has_group(regex) else 0))


def has_group(regex: str) -> bool:
    at, in_set = 0, False
    while at < len(regex):
        if regex[at] == "\\":
            at += 1
        elif in_set:
            in_set = regex[at] != "]"
        elif regex[at] == "[":
            in_set = True
        elif regex[at] == "(" and regex[at + 1 : at + 2] != "?":
            return True
        at += 1
    return False


def bool_cast_sql(value: str) -> str:
    """SQL text of a value read as a boolean: t, true, yes, on, 1 and their opposites."""
    low = f"lower(CAST({value} AS STRING))"
    return f"CASE WHEN ({value}) IS NULL THEN NULL WHEN {low} IN ('t', 'true', 'yes', 'on', '1') THEN true WHEN {low} IN ('f', 'false', 'no', 'off', '0') THEN false ELSE CAST(raise_error(concat('failed to parse as boolean: ', {low})) AS BOOLEAN) END"


def uuid_cast_sql(value: str) -> str:
    """SQL text of a value read as a UUID, in lower case."""
    low = f"lower(CAST({value} AS STRING))"
    return f"CASE WHEN ({value}) IS NULL THEN NULL WHEN {low} RLIKE '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$' THEN {low} ELSE raise_error(concat('failed to parse as uuid: ', {low})) END"


def quoted(text: str) -> str:
    """A Spark string literal that no escape changes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: The function that gives the regular expression of a pattern that isn't a literal.
REGEX_OF = "loom_similar_regex"
#: A regular expression for those that have a group.
_GROUP = r"(^|[^\\])\((?!\?)"


def register(spark) -> None:
    """Register REGEX_OF. It sees patterns and escapes only, in Arrow batches; matching stays with Spark."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def regex_of(pattern: pd.Series, escape: pd.Series) -> pd.Series:
        known: dict = {}
        for pair in set(zip(pattern, escape, strict=True)):
            known[pair] = None if None in pair else similar_regex(*pair)[0]
        return pd.Series([known[pair] for pair in zip(pattern, escape, strict=True)], dtype=object)

    regex_of.__annotations__ = {"pattern": pd.Series, "escape": pd.Series, "return": pd.Series}
    spark.udf.register(REGEX_OF, pandas_udf(regex_of, "string"))


def pattern_sql(value: str, pattern: str) -> str:
    """SQL text of the first match of a regular expression from a column, or its first group where it has one; NULL without a match."""
    group = f"CASE WHEN {pattern} RLIKE {quoted(_GROUP)} THEN 1 ELSE 0 END"
    return f"CASE WHEN {value} RLIKE {pattern} THEN regexp_extract({value}, {pattern}, {group}) END"

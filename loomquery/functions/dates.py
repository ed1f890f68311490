"""Dates and times with strftime patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomquery.dialect.tokens import DialectError

# Strftime directives and the letters of Spark's patterns.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a",
    "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "xx", "Z": "zzz", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
    "R": "HH:mm", "D": "MM/dd/yy", "n": "\n", "t": "\t", "%": "%",
}
DEFAULT = "%Y-%m-%d %H:%M:%S"
#: Text that is cast to a time is read by the first of these that fits.
READ = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][XX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX][XX][X]", "yyyy-MM-dd"]
#: Mail dates, without the day of the week that stands before them.
MAIL = "d MMM yyyy HH:mm:ss xx"


def pattern(strftime: str) -> str:
    """A strftime pattern in Spark's letters; other letters are quoted."""
    strftime = strftime or DEFAULT
    out, literal, at = [], "", 0

    def close() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if any(c.isalpha() or c in "'[]{}#" for c in literal) else literal)
        literal = ""

    while at < len(strftime):
        c = strftime[at]
        if c != "%":
            literal += c
        else:
            at += 1
            if at == len(strftime) or strftime[at] not in DIRECTIVES:
                raise DialectError(f"pattern {strftime!r} has a directive that isn't known")
            if strftime[at] in "nt%":
                literal += DIRECTIVES[strftime[at]]
            else:
                close()
                out.append(DIRECTIVES[strftime[at]])
        at += 1
    close()
    return "".join(out)


def to_date(text: Column, strftime: str = "") -> Column:
    """The day that a text names, at midnight."""
    return F.date_trunc("day", F.to_timestamp(text, pattern(strftime)))


def to_char(time: Column, strftime: str) -> Column:
    return F.date_format(time, pattern(strftime))


def current_date() -> Column:
    """Today at midnight."""
    return F.date_trunc("day", F.current_timestamp())


def truncated(seconds: int, time: str = "current_timestamp()") -> str:
    """SQL text of a time cut to a number of digits of its seconds."""
    if not 0 <= seconds <= 6:
        raise DialectError("the precision of a time is 0 to 6")
    step = 10 ** (6 - seconds)
    return time if step == 1 else f"timestamp_micros(unix_micros({time}) div {step} * {step})"


def cast_sql(value: str) -> str:
    """SQL text of a value read as a time."""
    tries = ", ".join(f'try_to_timestamp(CAST({value} AS STRING), "{p}")' for p in READ)
    tries += f", try_to_timestamp(regexp_replace(CAST({value} AS STRING), '^[A-Za-z]{{3}}, ', ''), \"{MAIL}\")"
    return f"CASE WHEN ({value}) IS NULL THEN NULL ELSE coalesce(try_cast({value} AS TIMESTAMP), {tries}, CAST(raise_error(concat('failed to parse as datetime: ', CAST({value} AS STRING))) AS TIMESTAMP)) END"

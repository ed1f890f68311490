"""Declared types and their Spark types."""

from __future__ import annotations

from loomquery.dialect.tokens import DialectError, Group, Tok, word

# Type names of the dialect. Every integer type has 64 bits; lengths and precisions are accepted and not kept.
TYPES = {
    "bool": "BOOLEAN", "boolean": "BOOLEAN", "int": "BIGINT", "integer": "BIGINT", "bigint": "BIGINT", "smallint": "BIGINT", "int2": "BIGINT",
    "int4": "BIGINT", "int8": "BIGINT", "unsigned": "BIGINT", "double": "DOUBLE", "decimal": "DECIMAL(38,10)", "numeric": "DECIMAL(38,10)",
    "number": "DECIMAL(38,10)", "text": "STRING", "string": "STRING", "varchar": "STRING", "datetime": "TIMESTAMP", "uuid": "STRING", "json": "STRING",
}


def take_type(nodes: list, at: int) -> tuple[str, str, int]:
    """(name in the dialect, Spark type, position after it) of the type at a position."""
    if at >= len(nodes) or not isinstance(nodes[at], Tok) or nodes[at].low not in TYPES:
        raise DialectError("a type is expected")
    name = nodes[at].low
    spark = TYPES[name]
    at += 1
    if at < len(nodes) and isinstance(nodes[at], Group) and nodes[at].open == "(":
        at += 1
    array = False
    if at < len(nodes) and word(nodes[at], "array"):
        array, at = True, at + 1
        if at < len(nodes) and isinstance(nodes[at], Group) and nodes[at].open == "[":
            at += 1
    elif at < len(nodes) and isinstance(nodes[at], Group) and nodes[at].open == "[" and (not nodes[at].inner or len(nodes[at].inner) == 1 and nodes[at].inner[0].kind == "number"):
        array, at = True, at + 1
        if at < len(nodes) and isinstance(nodes[at], Group) and nodes[at].open == "[" and not nodes[at].inner:
            raise DialectError("arrays of arrays aren't supported")
    return (name + "[]", f"ARRAY<{spark}>", at) if array else (name, spark, at)

"""The SQL dialect: a token tree, and rules that turn it into Spark SQL."""

from loomquery.dialect.rewrite import Rewriter, to_spark
from loomquery.dialect.tokens import DialectError, parse, render, split

__all__ = ["DialectError", "Rewriter", "parse", "render", "split", "to_spark"]

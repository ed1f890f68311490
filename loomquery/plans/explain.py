"""EXPLAIN and its facets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomquery.dialect.tokens import DialectError, Group, split, word
from loomquery.plans import blocks

FACETS = ("logical", "raw", "fmt", "buckets", "forward", "context")


def explain(session, nodes: list, args: dict) -> DataFrame:
    """One column, plan, of the lines of a query's plan; nothing is run.

    logical (the default): the optimized plan; raw: the physical one, fmt:
    formatted; buckets: the number of partitions of the result; context: the
    text that goes to Spark. forward is accepted.
    """
    facets = ["logical"]
    if nodes and isinstance(nodes[0], Group) and nodes[0].inner and not word(nodes[0].inner[0], "select", "with", "values"):
        facets = [x[0].low for x in split(nodes[0].inner)]
        nodes = nodes[1:]
    if not nodes or any(f not in FACETS for f in facets):
        raise DialectError("EXPLAIN takes facets of " + ", ".join(FACETS))
    if word(nodes[0], "do"):
        parts = blocks.statements(blocks.body(nodes))
        lines = [f"statement {i}: {part[0].low}" for i, part in enumerate(parts, 1)]
        return session.spark.createDataFrame([(x,) for x in lines], "plan string")
    if word(nodes[0], "insert", "update", "delete"):
        at = next((i for i, x in enumerate(nodes) if word(x, "select", "values")), None)
        if at is None:
            return session.spark.createDataFrame([(nodes[0].low,)], "plan string")
        nodes = nodes[at:]
    df = session.query(nodes, args)
    plan = df._jdf.queryExecution()
    texts = {
        "logical": lambda: plan.optimizedPlan().toString(),
        "raw": lambda: plan.executedPlan().toString(),
        "fmt": lambda: plan.explainString(session.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),
        "buckets": lambda: f"partitions: {df.rdd.getNumPartitions()}",
        "forward": lambda: "forward: off",
        "context": lambda: session.spark_text(nodes),
    }
    lines = [line for f in facets for line in texts[f]().split("\n") if line.strip()]
    return session.spark.createDataFrame([(x,) for x in lines], "plan string")

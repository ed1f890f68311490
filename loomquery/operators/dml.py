"""Changes to tables, each giving a new version of the table.

Nothing is changed in place: a version is a DataFrame over the one before it,
and the session writes it before it takes the other's place. So all or none of
a statement's rows take effect, and where one of several rows is taken, it
stays the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.dialect.tokens import DialectError
from loomquery.sources.tables import Table


class ConflictError(ValueError):
    """A row's key is taken."""


def _fit(table: Table, new: DataFrame, columns: list[str] | None) -> DataFrame:
    """New rows with the table's columns; those that aren't named are NULL."""
    columns = columns or table.df.columns
    if len(columns) != len(new.columns):
        raise DialectError(f"{len(columns)} columns are named and {len(new.columns)} given")
    if len(set(columns)) != len(columns):
        raise DialectError("a column is named twice")
    unknown = set(columns) - set(table.df.columns)
    if unknown:
        raise DialectError(f"no column {sorted(unknown)[0]}")
    missing = (set(table.key) | table.required) - set(columns)
    if missing:
        raise DialectError(f"column {sorted(missing)[0]} takes no NULL")
    new = new.toDF(*columns)
    rows = [(F.col(f"`{f.name}`") if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.df.schema]
    return checked(table.with_rows(new.select(*rows)))


def checked(table: Table) -> DataFrame:
    """The table's rows; a NULL in its key or in a NOT NULL column fails the job that reads them."""
    def value(f):
        own = F.col(f"`{f.name}`")
        return F.coalesce(own, F.raise_error(F.lit(f"column {f.name} takes no NULL")).cast(f.dataType)).alias(f.name) if f.name in table.required or f.name in table.key else own

    return table.df.select(*map(value, table.df.schema))


def _taken(table: Table, new: DataFrame, key: list[str]) -> bool:
    within = new.groupBy(*key).count().filter("count > 1").limit(1)
    across = new.join(table.df.select(*key), key, "left_semi").limit(1)
    return bool(within.take(1)) or bool(across.take(1))


def insert(table: Table, new: DataFrame, columns: list[str] | None = None, conflict: str = "fail") -> Table:
    """Add rows. conflict: fail if a key is taken, nothing (keep the old row) or replace (take the new one).

    New rows of one key conflict with each other: only one of them, whichever,
    is taken by nothing and replace.
    """
    new = _fit(table, new, columns)
    if not table.key:
        return table.with_rows(table.df.unionByName(new))
    if conflict == "fail":
        for key in [table.key, *table.unique.values()]:
            if _taken(table, new, key):
                raise ConflictError(f"duplicate key on {', '.join(key)}")
        return table.with_rows(table.df.unionByName(new))
    new = new.dropDuplicates(table.key)
    if conflict == "nothing":
        return table.with_rows(table.df.unionByName(new.join(table.df.select(*table.key), table.key, "left_anti").select(table.df.columns)))
    if conflict == "replace":
        return table.with_rows(table.df.join(new.select(*table.key), table.key, "left_anti").select(table.df.columns).unionByName(new))
    raise DialectError(f"conflict strategy {conflict} isn't known")


def upsert(table: Table, new: DataFrame, changes: dict[str, tuple[str, Column]], columns: list[str] | None = None, target: list[str] | None = None) -> Table:
    """Add rows; where the target key is taken, change the old row: column -> (operator, value) with + - AND OR or = (the value alone)."""
    target = target or table.key
    if sorted(target) not in [sorted(table.key), *map(sorted, table.unique.values())]:
        raise DialectError("the conflict target is neither the primary key nor a unique index")
    for name in changes:
        if name in table.key:
            raise DialectError(f"key column {name} can't be changed")
        if name not in table.df.columns:
            raise DialectError(f"no column {name}")
    new = _fit(table, new, columns)
    if new.groupBy(*target).count().filter("count > 1").take(1):
        raise ConflictError("a row would be changed twice")
    old = table.df.withColumn("__old", F.lit(True))
    joined = old.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in target], "full")
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    out = []
    for f in table.df.schema:
        value = F.when(F.col("__old").isNotNull(), F.col(f"o.{f.name}")).otherwise(F.col(f"n.{f.name}"))
        if f.name in changes:
            op, operand = changes[f.name]
            own = F.col(f"o.{f.name}")
            changed = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "=": lambda a, b: b}[op](own, operand)
            value = F.when(both, changed.cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return table.with_rows(joined.select(*out))


def check_targets(table: Table, columns: list[str]) -> None:
    for name in columns:
        if name not in table.df.columns or name == "bucket_id":
            raise DialectError(f"column {name} can't be set")
        if name in table.key:
            raise DialectError(f"key column {name} can't be set")
    if len(set(columns)) != len(columns):
        raise DialectError("a column is set twice")


def update(table: Table, values: dict[str, Column], where: Column | None = None) -> Table:
    """Set columns of the rows of which the condition is true."""
    check_targets(table, list(values))
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.with_rows(table.df.select(*[F.when(hit, values[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in table.df.schema]))


def update_from(table: Table, matched: DataFrame) -> Table:
    """Set columns from matched rows: the key, and a column new_NAME for each to set. Of several matches of a row one is taken."""
    names = [c.removeprefix("new_") for c in matched.columns if c not in table.key]
    check_targets(table, names)
    matched = matched.dropDuplicates(table.key).withColumn("__hit", F.lit(True))
    joined = table.df.join(matched, table.key, "left")
    return table.with_rows(joined.select(*[F.when(F.col("__hit"), F.col(f"new_{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in names else F.col(f.name) for f in table.df.schema]))


def delete(table: Table, where: Column | None = None) -> Table:
    """Remove the rows of which the condition is true; a condition of NULL keeps a row."""
    if where is None:
        return truncate(table)
    return table.with_rows(table.df.filter(~F.coalesce(where, F.lit(False))))


def truncate(table: Table) -> Table:
    return table.with_rows(table.df.limit(0))

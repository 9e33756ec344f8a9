"""The archive's constraints, held against its tables: keys, values that must be there, and references with their cascades."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.schema import REFERENCES, REQUIRED, UNIQUE

_TAGGED = "array<struct<rule:string,key:array<string>,own:long,others:long>>"


def _key(columns: tuple[str, ...]) -> Column:
    return F.array(*(F.col(c).cast("string") for c in columns))


def _entry(when: Column, rule: str, key: Column, own: int, others: int) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), key.alias("key"), F.lit(own).cast("long").alias("own"), F.lit(others).cast("long").alias("others")))


def _there(columns: tuple[str, ...]) -> Column:
    return F.forall(_key(columns), lambda v: v.isNotNull())


def _rules(table: str, columns: list[str]) -> Iterator[Column]:
    """What each row of a table says on its rules: that it has a key, that it lacks a value, that it refers, that others may refer."""
    for key in UNIQUE[table]:
        yield _entry(_there(key), f"{table}: unique {', '.join(key)}", _key(key), 1, 0)
    for c in REQUIRED[table]:
        if c in columns:
            yield _entry(F.col(c).isNull(), f"{table}: {c} is missing", F.lit(None).cast("array<string>"), 1, 0)
    for (child, column), (parent, key) in REFERENCES.items():
        name = f"{child}: {column} refers to {parent}"
        if child == table:
            yield _entry(_there((column,)), name, _key((column,)), 0, 1)
        if parent == table:
            yield _entry(_there((key,)), name, _key((key,)), 1, 0)


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """rule, key, rows of everything that breaks a rule: a key that several rows have, missing values (key null), a reference to
    nothing. Each table is scanned once, all rules share one shuffle of partial counts, so a key of any number of rows is
    a few rows. Nulls break no key and no reference. Columns that a table lacks aren't audited."""
    parts = [df.select(F.inline(F.filter(F.array(*_rules(name, df.columns)).cast(_TAGGED), lambda r: r.isNotNull()))) for name, df in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    found = union.groupBy("rule", "key").agg(F.sum("own").alias("own"), F.sum("others").alias("others"))
    unique, missing = F.col("rule").contains(": unique "), F.col("rule").endswith(" is missing")
    broken = F.when(unique, F.col("own") > 1).when(missing, F.col("own") > 0).otherwise((F.col("own") == 0) & (F.col("others") > 0))
    return found.where(broken).select("rule", "key", F.when(unique | missing, F.col("own")).otherwise(F.col("others")).alias("rows"))


def referring(table: str) -> list[tuple[str, str, str]]:
    """The tables and columns that refer to a table, and to which of its columns."""
    return [(child, column, key) for (child, column), (parent, key) in REFERENCES.items() if parent == table]


def delete(tables: dict[str, DataFrame], table: str, rows: Column) -> dict[str, DataFrame]:
    """All tables after the rows of a table have gone for which a condition holds, and with them what refers to them, and what
    refers to that, until nothing does. Rows on which the condition is null stay.

    The references make no circle, so a table is done when all that it refers to are: what goes is found along them, and each
    table loses its rows by one anti join a reference. Keys that go may be of any number; they are shuffled, not collected.
    """
    left, gone = dict(tables), {table: tables[table].where(rows)}
    left[table] = tables[table].where(~F.coalesce(rows, F.lit(False)))
    order = _order()
    for name in order:
        for child, column, key in referring(name):
            if name not in gone or child not in left:
                continue
            keys = gone[name].select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
            lost = left[child].join(keys, column, "left_semi")
            gone[child] = gone[child].unionByName(lost) if child in gone else lost
            left[child] = left[child].join(keys, column, "left_anti").select(*tables[child].columns)
    return left


def _order() -> list[str]:
    """Tables, each after those that it refers to."""
    names, out = list(UNIQUE), []
    while names:
        free = [n for n in names if not any(child == n and parent in names for (child, _), (parent, _) in REFERENCES.items())]
        if not free:
            raise ValueError("references make a circle")
        out += free
        names = [n for n in names if n not in free]
    return out

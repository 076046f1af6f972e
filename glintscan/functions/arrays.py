"""Walks over arrays as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that are gathered before they are set aside, so that long arrays are not copied at every step.
PIECE = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value; inside lambda functions, all that is named twice is computed twice unless it is bound so."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, state: Column, kind: str, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """For each item, in order, what ``emit`` makes of the state before it and of the item; ``advance`` gives the next state."""
    none = f"cast(array() as array<{kind}>)"
    begin = F.struct(state.alias("s"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("full"), F.expr(none).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        over = F.size(acc["part"]) >= PIECE
        part = F.concat(F.when(over, F.expr(none)).otherwise(acc["part"]), F.array(emit(acc["s"], x)))
        return F.struct(advance(acc["s"], x).alias("s"), F.when(over, F.concat(acc["full"], F.array(acc["part"]))).otherwise(acc["full"]).alias("full"), part.alias("part"))

    return F.aggregate(items, begin, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["part"]))


def each(rows: DataFrame, items: Column, name: str, *keep: str | Column) -> DataFrame:
    """A row for each item, with the columns of ``keep``.

    A plain explode makes the optimizer filter on the array below it, which computes the array twice.
    """
    return rows.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def numbered(rows: DataFrame, items: Column, number: str, name: str, *keep: str | Column) -> DataFrame:
    """As ``each``, with the items' numbers from 0."""
    return rows.select(*keep, F.posexplode_outer(items).alias(number, name)).filter(F.col(number).isNotNull())

"""Work on keys, one of which may hold a large share of the rows: joins to facts about a key, and equal rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one of SLICES rows, and more than a task has done in no time; there are fewer hot
#: keys than SLICES.
SLICES = 1_024
LEAST = 10_000

#: Equal rows that one task deals out at a time.
PIECE = 100_000


def _equal(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [rows[k].eqNullSafe(facts[f"_f_{k}"]) for k in keys])


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """rows with the other columns of facts; NULL keys are keys as well, and every key of rows has its fact.

    facts has one row per key, and size holds the rows of the key. Facts of hot keys are broadcast, at most SLICES of
    them; only rows of other keys are shuffled, so no task gets more than its part whatever a key holds. Where no key is
    hot, which a look at the facts tells, a plain join is left. Both inputs are read twice: settle them before, or hand
    in cheap ones.
    """
    named = facts.select(*[F.col(k).alias(f"_f_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    drop = [f"_f_{k}" for k in keys]
    rows_in_all, largest = facts.agg(F.sum(size), F.max(size)).first()
    least = max(LEAST, (rows_in_all or 0) // SLICES)
    if largest is None or largest <= least:
        return rows.join(named, _equal(rows, named, keys)).drop(*drop)
    hot = F.broadcast(named.filter(F.col(size) > least))
    cold = named.filter(F.col(size) <= least)
    of_hot = rows.join(hot, _equal(rows, hot, keys))
    others = rows.join(hot, _equal(rows, hot, keys), "left_anti")
    of_cold = others.join(cold, _equal(others, cold, keys))
    return of_hot.drop(*drop).unionByName(of_cold.drop(*drop))


def repeated(rows: DataFrame, times: str, number: str) -> DataFrame:
    """Each row as often as `times` says, numbered from 1; a row that stands for many is dealt out by several tasks.

    rows are read twice: settle them before.
    """
    few = rows.filter(F.col(times) <= PIECE).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    pieces = F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {PIECE}"))
    many = rows.filter(F.col(times) > PIECE).withColumn("_piece", F.explode(pieces)).repartition("_piece")
    first, last = F.col("_piece") * PIECE + 1, F.least(F.col(times), (F.col("_piece") + 1) * PIECE)
    many = many.withColumn(number, F.explode(F.sequence(first, last))).drop("_piece")
    return few.unionByName(many).drop(times)

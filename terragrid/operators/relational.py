"""Joins, counts and reshaping that the computations share, as plain DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["lon_idx", "lat_idx"]


def side_by_side(first: DataFrame, second: DataFrame, value: str, names: tuple[str, str], shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """Two layers of one grid in one row per pixel that both have; the second may be moved by whole pixels."""
    moved = second.select((F.col("lon_idx") + shift[0]).alias("lon_idx"), (F.col("lat_idx") + shift[1]).alias("lat_idx"), F.col(value).alias(names[1]))
    return first.withColumnRenamed(value, names[0]).join(moved, KEYS)


def with_attributes(rows: DataFrame, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows with the attributes of several tables, each by its keys; rows without a match go."""
    return reduce(lambda out, t: out.join(t[0], t[1]), tables, rows)


def whichever(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Full outer join of two aggregates; what one of them lacks is 0."""
    met = first.join(second, key, "full")
    return met.select(key, *(F.coalesce(F.col(c), F.lit(0).cast(met.schema[c].dataType)).alias(c) for c in met.columns if c != key))


def without_data(members: DataFrame, present: DataFrame, key: str, among: DataFrame | None = None, among_key: str | None = None) -> DataFrame:
    """Members that aren't present, of those whose ``among_key`` is in another table."""
    held = members if among is None else members.join(among, among_key, "left_semi")
    return held.join(present, key, "left_anti")


def counted(rows: DataFrame, key: str, distinct: str) -> DataFrame:
    """(key, n, <distinct>): rows, and distinct values of a column, per key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(distinct).alias(distinct))


def first_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order: by an aggregate, so no key's rows are sorted in one task."""
    rest = [c for c in rows.columns if c != key]
    least = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(least.alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def expanded(keys: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """Every distinct row with every number from first to last."""
    return keys.distinct().select("*", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias(name))


def every_nth(rows: DataFrame, number: Column, n: int) -> DataFrame:
    """Rows whose number from 0 is a multiple of n."""
    return rows.where(F.pmod(number, F.lit(n)) == 0)

"""Numbering and choosing within entities, without one entity coming together in a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, entity: list[str], instant: str, ties: list[str], name: str = "n", stretch: str = "day") -> DataFrame:
    """``row_number`` of each row in its entity by (instant, ties), split by stretches of time.

    Rows are numbered within entity and stretch, and the entity's rows in earlier
    stretches are added, so the largest task holds one stretch of an entity. Null
    instants come first; a null in the entity is an entity of its own. Rows equal in
    instant and ties get different numbers in no set order.
    """
    part = [*entity, "_tramo"]
    own = df.withColumn("_tramo", F.date_trunc(stretch, instant))
    before = Window.partitionBy(*entity).orderBy(F.col("_tramo").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.groupBy(*part).agg(F.count("*").alias("_filas")).select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(part)], F.coalesce(F.sum("_filas").over(before), F.lit(0)).alias("_antes"))
    inside = own.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(F.col(instant).asc_nulls_first(), *ties)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(part)])
    return inside.join(offsets, same).withColumn(name, (F.col("_n") + F.col("_antes")).cast("long")).drop("_tramo", "_n", "_antes", *[f"_o{i}" for i in range(len(part))])


def latest_by(df: DataFrame, entity: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each entity's greatest row by ``order``, then by the values; combined before the shuffle."""
    whole = F.max(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*order, *values])])).alias("x")
    return df.groupBy(*entity).agg(whole).select(*entity, *[F.col(f"x.c{i}").alias(c) for i, c in enumerate([*order, *values])])


def top_n(df: DataFrame, entity: list[str], order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """The first n rows of each entity, and their place if it has a name; Spark limits the groups before it shuffles them."""
    kept = df.withColumn("_n", F.row_number().over(Window.partitionBy(*entity).orderBy(*order))).filter(F.col("_n") <= n)
    return kept.withColumnRenamed("_n", name) if name else kept.drop("_n")


def single_or_null(value: Column, where: Column | None = None) -> Column:
    """Aggregate: the only distinct non-null value (among rows that meet ``where``), null if there are none or several."""
    v = value if where is None else F.when(where, value)
    return F.when(F.min(v) == F.max(v), F.max(v))

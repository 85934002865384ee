"""Merges of a source into a target without a table format that merges by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.operators.skew import skew_safe_join
from telar.session import checkpoint

INSERTED, UPDATED, SAME, KEPT = "insertada", "actualizada", "igual", "conservada"


def _differs(columns: list[str]) -> Column:
    return ~F.struct(*[F.col(f"s.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"t.{c}") for c in columns]))


def type1_merge(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Key, columns and ``accion``: rows of the source overwrite those of the target that differ.

    Both have one row per key. Rows of the target alone are kept, never deleted; nulls
    are equal to nulls, also in keys.
    """
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = source.select(*key, *columns, F.lit(True).alias("_hay")).alias("s").join(target.select(*key, *columns, F.lit(True).alias("_hay")).alias("t"), cond, "full_outer")
    action = F.when(F.col("t._hay").isNull(), INSERTED).when(F.col("s._hay").isNull(), KEPT).when(_differs(columns), UPDATED).otherwise(SAME)
    pick = lambda c: F.when(F.col("s._hay"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return both.select(*[pick(c) for c in (*key, *columns)], action.alias("accion"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """Outcome counters of a tagged merge."""
    count = lambda a: F.count_if(F.col("accion") == a)
    return merged.agg(count(INSERTED).alias("insertadas"), count(UPDATED).alias("actualizadas"), count(SAME).alias("iguales"), count(KEPT).alias("conservadas"))


def append_anomalies(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Why an append of immutable rows must not happen: key, motivo (``existe``, ``repetida``, ``nula``)."""
    counted = new.groupBy(key).agg(F.count("*").alias("n"))
    there = new.select(key).join(target.select(key).distinct(), key, "left_semi").distinct().select(key, F.lit("existe").alias("motivo"))
    again = counted.filter((F.col("n") > 1) & F.col(key).isNotNull()).select(key, F.lit("repetida").alias("motivo"))
    null = counted.filter(F.col(key).isNull()).select(key, F.lit("nula").alias("motivo"))
    return there.unionByName(again).unionByName(null)


def missing_keys(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys that the existing rows lack."""
    return wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(existing.select(key).distinct(), key, "left_anti")


def mint_pseudonyms(existing: DataFrame, wanted: DataFrame, key: str, name: str = "seudonimo") -> DataFrame:
    """New rows (key, pseudonym) for the keys without one.

    ``uuid()`` gives other values each time it is evaluated: write the result, and read it
    back, before any use.
    """
    return missing_keys(existing, wanted, key).withColumn(name, F.uuid())


def load_conflicts(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both whose values differ: key and the names (never the values) of the diverging columns."""
    both = source.select(key, *columns).alias("s").join(target.select(key, *columns).alias("t"), key)
    names = F.array_compact(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in columns]))
    return both.select(key, F.concat_ws(",", names).alias("columnas")).filter("columnas <> ''")


def claim_outcomes(claims: DataFrame, key: list[str], hash_: str, order: list[str], answered: str | None = None) -> DataFrame:
    """Idempotent claims in batch form: each claim and ``resultado``.

    The first claim of a key (by ``order``, which must tell claims apart) is ``nueva``;
    later ones are ``repeticion`` with the same hash and ``colision`` with another. answered:
    a column that says whether the first claim came to an answer; if it did not, later ones
    are ``incompleta``, whatever their hash, as there is nothing to repeat. The first is
    found by a combined aggregation and joined back in a join that stands hot keys.
    """
    names = {k: f"_k{i}" for i, k in enumerate(key)}
    # nulls in a key are a value, which an equi-join would drop
    held = claims.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for k, n in names.items()}).withColumns({f"{n}n": F.col(k).isNull() for k, n in names.items()})
    on = [x for n in names.values() for x in (n, f"{n}n")]
    values = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    done = F.lit(True) if answered is None else F.coalesce(F.col(answered), F.lit(False))
    first = checkpoint(held.groupBy(*on).agg(F.min(F.struct(*values, F.col(hash_).alias("h"), done.alias("r"))).alias("_primera"), F.count("*").alias("_n")))
    is_first = F.lit(True)
    for i, c in enumerate(order):
        is_first = is_first & F.col(c).eqNullSafe(F.col(f"_primera.o{i}"))
    outcome = F.when(is_first, "nueva").when(~F.col("_primera.r"), "incompleta").when(F.col(hash_).eqNullSafe(F.col("_primera.h")), "repeticion").otherwise("colision")
    return skew_safe_join(held, first, on, "_n").select(*claims.columns, outcome.alias("resultado"))

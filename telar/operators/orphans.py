"""References to records that do not exist at the instant of the reference (problem 4)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators.ordered import OrderedParts, Scan

_BEFORE_ALL = -(2**63)


def _sums(rows: pd.DataFrame, carried: tuple | None) -> tuple[np.ndarray, ...]:
    """Running numbers of living rows, of rows ever begun, and of absence marks, within each key."""
    k1, k2 = rows.destino.to_numpy(), rows.k.to_numpy()
    first = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
    at = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    out = []
    for i, c in enumerate(("vivas", "nacidas", "ausente")):
        x = rows[c].to_numpy()
        total = np.cumsum(x)
        total = total - (total - x)[at]
        if carried and carried[0] == (k1[0], k2[0]):
            total = total + np.where(at == 0, carried[1][i], 0)
        out.append(total)
    return tuple(out)


class _Sweep(Scan):
    """State: the last target and key with its sums."""

    schema = "tabla int, id long, t long, clase int"

    def reduce(self, rows: pd.DataFrame) -> tuple:
        return None, ((int(rows.destino.iat[-1]), int(rows.k.iat[-1])), tuple(int(x[-1]) for x in _sums(rows, None)))

    def step(self, state: tuple | None, summary: tuple) -> tuple:
        key, sums = summary[1]
        return key, tuple(a + b for a, b in zip(state[1], sums)) if state and state[0] == key else sums

    def scan(self, rows: pd.DataFrame, state: tuple | None) -> pd.DataFrame:
        alive, born, absent = _sums(rows, state)
        keep = (rows.tabla.to_numpy() >= 0) & (alive <= 0)
        clase = np.where(absent > 0, 0, np.where(born > 0, 1, 2))
        return pd.DataFrame({"tabla": rows.tabla.to_numpy()[keep], "id": rows.id.to_numpy()[keep], "t": rows.t.to_numpy()[keep], "clase": clase[keep]})


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose key has no living row at their instant: tabla int, id long, t long, clase string.

    refs: tabla int (>= 0), id long, destino int, k long, t long (instant, microseconds).
    parents: destino int, k long, desde long, hasta long (null: still there); a row lives
    while desde <= instant < hasta, a row without desde never lives but is a row of its key.
    clase: ``ausente`` (the target never has the key), ``eliminada`` (one had begun),
    ``tardia`` (it begins later). Null keys and instants are no references; equal
    references count once; empty tables give no rows, an empty target makes all absent.
    Method: the distinct non-null keys referred to are left-anti-joined against the target's
    keys; the absent ones are joined back, with the beginnings and ends of the present
    ones, by sorting them before the references of their key and carrying them along. So
    neither a key with a third of all references nor one with countless rows in the
    target comes together in one task.
    """
    refs = refs.dropna(subset=["k", "t", "id"]).select("destino", "k", "t", "tabla", "id").distinct()
    parents = parents.filter(F.col("k").isNotNull())
    gone = refs.select("destino", "k").distinct().join(parents.select("destino", "k").distinct(), ["destino", "k"], "left_anti")
    zero = F.lit(0).cast("long")
    lives = F.col("desde").isNotNull() & (F.col("hasta").isNull() | (F.col("hasta") > F.col("desde")))
    turns = parents.filter(F.col("desde").isNotNull()).select(
        "destino",
        "k",
        F.explode(
            F.array(
                F.struct(F.col("desde").alias("t"), F.when(lives, 1).otherwise(0).cast("long").alias("vivas"), F.lit(1).cast("long").alias("nacidas")),
                F.struct(F.when(lives, F.col("hasta")).alias("t"), F.lit(-1).cast("long").alias("vivas"), zero.alias("nacidas")),
            )
        ).alias("x"),
    )
    turns = turns.filter(F.col("x.t").isNotNull()).groupBy("destino", "k", F.col("x.t").alias("t")).agg(F.sum("x.vivas").alias("vivas"), F.sum("x.nacidas").alias("nacidas"))
    none = F.lit(-1).cast("int").alias("tabla")
    united = (
        refs.select("destino", "k", "t", F.col("tabla").cast("int"), "id", zero.alias("vivas"), zero.alias("nacidas"), zero.alias("ausente"))
        .unionByName(turns.select("destino", "k", "t", none, zero.alias("id"), "vivas", "nacidas", zero.alias("ausente")))
        .unionByName(gone.select("destino", "k", F.lit(_BEFORE_ALL).alias("t"), none, zero.alias("id"), zero.alias("vivas"), zero.alias("nacidas"), F.lit(1).cast("long").alias("ausente")))
    )
    found = OrderedParts(united, ["destino", "k", "t", "tabla", "id"]).run(_Sweep())
    names = F.array(F.lit("ausente"), F.lit("eliminada"), F.lit("tardia"))
    return found.select("tabla", "id", "t", F.element_at(names, F.col("clase") + 1).alias("clase"))

"""Attributes of an entity as known at the time of an event (problem 5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators.ordered import OrderedParts, Scan

_KEYS = ["k", "t", "tipo", "a", "b", "c"]


def _best(rows: pd.DataFrame) -> np.ndarray:
    """For each row the place of the change in force after it, or -1."""
    n = len(rows)
    rank = np.empty(n, "int64")
    rank[np.lexsort((rows.c.to_numpy(), rows.b.to_numpy(), rows.a.to_numpy()))] = np.arange(n)
    place = np.empty(n, "int64")
    place[rank] = np.arange(n)
    k = rows.k.to_numpy()
    group = np.r_[0, np.cumsum(k[1:] != k[:-1])]
    top = np.maximum.accumulate(group * (n + 1) + np.where(rows.tipo.to_numpy() == 0, rank + 1, 0)) - group * (n + 1)
    return np.where(top > 0, place[np.maximum(top - 1, 0)], -1)


def _with(rows: pd.DataFrame, carried: tuple | None) -> pd.DataFrame:
    if carried is None or carried[1] is None or carried[0] != rows.k.iat[0]:
        return rows
    k, version = carried
    head = {c: 0 for c in rows.columns} | {"k": k, "tipo": 0} | version
    return pd.concat([pd.DataFrame([head], columns=rows.columns).astype(rows.dtypes.to_dict()), rows], ignore_index=True)


class _LastKnown(Scan):
    """State: the last key and the change in force, if there is one."""

    schema = "id long, v long, vale boolean, propio long, tiene boolean"

    def reduce(self, rows: pd.DataFrame) -> tuple:
        last = rows[rows.k == rows.k.iat[-1]].reset_index(drop=True)
        at = _best(last)[-1]
        return None, (int(rows.k.iat[-1]), None if at < 0 else {c: last[c].iat[at].item() for c in ("a", "b", "c", "v", "vale")})

    def step(self, state: tuple | None, summary: tuple) -> tuple:
        k, version = summary[1]
        if state and state[0] == k and state[1] and (version is None or _order(state[1]) > _order(version)):
            version = state[1]
        return k, version

    def scan(self, rows: pd.DataFrame, state: tuple | None) -> pd.DataFrame:
        rows = _with(rows, state)
        at = _best(rows)
        keep = (rows.tipo.to_numpy() == 1) & (at >= 0)
        at = at[keep]
        return pd.DataFrame({"id": rows.id.to_numpy()[keep], "v": rows.v.to_numpy()[at], "vale": rows.vale.to_numpy()[at] > 0, "propio": rows.v.to_numpy()[keep], "tiene": rows.vale.to_numpy()[keep] > 0})


def _order(version: dict) -> tuple:
    return version["a"], version["b"], version["c"]


def known_at_event(events: DataFrame, changes: DataFrame) -> DataFrame:
    """For each event the attribute in force among the changes known by then.

    events: id long, k long, t int (day), propio long (what the event itself carries).
    changes: k long, t int (day it became available), a, b, c long (of several available
    changes the greatest (a, b, c) is in force), v long.
    Returns id, vigente (null: in force, but empty), propio, of events with a change in
    force. Rows with a null k, t, a, b or c are ignored. A change available on the event's
    day comes before the event. Equal events and changes count once. Method: both are
    united, range-sorted by entity, availability, and kind, and the greatest change so far
    is carried forward, also from partition to partition.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("v")
    own = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
    ev = events.select(*own("k", "t"), F.lit(1).alias("tipo"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), *own("id"), whole("propio"), F.col("propio").isNotNull().cast("int").alias("vale"))
    ch = changes.select(*own("k", "t"), F.lit(0).alias("tipo"), *own("a", "b", "c"), F.lit(0).cast("long").alias("id"), whole("v"), F.col("v").isNotNull().cast("int").alias("vale"))
    both = ev.unionByName(ch).dropna(subset=["k", "t", "a", "b", "c", "id"]).distinct()
    found = OrderedParts(both, [*_KEYS, "id", "v"]).run(_LastKnown())
    return found.select("id", F.when(F.col("vale"), F.col("v")).alias("vigente"), F.when(F.col("tiene"), F.col("propio")).alias("propio"))

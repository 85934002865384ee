"""Continuous periods and gaps of the intervals of each entity (problem 2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators.ordered import OrderedParts, Scan

OPEN = 2**31 - 1
NONE = -(2**63)
_STEP = 2**33


def _islands(e: np.ndarray, s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest end before each row within its group, and whether the row begins an island."""
    top = np.maximum.accumulate(group * _STEP + e) - group * _STEP
    first = np.r_[True, group[1:] != group[:-1]]
    before = np.where(first, -_STEP, np.r_[0, top[:-1]])
    return before, first | (s > before + 1)


def _group(rows: pd.DataFrame) -> np.ndarray:
    k1, k2 = rows.k1.to_numpy(), rows.k2.to_numpy()
    return np.r_[0, np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))]


class _Periods(Scan):
    """State: the last entity, the start of its last island, and its greatest end."""

    schema = "k1 long, k2 long, hueco boolean, s long, e long, n long"

    def reduce(self, rows: pd.DataFrame) -> tuple:
        last = rows[(rows.k1 == rows.k1.iat[-1]) & (rows.k2 == rows.k2.iat[-1])]
        s, e = last.s.to_numpy(), last.e.to_numpy()
        _, begins = _islands(e, s, np.zeros(len(last), "int64"))
        return None, ((int(rows.k1.iat[-1]), int(rows.k2.iat[-1])), int(s[begins][-1]), int(e.max()))

    def step(self, state: tuple | None, summary: tuple) -> tuple:
        entity, start, end = summary[1]
        if state is None or state[0] != entity:
            return summary[1]
        # all these rows are of the entity; an island within reach of the state's end goes on from it
        return entity, start if start > state[2] + 1 else state[1], max(end, state[2])

    def scan(self, rows: pd.DataFrame, state: tuple | None) -> pd.DataFrame:
        rows = rows[["k1", "k2", "s", "e"]].assign(n=1)
        if state and state[0] == (rows.k1.iat[0], rows.k2.iat[0]):
            rows = pd.concat([pd.DataFrame([(*state[0], state[1], state[2], 0)], columns=rows.columns), rows], ignore_index=True)
        s, e, group = rows.s.to_numpy(), rows.e.to_numpy(), _group(rows)
        before, begins = _islands(e, s, group)
        at = np.flatnonzero(begins)
        islands = pd.DataFrame({"k1": rows.k1.to_numpy()[at], "k2": rows.k2.to_numpy()[at], "hueco": False, "s": s[at], "e": np.maximum.reduceat(e, at), "n": np.add.reduceat(rows.n.to_numpy(), at)})
        at = at[before[at] > -_STEP]
        gaps = pd.DataFrame({"k1": rows.k1.to_numpy()[at], "k2": rows.k2.to_numpy()[at], "hueco": True, "s": before[at] + 1, "e": s[at] - 1, "n": 2})
        return pd.concat([islands, gaps], ignore_index=True)


def periods_and_gaps(df: DataFrame, entity: tuple[str, str], start: str, end: str) -> DataFrame:
    """Maximal covered periods and the gaps between them: entity columns, clase, desde, hasta (dates), intervalos.

    Both ends are inclusive, a null end is open, intervals that touch belong together.
    Rows with a null start or an end before the start are ignored; rows with the same two
    dates count once. clase is ``continuo`` (``intervalos`` made it up) or ``hueco``. A
    null in an entity column is an entity of its own. An empty table gives no rows; extra
    columns are never looked at. Method: distinct intervals are range-sorted by entity and
    start, each partition gives its greatest end, the summaries are prefix-combined, and a
    second pass with the carried period labels the islands; periods that cross partitions
    are joined by one small aggregation on their label, which is their first day.
    """
    k1, k2 = entity
    own = df.select(
        F.coalesce(F.col(k1).cast("long"), F.lit(NONE)).alias("k1"),
        F.coalesce(F.col(k2).cast("long"), F.lit(NONE)).alias("k2"),
        F.unix_date(start).cast("long").alias("s"),
        F.coalesce(F.unix_date(end), F.lit(OPEN)).cast("long").alias("e"),
    ).filter(F.col("s").isNotNull() & (F.col("e") >= F.col("s")))
    parts = OrderedParts(own.distinct(), ["k1", "k2", "s", "e"])
    pieces = parts.run(_Periods())
    whole = pieces.groupBy("k1", "k2", "hueco", "s").agg(F.max("e").alias("e"), F.sum("n").alias("intervalos"))
    kind = dict(df.dtypes)
    back = lambda c, name: F.when(F.col(c) != NONE, F.col(c)).cast(kind[name]).alias(name)
    return whole.select(
        back("k1", k1),
        back("k2", k2),
        F.when(F.col("hueco"), "hueco").otherwise("continuo").alias("clase"),
        F.date_from_unix_date(F.col("s").cast("int")).alias("desde"),
        F.when(F.col("e") < OPEN, F.date_from_unix_date(F.col("e").cast("int"))).alias("hasta"),
        "intervalos",
    )

"""Which periods cover an event, by a sweep over sorted starts, ends and events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators.asof import known_at_event
from telar.operators.ordered import OrderedParts, Scan

_SUMS = ("n", "suma", "con_valor")
_OPEN = 2**31 - 1


def _running(rows: pd.DataFrame, carried: tuple | None) -> list[np.ndarray]:
    k = rows.k.to_numpy()
    first = np.r_[True, k[1:] != k[:-1]]
    at = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    out = []
    for i, c in enumerate(_SUMS):
        x = rows[c].to_numpy()
        total = np.cumsum(x)
        total = total - (total - x)[at]
        out.append(total + np.where(at == 0, carried[1][i], 0) if carried and carried[0] == k[0] else total)
    return out


class _Sweep(Scan):
    """State: the last key with its sums."""

    schema = "id long, cubren long, suma long, con_valor long"

    def reduce(self, rows: pd.DataFrame) -> tuple:
        return None, (int(rows.k.iat[-1]), tuple(int(x[-1]) for x in _running(rows, None)))

    def step(self, state: tuple | None, summary: tuple) -> tuple:
        k, sums = summary[1]
        return k, tuple(a + b for a, b in zip(state[1], sums)) if state and state[0] == k else sums

    def scan(self, rows: pd.DataFrame, state: tuple | None) -> pd.DataFrame:
        n, total, valued = _running(rows, state)
        keep = rows.tipo.to_numpy() == 1
        return pd.DataFrame({"id": rows.id.to_numpy()[keep], "cubren": n[keep], "suma": total[keep], "con_valor": valued[keep]})


def covering(events: DataFrame, periods: DataFrame) -> DataFrame:
    """For each event how many periods cover its day and, if one does, its value: id, cubren, valor.

    events: id long, k long, dia date. periods: k long, desde date, hasta date (inclusive;
    null: open), valor long (null: none, also where that period alone covers). Periods
    without a start or that end before it cover nothing; repeated periods count each. Events with a null key or day come out with 0.
    Method: a period adds one, and its value, from its first day on and takes them away
    after its last; the running sums are carried along the sorted rows. Where exactly one
    period covers, the sum of the values is its value. So events and periods of a key
    never form pairs.
    """
    day = lambda c: F.unix_date(c).cast("long")
    zero = F.lit(0).cast("long")
    placed = events.filter(F.col("k").isNotNull() & F.col("dia").isNotNull() & F.col("id").isNotNull())
    ok = periods.filter(F.col("k").isNotNull() & F.col("desde").isNotNull() & (F.col("hasta").isNull() | (F.col("hasta") >= F.col("desde"))))
    value, valued = F.coalesce(F.col("valor"), F.lit(0)).cast("long"), F.col("valor").isNotNull().cast("long")
    begins = F.struct(day("desde").alias("t"), F.lit(1).cast("long").alias("n"), value.alias("suma"), valued.alias("con_valor"))
    ends = F.struct((day("hasta") + 1).alias("t"), F.lit(-1).cast("long").alias("n"), (-value).alias("suma"), (-valued).alias("con_valor"))
    turns = ok.select(F.col("k").cast("long").alias("k"), F.explode(F.array(begins, ends)).alias("x")).filter(F.col("x.t").isNotNull())
    turns = turns.groupBy("k", F.col("x.t").alias("t")).agg(*[F.sum(f"x.{c}").alias(c) for c in _SUMS])
    zeros = [zero.alias(c) for c in _SUMS]
    rows = placed.select(F.col("k").cast("long").alias("k"), day("dia").alias("t"), F.lit(1).alias("tipo"), F.col("id").cast("long").alias("id"), *zeros).unionByName(turns.select("k", "t", F.lit(0).alias("tipo"), zero.alias("id"), *_SUMS))
    swept = OrderedParts(rows, ["k", "t", "tipo", "id"]).run(_Sweep())
    unplaced = events.filter(F.col("k").isNull() | F.col("dia").isNull() | F.col("id").isNull()).select(F.col("id").cast("long").alias("id"), zero.alias("cubren"), zero.alias("suma"), zero.alias("con_valor"))
    return swept.unionByName(unplaced).select("id", "cubren", F.when((F.col("cubren") == 1) & (F.col("con_valor") == 1), F.col("suma")).alias("valor"))


def covered_whole(spans: DataFrame, periods: DataFrame) -> DataFrame:
    """Whether one period covers each span from its first to its last day: id, cubierto.

    spans: id long, k long, desde date, hasta date (null: the first day only). periods: k
    long, desde date, hasta date (inclusive; null: open). Spans without a key or a first
    day are not covered. Method: among the periods begun by the span's first day the one
    that lasts longest is carried along; it covers the span if any does.
    """
    day = lambda c: F.unix_date(c).cast("long")
    zero = F.lit(0).cast("long")
    events = spans.select("id", "k", F.unix_date("desde").alias("t"), F.coalesce(day("hasta"), day("desde")).alias("propio"))
    end = F.coalesce(day("hasta"), F.lit(_OPEN).cast("long"))
    changes = periods.select("k", F.unix_date("desde").alias("t"), end.alias("a"), zero.alias("b"), zero.alias("c"), end.alias("v"))
    found = known_at_event(events, changes).groupBy("id").agg(F.min(F.col("vigente") >= F.col("propio")).alias("cubierto"))
    return spans.select(F.col("id").cast("long").alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("cubierto", F.lit(False)).alias("cubierto"))

"""Differences between two copies of a table (problem 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.operators.ordered import OrderedParts, Scan
from telar.session import checkpoint

#: Rows under the rolling hash.
WINDOW = 4
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def latest(df: DataFrame, key: str, columns: list[str], newest: str | None) -> DataFrame:
    """One row per key: the latest by ``newest``, of equally late ones the greatest; null instants are the earliest."""
    order = ([F.col(newest)] if newest else []) + [F.col(c) for c in columns]
    return df.groupBy(F.col(key).alias(key)).agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_ultima")).select(key, *[F.col(f"_ultima.o{i + bool(newest)}").alias(c) for i, c in enumerate(columns)])


def _hash(columns: list[str], seed: int) -> Column:
    """A hash that tells nulls from values and from their neighbours' nulls."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _rolling(kh: np.ndarray) -> np.ndarray:
    """At each row, from the WINDOW-th on, the hash of the keys of the last WINDOW rows."""
    h = kh.view("uint64")
    out = np.zeros(max(len(h) - WINDOW + 1, 0), "uint64")
    for i in range(WINDOW):
        out = out * _FACTOR + h[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


class _Chunks(Scan):
    """Labels each row with its chunk, the hash of the key at its cut.

    State: side, the last WINDOW - 1 key hashes, the last label (None: no cut yet). Each side begins
    with hashes of zero and the label 0. Head: side and the first WINDOW - 1 hashes, whose windows
    reach back to the rows before.
    """

    schema = "_lado int, _h1 long, _h2 long, _trozo long"

    def __init__(self, every: int):
        self.every = np.uint64(every)

    def _labels(self, kh: np.ndarray, before: list[int]) -> np.ndarray:
        """Place of the last cut at or before each row, -1 for none."""
        cut = _rolling(np.r_[np.array(before, "int64"), kh]) % self.every == 0
        return np.maximum.accumulate(np.where(cut, np.arange(len(cut)), -1))

    def reduce(self, rows: pd.DataFrame) -> tuple:
        side = rows["_lado"].to_numpy()
        kh = rows["_kh"].to_numpy()[side == side[-1]]
        begins = len(kh) < len(side)  # the side begins among these rows
        if begins:
            at = self._labels(kh, [0] * (WINDOW - 1))[-1]
        else:
            inner = self._labels(kh[WINDOW - 1 :], kh[: WINDOW - 1].tolist()) if len(kh) >= WINDOW else np.array([-1])
            at = inner[-1] + WINDOW - 1 if inner[-1] >= 0 else -1
        label = int(kh[at]) if at >= 0 else 0 if begins else None
        return (int(side[0]), kh[: WINDOW - 1].tolist(), begins), (int(side[-1]), kh[-(WINDOW - 1) :].tolist(), label)

    def step(self, state: tuple | None, summary: tuple) -> tuple:
        (first_side, head, begins), (side, tail, label) = summary
        if begins:
            return side, ([0] * (WINDOW - 1) + tail)[-(WINDOW - 1) :], label
        before, last = (state[1], state[2]) if state and state[0] == side else ([0] * (WINDOW - 1), 0)
        if label is None:  # no cut but perhaps one whose window reaches back
            kh = np.array(head, "int64")
            at = self._labels(kh, before)[-1]
            label = int(kh[at]) if at >= 0 else last
        return side, (before + tail)[-(WINDOW - 1) :], label

    def scan(self, rows: pd.DataFrame, state: tuple | None) -> pd.DataFrame:
        side, kh = rows["_lado"].to_numpy(), rows["_kh"].to_numpy()
        out = np.zeros(len(rows), "int64")
        for s in np.unique(side):
            own = side == s
            before, label = (state[1], state[2]) if state and state[0] == s else ([0] * (WINDOW - 1), 0)
            at = self._labels(kh[own], before)
            out[own] = np.where(at >= 0, kh[own][np.maximum(at, 0)], label)
        return rows[["_lado", "_h1", "_h2"]].assign(_trozo=out)


def common_types(source: DataFrame, copy: DataFrame, columns: list[str]) -> dict[str, str]:
    """The type in which the columns of both are compared: the wider number, or strings if only one is a string."""
    a, b = dict(source.dtypes), dict(copy.dtypes)
    mixed = {c for c in columns if (a[c] == "string") != (b[c] == "string")}
    alike = [c for c in columns if c not in mixed]
    return {c: "string" for c in mixed} | dict(source.select(*alike).limit(0).union(copy.select(*alike).limit(0)).dtypes)


def chunked(rows: DataFrame, key: str, columns: list[str], every: int) -> DataFrame:
    """_lado, _h1, _h2, _trozo of the rows of both sides; only hashes are sorted and go through Python."""
    hashed = rows.select("_lado", F.col(key).alias("_k"), _hash([key], 1).alias("_kh"), _hash([key, *columns], 2).alias("_h1"), _hash([key, *columns], 3).alias("_h2"))
    return OrderedParts(hashed, ["_lado", "_k"]).run(_Chunks(every))


def diff_copies(source: DataFrame, copy: DataFrame, key: str, columns: list[str], source_newest: str | None = None, copy_newest: str | None = None, every: int = 16) -> DataFrame:
    """Rows missing on either side and differing fields: key, campo.

    campo is ``fila_solo_en_origen``, ``fila_solo_en_copia`` or the name of a column of
    ``columns`` (those that both hold and that are to be compared) whose values differ as
    strings or numbers: 97 equals 97.00, whatever types the sides have. null equals only
    null. Of several rows of a key the latest counts. A null key is a key like any other.
    Empty tables: every row of the other side is alone. Columns not named are not looked at.

    Method: content-defined chunking. Each side is sorted by key and cut where the rolling
    hash of the last keys is divisible by ``every``, so cuts move only near rows that came
    or went. Chunks with equal fingerprints (cut, number of rows, and two combined 64-bit
    hashes of the rows) are equal; an anti-join leaves the others, and only their rows
    are joined by key and compared field by field. Fields are never sorted: rows are found
    again by their hash, and a hash that met another's would only be compared in vain.
    """
    kinds = common_types(source, copy, [key, *columns])
    sides = []
    for i, (df, newest) in enumerate(((source, source_newest), (copy, copy_newest))):
        own = df.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], *([F.col(newest).alias("_hasta")] if newest else []))
        sides.append(latest(own, key, columns, "_hasta" if newest else None).withColumn("_lado", F.lit(i)))
    rows = checkpoint(sides[0].unionByName(sides[1]))  # read for the hashes and for the fields
    labelled = checkpoint(chunked(rows, key, columns, every))
    prints = labelled.groupBy("_trozo", "_lado").agg(F.count("*").alias("n"), F.expr("bit_xor(_h1)").alias("x1"), F.expr("bit_xor(_h2)").alias("x2"))
    same = ["_trozo", "n", "x1", "x2"]
    only = lambda i: prints.filter(F.col("_lado") == i).drop("_lado")
    unmatched = [only(i).join(only(1 - i), same, "left_anti").select("_trozo", F.lit(i).alias("_lado")) for i in (0, 1)]
    left = labelled.join(unmatched[0].unionByName(unmatched[1]), ["_trozo", "_lado"], "left_semi").select("_lado", "_h1", "_h2")
    own = rows.withColumns({"_h1": _hash([key, *columns], 2), "_h2": _hash([key, *columns], 3)}).join(left, ["_lado", "_h1", "_h2"], "left_semi")
    pick = lambda i: F.max(F.when(F.col("_lado") == i, F.struct(*columns))).alias(("_a", "_b")[i])
    both = own.groupBy(key).agg(pick(0), pick(1))
    changed = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]
    campos = F.when(F.col("_b").isNull(), F.array(F.lit("fila_solo_en_origen"))).when(F.col("_a").isNull(), F.array(F.lit("fila_solo_en_copia"))).otherwise(F.array_compact(F.array(*changed)))
    return both.select(F.col(key).cast(dict(source.dtypes)[key]).alias(key), F.explode(campos).alias("campo"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, discrepancias: distinct rows of a not in b plus those of b not in a; nulls equal nulls."""
    sides = a.withColumn("_lado", F.lit(1)).union(b.withColumn("_lado", F.lit(2)))
    return sides.groupBy(*a.columns).agg(F.bit_or("_lado").alias("_lados")).agg(F.count_if(F.col("_lados") < 3).alias("discrepancias"))

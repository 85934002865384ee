"""Filling containers of fixed capacity with texts (problem 6)."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telar.session import checkpoint, width


class _Filling:
    """Containers for a histogram of sizes.

    Work and result depend on the number of sizes, which the capacity bounds, and not on
    the number of texts: equal sizes are dealt with together. ``runs`` says for each size
    which ranks go where: (size, first rank, rank after the last, first container, texts
    of this size in each container).
    """

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for size, n in counts.items():
            self.left[size] = n
        self.total = list(self.left)
        self.bins = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.gaps: list[int] = []
        self.by_gap: dict[int, list[tuple[int, int]]] = {}
        self._large()
        for size in range(capacity // 3, 0, -1):
            self._small(size)
        self._empty()

    def _put(self, size: int, n: int, first_bin: int, each: int) -> None:
        rank = self.total[size] - self.left[size]
        self.runs.append((size, rank, rank + n, first_bin, each))
        self.left[size] -= n

    def _room(self, gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if gap not in self.by_gap:
                insort(self.gaps, gap)
            self.by_gap.setdefault(gap, []).append((first_bin, n))

    def _open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def _large(self) -> None:
        """Sizes above a third: from the largest down, with the largest partner that still fits."""
        c, least = self.capacity, self.capacity // 3 + 1
        below = list(range(c + 1))  # below[x] leads to the greatest size <= x that may be left

        def partner(x: int) -> int:
            path = []
            while x >= least and not self.left[x]:
                path.append(x)
                below[x] = min(below[x], x - 1)
                x = below[x]
            for y in path:
                below[y] = x
            return x if x >= least else 0

        for a in range(c, least - 1, -1):
            while self.left[a]:
                b = partner(min(a, c - a))
                if b == a and self.left[a] == 1:
                    b = partner(a - 1)
                if not b:
                    n = self.left[a]
                    at = self._open(n)
                    self._put(a, n, at, 1)
                    self._room(c - a, at, n)
                elif b == a:
                    n = self.left[a] // 2
                    at = self._open(n)
                    self._put(a, 2 * n, at, 2)
                    self._room(c - 2 * a, at, n)
                else:
                    n = min(self.left[a], self.left[b])
                    at = self._open(n)
                    self._put(a, n, at, 1)
                    self._put(b, n, at, 1)
                    self._room(c - a - b, at, n)

    def _small(self, size: int) -> None:
        """Best fit: into the narrowest gap that takes one, and again, as it is then the narrowest."""
        while self.left[size]:
            i = bisect_left(self.gaps, size)
            if i < len(self.gaps):
                gap = self.gaps[i]
                at, n = self.by_gap[gap].pop()
                if not self.by_gap[gap]:
                    del self.by_gap[gap]
                    self.gaps.pop(i)
            else:
                gap, n = self.capacity, -(-self.left[size] // (self.capacity // size))
                at = self._open(n)
            each = gap // size
            full = min(n, self.left[size] // each)
            if full:
                self._put(size, full * each, at, each)
                self._room(gap - each * size, at, full)
            rest = self.left[size]
            if full < n and 0 < rest < each:
                self._put(size, rest, at + full, rest)
                self._room(gap - rest * size, at + full, 1)
                full += 1
            self._room(gap, at + full, n - full)

    def _empty(self) -> None:
        """Texts without tokens take no room; they are dealt out evenly."""
        if n := self.left[0]:
            if not self.bins:
                self._open(1)
            self._put(0, n, 0, -(-n // self.bins))


def fill(capacity: int, counts: dict[int, int]) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Number of containers and the runs (see _Filling) for so many items of each size (0..capacity)."""
    filling = _Filling(capacity, counts)
    return filling.bins, filling.runs


def _placing(spark: SparkSession, capacities: list[int], runs: dict[int, list[tuple[int, int, int, int, int]]]):
    """A function of capacity, size and rank that gives the container, by binary search in the runs.

    The runs are bounded by the capacities: each step of a filling ends a size or narrows a
    gap. A size may have many, so the texts are not joined to them.
    """
    stride = max(capacities) + 1
    rows = sorted((i * stride + size, lo, first, each) for i, c in enumerate(capacities) for size, lo, _, first, each in runs[c])
    table = np.array(rows, "int64").reshape(-1, 4)
    sizes, place_of = np.unique(table[:, 0], return_inverse=True)
    ranks = 1 + max((hi for i in runs.values() for _, _, hi, _, _ in i), default=0)
    if len(sizes) * ranks >= 2**63:
        raise ValueError("too many texts of too many sizes for one number to tell them apart")
    sent = spark.sparkContext.broadcast((np.array(capacities, "int64"), sizes, place_of * ranks + table[:, 1], table[:, 1:]))

    @F.pandas_udf("long")
    def place(capacity: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        known, sizes, begins, table = sent.value
        group = np.searchsorted(known, capacity.to_numpy()) * stride + size.to_numpy()
        own = rank.to_numpy("int64")
        i = np.searchsorted(begins, np.searchsorted(sizes, group) * ranks + own, side="right") - 1
        return pd.Series(table[i, 1] + (own - table[i, 0]) // table[i, 2])

    return place


def pack(sizes: DataFrame, capacities: list[int], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Which container holds what: max_tokens, id_contenedor, key, parte, desde_token, n_tokens.

    Every row of ``sizes`` is packed once for each capacity. A text larger than the
    capacity is cut into full containers and a rest; others are never cut. A size that is
    null or negative counts as 0; texts of size 0 are dealt out over the containers.
    Repeated rows are packed as often as they come. An empty table gives no rows.

    Method: large-item matching. Sizes above a third of the capacity can share a container
    only in pairs and are matched greedily; smaller ones go, from the largest down, into
    the narrowest gap that takes them. This runs on the histogram of sizes (at most
    capacity + 1 numbers for each capacity), which is all that reaches the driver. Each
    text finds its container by its rank among those of its size; ranks are counted
    within salted groups, so that a size of which a third of all texts are is split.
    """
    spark = sizes.sparkSession
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    salts = width(spark)
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    items = (
        sizes.select(key, n.alias("_n"), F.explode(F.array(*[F.lit(c) for c in capacities])).alias("max_tokens"))
        .select(key, "_n", "max_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / F.col("max_tokens")).cast("long") - 1, F.lit(0)))).alias("parte"))
        .select(key, "max_tokens", "parte", F.least(F.col("max_tokens"), F.col("_n") - F.col("parte") * F.col("max_tokens")).cast("int").alias("n_tokens"))
        .withColumn("_sal", F.pmod(F.xxhash64(key, "parte"), F.lit(salts)).cast("int"))
    )
    group = ["max_tokens", "n_tokens", "_sal"]
    salted = checkpoint(items.groupBy(*group).agg(F.count("*").alias("n")))
    counts: dict[int, dict[int, int]] = {c: {} for c in capacities}
    for r in salted.groupBy("max_tokens", "n_tokens").agg(F.sum("n").alias("n")).collect():  # bounded by the capacities
        counts[r.max_tokens][r.n_tokens] = r.n
    place = _placing(spark, capacities, {c: fill(c, counts[c])[1] for c in capacities})
    before = Window.partitionBy("max_tokens", "n_tokens").orderBy("_sal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_antes"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(key, "parte")) - 1 + F.col("_antes")
    placed = items.join(offsets, group).withColumn("_rango", rank)
    return placed.select("max_tokens", place("max_tokens", "n_tokens", "_rango").alias("id_contenedor"), key, F.col("parte").cast("int").alias("parte"), (F.col("parte") * F.col("max_tokens")).alias("desde_token"), "n_tokens")


def occupancy(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, texts and parts, tokens, free room, the share filled, and the least number of containers."""
    bins = packed.groupBy("max_tokens", "id_contenedor").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("partes"))
    tokens = F.sum("n")
    return bins.groupBy("max_tokens").agg(
        F.count("*").alias("contenedores"),
        F.sum("partes").alias("partes"),
        tokens.alias("tokens"),
        (F.count("*") * F.col("max_tokens") - tokens).alias("libres"),
        (tokens / (F.count("*") * F.col("max_tokens"))).alias("ocupacion"),
        F.ceil(tokens / F.col("max_tokens")).alias("cota_inferior"),
        F.max("n").alias("mayor"),
    )

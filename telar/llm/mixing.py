"""Mixing sources to target weights along a curriculum (problem 7)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telar.session import width

#: Rows of one source that are summed up in one task, about.
ROWS_PER_BUCKET = 50_000
#: A table of targets is a parameter and not data; more rows than this are refused.
MOST_TARGETS = 10_000


@dataclass(frozen=True)
class Share:
    source: str
    weight: float  # of the target, over all targets
    share: float  # of the total, over the sources that have texts
    repeats: int
    available: int
    demand: float


def demands(targets: dict[str, tuple[float, int]], available: dict[str, int], total: float | None) -> tuple[float, list[Share]]:
    """The total and each source's part of it, in tokens.

    Without a total it is the largest at which every source with texts holds its share
    within its repetitions. With one, a source that can't supply its share gives all it
    may, and the others make up for it in proportion to their weights, as far as they can.
    """
    there = {s: w for s, (w, _) in targets.items() if available.get(s, 0) > 0}
    sum_all, sum_there = sum(w for w, _ in targets.values()) or 1.0, sum(there.values()) or 1.0
    most = {s: float(targets[s][1] * available[s]) for s in there}
    if total is None:
        total = min((most[s] * sum_there / w for s, w in there.items()), default=0.0)
        out = {s: min(most[s], total * w / sum_there) for s, w in there.items()}
    else:
        out, open_ = {}, dict(there)
        while open_:
            rest = total - sum(out.values())
            of = sum(open_.values())
            short = [s for s, w in open_.items() if rest * w / of >= most[s]]
            if not short:
                out |= {s: rest * w / of for s, w in open_.items()}
                break
            for s in short:
                out[s] = most[s]
                del open_[s]
    return total, [Share(s, w / sum_all, there.get(s, 0.0) / sum_there, r, available.get(s, 0), out.get(s, 0.0)) for s, (w, r) in targets.items()]


def ramps(shares: list[Share], tilt: float) -> dict[str, list[tuple[float, float]]]:
    """The default curriculum: knots (time, factor) per source, from 0 to 1.

    A source's weight changes evenly over the training, scarce sources (those that may be
    repeated often) gaining and abundant ones losing up to ``tilt``. The weights sum to the
    same at all times, and each source's integral stays its share.
    """
    total = sum(s.demand for s in shares) or 1.0
    mean = sum(s.demand * s.repeats for s in shares) / total
    spread = max((abs(s.repeats - mean) for s in shares if s.demand), default=0.0) or 1.0
    return {s.source: [(0.0, 1 - x), (1.0, 1 + x)] for s in shares if s.demand for x in [tilt * (s.repeats - mean) / spread]}


def _segments(shares: list[Share], schedule: dict[str, list[tuple[float, float]]]) -> list[tuple]:
    """Per source and stretch between knots: demand before it and after it, time, and the density's start and slope."""
    out = []
    for s in shares:
        if s.demand <= 0:
            continue
        knots = sorted(schedule.get(s.source, [(0.0, 1.0), (1.0, 1.0)]))
        if knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
            raise ValueError("a schedule has knots from time 0 to 1, each later than the one before, and no negative weights")
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        if area <= 0:
            raise ValueError("a schedule's weights can't all be zero")
        done = 0.0
        for i, (a, b) in enumerate(zip(knots, knots[1:])):
            scale = s.demand / area
            size = scale * (b[0] - a[0]) * (a[1] + b[1]) / 2
            last = i == len(knots) - 2
            out.append((s.source, done if i else -1.0, math.inf if last else done + size, done, a[0], scale * a[1], scale * (b[1] - a[1]) / (b[0] - a[0])))
            done += size
    return out


def read_targets(targets: DataFrame, source: str, weight: str, repeats: str) -> dict[str, tuple[float, int]]:
    """Weight and repetitions of each source; of repeated rows the greatest; null sources, and weights that are not positive, are left out."""
    rows = targets.select(F.col(source).alias("s"), F.col(weight).cast("double").alias("w"), F.coalesce(F.col(repeats), F.lit(1)).cast("int").alias("r")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        if r.s is not None and r.w is not None and 0 < r.w < math.inf and r.r > 0:
            w, k = out.get(r.s, (0.0, 0))
            out[r.s] = (max(w, r.w), max(k, r.r))
    return out


class Mixture:
    """Texts of ``sizes`` (key, source, size) chosen and placed by ``targets``.

    Texts of a source are taken in an order of hashes, epoch after epoch, none more often
    than its repetitions allow, until the source's demand is met to within half a text.
    Texts without tokens, without a source or of a source without a target are not used.
    Empty tables give an empty mixture; repeated rows are texts of their own.

    Method: each source's weight schedule is integrated to its cumulative demand over the
    time from 0 to 1; a text at a cumulative size gets the time at which the demand
    reaches it, by inverting that integral, and all are range-sorted by this position.
    Cumulative sizes come from buckets of the hash order: sums within a bucket by a window,
    before it from the buckets' totals, so no source comes together in one task.
    """

    def __init__(self, sizes: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", weight: str = "peso_objetivo", repeats: str = "max_repeticiones", total: float | None = None, schedule: dict[str, list[tuple[float, float]]] | None = None, tilt: float = 0.5, seed: int = 7):
        self.key, self.source, self.size, self.seed = key, source, size, seed
        self.spark = sizes.sparkSession
        own = sizes.select(key, source, F.col(size).cast("long").alias(size))
        wanted = read_targets(targets, source, weight, repeats)
        names = self.spark.createDataFrame([(s,) for s in wanted], f"`{source}` string")
        # the targets are a parameter of at most MOST_TARGETS rows
        self.own = own.filter(F.col(size) > 0).join(F.broadcast(names), source, "left_semi")
        known = self.own.groupBy(source).agg(F.sum(size).alias("n"), F.count("*").alias("filas")).collect()
        self.rows = sum(r.filas for r in known)
        self.total, self.shares = demands(wanted, {r[source]: r.n for r in known}, total)
        self.schedule = ramps(self.shares, tilt) if schedule is None else schedule

    def chosen(self) -> DataFrame:
        """posicion (0..1), source, key, repeticion (from 1), size; sorted by posicion."""
        key, source, size = self.key, self.source, self.size
        spark = self.spark
        bits = max(1, math.ceil(math.log2(max(width(spark), self.rows / ROWS_PER_BUCKET, 2))))
        h = F.xxhash64(F.lit(self.seed), F.col(key))
        own = self.own.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits).cast("int")).withColumn("_h", F.col("_h").bitwiseXOR(F.lit(-(2**63))))
        sums = own.groupBy(source, "_b").agg(F.sum(size).alias("_s"))
        earlier = F.sum("_s").over(Window.partitionBy(source).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sums.select(source, "_b", F.coalesce(earlier, F.lit(0)).alias("_antes"))
        inside = F.sum(size).over(Window.partitionBy(source, "_b").orderBy("_h", key, size).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        middle = (F.col("_antes") + F.col("_hasta") - F.col(size) / 2).alias("_medio")
        placed = own.withColumn("_hasta", inside).join(offsets, [source, "_b"]).select(key, source, size, middle)
        needs = spark.createDataFrame([(s.source, s.demand, s.available, s.repeats) for s in self.shares if s.demand > 0], f"`{source}` string, _pide double, _hay long, _veces int")
        last = F.least(F.col("_veces") - 1, F.floor((F.col("_pide") - F.col("_medio")) / F.col("_hay"))).cast("int")
        copies = placed.join(F.broadcast(needs), source).withColumn("_ultima", last).filter("_ultima >= 0").withColumn("_vez", F.explode(F.sequence(F.lit(0), F.col("_ultima")))).withColumn("_c", F.col("_vez") * F.col("_hay") + F.col("_medio"))
        segments: dict[str, list[tuple]] = {}
        for s, *stretch in _segments(self.shares, self.schedule):
            segments.setdefault(s, []).append(tuple(stretch))
        # one row per target with its stretches, so that a text is joined to one row only
        stretches = spark.createDataFrame(list(segments.items()), f"`{source}` string, _tramos array<struct<c0: double, c1: double, d0: double, t0: double, w: double, m: double>>")
        own_stretch = F.filter("_tramos", lambda x: (x["c0"] < F.col("_c")) & (F.col("_c") <= x["c1"]))[0]
        found = copies.join(F.broadcast(stretches), source).withColumn("_t", own_stretch)
        y = F.col("_c") - F.col("_t.d0")
        root = F.sqrt(F.greatest(F.col("_t.w") * F.col("_t.w") + 2 * F.col("_t.m") * y, F.lit(0.0)))
        at = F.col("_t.t0") + F.when(y > 0, 2 * y / (F.col("_t.w") + root)).otherwise(0.0)
        return found.select(at.alias("posicion"), source, key, (F.col("_vez") + 1).alias("repeticion"), size).orderBy("posicion", source, key, "repeticion")

    def reached(self, chosen: DataFrame) -> DataFrame:
        """Per target: its share as asked and among the sources there, tokens there and chosen, the share reached and the repetitions."""
        source = self.source
        asked = self.spark.createDataFrame([(s.source, s.weight, s.share, s.repeats, s.available) for s in self.shares], f"`{source}` string, cuota_objetivo double, cuota_presente double, max_repeticiones int, tokens_disponibles long")
        got = chosen.groupBy(source).agg(F.sum(self.size).alias("tokens"), F.count("*").alias("textos"), F.max("repeticion").alias("repeticiones"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        every = asked.join(got, source, "left").select(source, "cuota_objetivo", "cuota_presente", "max_repeticiones", "tokens_disponibles", zero("tokens"), zero("textos"), zero("repeticiones"))
        sum_ = F.sum("tokens").over(Window.partitionBy())  # as many rows as targets
        return every.withColumn("cuota_alcanzada", F.when(sum_ > 0, F.col("tokens") / sum_).otherwise(0.0))



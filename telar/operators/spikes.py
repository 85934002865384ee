"""Values that a measuring device cannot have measured (problem 1)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators.ordered import PART, OrderedParts
from telar.operators.sketch import Sketch, ranked
from telar.session import checkpoint

NONE = -(2**63)
_DAY, _MINUTE = 86_400_000_000, 60_000_000
_COLUMNS = "d long, f int, franja int, id long, v long, imposible boolean, usable boolean, salto2 long, corto long, pico long, racha long, cabeza boolean, `_parte` int"


@dataclass(frozen=True)
class Field:
    """A measured column: what lies outside low..high (low excluded if open_low) is impossible.

    floor is the least interquartile range taken for a device, usual the one that a device
    without values of its own would have, both in the column's unit.
    """

    name: str
    low: float
    high: float
    floor: float
    usual: float
    open_low: bool = False


@dataclass(frozen=True)
class Limits:
    #: Readings on each side that make up the level around a reading.
    around: int = 10
    #: Expansion of the interquartile fences.
    expand: float = 4.3
    #: A run of one value shorter than this is never a case and counts as ordinary readings.
    least_run: int = 8
    #: Chance that a device's ordinary readings hold a run that counts as stuck.
    run_chance: float = 1e-3
    #: Hours of a context within the day.
    context_hours: int = 6
    #: A context's quartiles are drawn towards the device's, and the device's range towards the
    #: field's usual one, as if so many values had been seen there.
    context_weight: float = 100.0
    usual_weight: float = 2.0
    #: Changes between readings no further apart than this have fences of their own, drawn
    #: towards ``change_usual`` ranges of the device.
    near_minutes: float = 10.0
    change_usual: float = 1.6
    sketch_k: int = 400


def _starts(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Whether a row begins a group (device and field), and whether it begins a run."""
    d, f, v = rows.d.to_numpy(), rows.f.to_numpy(), rows.v.to_numpy()
    group = np.r_[True, (d[1:] != d[:-1]) | (f[1:] != f[:-1])]
    return group, group | np.r_[True, v[1:] != v[:-1]]


def _runs(rows: pd.DataFrame, carried: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group starts, run starts (false where a run goes on from before) and whole run lengths."""
    group, starts = _starts(rows)
    at = np.flatnonzero(starts)
    size = np.diff(np.r_[at, len(rows)])
    heads = starts.copy()
    if carried:
        before, after = carried
        size[0] += before
        size[-1] += after
        heads[0] = not before
    return group, heads, np.repeat(size, np.diff(np.r_[at, len(rows)]))


def _reduce_runs(rows: pd.DataFrame, _: object) -> tuple:
    rows = _once(rows)
    _, starts = _starts(rows)
    at = np.flatnonzero(starts)
    key = lambda i: (int(rows.d.iat[i]), int(rows.f.iat[i]), int(rows.v.iat[i]))
    return key(0), int(at[1] if len(at) > 1 else len(rows)), key(-1), len(rows) - int(at[-1]), len(at) == 1


def _carry_runs(found: list[tuple[int, tuple]]) -> dict[int, tuple[int, int]]:
    """For each partition how far its first run reaches back and its last one on."""
    before, after = {}, {}
    for order, out in ((found, before), (found[::-1], after)):
        key, length = None, 0
        for part, (first, n_first, last, n_last, one) in order:
            near, n_near, far, n_far = (first, n_first, last, n_last) if out is before else (last, n_last, first, n_first)
            out[part] = length if key == near else 0
            key, length = far, out[part] + n_near if one else n_far
    return {part: (before[part], after[part]) for part, _ in found}


def _usable(rows: pd.DataFrame, runs: np.ndarray, least_run: int) -> np.ndarray:
    return ~rows.imposible.to_numpy() & (runs < least_run)


def _once(rows: pd.DataFrame) -> pd.DataFrame:
    """Equal rows lie side by side in one partition, as all columns are sort keys."""
    same = np.ones(len(rows), bool)
    same[:1] = False
    for c in ("d", "f", "t", "id", "v"):
        x = rows[c].to_numpy()
        same[1:] &= x[1:] == x[:-1]
    return rows[~same].reset_index(drop=True) if same.any() else rows


class _Levels:
    """Level, departure and sudden changes of each usable reading, also over partition ends."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def reduce(self, rows: pd.DataFrame, carried: dict) -> tuple:
        """The first and last usable values and instants of the partition's first and last group."""
        k, rows = self.limits.around, _once(rows)
        ok = _usable(rows, _runs(rows, carried["runs"])[2], self.limits.least_run)
        d, f = rows.d.to_numpy(), rows.f.to_numpy()
        vt = rows[["v", "t"]].to_numpy()
        ends = []
        for i in (0, -1):
            own = vt[ok & (d == d[i]) & (f == f[i])]
            ends.append(((int(d[i]), int(f[i])), own[:k].tolist(), own[-k:].tolist() if len(own) else []))
        return ends[0], ends[1]

    def carry(self, found: list[tuple[int, tuple]]) -> dict[int, tuple[list, list]]:
        k = self.limits.around
        before, after = {}, {}
        state: tuple[Any, list] = (None, [])
        for part, (first, last) in found:
            before[part] = state[1] if state[0] == first[0] else []
            state = (last[0], ((state[1] if state[0] == last[0] else []) + last[2])[-k:])
        state = (None, [])
        for part, (first, last) in found[::-1]:
            after[part] = state[1] if state[0] == last[0] else []
            state = (first[0], (first[1] + (state[1] if state[0] == first[0] else []))[:k])
        return {part: (before[part], after[part]) for part, _ in found}

    def scan(self, rows: pd.DataFrame, carried: dict) -> pd.DataFrame:
        rows = _once(rows)
        group, heads, runs = _runs(rows, carried["runs"])
        ok = _usable(rows, runs, self.limits.least_run)
        number = np.cumsum(group)
        before, after = (np.array(x, "int64").reshape(-1, 2) for x in carried["levels"])
        vt = np.r_[before, rows[["v", "t"]].to_numpy()[ok], after]
        v, t = vt[:, 0], vt[:, 1]
        g = np.r_[np.full(len(before), number[0]), number[ok], np.full(len(after), number[-1])]
        level = pd.Series(v.astype("float64")).groupby(g).rolling(2 * self.limits.around + 1, center=True, min_periods=1).median().to_numpy()
        # changes from and to the neighbours; -1 where there is none within reach
        step = np.diff(v)
        near = (g[1:] == g[:-1]) & (np.diff(t) <= self.limits.near_minutes * _MINUTE)
        short = np.r_[-1, np.where(near, np.abs(step), -1)]
        peak = np.full(len(v), -1)
        if len(v) > 2:
            turns = near[1:] & near[:-1] & (np.sign(step[1:]) * np.sign(step[:-1]) < 0)
            peak[1:-1] = np.where(turns, np.minimum(np.abs(step[1:]), np.abs(step[:-1])), -1)
        own = slice(len(before), len(v) - len(after))
        out = {}
        for name, x, none in (("salto2", np.rint(2 * (v - level)), 0), ("corto", short, -1), ("pico", peak, -1)):
            out[name] = np.full(len(rows), none, "int64")
            out[name][ok] = x[own].astype("int64")
        part = rows[["d", "f", "id", "v", "imposible"]].assign(franja=(rows.t.to_numpy() % _DAY // (3_600_000_000 * self.limits.context_hours)).astype("int32"), usable=ok, **out, racha=runs, cabeza=heads)
        return part.assign(**{PART: rows[PART]})[["d", "f", "franja", "id", "v", "imposible", "usable", "salto2", "corto", "pico", "racha", "cabeza", PART]]


class _Fences:
    """What is normal for each device and field, and the values that are not.

    A group (device and field) that lies in one partition is judged by its own values. Of
    one that goes on in others each partition gives quantile sketches and counts, which are
    merged; its fences are then sent to the partitions that hold a part of it.
    """

    def __init__(self, fields: list[Field], limits: Limits):
        self.limits = limits
        self.floor, self.usual = (np.array([200.0 * getattr(x, c) for x in fields]) for c in ("floor", "usual"))
        self.contexts = math.ceil(24 / limits.context_hours)

    def reduce(self, rows: pd.DataFrame, _: object) -> tuple:
        """Key, sketches and counts of the first and the last group, which may go on elsewhere."""
        d, f = rows.d.to_numpy(), rows.f.to_numpy()
        ends = []
        for i in (0, -1) if (d[0], f[0]) != (d[-1], f[-1]) else (0,):
            own = rows[(d == d[i]) & (f == f[i])]
            use = own[own.usable]
            k = self.limits.sketch_k
            departures = [Sketch.of(use.salto2.to_numpy()[use.franja.to_numpy() == c], k) for c in range(self.contexts)]
            short = use.corto.to_numpy()
            ends.append(((int(d[i]), int(f[i])), departures, Sketch.of(short[short >= 0], k), *self._runs(own)))
        return tuple(ends)

    def _runs(self, own: pd.DataFrame) -> tuple[int, int]:
        racha = own.racha.to_numpy()[own.cabeza.to_numpy()]
        return int((racha < self.limits.least_run).sum()), int(((racha > 1) & (racha < self.limits.least_run)).sum())

    def carry(self, found: list[tuple[int, tuple]]) -> dict[int, dict]:
        """For each partition the fences of its first and last group, where they lie in several."""
        k = self.limits.sketch_k
        merged: dict[tuple, list] = {}
        holders: dict[tuple, list[int]] = {}
        for part, ends in found:
            for key, departures, short, n, several in ends:
                holders.setdefault(key, []).append(part)
                if key in merged:
                    m = merged[key]
                    merged[key] = [[a.merge(b, k) for a, b in zip(m[0], departures)], m[1].merge(short, k), m[2] + n, m[3] + several]
                else:
                    merged[key] = [departures, short, n, several]
        out: dict[int, dict] = {part: {} for part, _ in found}
        for key, parts in holders.items():
            if len(parts) > 1:
                departures, short, n, several = merged[key]
                whole = departures[0]
                for x in departures[1:]:
                    whole = whole.merge(x, 4 * k)
                q = lambda x: [np.array([y]) for y in (float(x.n), *[x.quantile(p) for p in (0.1, 0.25, 0.75, 0.9)])]
                contexts = [np.array(x).T for x in zip(*[q(x) for x in departures])]
                fences = self._norms(np.array([key[1]]), tuple(q(whole)), contexts, tuple(q(short)), np.array([n]), np.array([several]))
                for part in parts:
                    out[part][key] = tuple(x[0] for x in fences)
        return out

    def _range(self, near: np.ndarray, tails: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For normal noise Q90 - Q10 is 1.9 times Q75 - Q25, and it tells more where values are coarse; where
        spikes are many it would widen without end, so it counts for twice the quartiles' range at most."""
        wide = np.where(near > 0, np.minimum(tails / 1.9, 2.0 * near), tails / 1.9)
        return np.fmax(np.fmax(near, wide), floor)

    def _norms(self, f: np.ndarray, device: tuple, contexts: list[np.ndarray], short: tuple, runs: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fences (of twice the departure) for groups by contexts, of sudden changes, and runs that are too long.

        device, contexts (a row for each group) and short: number of values and their quantiles.
        """
        lim, floor = self.limits, self.floor[f]
        n, q10, q25, q75, q90 = device
        iqr = (np.nan_to_num(n * self._range(q75 - q25, q90 - q10, floor)) + lim.usual_weight * self.usual[f]) / (n + lim.usual_weight)
        cn, c10, c25, c75, c90 = contexts
        towards = lambda own, whole: (np.nan_to_num(cn * own) + lim.context_weight * whole[:, None]) / (cn + lim.context_weight)
        reach = lim.expand * towards(self._range(c75 - c25, c90 - c10, floor[:, None]), iqr)
        low, high = towards(c25, q25) - reach, towards(c75, q75) + reach
        m, _, s25, s75, _ = short
        usual = lim.context_weight * lim.change_usual * iqr / 2
        drawn = lambda x: (np.nan_to_num(m * x) + usual) / (m + lim.context_weight)
        change = drawn(s75) + lim.expand * drawn(np.fmax(s75 - s25, floor / 2))
        # runs that may be cases are no norm; where there is nothing else, the source doesn't vary and they are cases
        ordinary = np.maximum(1, runs)
        same = np.minimum(0.9, np.maximum(0.01, several / ordinary))
        long_run = np.maximum(float(lim.least_run), np.ceil(1 + (math.log(lim.run_chance) - np.log(ordinary)) / np.log(same)))
        return low, high, change, long_run

    def scan(self, rows: pd.DataFrame, carried: dict) -> pd.DataFrame:
        d, f = rows.d.to_numpy(), rows.f.to_numpy()
        starts = np.r_[True, (d[1:] != d[:-1]) | (f[1:] != f[:-1])]
        g = np.cumsum(starts) - 1
        at = np.flatnonzero(starts)
        ok, size = rows.usable.to_numpy(), len(at)
        fr, x, short = rows.franja.to_numpy().astype("int64"), rows.salto2.to_numpy(), rows.corto.to_numpy()
        racha, head = rows.racha.to_numpy(), rows.cabeza.to_numpy()
        quantiles = (0.1, 0.25, 0.75, 0.9)
        device = ranked(g[ok], x[ok], size, quantiles)
        contexts = [y.reshape(size, self.contexts) for y in ranked(g[ok] * self.contexts + fr[ok], x[ok], size * self.contexts, quantiles)]
        near = ok & (short >= 0)
        ordinary = head & (racha < self.limits.least_run)
        low, high, change, long_run = self._norms(f[at], device, contexts, ranked(g[near], short[near], size, quantiles), np.bincount(g[ordinary], minlength=size), np.bincount(g[ordinary & (racha > 1)], minlength=size))
        for key, fences in carried.items():
            for i in np.flatnonzero((d[at] == key[0]) & (f[at] == key[1])):
                low[i], high[i], change[i], long_run[i] = fences
        jump = ok & ((x < low[g, fr]) | (x > high[g, fr]))
        sudden = ok & (rows.pico.to_numpy() > change[g])
        stuck = racha >= long_run[g]
        flags = rows[["id", "d", "f", "v", "imposible"]].assign(salto=jump, cambio=sudden, atascado=stuck)
        return flags[flags.imposible | jump | sudden | stuck]


def flag_measurements(df: DataFrame, key: str, source: str, instant: str, fields: list[Field], limits: Limits = Limits()) -> DataFrame:
    """Measured values with their flags: key, source, campo, valor (hundredths), imposible, salto, cambio, atascado.

    Only values with a flag come out. ``imposible``: outside the field's bounds. ``salto``:
    outside the expanded interquartile fences of its device and part of the day around the
    level of the device's readings near that time, so that drifts and lasting changes of
    level are followed. ``cambio``: within ``near_minutes`` of the readings before and
    after it, above both or below both by more than such readings of the device ever
    change. ``atascado``: part of a run of one value that is much longer than the device's
    ordinary runs; where nothing varies, any run of ``least_run`` or more is.

    Rows with equal key, source, instant and values count once. A null value is no value; a
    null source is a source of its own; null instants sort first; a null key stays null.
    Ties in time are ordered by key. A device with few values is judged by the field's
    usual range, the more by its own the more there are. An empty table gives no rows.
    Extra columns are not looked at.

    Method: values are range-sorted by source, field and time; runs and rolling medians
    are carried over partition ends. Departures from the level, by part of the day, and
    changes within minutes go into quantile sketches per source and field, which are
    merged over the partitions that hold the source; rows never move again.
    """
    cents = lambda x: F.round(F.col(x.name).cast("decimal(20,2)") * 100).cast("long")
    bad = [(F.col("v") < int(x.low * 100)) | (F.col("v") > int(x.high * 100)) | (F.lit(x.open_low) & (F.col("v") == int(x.low * 100))) for x in fields]
    one_of = lambda conditions: F.when(F.col("f") == 0, conditions[0]) if len(conditions) == 1 else F.element_at(F.array(*conditions), F.col("f") + 1)
    long = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("id"),
        F.coalesce(F.col(source).cast("long"), F.lit(NONE)).alias("d"),
        F.coalesce(F.unix_micros(instant), F.lit(NONE)).alias("t"),
        F.posexplode(F.array(*[cents(x) for x in fields])).alias("f", "v"),
    ).filter("v is not null")
    parts = OrderedParts(long, ["d", "f", "t", "id", "v"], len(fields) * df.count())
    parts.df = parts.df.withColumn("imposible", one_of(bad))
    runs = _carry_runs(parts.summaries(_reduce_runs))
    levels, fences = _Levels(limits), _Fences(fields, limits)
    carries = {part: {"runs": x} for part, x in runs.items()}
    for part, x in levels.carry(parts.summaries(levels.reduce, carries)).items():
        carries[part]["levels"] = x
    seen = OrderedParts.of(checkpoint(parts.emit(levels.scan, _COLUMNS, carries)))
    flagged = seen.emit(fences.scan, "id long, d long, f int, v long, imposible boolean, salto boolean, cambio boolean, atascado boolean", fences.carry(seen.summaries(fences.reduce)))
    back = lambda c, name, kind: F.when(F.col(c) != NONE, F.col(c)).cast(kind).alias(name)
    kinds = dict(df.dtypes)
    return flagged.select(back("id", key, kinds[key]), back("d", source, kinds[source]), F.element_at(F.array(*[F.lit(x.name) for x in fields]), F.col("f") + 1).alias("campo"), F.col("v").alias("valor"), "imposible", "salto", "cambio", "atascado")

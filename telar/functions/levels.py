"""Versioned thresholds that class readings into levels, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, WARNING, ERROR = "OK", "WARNING", "ERROR"
#: Severity of each level.
RANKS = {OK: 1, WARNING: 2, ERROR: 3}


@dataclass(frozen=True)
class Rules:
    # The thresholds of version SIM-1.0.
    version: str = "SIM-1.0"
    hr_error_below: Decimal = Decimal("55")
    hr_ok_from: Decimal = Decimal("60")
    hr_ok_below: Decimal = Decimal("100")
    hr_error_above: Decimal = Decimal("110")
    spo2_ok_from: Decimal = Decimal("95")
    spo2_error_below: Decimal = Decimal("92")
    mov_first_week: int = 20
    mov_ok_from: dict[int, int] = field(default_factory=lambda: {2: 10, 3: 10})


VERSIONS = {"SIM-1.0": Rules()}


def rules(version: str) -> Rules:
    if version not in VERSIONS:
        raise ValueError(f"no rules of version {version}")
    return VERSIONS[version]


def hr_level(hr: Column, r: Rules = Rules()) -> Column:
    """Null for null."""
    return (
        F.when((hr < F.lit(r.hr_error_below)) | (hr > F.lit(r.hr_error_above)), ERROR)
        .when((hr >= F.lit(r.hr_ok_from)) & (hr < F.lit(r.hr_ok_below)), OK)
        .when(hr.isNotNull(), WARNING)
    )


def spo2_level(spo2: Column, r: Rules = Rules()) -> Column:
    """Null for null."""
    return F.when(spo2 >= F.lit(r.spo2_ok_from), OK).when(spo2 >= F.lit(r.spo2_error_below), WARNING).when(spo2.isNotNull(), ERROR)


def mov_level(mov: Column, week: Column, trimester: Column, r: Rules = Rules()) -> Column:
    """Null for null, and where no rule applies: a negative count, an early week, a trimester without threshold."""
    enough = F.lit(None).cast("int")
    for t, n in r.mov_ok_from.items():
        enough = F.when(trimester == t, n).otherwise(enough)
    applies = (mov >= 0) & (week >= r.mov_first_week) & enough.isNotNull()
    return F.when(applies & (mov >= enough), OK).when(applies & (2 * mov >= enough), WARNING).when(applies, ERROR)


def rank(level: Column) -> Column:
    """1 to 3 by severity; null for null and for what is no level."""
    return F.when(level == OK, RANKS[OK]).when(level == WARNING, RANKS[WARNING]).when(level == ERROR, RANKS[ERROR])


def severest(*levels: Column) -> Column:
    """The most severe of the levels that apply; null if none does."""
    worst = F.greatest(*[rank(x) for x in levels])
    return F.when(worst == RANKS[OK], OK).when(worst == RANKS[WARNING], WARNING).when(worst == RANKS[ERROR], ERROR)


def vitals_shape(hr: Column, spo2: Column, mov: Column) -> Column:
    return hr.isNotNull() & spo2.isNotNull() & mov.isNull()


def movement_shape(hr: Column, spo2: Column, mov: Column) -> Column:
    return hr.isNull() & spo2.isNull() & mov.isNotNull()


def catalogue_faults(levels: list[tuple[str, int, str]], r: Rules = Rules()) -> list[str]:
    """What is wrong with a catalogue of (code, priority, version), which has one row per level."""
    found = [f"code {c} stands {n} times" for c in RANKS if (n := sum(x[0] == c for x in levels)) != 1]
    found += [f"unknown code {c}" for c, _, _ in levels if c not in RANKS]
    found += [f"priority of {c} is {p}" for c, p, _ in levels if c in RANKS and p != RANKS[c]]
    return found + [f"version of {c} is {v}" for c, _, v in levels if v != r.version]

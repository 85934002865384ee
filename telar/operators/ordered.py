"""Scans over globally sorted rows that carry a state from one partition to the next.

A window over one entity puts all its rows into one task. Here the rows are range-sorted
by entity and order columns instead, so an entity that holds a third of all rows spreads
over a third of the partitions. A scan then takes three steps:

1. each partition is reduced to a summary of constant size,
2. the driver combines the summaries, in order, to the state before each partition,
3. each partition is scanned again from that state on.

Both passes take a partition batch by batch (``Scan``), so a task holds one batch and a
state, however large its partition. The number of partitions therefore follows the session
(``spark.sql.shuffle.partitions``) and not the rows, and with it what the driver sees and
sends. ``OrderedParts.summaries`` and ``emit``, for scans that have to see a partition
whole, take as many partitions as keep each of them within ``ROWS_PER_PART``.

The sorted rows are checkpointed, as range bounds come from a sample: the second pass,
or a task run again after the loss of an executor, must meet the same partitions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.session import ROWS_PER_PART, checkpoint, width

PART = "_parte"


class Scan:
    """A scan in batches; batches end anywhere, also within an entity.

    The summary of rows is ``(head, state)``: head is what has to be known of their
    beginning, state is what is carried on if nothing comes before them.
    """

    schema: str

    def reduce(self, rows: pd.DataFrame) -> tuple[Any, Any]:
        raise NotImplementedError

    def step(self, state: Any, summary: tuple[Any, Any]) -> Any:
        """The state after rows with this summary; state is None at the very beginning."""
        raise NotImplementedError

    def scan(self, rows: pd.DataFrame, state: Any) -> pd.DataFrame:
        raise NotImplementedError


class OrderedParts:
    """Rows sorted by ``keys`` over all partitions.

    keys must tell rows apart well enough that no single combination of them holds more
    rows than a task can take; callers aggregate repeated rows beforehand. rows: about how
    many there are, for scans that see partitions whole.
    """

    def __init__(self, df: DataFrame, keys: list[str | Column], rows: int | None = None):
        spark = df.sparkSession
        n = max(width(spark), math.ceil((rows or 0) / ROWS_PER_PART))
        cols = [F.col(k) if isinstance(k, str) else k for k in keys]
        ordered = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
        self.df = checkpoint(ordered.withColumn(PART, F.spark_partition_id()))

    @classmethod
    def of(cls, df: DataFrame) -> OrderedParts:
        """Rows that a scan over whole partitions has emitted with their PART, checkpointed."""
        parts = cls.__new__(cls)
        parts.df = df
        return parts

    def run(self, scan: Scan) -> DataFrame:
        """The scan's rows; a partition is never held whole."""

        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, head, state = None, None, None
            for part, rows in _batches(batches):
                own = scan.reduce(rows)
                if part != at:
                    if at is not None:
                        yield _summary(at, (head, state))
                    at, head, state = part, own[0], own[1]
                else:
                    state = scan.step(state, own)
            if at is not None:
                yield _summary(at, (head, state))

        given = self._send(fold(self._collect(self.df.mapInPandas(reduce, "p int, s binary")), scan.step))

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, state = None, None
            for part, rows in _batches(batches):
                if part != at:
                    at, state = part, given(part)
                yield scan.scan(rows, state)
                state = scan.step(state, scan.reduce(rows))

        return self.df.mapInPandas(emit, scan.schema)

    def summaries(self, reduce: Callable[[pd.DataFrame, Any], Any], carries: dict[int, Any] | None = None) -> list[tuple[int, Any]]:
        """(partition, summary) in order; reduce sees a partition whole and must return something of bounded size."""
        given = self._send(carries)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, rows in _by_part(batches):
                yield _summary(part, reduce(rows, given(part)))

        return self._collect(self.df.mapInPandas(run, "p int, s binary"))

    def emit(self, scan: Callable[[pd.DataFrame, Any], pd.DataFrame], schema: str, carries: dict[int, Any] | None = None) -> DataFrame:
        """The scan's rows; scan gets a partition's sorted rows and its carried state or None."""
        given = self._send(carries)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, rows in _by_part(batches):
                yield scan(rows, given(part))

        return self.df.mapInPandas(run, schema)

    def _collect(self, summaries: DataFrame) -> list[tuple[int, Any]]:
        return sorted(((r.p, pickle.loads(r.s)) for r in summaries.collect()), key=lambda x: x[0])

    def _send(self, carries: dict[int, Any] | None) -> Callable[[int], Any]:
        if not carries:
            return lambda part: None
        # each state pickled for itself: a worker unpickles its partition's only
        sent = self.df.sparkSession.sparkContext.broadcast({part: pickle.dumps(x) for part, x in carries.items()})
        return lambda part: pickle.loads(sent.value[part]) if part in sent.value else None


def _summary(part: int, x: Any) -> pd.DataFrame:
    return pd.DataFrame({"p": [part], "s": [pickle.dumps(x)]})


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Batches of one partition each, also where several have come to lie in one task."""
    for batch in batches:
        for part, rows in batch.groupby(PART, sort=True):
            yield int(part), rows.reset_index(drop=True)


def _by_part(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Whole partitions."""
    held: list[pd.DataFrame] = []
    at = None
    for part, rows in _batches(batches):
        if held and part != at:
            yield at, pd.concat(held, ignore_index=True)
            held = []
        at = part
        held.append(rows)
    if held:
        yield at, pd.concat(held, ignore_index=True)


def fold(found: list[tuple[int, Any]], step: Callable[[Any, Any], Any]) -> dict[int, Any]:
    """For each partition the state left by all before it: step(state, summary) -> state."""
    state, out = None, {}
    for part, summary in found:
        out[part] = state
        state = step(state, summary)
    return out

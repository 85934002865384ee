"""Stateful stream operators: exactly-once claims, the delivery queue, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telar.functions import delivery
from telar.streaming import machine

#: The state store that transformWithState needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """Rows of one micro-batch come in no set order."""
    return sorted(rows, key=lambda r: r.llegada)


class _Claims(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("primera", "huella string, llegada long, contestada boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _in_order(rows):
            if not self.first.exists():
                self.first.update((r.huella, r.llegada, r.contestada))
                what, by = "NUEVA", r.llegada
            else:
                huella, by, answered = self.first.get()
                what = "INCOMPLETA" if not answered else "REPETICION" if huella == r.huella else "COLISION"
            yield Row(recurso=key[0], clave=key[1], llegada=r.llegada, resultado=what, primera=by)

    def close(self) -> None:
        pass


def ingest_claims(stream: DataFrame) -> DataFrame:
    """stream: recurso string, clave string, huella string, llegada long, and perhaps contestada boolean. Gives recurso, clave, llegada, resultado, primera.

    The first package of a resource and key is NUEVA; the same content again is a
    REPETICION, answered by the first one's result; other content a COLISION. Where the
    first one never came to an answer (contestada false), later ones are INCOMPLETA,
    whatever their content. A null key or content is a value like any other.
    """
    answered = F.coalesce(F.col("contestada"), F.lit(True)) if "contestada" in stream.columns else F.lit(True)
    own = stream.select("recurso", "clave", "huella", "llegada", answered.alias("contestada"))
    return own.groupBy("recurso", "clave").transformWithState(_Claims(), "recurso string, clave string, llegada long, resultado string, primera long", "Append", "None")


class _Queue(StatefulProcessor):
    def __init__(self, policy: machine.Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("paquete", "estado string, reintentable boolean, intentos int, arriendo long, proximo long, motivo string")

    def _get(self) -> machine.Package:
        return machine.Package(*self.state.get()) if self.state.exists() else machine.Package()

    def _put(self, key, p: machine.Package, what: str, at: int, llegada: int | None) -> Row:
        self.state.update((p.state, p.retryable, p.attempts, p.lease_until, p.next_at, p.reason))
        return Row(id_outbox=key[0], llegada=llegada, t=at, efecto=what, estado=p.state, intentos=p.attempts, proximo=p.next_at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _in_order(rows):
            p = self._get()
            if r.evento == "CAPTURA":
                what = "CAPTURADO"
            elif r.evento == "RECLAMO":
                p, what = machine.claim(p, r.t, self.policy)
                if what == "RECLAMADO":
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.policy.lease_ms)
            elif r.evento == "VENCIMIENTO":
                p, what = machine.lease_expired(p, r.t, self.policy, r.intento)
            else:
                p, what = machine.result(p, r.intento, r.evento, r.t, self.policy)
            if what.endswith("REPROGRAMADO"):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.policy.wait(p.attempts))
            yield self._put(key, p, what, r.t, r.llegada)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        p, what = machine.lease_expired(self._get(), now, self.policy)
        if what != "VIGENTE":
            if what.endswith("REPROGRAMADO"):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.policy.wait(p.attempts))
            yield self._put(key, p, what, now, None)
        elif machine.is_due(p, now):
            yield self._put(key, p, "LISTO", now, None)

    def close(self) -> None:
        pass


def queue_machine(stream: DataFrame, policy: machine.Policy = machine.Policy()) -> DataFrame:
    """stream: id_outbox long, llegada long, t long (ms), evento string, intento int.

    evento is CAPTURA, RECLAMO, VENCIMIENTO or an outcome of the attempt ``intento``. Gives
    each step's effect and the state after it. A timer seals an abandoned attempt, and one at
    the end of a wait says that the package may be sent again (LISTO). VENCIMIENTO may name
    the attempt it is about. A query with timers goes on under ``availableNow`` too: stop it, or feed VENCIMIENTO events.
    """
    out = "id_outbox long, llegada long, t long, efecto string, estado string, intentos int, proximo long"
    return stream.select("id_outbox", "llegada", "t", "evento", "intento").groupBy("id_outbox").transformWithState(_Queue(policy), out, "Append", "ProcessingTime")


class _Limit(StatefulProcessor):
    def __init__(self, budget: int, window_ms: int):
        self.budget, self.window_ms = budget, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("aceptadas", "t array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        accepted = list(self.state.get()[0]) if self.state.exists() else []
        for r in _in_order(rows):
            accepted, ok = machine.admit(accepted, r.t, self.budget, self.window_ms)
            yield Row(origen=key[0], llegada=r.llegada, t=r.t, aceptada=ok)
        self.state.update((accepted,))

    def close(self) -> None:
        pass


class _SharedLimit(StatefulProcessor):
    def __init__(self, budget: int, total: int, window_ms: int):
        self.budget, self.total, self.window_ms = budget, total, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("aceptadas", "origen array<string>, t array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        accepted = list(zip(*self.state.get())) if self.state.exists() else []
        for r in _in_order(rows):
            accepted, ok = machine.admit_shared(accepted, r.origen, r.t, self.budget, self.total, self.window_ms)
            yield Row(origen=r.origen, llegada=r.llegada, t=r.t, aceptada=ok)
        self.state.update(([o for o, _ in accepted], [t for _, t in accepted]))

    def close(self) -> None:
        pass


def rate_limit(stream: DataFrame, budget: int, window_ms: int, total: int | None = None) -> DataFrame:
    """stream: origen string, llegada long, t long (ms). Gives each request and whether it was let in; the state holds at most ``budget`` times.

    total: budget of all origins together. Each request then depends on those of all
    origins before it, so one task sees them all; its state holds at most ``total`` times.
    """
    out = "origen string, llegada long, t long, aceptada boolean"
    if total is None:
        return stream.select("origen", "llegada", "t").groupBy("origen").transformWithState(_Limit(budget, window_ms), out, "Append", "None")
    return stream.select(F.lit(0).alias("todos"), "origen", "llegada", "t").groupBy("todos").transformWithState(_SharedLimit(budget, total, window_ms), out, "Append", "None")


def _open() -> Column:
    """Of packages (estado, reintentable, intentos, arriendo, proximo, motivo), those not settled."""
    return (F.col("estado") != delivery.SENT) & ((F.col("estado") != delivery.FAILED) | F.coalesce("reintentable", F.lit(False)))


def next_wakeup(packages: DataFrame, now: int, pause: int | None = None, policy: machine.Policy = machine.Policy()) -> DataFrame:
    """despertar (ms): the earliest of schedules, lease ends and the pause, which counts only if it holds back a package; null if nothing can change."""
    waiting = _open() & F.col("arriendo").isNull() & (F.col("intentos") < policy.attempts)
    due = waiting & (F.col("proximo").isNull() | (F.col("proximo") <= now))
    instants = [F.min(F.when(waiting & (F.col("proximo") > now), F.col("proximo"))), F.min(F.when(_open(), F.col("arriendo"))), F.when(F.count_if(due) > 0, F.lit(pause).cast("long"))]
    return packages.agg(F.least(*instants).alias("despertar"))


def close_inherited(packages: DataFrame, policy: machine.Policy = machine.Policy()) -> DataFrame:
    """The packages of an older queue under a policy: open ones with all attempts used are closed for review (``machine.inherited_exhaustion``)."""
    used = F.coalesce(_open() & F.col("arriendo").isNull() & (F.col("intentos") >= policy.attempts), F.lit(False))
    to = {"estado": F.lit(delivery.FAILED), "reintentable": F.lit(False), "proximo": F.lit(None), "motivo": F.lit("AGOTAMIENTO_HEREDADO")}
    return packages.withColumns({c: F.when(used, x).otherwise(F.col(c)) for c, x in to.items()})

"""Delivery of queued packages: waits, outcomes and eligibility as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default policy (seconds, seconds, attempts).
BASE_S, CAP_S, ATTEMPTS = 1.0, 60.0, 5
HTTP_TIMEOUT_S = 10.0

PENDING, SENT, FAILED = "PENDIENTE", "ENVIADO", "FALLIDO"
DELIVERED, RETRY, RETRY_AND_STOP, REJECTED = "ENTREGADO", "REINTENTO", "REINTENTO_Y_ALTO", "RECHAZO"


def backoff(attempt: Column, base: float = BASE_S, cap: float = CAP_S) -> Column:
    """Seconds to wait after the k-th attempt: doubled each time up to the cap, without overflow."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(62)).cast("double")))


def lease_seconds(http_timeout: float = HTTP_TIMEOUT_S) -> float:
    """How long an attempt may stay open before it counts as abandoned."""
    return 4 * http_timeout + 30


def outcome(code: Column, coherent: Column) -> Column:
    """What an HTTP answer means; a 201 counts only if it is coherent (``coherent_201``). Of server errors those from 500 to 599 are tried again. No answer is a retry."""
    return (
        F.when(code.isNull(), RETRY)
        .when((code == 201) & coherent, DELIVERED)
        .when(code.isin(401, 403), RETRY_AND_STOP)
        .when(code.between(500, 599), RETRY)
        .otherwise(REJECTED)
    )


def coherent_201(replay: Column, body: Column, sent: Column) -> Column:
    """The five conditions of an answer 201 that confirms a package of so many readings, as one flag.

    The header says whether it is a replay (``true`` or ``false``); the body can be read and
    has its fields; it names as many readings as it says it made; and these are as many as were sent.
    """
    made = F.get_json_object(body, "$.lecturas_creadas").try_cast("int")
    named = F.json_array_length(F.get_json_object(body, "$.ids_lectura"))
    read = F.get_json_object(body, "$.id_sesion").try_cast("int").isNotNull() & made.isNotNull() & named.isNotNull()
    return F.coalesce(replay.isin("true", "false") & read & (named == made) & (made == sent), F.lit(False))


def payload_size(payload: Column) -> Column:
    """Number of readings of a package; null if it can't be read."""
    return F.json_array_length(F.get_json_object(payload, "$.lecturas"))


def terminal(state: Column, retryable: Column) -> Column:
    return (state == SENT) | ((state == FAILED) & ~F.coalesce(retryable, F.lit(False)))


def eligible(state: Column, retryable: Column, attempts: Column, limit: Column, next_at: Column, now: Column, open_attempt: Column, scheduled: bool = True) -> Column:
    """Not terminal, attempts left, no attempt open, and its schedule due; the schedule is not looked at when a person asks (``scheduled`` false)."""
    may = ~terminal(state, retryable) & (attempts < limit) & ~F.coalesce(open_attempt, F.lit(False))
    return may & (next_at.isNull() | (next_at <= now)) if scheduled else may

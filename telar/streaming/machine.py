"""Transitions of one queued package and of one rate limit, as pure functions.

Spark calls them with keyed state (``telar.streaming.processors``); tests call them alone.
All times are milliseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from telar.functions.delivery import ATTEMPTS, BASE_S, CAP_S, DELIVERED, FAILED, HTTP_TIMEOUT_S, PENDING, REJECTED, RETRY, RETRY_AND_STOP, SENT, lease_seconds


@dataclass(frozen=True)
class Policy:
    base_ms: int = int(BASE_S * 1000)
    cap_ms: int = int(CAP_S * 1000)
    attempts: int = ATTEMPTS
    lease_ms: int = int(lease_seconds(HTTP_TIMEOUT_S) * 1000)

    def wait(self, attempt: int) -> int:
        return min(self.cap_ms, self.base_ms * 2 ** min(attempt - 1, 40))


@dataclass(frozen=True)
class Package:
    state: str = PENDING
    retryable: bool | None = None
    attempts: int = 0
    #: End of the open attempt's lease; None without an open attempt.
    lease_until: int | None = None
    next_at: int | None = None
    reason: str | None = None


def is_terminal(p: Package) -> bool:
    return p.state == SENT or (p.state == FAILED and not p.retryable)


def claim(p: Package, now: int, policy: Policy = Policy()) -> tuple[Package, str]:
    """Opens an attempt: RECLAMADO, or why not."""
    if is_terminal(p):
        return p, "TERMINAL"
    if p.lease_until is not None:
        return p, "ARRENDADO"
    if p.attempts >= policy.attempts:
        return p, "AGOTADO"
    if p.next_at is not None and p.next_at > now:
        return p, "AUN_NO"
    return replace(p, attempts=p.attempts + 1, lease_until=now + policy.lease_ms, next_at=None), "RECLAMADO"


def _after_failure(p: Package, now: int, policy: Policy, scheduled: bool) -> tuple[Package, str]:
    if p.attempts >= policy.attempts:
        return replace(p, state=FAILED, retryable=False, lease_until=None, next_at=None, reason="AGOTADO"), "AGOTADO"
    return replace(p, state=FAILED, retryable=True, lease_until=None, next_at=now + policy.wait(p.attempts) if scheduled else None), "REPROGRAMADO" if scheduled else "SIN_PROGRAMAR"


def result(p: Package, attempt: int, outcome: str, now: int, policy: Policy = Policy()) -> tuple[Package, str]:
    """The answer to an attempt. One that comes after its attempt was sealed counts only if it is a delivery."""
    if attempt < 1 or attempt > p.attempts:
        return p, "DESCONOCIDO"
    if attempt != p.attempts or p.lease_until is None:
        if outcome != DELIVERED or p.state == SENT:
            return p, "TARDIO"
        # an attempt that is open meanwhile stays so until its own answer or its end
        return replace(p, state=SENT, retryable=None, next_at=None, reason=None), "ENTREGADO_TARDE"
    if p.state == SENT:
        return replace(p, lease_until=None), "YA_ENTREGADO"
    if outcome == DELIVERED:
        return replace(p, state=SENT, retryable=None, lease_until=None, next_at=None), "ENTREGADO"
    if outcome == REJECTED:
        return replace(p, state=FAILED, retryable=False, lease_until=None, next_at=None, reason="RECHAZO"), "RECHAZADO"
    if outcome in (RETRY, RETRY_AND_STOP):
        return _after_failure(p, now, policy, outcome == RETRY)
    raise ValueError(f"no outcome {outcome}")


def lease_expired(p: Package, now: int, policy: Policy = Policy(), attempt: int | None = None) -> tuple[Package, str]:
    """Seals an abandoned attempt, if the lease is still the one that ran out.

    The package itself changes only if nothing else has settled it: not if it was delivered
    or closed meanwhile, nor if ``attempt``, the one that is said to be abandoned, is not its
    last. Otherwise the next attempt is scheduled, or the package is exhausted.
    """
    if attempt is not None and attempt != p.attempts:
        return p, "ABANDONADO_SUPERADO"
    if p.lease_until is None or p.lease_until > now:
        return p, "VIGENTE"
    if p.state == SENT:
        return replace(p, lease_until=None), "ABANDONADO_YA_ENTREGADO"
    if is_terminal(p):
        return replace(p, lease_until=None), "ABANDONADO_CERRADO"
    p, what = _after_failure(p, now, policy, True)
    return p, "ABANDONADO_" + what


def is_due(p: Package, now: int) -> bool:
    """Whether a scheduled retry may be sent."""
    return p.state == FAILED and bool(p.retryable) and p.lease_until is None and p.next_at is not None and p.next_at <= now


def inherited_exhaustion(p: Package, policy: Policy = Policy()) -> Package:
    """Packages of an older queue with all attempts used are closed for review."""
    if not is_terminal(p) and p.lease_until is None and p.attempts >= policy.attempts:
        return replace(p, state=FAILED, retryable=False, next_at=None, reason="AGOTAMIENTO_HEREDADO")
    return p


def admit(accepted: list[int], now: int, budget: int, window_ms: int) -> tuple[list[int], bool]:
    """Sliding window: whether a request is let in. Refused requests are not recorded."""
    live = [t for t in accepted if t > now - window_ms]
    return (live, False) if len(live) >= budget else ([*live, now], True)


def admit_shared(accepted: list[tuple[str | None, int]], origin: str | None, now: int, budget: int, total: int, window_ms: int) -> tuple[list[tuple[str | None, int]], bool]:
    """Sliding window with a budget per origin and one for all of them. Refused requests spend neither."""
    live = [(o, t) for o, t in accepted if t > now - window_ms]
    if sum(o == origin for o, _ in live) >= budget or len(live) >= total:
        return live, False
    return [*live, (origin, now)], True

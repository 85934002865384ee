"""Names, addresses, keys and canonical forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of an idempotency key.
KEY_FORM = "^[A-Za-z0-9_-]{8,128}$"
EMAIL_FORM = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# The form of an address that registers itself, in lower case, and of a day.
REGISTRATION_EMAIL_FORM = r"^paciente[0-9]{2,}@example\.com$"
DATE_FORM = r"^\d{4}-\d{2}-\d{2}$"


def full_name(*parts: Column) -> Column:
    """The parts that are not empty, joined by one space and otherwise as they are; null if none is."""
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.nullif(joined, F.lit(""))


def canonical_email(email: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.regexp_replace(email, r"^\s+|\s+$", ""))


def valid_key(key: Column) -> Column:
    """Whether a text has the form of an idempotency key; false for null."""
    return F.coalesce(key.rlike(KEY_FORM) & ~key.contains("\n"), F.lit(False))


def valid_date(text: Column) -> Column:
    """The day of an ISO date of the full form, null for any other text."""
    return F.when(text.rlike(DATE_FORM), F.try_to_date(text, "yyyy-MM-dd"))


def finite(text: Column) -> Column:
    """A number that is one: null for null, blanks, NaN and infinity; 0 stays."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def redact_urls(text: Column) -> Column:
    """URLs with credentials, host and path taken out."""
    return F.regexp_replace(text, r"[A-Za-z][A-Za-z0-9+.-]*://[^\s'\"]+", "<url>")


def hundredths(x: Column) -> Column:
    """Two-decimal text of a decimal; minus zero is zero; ``null`` for null."""
    d = x.cast("decimal(20,2)")
    return F.coalesce(F.when(d == 0, "0.00").otherwise(d.cast("string")), F.lit("null"))


def utc_instant(ts: Column) -> Column:
    """ISO text in UTC; the fraction only where there is one, always six digits; ``null`` for null."""
    us = F.unix_micros(ts)
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    part = F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit("+00:00")), F.lit("null"))


def canonical_object(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and compact separators from the fields' JSON texts."""
    parts: list[Column] = []
    for i, k in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{k}":'), fields[k]]
    return F.concat(*parts, F.lit("}"))


def fingerprint(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def short_key(key: Column) -> Column:
    """First twelve hex digits of the key's hash, for logs."""
    return F.substring(F.sha2(key, 256), 1, 12)


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**40)) / F.lit(float(2**40))
